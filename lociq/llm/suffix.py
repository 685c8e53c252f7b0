r"""Exact removal of repeated byte strings by a distributed, prefix-aware suffix merge sort.

A byte goes if a string of WINDOW bytes that covers it also starts earlier
(smaller doc_id, or the same document and an earlier start); matches stay
inside documents and are judged on the input.

Which suffixes are sorted.  In each text the positions are marked where a
hash of GRAM bytes is the least of any window of WINDOW bytes that holds it.
The mark depends on the window's bytes only, so equal windows have their marks
at equal places: every repeated window shows as two marked suffixes that share
GRAM bytes or more, and sorting the marked suffixes (about one position in 35)
finds all of them.

0. A text that also stands under a smaller doc_id loses all its bytes if it has
   WINDOW of them; only the first of equal texts goes on, as long as the list of
   the others is small enough to be sent to every task (it saves work only: the
   steps below find the same).
1. Marks are sent to reducers as blocks of hashes; a mark whose hash occurs
   once has no twin and is done with.
2. Texts meet their remaining marks.  Each task sorts its suffixes (WINDOW
   bytes from the mark) and writes runs, one for each group, front-coded:
   the count of bytes shared with the suffix before, then the rest.  A run also
   carries the bytes to the left of each mark.  Of marks with the same bytes
   around them only a run's first is in it; the others' spans are known there.
3. A reducer merges its runs with a loser tree whose nodes remember how many
   bytes each loser shares with the winner that beat it; bytes known to be
   shared are never compared again, and the merge hands out the common prefix
   of each suffix with the one before it.
4. In a group of suffixes that share GRAM bytes, the common prefixes cut the
   order into classes at every length; with the classes of the bytes to the
   left they say, for each place of a window around the mark, which windows are
   equal.  The first of each class stays, the others give their bytes.

Groups are chosen by the hash, so that equal suffixes meet, and are as many as
the texts' bytes ask for; a task sorts its groups and holds one at a time.
Hashes only choose: what is equal is decided by bytes (classes are numbered, not
hashed; marks folded for equal surroundings are compared with the first), and
equal texts by md5.  A passage that very many documents share comes to its
reducer once from each task.

Null text: empty.  Texts shorter than WINDOW lose nothing.  Equal rows are one
document (its first copy stays in each); rows of one doc_id with different
texts are told apart by a hash of the text.  A null doc_id sorts as the smallest.  An empty table gives
an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm._common import BROADCAST_BYTES, Scratch, join_back, table
from lociq.llm._text import U, mix, pieces, powers, prefix_hashes

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1  # marks a window can choose from
LEFT = WINDOW - GRAM  # bytes to the left that a window can reach
#: Texts that go to Python at a time where each mark becomes an object there.
TEXTS = 2048
#: Bytes of text whose marks make a group.
GROUP_BYTES = 512 << 20
#: Most tasks that groups are dealt over; a task has its groups one after the other.
MOST_TASKS = 20_000
_FOLD = U(0xD6E8FEB86659FD93)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of width values."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


def marks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marked positions and their hashes; off parts the texts."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = prefix_hashes(data)
    _, down = powers(n)
    grams = mix((h[GRAM:] - h[:-GRAM]) * down[: n - GRAM + 1]) | U(1)
    least = _slide(grams, SPAN, np.minimum)  # of the window that starts at each position
    room = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    least[room[: len(least)] < WINDOW] = 0
    padded = np.concatenate([np.zeros(SPAN - 1, U), least, np.zeros(SPAN - 1, U)])
    best = _slide(padded, SPAN, np.maximum)[: len(grams)]
    at = np.flatnonzero(best == grams)
    return at, grams[at]


def _groups(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> U(16)) % U(n)).astype(np.int64)


def _mark_blocks(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found: list[list] = [[], [], []]
            for rows, data, off in pieces(b.column(2)):
                at, h = marks(data, off)
                doc = np.searchsorted(off, at, side="right") - 1
                for part, x in zip(found, (h, doc + rows.start, at - off[doc]), strict=True):
                    part.append(x)
            h, doc, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
            order = np.argsort(_groups(h.astype(U), n), kind="stable")
            h, doc, pos = h[order].astype(U), doc[order], pos[order]
            cut = np.searchsorted(_groups(h, n), np.arange(n + 1))
            out = []
            for g in range(n):
                part = slice(cut[g], cut[g + 1])
                if cut[g] < cut[g + 1]:
                    used, local = np.unique(doc[part], return_inverse=True)
                    out.append((g, ids[used].tobytes(), keys[used].tobytes(), local.astype(np.uint32).tobytes(), pos[part].astype(np.uint32).tobytes(), (h[part] >> U(32)).astype(np.uint32).tobytes()))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["grp", "ids", "keys", "doc", "pos", "hash"])

    return run


ROUTED = "grp int, ids binary, keys binary, x binary, y binary"


def _route(n: int, ids: np.ndarray, keys: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Values of documents -> one block for each group of documents, by a hash of the id."""
    to = _groups(mix(ids.astype(U)), n)
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(n + 1))
    some = np.flatnonzero(np.diff(cut))
    parts = [[v[order[cut[g] : cut[g + 1]]].tobytes() for g in some] for v in (ids, keys, x.astype(np.uint32), y.astype(np.uint32))]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], names=["grp", "ids", "keys", "x", "y"])


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each group in turn; rows come sorted by their group."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole groups -> (doc_id, text_key, spans): the spans x, y of each document joined."""
    for rows in by_group(batches):
        ids, keys, x, y = (np.concatenate([np.frombuffer(v, kind) for v in part]) for part, kind in zip(list(zip(*rows, strict=True))[1:], (np.int64, np.int64, np.uint32, np.uint32), strict=True))
        order = np.lexsort((x, keys, ids))
        ids, keys, x, y = ids[order], keys[order], x[order].astype(np.int64), y[order].astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))
        ends = np.append(cut[1:], len(ids))
        for at in range(0, len(cut), 4096):
            part = slice(at, at + 4096)
            blobs = [join_spans(x[i:j], y[i:j]).astype(np.uint32).tobytes() for i, j in zip(cut[part], ends[part], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[cut[part]]), pa.array(keys[cut[part]]), pa.array(blobs, pa.binary())], names=["doc_id", "text_key", "spans"])


def _with_twins(n: int):
    """Blocks of whole groups -> the marks whose hash occurs again, on their way to their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches):
            held: list[list] = [[], [], [], []]
            for _, ids, keys, doc, pos, h in rows:
                local = np.frombuffer(doc, np.uint32)
                for part, x in zip(held, (np.frombuffer(ids, np.int64)[local], np.frombuffer(keys, np.int64)[local], np.frombuffer(pos, np.uint32), np.frombuffer(h, np.uint32)), strict=True):
                    part.append(x)
            ids, keys, pos, h = (np.concatenate(x) for x in held)
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            twin = np.zeros(len(h), bool)
            twin[order[1:]] |= same
            twin[order[:-1]] |= same
            if twin.any():
                yield _route(n, ids[twin], keys[twin], pos[twin], pos[twin])

    return run


def front_code(suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Sorted suffixes -> bytes shared with the one before, lengths, and the rests joined."""
    shared, rests, before = bytearray(), [], b""
    for s in suffixes:
        k = 0
        if s == before:
            k = len(s)
        else:
            lo, hi = 0, min(len(s), len(before))
            while lo < hi:  # the longest common prefix, by halves
                mid = (lo + hi + 1) // 2
                if s[lo:mid] == before[lo:mid]:
                    lo = mid
                else:
                    hi = mid - 1
            k = lo
        shared.append(k)
        rests.append(s[k:])
        before = s
    return bytes(shared), bytes(map(len, suffixes)), b"".join(rests)


def _runs(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = (b.column(k).to_pylist() for k in (0, 1))
            groups: dict[int, list] = {}
            for k, (text, at) in enumerate(zip(b.column(2), b.column(3).to_pylist(), strict=True)):
                data = (text.as_py() or "").encode()
                pos = np.unique(np.frombuffer(at, np.uint32)).astype(np.int64)
                h = prefix_hashes(np.frombuffer(data, np.uint8)) if len(data) < 1 << 24 else None
                g = _gram_groups(data, pos, h, n)
                for p, grp in zip(pos.tolist(), g.tolist(), strict=True):
                    groups.setdefault(grp, []).append((data[p : p + WINDOW], data[max(0, p - LEFT) : p], k, p))
            out = []
            for grp, rows in groups.items():
                rows.sort(key=lambda r: (r[0], r[1], ids[r[2]], keys[r[2]], r[3]))
                firsts, again = [], []
                for r in rows:  # repeated rows of a document are the document itself
                    if not firsts or r[:2] != firsts[-1][:2]:
                        firsts.append(r)
                    elif len(r[1]) >= WINDOW - len(r[0]) and (ids[r[2]], keys[r[2]], r[3]) != (ids[firsts[-1][2]], keys[firsts[-1][2]], firsts[-1][3]):
                        again.append(r)
                if again:
                    known = [(pos - len(left), pos + len(suffix)) for suffix, left, _, pos in again]
                    x, y = (np.array(v, np.uint32).tobytes() for v in zip(*known, strict=True))
                    out.append((grp, None, x, y, None, None, np.array([ids[r[2]] for r in again], np.int64).tobytes(), np.array([keys[r[2]] for r in again], np.int64).tobytes(), None))
                rows = firsts
                shared, sizes, rests = front_code([r[0] for r in rows])
                left = np.zeros((len(rows), LEFT), np.uint8)
                for i, r in enumerate(rows):
                    if r[1]:
                        left[i, : len(r[1])] = np.frombuffer(r[1], np.uint8)[::-1]
                out.append((grp, shared, sizes, _packed(rests), bytes(len(r[1]) for r in rows), _packed(left.T.tobytes()), np.array([ids[r[2]] for r in rows], np.int64).tobytes(), np.array([keys[r[2]] for r in rows], np.int64).tobytes(), np.array([r[3] for r in rows], np.uint32).tobytes()))
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["grp", *RUN_FIELDS])

    return run


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


RUN_FIELDS = ("shared", "sizes", "rests", "left_sizes", "lefts", "ids", "keys", "pos")


def _gram_groups(data: bytes, pos: np.ndarray, h: np.ndarray | None, n: int) -> np.ndarray:
    if h is None:
        h = prefix_hashes(np.frombuffer(data, np.uint8))
    _, down = powers(len(data))
    return _groups(mix((h[pos + GRAM] - h[pos]) * down[pos]) | U(1), n)


def merge_runs(runs: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[int, int, bytes, int]]:
    """Front-coded runs -> (run, index in it, suffix, bytes shared with the suffix before), in order.

    The loser tree keeps, for each run's head, the bytes it shares with the
    last winner on its path.  Of two heads the one that shares more with the
    last winner is the smaller and no byte is looked at; if they share equally
    many, comparison starts behind those.
    """
    k = len(runs)
    width = 1
    while width < k:
        width *= 2
    head: list = [None] * width
    known = [0] * width  # bytes shared with the last winner
    index = [-1] * width
    offset = [0] * width

    def advance(r: int) -> None:
        """The next suffix of a run; the last winner is the one before it."""
        i = index[r] = index[r] + 1
        shared, sizes, rests = runs[r]
        if i == len(sizes):
            head[r] = None
            return
        c, n = shared[i], sizes[i]
        at = offset[r]
        head[r] = (head[r][:c] if c else b"") + rests[at : at + n - c]
        offset[r] = at + n - c
        known[r] = c

    for r in range(k):
        advance(r)
        known[r] = 0

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known becomes what it shares with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)  # the loser shares as much with the winner as with the one before
        if x == y:
            known[b] = len(y)
            return a, b
        lo, hi = ka, min(len(x), len(y))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if x[lo:mid] == y[lo:mid]:
                lo = mid
            else:
                hi = mid - 1
        if x[lo:] < y[lo:]:
            known[b] = lo
            return a, b
        known[a] = lo
        return b, a

    losers = [0] * width

    def build(node: int) -> int:
        if node >= width:
            return node - width
        a, b = build(2 * node), build(2 * node + 1)
        won, losers[node] = play(a, b)
        return won

    top = build(1) if width > 1 else 0
    shared = 0
    while head[top] is not None:
        yield top, index[top], head[top], shared
        advance(top)
        node, won = (top + width) // 2, top
        while node:
            won, losers[node] = play(won, losers[node])
            node //= 2
        top, shared = won, known[won]


def covered(lcp: np.ndarray, size: np.ndarray, left_size: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """covered[i, d]: the window that starts d bytes before mark i also starts earlier.

    Suffixes are in sorted order, lcp with the one before, left holds the bytes
    to the left backwards (a row per distance), order the place in the corpus.
    """
    m = len(lcp)
    out = np.zeros((m, LEFT + 1), bool)
    back = np.zeros(m, np.int64)
    by_place = np.argsort(order, kind="stable")
    for d in range(LEFT + 1):
        if d:
            back = np.unique(back * 257 + left[d - 1] + 1, return_inverse=True)[1]
        live = by_place[(left_size[by_place] >= d) & (size[by_place] >= WINDOW - d)]
        if len(live) < 2:
            continue
        right = np.cumsum(lcp < WINDOW - d)
        key = back[live] * (right[-1] + 1) + right[live]
        first = np.unique(key, return_index=True)[1]
        again = np.ones(len(live), bool)
        again[first] = False
        out[live[again], d] = True
    return out


def _merge(n: int):
    return lambda batches: _merged(batches, n)


def _merged(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole groups -> the covered spans (start, end), on their way to their documents."""
    for rows in by_group(batches):
        done = [r for r in rows if r[1] is None]
        if done:
            yield _route(n, *(np.concatenate([np.frombuffer(r[k], kind) for r in done]) for k, kind in ((6, np.int64), (7, np.int64), (2, np.uint32), (3, np.uint32))))
        runs = [list(r[1:]) for r in rows if r[1] is not None]
        if not runs:
            continue
        for r in runs:
            r[2], r[4] = _unpacked(r[2]), _unpacked(r[4])
        base = np.cumsum([0, *(len(r[1]) for r in runs)])
        where, lcp, size = [], [], []
        for r, i, s, shared in merge_runs([tuple(r[:3]) for r in runs]):
            where.append(base[r] + i)
            lcp.append(shared)
            size.append(len(s))
        where, lcp, size = np.array(where), np.array(lcp), np.array(size)
        left_size = np.concatenate([np.frombuffer(r[3], np.uint8) for r in runs])[where].astype(np.int64)
        left = np.concatenate([np.frombuffer(r[4], np.uint8).reshape(LEFT, -1) for r in runs], axis=1)[:, where]
        ids, keys = (np.concatenate([np.frombuffer(r[k], np.int64) for r in runs])[where] for k in (5, 6))
        pos = np.concatenate([np.frombuffer(r[7], np.uint32) for r in runs])[where].astype(np.int64)
        order = np.lexsort((pos, keys, ids))
        again = (ids[order][1:] == ids[order][:-1]) & (keys[order][1:] == keys[order][:-1]) & (pos[order][1:] == pos[order][:-1])
        if again.any():  # marks of repeated rows: one document
            one = np.ones(len(pos), bool)
            one[order[1:][again]] = False
            lcp, size, left_size, left, ids, keys, pos = _lcp_of(lcp, one), size[one], left_size[one], left[:, one], ids[one], keys[one], pos[one]
            order = np.lexsort((pos, keys, ids))
        place = np.empty(len(pos), np.int64)
        place[order] = np.arange(len(pos))

        # a mark with the same bytes around it as an earlier one: folded into the first
        around = np.zeros(len(pos), U)
        for d in range(LEFT):
            around = mix(around * _FOLD + left[d].astype(U) + U(1))
        twin = (lcp == size) & (np.concatenate([[0], size[:-1]]) == size)
        same = mix(mix(around * _FOLD + left_size.astype(U)) * _FOLD + np.cumsum(~twin).astype(U))
        by_place = np.argsort(place)
        first = np.zeros(len(pos), bool)
        _, leads, of = np.unique(same[by_place], return_index=True, return_inverse=True)
        lead = np.empty(len(pos), np.int64)
        lead[by_place] = by_place[leads][of]
        suffix = np.cumsum(~twin)
        first[lead] = True
        first |= (left != left[:, lead]).any(0) | (left_size != left_size[lead]) | (suffix != suffix[lead])  # only the hashes were equal
        low = np.where(first, -1, np.maximum(0, WINDOW - size))  # first and last place covered, of a folded mark
        high = np.where(first, -1, left_size)
        spans = [np.stack([ids, keys, pos - high, pos - low + WINDOW], 1)[~first & (high >= low)]]

        # of the first ones, only those with company at GRAM bytes
        lcp_first = _lcp_of(lcp, first)
        keep = np.flatnonzero(first)
        with_next = np.append(lcp_first[1:] >= GRAM, False)
        some = (lcp_first >= GRAM) | with_next
        sub = keep[some]
        sub_lcp = np.where(lcp_first[some] >= GRAM, lcp_first[some], 0)
        if len(sub):
            hit = covered(sub_lcp, size[sub], left_size[sub], left[:, sub], place[sub])
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            i, d0 = np.nonzero(edge == 1)
            _, d1 = np.nonzero(edge == -1)
            at = sub[i]
            spans.append(np.stack([ids[at], keys[at], pos[at] - (d1 - 1), pos[at] - d0 + WINDOW], 1))
        rows = np.concatenate(spans)
        if not len(rows):
            continue
        yield _route(n, *rows.T)


def _lcp_of(lcp: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Common prefixes between neighbours once only the kept suffixes remain."""
    at = np.flatnonzero(keep)
    if not len(at):
        return lcp[:0]
    out = np.minimum.reduceat(lcp, np.concatenate([[0], at[:-1] + 1])) if len(at) > 1 else lcp[:1].copy()
    if at[-1] + 1 < len(lcp):  # what follows the last kept one belongs to none
        out[-1] = lcp[(at[-2] + 1 if len(at) > 1 else 0) : at[-1] + 1].min()
    out[0] = 0
    return out


def join_spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sorted spans -> maximal runs as start, end, start, end, ..."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([start[at], reach[np.append(at[1:], len(start)) - 1]], 1).ravel()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for d, text, spans, whole in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            runs = [(0, len(data))] if whole else np.frombuffer(spans or b"", np.uint32).reshape(-1, 2).tolist()
            kept, at = [], 0
            for i, j in runs:
                kept.append(data[at:i])
                at = j
            left = b"".join([*kept, data[at:]])
            rows.append((d, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def later_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key) of texts of WINDOW bytes or more that also stand under a smaller doc_id; saved."""
    known = scratch.save(docs.where(F.octet_length("text") >= WINDOW).select("doc_id", "text_key", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")))
    first = scratch.save(known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first <> last").drop("last"))
    return scratch.save(join_back(known, "digest", first).where("doc_id <> first").select("doc_id", "text_key").distinct())


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, spans) of each document that loses bytes."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES))
    grouped = lambda df: df.repartition(min(n, max(parts, MOST_TASKS)), "grp").sortWithinPartitions("grp")
    gathered = "doc_id long, text_key long, spans binary"
    blocks = docs.mapInArrow(_mark_blocks(n), "grp int, ids binary, keys binary, doc binary, pos binary, hash binary")
    twins = scratch.save(grouped(grouped(blocks).mapInArrow(_with_twins(n), ROUTED)).mapInArrow(_gather, gathered))
    near = docs.join(twins.hint("merge"), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spans")
    runs = near.mapInArrow(_runs(n), "grp int, " + ", ".join(f"{x} binary" for x in RUN_FIELDS))
    return scratch.save(grouped(grouped(runs).mapInArrow(_merge(n), ROUTED)).mapInArrow(_gather, gathered), TEXTS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select(known.alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    later, keys = later_copies(docs, scratch), ["doc_id", "text_key"]
    if later.count() * 16 > BROADCAST_BYTES:
        later = later.where("false")
    spans = repeated_spans(docs.join(F.broadcast(later), keys, "left_anti"), scratch)
    lost = scratch.save(spans.withColumn("whole", F.lit(False)).unionByName(later.select(*keys, F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("whole"))))
    both = docs.join(lost.hint("merge"), keys, "left").select("doc_id", "text", "spans", "whole")
    out = both.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
#: Every window by its md5; texts as hexadecimal digits, cut into pieces so that no text is walked again for each window.
SQL = {
    "op10_suffix_array_dedup": f"""
WITH t AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, n, k, substr(h, 2 * k + 1, {2 * (2048 + WINDOW)}) AS p FROM (SELECT *, unnest(range(0, n, 2048)) AS k FROM t)),
w AS (SELECT doc_id, k + j AS place, md5_number(substr(p, 2 * j + 1, {2 * WINDOW})) AS s FROM (SELECT *, unnest(range(0, least(2048, n - {WINDOW} - k + 1))) AS j FROM c)),
e AS (SELECT doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, place) AS r FROM w) WHERE r > 1),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM (SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + {WINDOW} THEN 0 ELSE 1 END AS new FROM e)),
r AS (SELECT doc_id, run, min(place) AS low, max(place) + {WINDOW} AS high FROM i GROUP BY doc_id, run),
o AS (SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS begin FROM (SELECT doc_id, low, high FROM r UNION ALL SELECT doc_id, n, n FROM t)),
kept AS (SELECT o.doc_id, string_agg(substr(h, 2 * begin + 1, 2 * (low - begin)), '' ORDER BY low, begin) AS h FROM o JOIN t USING (doc_id) GROUP BY o.doc_id),
lost AS (SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
""",
}
