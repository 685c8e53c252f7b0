"""Benchmark decontamination by SimHash over item-sized windows.

Texts are words (lower case, parted by ASCII white space) and their 5-word
shingles; an item of fewer words is one shingle of its own length.  A document
holds an item if a window of as many words as the item has a weighted Jaccard
similarity of at least 0.75 with it; a shingle weighs as often as it occurs.
A text with fewer words than the item is one window, the whole of it.

1. Every window of every size that an item has gets a 64-bit SimHash, by rolling
   counts: with the running count of each bit over a text's shingles, a window's
   count is one subtraction, and the 64 counts of a window lie side by side.
2. Four blocks of sixteen bits index the items of a size: a table names, for each
   value of a block, the items that lie within five bits of it there.  By the
   pigeonhole principle every item within RADIUS = 23 bits of a window is named by
   some block.  An item named is kept if its whole fingerprint lies within the
   radius.  Nothing else proposes windows.
3. Kept pairs are verified: by the count of the window's shingles that are any
   item's, which bounds the similarity, then by the exact weighted similarity.

At similarity 0.75 the fingerprints differ in 11 bits on average, with a
standard deviation of 3; the radius lies four deviations above.

One pass over the texts finds all, without a shuffle; memory does not grow with
a text beyond its own words.  Items go to the executors ITEMS at a time, in the
order of their size, so a larger benchmark takes more passes and no more memory.

This is not the native form: the SimHash of every item-sized window as Spark
expressions took 23,000 CPU seconds a GB of text for one size of 43.

Null or blank texts and items hold nothing and match nothing.  Repeated
documents give a row each only if their doc_id differ; repeated items match
each under their item_id.  Null ids are left out.  Empty tables give empty
results; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lociq.llm._common import Scratch, table
from lociq.llm._text import _MULTIPLIERS, SHINGLE, U, mix, pieces, words

SIMILARITY = 0.75
BLOCKS, BLOCK_RADIUS = 4, 5
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Items sent to the executors at a time, about.
ITEMS = 4096
#: Items that share an index; windows looked at together.
GROUP, WINDOWS = 16, 8192
_MEMBER_BITS = 20


def grams(w: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of size words, from the words' hashes."""
    n = max(0, len(w) - size + 1)
    out = np.full(n, U(size))
    for k in range(size):
        out += w[k : n + k] * _MULTIPLIERS[k]
    return mix(out)


def bits(h: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash, a row each."""
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(counts: np.ndarray, of) -> np.ndarray:
    """Fingerprints: the bits that more than half of `of` shingles have."""
    return np.packbits((counts > of).ravel(), bitorder="little").view(U)


def needed(a, b):
    """Shingles that sets of sizes a and b must share: both / (a + b - both) >= 3/4."""
    return -(-3 * (a + b) // 7)


class Group:
    """At most GROUP items of one size: fingerprints, tables of the blocks, shingles with their weights."""

    def __init__(self, n: int, of: list[int], sets: list[np.ndarray]):
        self.n, self.of = n, of
        self.size = min(n, SHINGLE)
        self.m = n - self.size + 1
        self.weighted = [np.unique(h, return_counts=True) for h in sets]
        self.prints = np.array([majority(bits(h).sum(0), len(h) // 2)[0] for h in sets], U)
        kind = np.uint8 if len(of) <= 8 else np.uint16
        values = np.arange(1 << 16, dtype=np.uint16)
        self.tables = [np.zeros(1 << 16, kind) for _ in range(BLOCKS)]  # of each block, the items named by each of its values
        for j, blocks in enumerate(self.prints.view(np.uint16).reshape(-1, BLOCKS)):
            for k, block in enumerate(blocks):
                self.tables[k] |= (np.bitwise_count(values ^ block) <= BLOCK_RADIUS).astype(kind) << kind(j)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of fingerprints and the items named for them that lie within the radius."""
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        named = self.tables[0].take(blocks[:, 0], mode="wrap")
        for k in range(1, BLOCKS):
            named |= self.tables[k].take(blocks[:, k], mode="wrap")
        j, at = np.divmod(np.flatnonzero(np.bitwise_count(self.prints[:, None] ^ prints) <= RADIUS), len(prints))
        kept = (named[at] >> j.astype(named.dtype)) & 1 == 1
        return at[kept], j[kept]

    def similarity(self, j: int, window: np.ndarray) -> float:
        shingle, weight = self.weighted[j]
        at = np.minimum(np.searchsorted(shingle, window), len(shingle) - 1)
        both = int(np.minimum(np.bincount(at[shingle[at] == window], minlength=len(shingle)), weight).sum())
        return both / (len(window) + self.m - both)


class Index:
    """All items of one pass, in groups of one size."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        by_size: dict[int, list] = {}
        for rows, data, off in pieces(pa.array([t for _, t in items], pa.large_string())):
            w, at = words(data, off)
            for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if j > i:
                    by_size.setdefault(int(j - i), []).append((rows.start + k, grams(w[i:j], min(int(j - i), SHINGLE))))
        self.groups = [Group(n, [i for i, _ in part], [h for _, h in part]) for n, held in sorted(by_size.items()) for part in (held[x : x + GROUP] for x in range(0, len(held), GROUP))]
        self.member = np.zeros(1 << _MEMBER_BITS, bool)
        for g in self.groups:
            for h, _ in g.weighted:
                self.member[h >> U(64 - _MEMBER_BITS)] = True
        most = max((g.m for g in self.groups), default=0)
        self.longest = max((g.n for g in self.groups), default=0)
        self.counts = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32

    def find(self, w: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """(text, item) -> (similarity, -start) of the best window; at: where each text's words begin, and the end."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        room = at[1:][doc] - np.arange(len(w))
        runs = {size: grams(w, size) for size in {g.size for g in self.groups}}
        held = {size: np.concatenate([[0], np.cumsum(self.member[h >> U(64 - _MEMBER_BITS)])]) for size, h in runs.items()}

        def verify(g: Group, starts: np.ndarray, items: np.ndarray, m: np.ndarray | int) -> None:
            h, inside = runs[g.size], held[g.size]
            some = inside[starts + m] - inside[starts] >= needed(m, g.m)
            if not some.any():
                return
            for s, j, k in zip(starts[some].tolist(), items[some].tolist(), np.broadcast_to(m, len(starts))[some].tolist(), strict=True):
                score = g.similarity(j, h[s : s + k])
                if score >= SIMILARITY:
                    key, found = (int(doc[s]), g.of[j]), (score, int(at[doc[s]]) - s)
                    if key not in best or found > best[key]:
                        best[key] = found

        for low in range(0, len(w), max(WINDOWS, 4 * self.longest)):
            high = min(len(w), low + max(WINDOWS, 4 * self.longest))
            top = min(len(w), high + self.longest)
            five = runs[SHINGLE][low:top] if SHINGLE in runs else np.zeros(0, U)
            total = np.zeros((len(five) + 1, 64), self.counts)
            np.cumsum(bits(five), axis=0, dtype=self.counts, out=total[1:])
            for g in self.groups:
                n = min(high, len(w) - g.n + 1) - low
                if n <= 0:
                    continue
                prints = majority(total[g.m : g.m + n] - total[:n], self.counts(g.m // 2)) if g.size == SHINGLE else runs[g.size][low : low + n]
                near, items = g.near(prints)
                near += low
                inside = room[near] >= g.n
                verify(g, near[inside], items[inside], g.m)
            short = np.flatnonzero((at[:-1] >= low) & (at[:-1] < high) & (np.diff(at) >= SHINGLE) & (np.diff(at) < self.longest))
            if len(short):  # whole texts against longer items
                starts, m = at[short], np.diff(at)[short] - SHINGLE + 1
                prints = majority(total[starts - low + m] - total[starts - low], (m // 2).astype(self.counts)[:, None])
                for g in self.groups:
                    if g.size == SHINGLE:
                        fits = np.flatnonzero((m < g.m) & (4 * m >= 3 * g.m))
                        near, items = g.near(prints[fits])
                        verify(g, starts[fits[near]], items, m[fits[near]])
        return best


def _scan(sent, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for b in batches:
            for rows, data, off in pieces(b.column(1), 1 << 18):
                found = sorted((rows.start + d, i, -start, score) for (d, i), (score, start) in index.find(*words(data, off)).items())
                d, i, start, score = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d, pa.int64())), pa.array([index.ids[k] for k in i], item_type), pa.array(start, pa.int32()), pa.array(score, pa.float64())], names=["doc_id", "item_id", "start_word", "similarity"])

    return run


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): for each document and item it holds, the best window, the first of equals."""
    spark = docs.sparkSession
    lowered = lambda df, key: df.where(f"{key} is not null and text is not null").select(key, F.lower(F.col("text").cast("string")).alias("text"))
    docs, items = lowered(docs, "doc_id"), lowered(items, "item_id").distinct()
    size = F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+"))
    passes = max(1, -(-items.count() // ITEMS))
    dealt = Scratch(spark).save(items.withColumn("n", size).repartitionByRange(passes, "n", "item_id", "text").select("item_id", "text", F.spark_partition_id().alias("pass")))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start_word int, similarity double"
    found = None
    for k in range(passes):
        held = [(r["item_id"], r["text"]) for r in dealt.where(F.col("pass") == k).orderBy("item_id", "text").collect()]  # about ITEMS rows
        one = docs.mapInArrow(_scan(spark.sparkContext.broadcast(held), to_arrow_type(items.schema["item_id"].dataType)), schema)
        found = one if found is None else found.union(one)
    best = F.max_by(F.struct("start_word", "similarity"), F.struct("similarity", -F.col("start_word"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.start_word", "b.similarity")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
#: Brute force over all windows that hold enough shingles of the item.
SQL = {
    "op8_benchmark_decontamination": rf"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
size AS (SELECT item_id, CAST(len(ws) AS BIGINT) AS n, CAST(least(len(ws), {SHINGLE}) AS BIGINT) AS g FROM items WHERE len(ws) > 0),
item AS (SELECT item_id, g, array_to_string(ws[i:i + g - 1], ' ') AS x, count(*) AS weight FROM (SELECT item_id, g, ws, unnest(range(1, n - g + 2)) AS i FROM items JOIN size USING (item_id)) GROUP BY ALL),
text AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS total, g, i, array_to_string(ws[i:i + g - 1], ' ') AS x FROM (SELECT doc_id, ws, g, unnest(range(1, len(ws) - g + 2)) AS i FROM split, (SELECT DISTINCT g FROM size))),
hit AS (SELECT doc_id, item_id, total, n, g, i - 1 AS i, x, weight FROM text JOIN item USING (g, x) JOIN size USING (item_id, g)),
held AS (SELECT doc_id, item_id, total, n, g, least(total, n) - g + 1 AS a, n - g + 1 AS b FROM hit GROUP BY ALL HAVING count(*) * 7 >= 3 * (least(total, n) - g + 1 + n - g + 1)),
win AS (SELECT *, unnest(range(0, greatest(total - n, 0) + 1)) AS s FROM held),
met AS (SELECT w.doc_id, w.item_id, s, a, b, x, least(count(*), weight) AS shared FROM win w JOIN hit h ON h.doc_id = w.doc_id AND h.item_id = w.item_id AND h.i >= s AND h.i < s + a GROUP BY w.doc_id, w.item_id, s, a, b, x, weight),
score AS (SELECT doc_id, item_id, s, sum(shared) / (a + b - sum(shared)) AS similarity FROM met GROUP BY doc_id, item_id, s, a, b)
SELECT doc_id, item_id, CAST(arg_max(s, (similarity, -s)) AS INTEGER) AS start_word, max(similarity) AS similarity FROM score WHERE similarity >= {SIMILARITY} GROUP BY doc_id, item_id
""",
}
