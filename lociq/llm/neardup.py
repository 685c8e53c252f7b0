"""Near-duplicate documents by min-max hashing, links confirmed on full shingle sets.

A text's set holds its distinct 5-word shingles (words: runs of anything but
ASCII white space, A-Z lower-cased; fewer words: the whole as one).  Under each
of 72 hash functions both the minimum and the maximum over the set are kept,
which gives 144 signature values for 72 evaluations.  36 bands of 4 values
find pairs: a pair of similarity 0.75 misses all of them with probability
1.1e-6.  Equal sets are first folded into one representative, found by
aggregation, so groups of copies cost a row each however large they are.

Two rounds find the links.  First each document meets one other, the smallest
id of any bucket it is in; the links confirmed join many members.  Then, in
buckets that still hold several components, members of different components
meet: by signature, in blocks, which leaves the members with a lookalike, and
those are compared by their full sets inside the bucket, where only links that
join components are put out.  So no round makes a row for each pair of a
bucket.  A pair is compared in the first band that it shares, and buckets of
more than TILE members are dealt over tiles, each with two slices of them.  A
pair goes on only if its sizes allow the similarity and its signatures agree
in at least 0.58 of the values (four and a half standard deviations below
0.75), and it becomes a link only if 100 * intersection >= 75 * union.

Null or blank text: empty set, linked with nothing, component is its own
doc_id.  Repeated rows: a row each, of one component; different texts of one
doc_id are one node of the links.  A null doc_id links
nothing and has its set's representative as component, or null; kept is false.
Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm._common import Scratch, connected_components, join_back, small_side, table
from lociq.llm._text import U, mix, pieces, shingles

PERMUTATIONS, ROWS = 72, 4
BANDS = 2 * PERMUTATIONS // ROWS
AGREE = 0.58
TILE = 1024
#: Rows that hold sets go to Python so many at a time.
WIDE = 256
_A = np.random.default_rng(11).integers(1, 2**63, PERMUTATIONS, dtype=np.int64).astype(U) | U(1)
_B = np.random.default_rng(13).integers(1, 2**63, (BANDS, ROWS), dtype=np.int64).astype(U) | U(1)

SIGNED = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sig binary"


def min_max(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows of minimum, maximum, minimum, ... over each segment of hashes; no segment may be empty."""
    out = np.empty((len(begin), 2 * PERMUTATIONS), U)
    held = np.empty_like(hashes)
    for p in range(PERMUTATIONS):
        np.multiply(hashes, _A[p], out=held)
        np.minimum.reduceat(held, begin, out=out[:, 2 * p])
        np.maximum.reduceat(held, begin, out=out[:, 2 * p + 1])
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    parts = mix(values).reshape(len(values), BANDS, ROWS)
    return mix((parts * _B[None]).sum(2, dtype=U) + np.arange(BANDS, dtype=U)[None])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, data, off in pieces(b.column(1)):
            h, begin = shingles(data, off)
            sets = [np.unique(h[i:j]) for i, j in zip(begin[:-1], begin[1:], strict=True)]
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"\0" * 16 for s in sets]
            hi_lo = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            values = min_max(np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(n[full])[:-1]])) if len(full) else np.empty((0, 2 * PERMUTATIONS), U)
            keys = band_keys(values) if len(full) else np.empty((0, BANDS), U)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            sig = (mix(values) >> U(56)).astype(np.uint8)
            sigs: list = [None] * len(n)
            for k, i in enumerate(full):
                sigs[i] = sig[k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0)[rows].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hi_lo[:, 0]), pa.array(hi_lo[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_hi", "set_lo", "bands", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, data, off in pieces(b.column(1)):
            h, begin = shingles(data, off)
            sets = [np.unique(h[i:j]).tobytes() for i, j in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0)[rows].cast(pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "items"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for b in batches:
        sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS) for c in ("sa", "sb"))
        yield b.select(["a", "b"]).filter(pa.array((sa == sb).mean(1) >= AGREE))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= 75 * union."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [linked(np.frombuffer(x, U), np.frombuffer(y, U)) for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Bucket:
    """Members of one tile of a bucket, by size."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: (r["size"], r["doc_id"]))
        self.rows, self.n = rows, len(rows)
        column = lambda k: np.array([r[k] for r in rows], np.int64)
        self.ids, self.size, self.label, self.slice = (column(k) for k in ("doc_id", "size", "label", "slice"))
        self.bands = np.stack([r["bands"] for r in rows])
        self.band = int(np.flatnonzero(self.bands[0] == rows[0]["key"])[0])
        self.apart = rows[0]["lo_slice"] != rows[0]["hi_slice"]
        self.sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(self.n, -1)

    def partners(self, i: int) -> np.ndarray:
        """Later members that member i must be compared with here."""
        to = int(np.searchsorted(self.size, self.size[i] * 4 // 3, side="right"))
        js = np.arange(i + 1, to)
        js = js[self.label[js] != self.label[i]]
        if self.apart:
            js = js[self.slice[js] != self.slice[i]]
        if len(js):
            js = js[(self.sig[js] == self.sig[i]).mean(1) >= AGREE]
        if len(js):
            js = js[(self.bands[js] == self.bands[i]).argmax(1) == self.band]
        return js

    def lookalikes(self) -> list[int]:
        found = np.zeros(self.n, bool)
        for i in range(self.n - 1):
            js = self.partners(i)
            found[js] = True
            found[i] |= len(js) > 0
        return self.ids[found].tolist()

    def links(self) -> list[tuple[int, int]]:
        sets, root, out = [np.frombuffer(r["items"], U) for r in self.rows], {}, []

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for i in range(self.n - 1):
            for j in self.partners(i).tolist():
                a, b = find(int(self.label[i])), find(int(self.label[j]))
                if a != b and linked(sets[i], sets[j]):
                    root[max(a, b)] = min(a, b)
                    out.append((int(self.ids[i]), int(self.ids[j])))
        return out


def _by_bucket(batches: Iterator[pa.RecordBatch], of: Callable[[Bucket], list]) -> Iterator[tuple[tuple, list]]:
    """of(bucket) for each run of rows with equal (key, lo_slice, hi_slice)."""
    held: list[dict] = []
    name = lambda r: (r["key"], r["lo_slice"], r["hi_slice"])
    for batch in batches:
        bands = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        for row, keys in zip(batch.drop_columns(["bands"]).to_pylist(), bands, strict=True):
            row["bands"] = keys.copy()
            if held and name(held[0]) != name(row):
                yield name(held[0]), of(Bucket(held))
                held = []
            held.append(row)
    if held:
        yield name(held[0]), of(Bucket(held))


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (key, lo, hi), ids in _by_bucket(batches, Bucket.lookalikes):
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([lo] * n, pa.int32()), pa.array([hi] * n, pa.int32()), pa.array(ids, pa.int64())], names=["key", "lo_slice", "hi_slice", "doc_id"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, pairs in _by_bucket(batches, Bucket.links):
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Full sets of some documents, whose texts are read once more."""
    near = docs.join(small_side(ids, F.lit(16)), "doc_id", "left_semi")
    return near.select("doc_id", "text").mapInArrow(_sets, "doc_id long, items binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.save(docs.mapInArrow(_sign, SIGNED))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", F.col("n_shingles").alias("size"), "bands", "sig")).alias("r")
    reps = scratch.save(usable.groupBy("set_hi", "set_lo").agg(first).select("set_hi", "set_lo", "r.*"))
    facts = reps.select("doc_id", "size", "bands", "sig")
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    first = scratch.save(keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first <> last").drop("last"))
    met = join_back(keyed, "key", first).where("doc_id <> first")
    met = met.groupBy(F.col("doc_id").alias("b")).agg(F.min("first").alias("a"))
    one = lambda side: facts.select(F.col("doc_id").alias(side), F.col("size").alias(f"n{side}"), F.col("sig").alias(f"s{side}"))
    sized = met.join(one("b"), "b").join(one("a"), "a").where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    tried = scratch.save(sized.select("a", "b", "sa", "sb").mapInArrow(_alike, "a long, b long"))
    ids = scratch.save(tried.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), rows=2 * tried.count())
    sets = scratch.save(_sets_of(ids, docs))
    one = lambda side: sets.select(F.col("doc_id").alias(side), F.col("items").alias(f"x{side}"))
    links = scratch.save(tried.join(one("b"), "b").join(one("a"), "a").select("a", "b", "xa", "xb").mapInArrow(_confirm, "a long, b long"), WIDE)
    scratch.drop(sets)
    parts = connected_components(links, scratch)

    labelled = reps.select("doc_id", "bands").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("label"), F.explode("bands").alias("key"))
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    several = scratch.save(several.select("key", "n", F.ceil(F.col("n") / TILE).cast("int").alias("slices")))
    mixed, slices = join_back(labelled, "key", several), F.col("slices")
    mixed = mixed.select("key", "doc_id", "label", F.pmod(F.xxhash64("doc_id", F.lit(3)), slices).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("other"))
    mixed = scratch.save(mixed.select("key", "doc_id", "label", "slice", F.least("slice", "other").alias("lo_slice"), F.greatest("slice", "other").alias("hi_slice")))
    tile = ["key", "lo_slice", "hi_slice"]
    whole = lambda df: df.repartition(*tile).sortWithinPartitions(*tile)
    flagged = scratch.save(whole(mixed.join(facts, "doc_id").where("array_contains(bands, key)")).mapInArrow(_flag, "key long, lo_slice int, hi_slice int, doc_id long"))
    ids = scratch.save(flagged.select("doc_id").distinct(), rows=flagged.count())
    if not ids.isEmpty():
        sets = scratch.save(_sets_of(ids, docs))
        full = mixed.join(flagged, [*tile, "doc_id"]).join(facts, "doc_id").where("array_contains(bands, key)").join(sets, "doc_id")
        links = links.union(scratch.save(whole(full).mapInArrow(_link, "a long, b long"), WIDE))
        parts = connected_components(links, scratch)

    named = reps.select("set_hi", "set_lo", F.col("doc_id").alias("rep")).join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_hi", "set_lo").join(named, ["set_hi", "set_lo"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
SQL = {
    "op3_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN s sa ON sa.doc_id = c.a JOIN s sb ON sb.doc_id = c.b WHERE 100 * n >= 75 * (len(sa.sh) + len(sb.sh) - n)),
ways AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.u, b.v FROM reach r JOIN ways b ON r.v = b.u)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) ON u = doc_id
""",
}
