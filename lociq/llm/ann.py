"""Nearest neighbours by a block matrix join.

Queries and candidates are cut into blocks by a hash of their id; every pair
of blocks meets in one tile.  Only int8 copies of the unit vectors travel to the
tiles, with their scales, errors and norms; their products give each cosine with
a proven error bound.  Pairs whose upper bound reaches the k-th best lower bound
of their query, first in the tile and then over all tiles, are recomputed in
double precision from the original vectors, fetched for them alone, and heaps
merge the best.  The bounds make the result exact: nothing is lost to
quantisation.  Of candidates with equal vectors only those of the k + 1 smallest
ids take part: all have one score, ties go to the smaller id, and a query leaves
out at most its own id.  So a vector that very many rows share is thinned before
the shuffle and never fills a task.

Rows with a null id, and vectors that are null, empty, zero or hold null or
non-finite components, take no part; vectors of different length are not compared.  Ties go to the smaller
vec_id.  Rows that repeat a vec_id are candidates each, but never of a query
with that id; a repeated query id is one query per distinct vector, merged.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.llm._common import Scratch, table

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096


def usable(df: DataFrame, vector: str) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0))


PACKED = "block long, dim int, ids binary, raw binary, small binary, facts binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, dim, id, vector) of whole blocks -> one row per block and dim; facts are scale, error and norm of each row."""
    held: dict = {}
    for b in batches:
        for block, dim, i, v in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
            ids, vectors = held.setdefault((block, dim), ([], []))
            ids.append(i)
            vectors.append(v.values.to_numpy(zero_copy_only=False).astype(np.float64))
    for (block, dim), (ids, vectors) in held.items():
        raw = np.stack(vectors)
        small, *facts = quantise(raw)
        data = (np.array(ids, np.int64), raw, small, np.stack(facts))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=["block", "dim", "ids", "raw", "small", "facts"])


def blocks(df: DataFrame, id_col: str, vector: str, n: int) -> DataFrame:
    rows = df.select(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("block"), F.size(vector).alias("dim"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.repartition(n, "block").mapInArrow(_pack, PACKED)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> their rows (block, dim, place, id, raw vector)."""
    for b in batches:
        for block, dim, ids, raw in zip(*(b.column(n).to_pylist() for n in ("block", "dim", "ids", "raw")), strict=True):
            n, width = len(ids) // 8, 8 * dim
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([dim] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(np.frombuffer(ids, np.int64)), pa.array([raw[i * width : (i + 1) * width] for i in range(n)], pa.binary())], names=["block", "dim", "place", "id", "raw"])


def quantise(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, error norms, norms of the int8 copies."""
    unit = raw / np.abs(raw).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    back = small * scale[:, None]
    return small, scale, np.sqrt(((unit - back) ** 2).sum(1)), np.sqrt((back * back).sum(1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same for equal rows."""

    def one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for k in range(x.shape[1]):  # sums in the order of components, whatever the count of rows
            out += x[:, k] * y[:, k]
        return out

    return one(a, b) / (np.sqrt(one(a, a)) * np.sqrt(one(b, b)))


def _tile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_block, block, dim, q_ids, q_small, q_facts, ids, small, facts in zip(*(b.column(n).to_pylist() for n in ("q_block", "block", "dim", "q_ids", "q_small", "q_facts", "ids", "small", "facts")), strict=True):
                exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # BLAS multiplies small whole numbers exactly
                qi, ci = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q8, c8 = (np.frombuffer(x, np.int8).reshape(-1, dim).astype(exact) for x in (q_small, small))
                (qs, qe, _), (cs, ce, cn) = (np.frombuffer(x).reshape(3, -1) for x in (q_facts, facts))
                found: list[list] = [[], [], [], []]
                for at in range(0, len(qi), 128):
                    part = slice(at, at + 128)
                    near = (q8[part] @ c8.T).astype(np.float64) * qs[part, None] * cs[None, :]
                    slack = qe[part, None] * cn[None, :] + ce[None, :] + 1e-9
                    own = qi[part, None] == ci[None, :]
                    low = np.where(own, -np.inf, near - slack)
                    floor = np.partition(low, len(ci) - k, axis=1)[:, len(ci) - k] if len(ci) > k else np.full(len(low), -np.inf)
                    rows, cols = np.nonzero((near + slack >= floor[:, None]) & ~own)
                    for x, y in zip(found, (rows + at, cols, low[rows, cols], (near + slack)[rows, cols]), strict=True):
                        x.append(y)
                data = [np.concatenate(x).astype(t).tobytes() for x, t in zip(found, (np.int32, np.int32, np.float64, np.float64), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([q_block], pa.int64()), pa.array([dim], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in data)], names=["q_block", "dim", "block", "q_place", "place", "low", "high"])

    return run


def within_reach(q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Which pairs' upper bound reaches the k-th best lower bound of their query."""
    order = np.lexsort((-low, q))
    first = np.searchsorted(q[order], q[order])
    kth = first + k - 1
    inside = kth < len(q)
    inside[inside] = q[order][kth[inside]] == q[order][inside]
    floor = np.where(inside, low[order][np.minimum(kth, len(q) - 1)], -np.inf)
    out = np.empty(len(q), bool)
    out[order] = high[order] >= floor
    return out


def _narrow(k: int):
    """Tiles of whole query blocks, sorted by them -> the pairs that may be among the best of all tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [np.zeros(0, t) for t in (np.int32, np.int64, np.int32, np.float64, np.float64)]

        def rows() -> pa.RecordBatch:
            n = len(held[0])
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int32()), *map(pa.array, held[:3])], names=["q_block", "dim", "q_place", "block", "place"])

        for b in batches:
            for q_block, dim, block, *data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key not in (None, (q_block, dim)):
                    yield rows()
                    held = [x[:0] for x in held]
                key = q_block, dim
                q, c, low, high = (np.frombuffer(x, t) for x, t in zip(data, (np.int32, np.int32, np.float64, np.float64), strict=True))
                held = [np.concatenate(x) for x in zip(held, (q, np.full(len(q), block), c, low, high), strict=True)]
                kept = within_reach(held[0], held[3], held[4], k)
                held = [x[kept] for x in held]
        if key is not None:
            yield rows()

    return run


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = np.zeros(len(b))
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x, y = (np.frombuffer(b"".join(b.column(n).take(pa.array(at)).to_pylist())).reshape(-1, dim) for n in ("q_raw", "raw"))
            out[at] = cosines(x, y)
        yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(out)], names=["query_id", "vec_id", "score"])


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for b in batches:
            for q, v, s in zip(*(b.column(n).to_pylist() for n in range(3)), strict=True):
                heap = best.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
        rows = [(q, r, -v, s) for q, heap in best.items() for r, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        q, r, v, s = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    return run


def few_copies(df: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """Of equal vectors the rows of the k + 1 smallest ids, at most k rows of one id."""
    same = Window.partitionBy(vector)
    ranked = df.withColumn("_id", F.dense_rank().over(same.orderBy(id_col))).where(F.col("_id") <= k + 1)
    return ranked.withColumn("_row", F.row_number().over(Window.partitionBy(vector, id_col).orderBy(id_col))).where(F.col("_row") <= k).drop("_id", "_row")


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest cosine of each query, its own id excepted."""
    queries, candidates = (usable(df.select(id_col, vector).where(F.col(id_col).isNotNull()), vector) for df in (queries, candidates))
    queries, scratch = queries.distinct(), Scratch(queries.sparkSession)
    candidates = scratch.save(few_copies(candidates, id_col, vector, k))
    nq, nc = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (candidates, CANDIDATE_BLOCK)))
    q, c = (scratch.save(blocks(df, id_col, vector, n)) for df, n in ((queries, nq), (candidates, nc)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q_small = q.select(F.col("block").alias("q_block"), "dim", *(F.col(x).alias(f"q_{x}") for x in ("ids", "small", "facts")), every(nc).alias("block"))
    tiles = q_small.join(c.select("block", "dim", "ids", "small", "facts", every(nq).alias("q_block")), ["q_block", "block", "dim"])
    met = tiles.mapInArrow(_tile(k), "q_block long, dim int, block long, q_place binary, place binary, low binary, high binary")
    met = met.repartition("q_block", "dim").sortWithinPartitions("q_block", "dim").mapInArrow(_narrow(k), "q_block long, dim int, q_place int, block long, place int")
    q_rows, c_rows = (df.select("block", "dim", "ids", "raw").mapInArrow(_unpack, "block long, dim int, place int, id long, raw binary") for df in (q, c))
    q_rows = q_rows.select(F.col("block").alias("q_block"), "dim", F.col("place").alias("q_place"), F.col("id").alias("query_id"), F.col("raw").alias("q_raw"))
    near = met.join(c_rows.withColumnRenamed("id", "vec_id"), ["block", "dim", "place"]).join(q_rows, ["q_block", "dim", "q_place"])
    found = near.select("query_id", "vec_id", "dim", "q_raw", "raw").mapInArrow(_score, "query_id long, vec_id long, score double")
    return found.repartition("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op2_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where("vec_id % 50 = 0"), rows, 5)


QUERIES = {"op2_approximate_nearest_neighbours": op2_approximate_nearest_neighbours}
SQL = {
    "op2_approximate_nearest_neighbours": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.size * c.size) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
""",
}
