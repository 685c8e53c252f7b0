"""Shared pieces: tables in the shared folder, checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.storage import fresh_folder, remove

#: Most bytes that a side may hold to be broadcast; beyond it a join shuffles.
BROADCAST_BYTES = 32 << 20
#: A key is hot if more than one in HOT of all rows have it.
HOT = 10_000
#: Narrow rows in a file of a table whose size is known.
FILE_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder: lineage ends there, so a lost executor costs no recomputation beyond it.

    What drop has not removed goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = fresh_folder(spark)
        self.n = 0

    def save(self, df: DataFrame, batch: int | None = None, rows: int | None = None) -> DataFrame:
        """Writes df and reads it back; batch: most rows that go to Python at a time, for wide rows.

        rows: a bound of df's narrow rows, where one is known; it is then written
        in files of FILE_ROWS, not in one of each shuffle partition.
        """
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        path = f"{self.base}/{self.n}"
        self.n += 1
        if batch:
            key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", self.spark.conf
            before = conf.get(key)
            conf.set(key, str(batch))
            try:
                df.write.parquet(path)
            finally:
                conf.set(key, before)
        else:
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lociq_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._lociq_path)


def small_side(df: DataFrame, row_bytes, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a saved side for broadcast only if its measured bytes stay under the limit, else it is sorted and merged, which can spill."""
    held = df.agg(F.sum(row_bytes).alias("b")).first()["b"] or 0
    return F.broadcast(df) if held <= limit else df.hint("merge")


def join_back(rows: DataFrame, key: str, per_key: DataFrame) -> DataFrame:
    """rows with the columns of a saved per_key (key, n, ...), where n counts the rows of a key; rows of other keys go.

    A key that more than 1/HOT of these rows have is joined by broadcast (there
    are fewer than HOT such keys), so its rows stay where they are.
    """
    total = per_key.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > total
    hot, cold = per_key.where(is_hot).drop("n"), per_key.where(~is_hot).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of undirected edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars; each
    step aggregates minima with map-side combine, and its edges are written out.
    Null ends and loops are left out.  An empty input gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    rows = edges.count()
    e = scratch.save(e.where("u is not null and v is not null and u <> v").distinct(), rows=rows)
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e, old = scratch.save(small, rows=2 * rows), e
        scratch.drop(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
