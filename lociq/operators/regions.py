"""Candidate regions from translated-search rows.

Rows: marker, contig, m_start, m_end (on the marker), start, end (on the
contig), evalue and an order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions.scalars import marker_base
from lociq.operators.intervals import merged_size

#: Reach within which a row extends a region.
REACH = 50_000


def accumulate(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One region per (marker, contig): rows in order extend it within REACH, are absorbed inside it, or are ignored."""
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    item = F.struct(rank.alias("rank"), "start", "end", "evalue", F.struct(F.col("m_start").alias("start"), F.col("m_end").alias("end")).alias("m"))
    groups = rows.groupBy("marker", "contig").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    first = F.get("xs", F.lit(0))
    begin = F.struct(first["start"].alias("start"), first["end"].alias("end"), first["evalue"].alias("evalue"), F.array(first["m"]).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        before = acc["start"] - x["start"]
        extends_start = (before >= 0) & (before <= REACH)
        start = F.when(extends_start, x["start"]).otherwise(acc["start"])
        after = x["end"] - acc["end"]
        extends_end = (after >= 0) & (after <= REACH)
        inside = ~extends_end & (acc["end"] >= x["start"]) & (x["start"] >= start)
        end = F.when(extends_end | (inside & (x["end"] > acc["end"])), x["end"]).otherwise(acc["end"])
        taken = extends_start | extends_end | inside
        return F.struct(start.alias("start"), end.alias("end"), F.when(taken & (x["evalue"] < acc["evalue"]), x["evalue"]).otherwise(acc["evalue"]).alias("evalue"), F.when(taken, F.array_append(acc["spans"], x["m"])).otherwise(acc["spans"]).alias("spans"))

    folded = F.aggregate(F.slice("xs", F.lit(2), F.greatest(F.size("xs") - 1, F.lit(0))), begin, step)
    return groups.select("marker", "contig", folded.alias("r")).select("marker", "contig", "r.*")


def best_variant(regions: DataFrame, ties: list[Column]) -> DataFrame:
    """Per base marker and contig the variant of lowest e-value."""
    out = regions.withColumn("base", marker_base(F.col("marker")))
    w = Window.partitionBy("base", "contig").orderBy("evalue", *ties)
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_contigs(regions: DataFrame, limit: int, ties: list[Column]) -> DataFrame:
    """The contigs of lowest e-value of each marker (1 to 20)."""
    if not 1 <= limit <= 20:
        raise ValueError("limit must lie between 1 and 20")
    w = Window.partitionBy("marker").orderBy("evalue", *ties)
    return regions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def with_size(regions: DataFrame) -> DataFrame:
    """Adds the size of the merged marker spans."""
    spans = regions.select("marker", "contig", F.explode("spans").alias("x")).select("marker", "contig", "x.start", "x.end")
    return regions.join(merged_size(spans, ["marker", "contig"], "start", "end"), ["marker", "contig"])


def large_enough(regions: DataFrame, share: float = 0.7) -> DataFrame:
    """Regions of at least a share of the marker's largest, rounded down."""
    most = F.max("size").over(Window.partitionBy("marker"))
    return regions.withColumn("_least", (most * share).cast("bigint")).where(F.col("size") >= F.col("_least")).drop("_least")


def flank(genome_bytes: Column) -> Column:
    """A fiftieth of the genome's size in thousands of bytes, between 5,000 and 20,000."""
    return F.greatest(F.lit(5000), F.least(F.lit(20000), (genome_bytes / 1000 / 50).cast("int")))


def extend(regions: DataFrame, width: Column) -> DataFrame:
    """Regions with flanks; the start stops at 0, the end is not held."""
    return regions.withColumns({"start": F.greatest(F.lit(0), F.col("start") - width), "end": F.col("end") + width})
