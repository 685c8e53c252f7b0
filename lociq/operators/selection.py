"""Selections between the steps of a run: what goes into a rerun, onto a queue, or into a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions.scalars import marker_base


def of_markers(records: DataFrame, markers: DataFrame, target: str = "target", shorten: bool = False) -> DataFrame:
    """Records of the markers given; a target is a marker id with an optional _variant. shorten: ids become the marker."""
    rows = records.withColumn("_m", marker_base(F.col(target))).join(markers.select(F.col("marker").alias("_m")).distinct(), "_m", "left_semi")
    return (rows.withColumn(target, F.col("_m")) if shorten else rows).drop("_m")


def not_retrieved(markers: DataFrame, records: DataFrame, target: str = "target") -> DataFrame:
    """Markers asked for of which no record was found."""
    found = records.select(marker_base(F.col(target)).alias("marker")).distinct()
    return markers.select("marker").distinct().join(found, "marker", "left_anti")


def of_contigs(records: DataFrame, regions: DataFrame, contig: str = "seq_id") -> DataFrame:
    """Sequences of the contigs on which a region lies."""
    return records.join(regions.select(F.col("contig").alias(contig)).distinct(), contig, "left_semi")


def lines_in_ranges(lines: DataFrame, ranges: DataFrame, number: str = "line_no", width: int = 1000) -> DataFrame:
    """Lines with first <= number < last of each range; both meet in bins of width lines."""
    r = ranges.where("last > first").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("last") - 1) / width))))
    hit = lines.withColumn("_bin", F.floor(F.col(number) / width)).join(r, "_bin")
    return hit.where((F.col(number) >= F.col("first")) & (F.col(number) < F.col("last"))).drop("_bin")


def numbered(jobs: DataFrame, ties: list[Column], name: str = "ordinal") -> DataFrame:
    """Numbers a marker's regions, largest first."""
    return jobs.withColumn(name, F.row_number().over(Window.partitionBy("marker").orderBy(F.desc("size"), *ties)))


def longest_first(jobs: DataFrame, ties: list[Column]) -> DataFrame:
    return jobs.orderBy(F.desc("size"), *ties)


def newest(first: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """Union of two rounds by key; the later round wins."""
    return later.unionByName(first.join(later.select(key).distinct(), key, "left_anti"))


def genome_length(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Length of sequence lines, each with its line end."""
    return lines.where(~F.col(line).startswith(">")).groupBy(*keys).agg(F.sum(F.length(line) + 1).alias("length"))


def coding_length(genes: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of end - start."""
    return genes.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("coding"))


def dense_enough(runs: DataFrame, upper: float) -> DataFrame:
    """Gene-finding runs whose coding density settles their genetic code."""
    return runs.where(F.col("density") >= upper)


def viral(runs: DataFrame) -> DataFrame:
    """Runs poor enough, on inputs small enough, to try the virus data sets."""
    return runs.where("s_percent < 3.0 and input_bytes < 500000")


def shared_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows equal in all columns."""
    return a.intersect(b)


def profile_jobs(markers: DataFrame, files: DataFrame) -> DataFrame:
    """A search job per marker and sequence file of that marker."""
    return markers.join(files.withColumn("marker", marker_base(F.regexp_extract("file", r"([^/.]+)[^/]*$", 1))), "marker")


def gff_of_results(lines: DataFrame, results: DataFrame) -> DataFrame:
    """GFF lines (marker, contig, gene, line, round) of the genes that are results; of a gene the last round's."""
    mine = lines.join(results.select("marker", "gene").distinct(), ["marker", "gene"], "left_semi")
    last = mine.groupBy("marker", "gene").agg(F.max("round").alias("round"))
    return mine.join(last, ["marker", "gene", "round"])
