"""Runs as chains of transformations: one input, a batch, and the automatic lineage.

Inputs and lineages are columns, not loops: a batch of files and all candidate
lineages go through one plan, and the best lineage is a window over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.functions.scalars import gene_contig, gene_end, gene_of_target, gene_start
from lociq.operators import hits as H
from lociq.operators.lineage import best_lineage
from lociq.sources import text


def read_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Cutoffs of a lineage: marker, cutoff and, where the data set has them, length and sigma."""
    scores = text.score_cutoffs(spark, f"{folder}/scores_cutoff")
    try:
        lengths = text.length_cutoffs(spark, f"{folder}/lengths_cutoff")
        return scores.join(lengths, "marker", "left")
    except Exception as e:  # a data set without lengths classifies by profile
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return scores.withColumns({"length": F.lit(None).cast("double"), "sigma": F.lit(None).cast("double")})


TIES = ("file", "target")


def assess(hits: DataFrame, cutoffs: DataFrame, proteins: bool, by_length: bool) -> tuple[DataFrame, DataFrame]:
    """Domain hits (marker, file, line_order, target, ...) -> (rows that are reported, statuses)."""
    return H.status_flow(classified(hits, cutoffs, proteins, by_length), cutoffs, [F.col(c) for c in TIES])


def classified(hits: DataFrame, cutoffs: DataFrame, proteins: bool, by_length: bool) -> DataFrame:
    """Domain hits -> targets at the cutoff with their ranks; unless proteins, targets name places and overlapping ones are suppressed."""
    rows = hits.withColumnRenamed("full_score", "score")
    found = H.targets(rows, ["file", "marker", "target"], "line_order").withColumn("gene", F.col("target") if proteins else gene_of_target(F.col("target")))
    if proteins:
        kept = found.join(cutoffs.select("marker", "cutoff"), "marker").where("first_score >= cutoff")
    else:
        places = found.withColumns({"contig": gene_contig(F.col("gene")), "g_start": gene_start(F.col("gene")), "g_end": gene_end(F.col("gene"))})
        kept = H.suppress_overlapping_genes(places, cutoffs)
    kept = kept.withColumn("score", F.col("first_score"))
    ranked = H.classify_by_length(kept, cutoffs) if by_length else H.classify_by_profile(kept)
    return H.upsert_rounds(ranked)


def second_round(first: DataFrame, later: DataFrame, cutoffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A rerun of incomplete markers: its ranked rows go over the first round's filtered ones (filter_ranks), then all is filtered again."""
    return H.status_flow(H.upsert_rounds(first, later), cutoffs, [F.col(c) for c in TIES])


def choose_lineage(statuses: DataFrame) -> DataFrame:
    """Per input the lineage of best score; statuses: input, lineage, ordinal, marker, status."""
    return best_lineage(H.summarise(statuses, ["input", "lineage", "ordinal"]), ["input"])


def looks_viral(summary: DataFrame, input_bytes: int) -> DataFrame:
    """Best runs that warrant a try of the virus data sets: single below 3 % and a small file."""
    return summary.where((F.col("s_percent") < 3.0) & (F.lit(input_bytes) < 500_000))


def run_batch(hits: DataFrame, cutoffs: DataFrame, by_length: bool) -> DataFrame:
    """Summary per input of protein-mode hits with an input column; inputs don't see each other."""
    of_input = lambda c: F.concat_ws("\u0001", "input", c)
    dims = hits.select("input", "marker").distinct().join(cutoffs, "marker").withColumn("marker", of_input("marker")).drop("input")
    keyed = hits.withColumns({"marker": of_input("marker"), "target": of_input("target")})
    _, statuses = assess(keyed, dims, True, by_length)
    parts = F.split("marker", "\u0001")
    found = statuses.where("status <> 'Missing'").select(parts[0].alias("input"), "status")
    return H.summarise_found(found, hits, cutoffs.agg(F.countDistinct("marker").alias("n")), ["input"])


def run_proteins(spark: SparkSession, hit_files: str, dataset: str, by_length: bool = False) -> tuple[DataFrame, DataFrame]:
    """One protein set: the hit files of a profile search and a data set's folder."""
    return assess(text.domain_hits(spark, hit_files), read_dataset(spark, dataset), True, by_length)


def newest_per_marker(rows: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("marker").orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
