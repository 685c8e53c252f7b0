"""Lineage choice, placement and taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Taxids that need no minimum of markers.
NO_MINIMUM = ("204428",)
MIN_MARKERS, RATIO, ARCHAEA_RATIO = 12, 2.5, 1.2


def best_lineage(runs: DataFrame, keys: list[str], by_percent: bool = False) -> DataFrame:
    """Per input the run of most complete markers, then most fragments, then highest single-copy share, then first.

    runs: lineage, ordinal, s, d, f and s_percent, d_percent, f_percent.  With
    nothing found by the best of several, the first run is taken.
    """
    c, f = (F.col("s_percent") + F.col("d_percent"), F.col("f_percent")) if by_percent else (F.col("s") + F.col("d"), F.col("f"))
    nothing = (F.max(c).over(Window.partitionBy(*keys)) == 0) & (F.max(f).over(Window.partitionBy(*keys)) == 0)
    ranked = runs.withColumns({"_c": c, "_f": f, "_none": nothing})
    w = Window.partitionBy(*keys).orderBy(F.when(F.col("_none"), F.col("ordinal")), F.desc("_c"), F.desc("_f"), F.desc("s_percent"), "ordinal")
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_c", "_f", "_none")


def all_best(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every row of the highest value."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value)))).where("_r = 1").drop("_r")


def nearest_dataset(paths: DataFrame, datasets: DataFrame) -> DataFrame:
    """(taxid, dataset_taxid): the deepest element of a taxid's path (root first) that has a dataset."""
    steps = paths.select("taxid", F.posexplode("path").alias("depth", "node"))
    return steps.join(datasets.select(F.col("taxid").alias("node")), "node").groupBy("taxid").agg(F.max_by("node", "depth").alias("dataset_taxid"))


def common_ancestor(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of paths the deepest element that all share."""
    n = paths.groupBy(*keys).agg(F.count("*").alias("_n"))
    steps = paths.select(*keys, F.posexplode("path").alias("depth", "node")).groupBy(*keys, "node").agg(F.count("*").alias("_c"), F.max("depth").alias("depth"))
    return steps.join(n, keys).where("_c = _n").groupBy(*keys).agg(F.max_by("node", "depth").alias("ancestor"))


def first_resolvable(placements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, taxid): the first node of each query's placements (array) that resolves."""
    steps = placements.select("query", F.posexplode("nodes").alias("pos", "node"))
    return steps.join(nodes, "node").groupBy("query").agg(F.min_by("taxid", "pos").alias("taxid"))


def marker_weights(placed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return placed.groupBy(*(keys or []), "taxid").agg(F.count("*").alias("weight"), F.min("query").alias("first"))


def trusted(weights: DataFrame, keys: list[str], ratio: float = RATIO) -> DataFrame:
    """Taxids whose weight times ratio reaches the highest weight; alone if the best needs no minimum."""
    w = Window.partitionBy(*keys)
    top = weights.withColumns({"most": F.max("weight").over(w), "best": F.first("taxid").over(w.orderBy(F.desc("weight"), "first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    free = F.col("best").isin(*NO_MINIMUM)
    return top.where((free & (F.col("taxid") == F.col("best"))) | (~free & (F.col("weight") * ratio >= F.col("most"))))


def choose_taxid(weights: DataFrame, paths: DataFrame, keys: list[str], root: str, ratio: float = RATIO) -> DataFrame:
    """(keys, taxid, most, placed): the common ancestor of the trusted taxids, or root with too few markers."""
    kept = trusted(weights, keys, ratio).join(paths, "taxid")
    lca = common_ancestor(kept.select(*keys, "path"), keys)
    facts = weights.groupBy(*keys).agg(F.max("weight").alias("most"), F.sum("weight").alias("placed"))
    enough = (F.col("most") >= MIN_MARKERS) | F.col("ancestor").isin(*NO_MINIMUM)
    return facts.join(lca, keys, "left").select(*keys, F.when(enough, F.col("ancestor")).otherwise(root).alias("taxid"), "most", "placed")


def genetic_code_choice(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per input the code of highest coding density; of two within 0.05 the one of higher mean score."""
    w = Window.partitionBy(*keys).orderBy(F.desc("density"), "code")
    ranked = runs.withColumns({"_n": F.row_number().over(w), "_first": F.first("density").over(w), "_score": F.first("score").over(w)})
    swap = (F.col("_n") == 2) & (F.col("_first") - F.col("density") <= 0.05) & (F.col("score") > F.col("_score"))
    pick = Window.partitionBy(*keys).orderBy(F.desc(swap), "_n")
    return ranked.withColumn("_p", F.row_number().over(pick)).where("_p = 1").drop("_n", "_first", "_score", "_p")
