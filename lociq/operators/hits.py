"""From profile-search hits to marker statuses.

Hits hold one row per domain: marker, target, score, hmm_from, hmm_to, qlen and
what identifies a row.  Every step is a DataFrame -> DataFrame function; the
cutoff table is a dimension that is broadcast only where its size allows
(Spark's own threshold decides).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions.scalars import marker_number, percent, python_round
from lociq.operators.intervals import greedy_accept

RANKS = ("complete", "very_large", "fragment")


def pass_cutoff(hits: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Hits of known markers with at least the marker's cutoff score."""
    return hits.join(cutoffs.select("marker", "cutoff"), "marker").where("score >= cutoff")


def top_domains(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose score is the best of their target."""
    return hits.withColumn("best", F.max("score").over(Window.partitionBy(*keys))).where("score = best")


def targets(hits: DataFrame, keys: list[str], line: str) -> DataFrame:
    """One row per target: best score, score and qlen of its first line, union length of its top-scoring domains.

    All of it shares one partitioning by keys, so hits are read and shuffled once.
    """
    w = Window.partitionBy(*keys)
    top = F.col("score") == F.col("best")
    before = w.orderBy("hmm_from", "hmm_to").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(top, F.col("hmm_to"))).over(before), F.col("hmm_from") - 1)
    new = F.when(top, F.greatest(F.lit(0), F.col("hmm_to") - F.greatest(reach, F.col("hmm_from") - 1))).otherwise(0)
    rows = hits.select(*keys, "score", "qlen", "hmm_from", "hmm_to", F.col(line).alias("_line")).withColumn("best", F.max("score").over(w)).withColumn("_new", new.cast("bigint"))
    return rows.groupBy(*keys).agg(F.max("best").alias("best"), F.min_by("score", "_line").alias("first_score"), F.min_by("qlen", "_line").alias("qlen"), F.sum("_new").alias("matched_length"))


def suppress_overlapping_genes(found: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per file of hits, by matched length and best score: a target goes if its gene overlaps one accepted before; only those at the cutoff are accepted.

    Files of one marker don't see each other; a later file overwrites in upsert_rounds.
    """
    rows = found.join(cutoffs.select("marker", "cutoff"), "marker")
    order = [-F.col("matched_length"), -F.col("best"), F.col("target")]
    file = ["file"] if "file" in found.columns else []
    return greedy_accept(rows, [*file, "marker", "contig"], order, "g_start", "g_end", F.col("first_score") >= F.col("cutoff"))


def classify_by_length(found: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """z = (length - matched) / sigma: complete within two sigmas, very_large below -2, else fragment."""
    z = (F.col("length") - F.col("matched_length")) / F.when(F.col("sigma") == 0, 1.0).otherwise(F.col("sigma"))
    rank = F.when((z >= -2) & (z <= 2), "complete").when(z < -2, "very_large").otherwise("fragment")
    return found.join(cutoffs.select("marker", "length", "sigma"), "marker").withColumns({"zeta": z, "rank": rank}).drop("length", "sigma")


def classify_by_profile(found: DataFrame) -> DataFrame:
    """complete if at least 80 % of the profile is matched, else fragment."""
    return found.withColumn("rank", F.when(F.col("matched_length") >= 0.8 * F.col("qlen"), "complete").otherwise("fragment"))


def upsert_rounds(*rounds: DataFrame, keys: tuple[str, ...] = ("rank", "marker", "gene"), within: str = "file") -> DataFrame:
    """Later rounds, then later files, replace rows of equal keys. Round 2 must be put over the filtered round 1."""
    both = None
    for n, r in enumerate(rounds):
        r = r.withColumn("_round", F.lit(n))
        both = r if both is None else both.unionByName(r, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_round"), F.desc(within))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_round")


def resolve_ranks(ranked: DataFrame) -> DataFrame:
    """very_large without complete's markers and genes; fragment without those of complete and surviving very_large.

    The anti-joins are existence flags over windows, so the rows are made once
    and not once for every side of every join.
    """
    by = {k: Window.partitionBy(k) for k in ("marker", "gene")}
    whole, large = F.col("rank") == "complete", F.col("rank") == "very_large"
    some = lambda flag, k: F.max(flag).over(by[k])
    out = ranked.withColumn("_m", some(whole, "marker")).withColumn("_g", some(whole, "gene"))
    out = out.withColumn("_up", whole | (large & ~F.col("_m") & ~F.col("_g")))
    out = out.withColumn("_ug", some(F.col("_up"), "gene")).withColumn("_um", some(F.col("_up"), "marker"))
    return out.where(F.col("_up") | ((F.col("rank") == "fragment") & ~F.col("_ug") & ~F.col("_um"))).drop("_m", "_g", "_up", "_ug", "_um")


def best_marker_per_gene(ranked: DataFrame, ties: list[Column]) -> DataFrame:
    """Per rank a gene stays with the marker of best score; ties by the order given."""
    w = Window.partitionBy("rank", "gene").orderBy(F.desc("score"), *ties)
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def relative_score_filter(ranked: DataFrame, share: float = 0.85) -> DataFrame:
    """Per rank and marker, rows with at least a share of the best score."""
    w = Window.partitionBy("rank", "marker")
    return ranked.withColumn("_top", F.max("score").over(w)).where(F.col("score") >= share * F.col("_top")).drop("_top")


def best_fragment(fragments: DataFrame, ties: list[Column]) -> DataFrame:
    w = Window.partitionBy("marker").orderBy(F.desc("score"), *ties)
    return fragments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def consolidate(ranked: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(marker, status) for each expected marker: Complete, Duplicated, Fragmented or Missing."""
    n = ranked.groupBy("marker").agg(F.count_if(F.col("rank") != "fragment").alias("whole"), F.count_if(F.col("rank") == "fragment").alias("parts"))
    status = F.when(F.col("whole") == 1, "Complete").when(F.col("whole") > 1, "Duplicated").when(F.col("parts") > 0, "Fragmented").otherwise("Missing")
    return cutoffs.select("marker").distinct().join(n, "marker", "left").select("marker", status.alias("status"))


def missing_markers(statuses: DataFrame) -> DataFrame:
    return statuses.where("status = 'Missing'").select("marker")


def incomplete_markers(statuses: DataFrame) -> DataFrame:
    """What a second search round looks for."""
    return statuses.where("status in ('Missing', 'Fragmented')").select("marker")


def summarise(statuses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts and percentages per status, each rounded on its own; M is what is left of n."""
    keys = keys or []
    c = statuses.groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(k) for s, k in (("Complete", "s"), ("Duplicated", "d"), ("Fragmented", "f"))), F.count("*").alias("n"))
    c = c.withColumn("m", F.col("n") - F.col("s") - F.col("d") - F.col("f")).withColumn("c", F.col("s") + F.col("d"))
    return c.withColumns({f"{k}_percent": F.when(F.col("n") > 0, percent(F.col(k), F.col("n"))).otherwise(0.0) for k in "csdfm"})


def summarise_found(found: DataFrame, inputs: DataFrame, n_markers: DataFrame, keys: list[str]) -> DataFrame:
    """summarise for many inputs at once: found has the statuses of markers that were found, n_markers one row with n; the rest of n is missing."""
    c = found.groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(k) for s, k in (("Complete", "s"), ("Duplicated", "d"), ("Fragmented", "f"))))
    c = inputs.select(*keys).distinct().join(c, keys, "left").select(*keys, *(F.coalesce(k, F.lit(0)).alias(k) for k in "sdf"))
    c = c.join(F.broadcast(n_markers.select("n")), how="cross")  # one row
    c = c.withColumn("m", F.col("n") - F.col("s") - F.col("d") - F.col("f")).withColumn("c", F.col("s") + F.col("d"))
    return c.withColumns({f"{k}_percent": F.when(F.col("n") > 0, percent(F.col(k), F.col("n"))).otherwise(0.0) for k in "csdfm"})


def notation(summary: DataFrame, stops: Column | None = None) -> Column:
    """C:x%[S:x%,D:x%],F:x%,M:x%,n:N and ,E:x% where there are internal stops."""
    p = lambda k: F.format_number(f"{k}_percent", 1)
    base = F.concat(F.lit("C:"), p("c"), F.lit("%[S:"), p("s"), F.lit("%,D:"), p("d"), F.lit("%],F:"), p("f"), F.lit("%,M:"), p("m"), F.lit("%,n:"), F.col("n").cast("string"))
    return base if stops is None else F.concat(base, F.when(stops > 0, F.concat(F.lit(",E:"), F.format_number(stops, 1), F.lit("%"))).otherwise(""))


def stop_summary(genes: DataFrame) -> DataFrame:
    """Complete markers whose every copy has an internal stop, their share of complete markers, and mean identity.

    genes: marker, status, stops, identity, of complete and fragmented markers.
    """
    whole = genes.where("status in ('Complete', 'Duplicated')").groupBy("marker").agg(F.bool_and(F.col("stops") > 0).alias("stopped"))
    n = whole.agg(F.count_if("stopped").alias("n_stopped"), F.count("*").alias("n_complete"))
    mean = genes.agg(F.avg("identity").alias("m")).select(python_round(F.col("m"), 2).alias("avg_identity"))
    share = F.when(F.col("n_complete") > 0, percent(F.col("n_stopped"), F.col("n_complete"))).otherwise(0.0)
    return n.crossJoin(mean).select("n_stopped", "n_complete", share.alias("e_percent"), "avg_identity")  # one row each


def parasite_check(statuses: DataFrame, expected_missing: DataFrame) -> DataFrame:
    """Whether the markers missing fit a list that parasites lack, and the score without that list."""
    listed = expected_missing.select("marker").distinct().withColumn("listed", F.lit(True))
    both = statuses.join(listed, "marker", "full")
    c = both.agg(F.count_if("listed").alias("n_list"), F.count_if(F.col("status") == "Missing").alias("n_missing"), F.count_if((F.col("status") == "Missing") & F.col("listed")).alias("n_both"), *(F.count_if(F.col("status") == s).alias(k) for s, k in (("Complete", "s"), ("Duplicated", "d"), ("Fragmented", "f"))), F.count("status").alias("n_all"))
    share = F.when(F.col("n_missing") > 0, F.col("n_both") / F.col("n_missing") * 100).otherwise(0.0)
    n = F.col("n_all") - F.col("n_list")
    c = c.withColumns({"overlap_percent": python_round(share, 1), "parasitic": (F.col("n_missing") >= 0.8 * F.col("n_list")) & (share >= 80), "n": n})
    c = c.withColumns({f"{k}_percent": F.when(n > 0, percent(F.col(k), n)).otherwise(0.0) for k in "sdf"})
    return c.withColumns({"c_percent": python_round(F.col("s_percent") + F.col("d_percent"), 1), "m_percent": python_round(100 - F.col("s_percent") - F.col("d_percent") - F.col("f_percent"), 1)}).drop("n_all")


def result_table(statuses: DataFrame, ranked: DataFrame, annotation: DataFrame | None = None, places: tuple[Column, ...] = ()) -> DataFrame:
    """The full table: a row per marker and gene, missing markers too, with annotation where there is one, and columns of the gene's place if given."""
    genes = ranked.select("marker", "gene", "score", "matched_length", *places)
    out = statuses.join(genes, "marker", "left")
    if annotation is not None:
        out = out.join(annotation, "marker", "left")
    return out.orderBy(marker_number(F.col("marker")), F.desc("score"), "gene")


def filter_ranks(found: DataFrame, ties: list[Column]) -> DataFrame:
    """Classified targets after all filters; a second search round is put over these."""
    return relative_score_filter(best_marker_per_gene(resolve_ranks(found), ties))


def only_best_fragments(kept: DataFrame, ties: list[Column]) -> DataFrame:
    """All complete and very large rows, and of each marker's fragments the best one (of equal scores the longer match)."""
    w = Window.partitionBy("marker", "rank").orderBy(F.desc("score"), F.desc("matched_length"), *ties)
    return kept.withColumn("_n", F.row_number().over(w)).where("rank <> 'fragment' or _n = 1").drop("_n")


def status_flow(found: DataFrame, cutoffs: DataFrame, ties: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Classified targets -> (rows that are reported, statuses)."""
    kept = only_best_fragments(filter_ranks(found, ties), ties)
    return kept, consolidate(kept, cutoffs)
