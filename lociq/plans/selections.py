"""Queries over selections and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators import selection as S
from lociq.plans.adapters import view, with_views

K = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _odd(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "cutoffs").where("p_size % 3 = 1").select("marker")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "hits").withColumn("target", F.concat("marker", F.lit("_"), (F.col("l_linenumber") % 3).cast("string")))


def incomplete_targets(spark: SparkSession, d: str) -> DataFrame:
    return S.of_markers(_targets(spark, d), _odd(spark, d), shorten=True).select("target", *K)


def not_retrieved(spark: SparkSession, d: str) -> DataFrame:
    return S.not_retrieved(view(spark, d, "cutoffs"), _targets(spark, d).where("g_end - g_start > 2900"))


def contig_selection(spark: SparkSession, d: str) -> DataFrame:
    seqs = view(spark, d, "hits").select(F.col("contig").alias("seq_id"), *K)
    return S.of_contigs(seqs, view(spark, d, "hits").where("score > 104000").select("contig"))


def gff_line_ranges(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    ranges = e.select(F.col("event_id").alias("gene"), F.col("event_id").alias("first"), (F.col("event_id") + F.col("user_id") % 40).alias("last"))
    return S.lines_in_ranges(e.select(F.col("event_id").alias("line_no")), ranges, width=64).select("gene", "line_no")


def region_ordinals(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "regions").withColumn("size", F.col("end") - F.col("start"))
    return S.numbered(rows, [F.col("event_id")]).select("marker", "event_id", "size", F.col("ordinal").cast("long").alias("ordinal"))


def job_order(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "regions").withColumn("size", F.col("end") - F.col("start"))
    return S.longest_first(rows, [F.col("event_id")]).select("marker", "event_id", "size")


def gene_details_upsert(spark: SparkSession, d: str) -> DataFrame:
    h = view(spark, d, "hits").groupBy("contig", (F.col("l_linenumber") % 2).alias("round")).agg(F.max("score").alias("score"), F.max("g_end").alias("g_end"))
    first, later = (h.where(F.col("round") == k).withColumnRenamed("contig", "gene") for k in (0, 1))
    return S.newest(first, later.where("g_end % 2 = 1 or score < 104500"), "gene").select("gene", "round", "score")


def genome_length(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return S.genome_length(docs.select(F.col("source").alias("input"), F.explode(F.split("text", "\n")).alias("line")), ["input"])


def coding_length(spark: SparkSession, d: str) -> DataFrame:
    return S.coding_length(view(spark, d, "hits").select("contig", F.col("g_start").alias("start"), F.col("g_end").alias("end")), ["contig"])


def dense_runs(spark: SparkSession, d: str) -> DataFrame:
    c = S.coding_length(view(spark, d, "hits").select("contig", "flag", F.col("g_start").alias("start"), F.col("g_end").alias("end")), ["contig", "flag"])
    return S.dense_enough(c.withColumn("density", F.col("coding") / 1_000_000), 0.9)


def viral_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "cutoffs").select("marker", (F.col("p_size") / 10).alias("s_percent"), (F.col("p_size") * 20_000).cast("long").alias("input_bytes"))
    return S.viral(rows)


def shared_exons(spark: SparkSession, d: str) -> DataFrame:
    x = view(spark, d, "exons").select("contig", "low", "high", "strand")
    return S.shared_rows(x.where("low % 2 = 0"), x.where("high % 3 = 0"))


def profile_jobs(spark: SparkSession, d: str) -> DataFrame:
    files = _targets(spark, d).select(F.concat(F.lit("dir/"), "target", F.lit(".faa")).alias("file")).distinct()
    return S.profile_jobs(_odd(spark, d), files)


QUERIES = {f.__name__: f for f in (incomplete_targets, not_retrieved, contig_selection, gff_line_ranges, region_ordinals, job_order, gene_details_upsert, genome_length, coding_length, dense_runs, viral_runs, shared_exons, profile_jobs)}

_K = ", ".join(K)
_ODD = "(SELECT marker FROM cutoffs WHERE p_size % 3 = 1)"
SQL = {
    "incomplete_targets": with_views("hits", "cutoffs") + f" SELECT marker AS target, {_K} FROM hits WHERE marker IN {_ODD}",
    "not_retrieved": with_views("hits", "cutoffs") + " SELECT marker FROM cutoffs WHERE marker NOT IN (SELECT marker FROM hits WHERE g_end - g_start > 2900)",
    "contig_selection": with_views("hits") + f" SELECT contig AS seq_id, {_K} FROM hits WHERE contig IN (SELECT contig FROM hits WHERE score > 104000)",
    "gff_line_ranges": "SELECT a.event_id AS gene, b.event_id AS line_no FROM events a JOIN events b ON b.event_id >= a.event_id AND b.event_id < a.event_id + a.user_id % 40",
    "region_ordinals": with_views("regions") + ' SELECT marker, event_id, "end" - start AS size, row_number() OVER (PARTITION BY marker ORDER BY "end" - start DESC, event_id) AS ordinal FROM regions',
    "job_order": with_views("regions") + ' SELECT marker, event_id, "end" - start AS size FROM regions',
    "gene_details_upsert": with_views("hits") + """, h AS (SELECT contig AS gene, l_linenumber % 2 AS round, max(score) AS score, max(g_end) AS g_end FROM hits GROUP BY ALL),
l AS (SELECT * FROM h WHERE round = 1 AND (g_end % 2 = 1 OR score < 104500)) SELECT gene, round, score FROM l UNION ALL SELECT gene, round, score FROM h WHERE round = 0 AND gene NOT IN (SELECT gene FROM l)""",
    "genome_length": "WITH l AS (SELECT source AS input, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT input, CAST(sum(length(s) + 1) AS BIGINT) AS length FROM l WHERE s NOT LIKE '>%' GROUP BY input",
    "coding_length": with_views("hits") + " SELECT contig, CAST(sum(g_end - g_start) AS BIGINT) AS coding FROM hits GROUP BY contig",
    "dense_runs": with_views("hits") + " SELECT contig, flag, CAST(sum(g_end - g_start) AS BIGINT) AS coding, sum(g_end - g_start) / 1000000 AS density FROM hits GROUP BY ALL HAVING sum(g_end - g_start) / 1000000 >= 0.9",
    "viral_runs": with_views("cutoffs") + " SELECT marker, p_size / 10 AS s_percent, CAST(p_size * 20000 AS BIGINT) AS input_bytes FROM cutoffs WHERE p_size / 10 < 3.0 AND p_size * 20000 < 500000",
    "shared_exons": with_views("exons") + " SELECT contig, low, high, strand FROM exons WHERE low % 2 = 0 INTERSECT SELECT contig, low, high, strand FROM exons WHERE high % 3 = 0",
    "profile_jobs": with_views("hits", "cutoffs") + f" SELECT DISTINCT marker, concat('dir/', marker, '_', CAST(l_linenumber % 3 AS STRING), '.faa') AS file FROM hits WHERE marker IN {_ODD}",
}
