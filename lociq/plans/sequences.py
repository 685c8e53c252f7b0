"""Queries over sequences, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import scalars as X
from lociq.operators import alignments as A
from lociq.operators import assembly as S
from lociq.plans.adapters import view, with_views


def assembly_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two Ns or more part contigs here: the test sequences have few long gaps."""
    m = S.metrics(view(spark, d, "dna"), ["input"], 2)
    return m.withColumn("gap_percent", F.round("gap_percent", 6))


def alphabet_check(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seqs = docs.select(F.col("source").alias("input"), F.col("doc_id").alias("seq_id"), F.when(F.col("doc_id") % 20 < 12, F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "bdefhijklmopqrsuvwxyz", "acgtacgtacgtacgtacgt" + "n")).otherwise(F.regexp_replace(F.lower("text"), "[^a-z]", "")).alias("seq"))
    return S.is_nucleotide(seqs, ["input"], "seq_id").join(S.is_protein(seqs, ["input"], "seq_id"), "input")


def fasta_header_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lines = docs.select(F.col("source").alias("input"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return S.header_audit(lines.select("input", F.concat(F.lit(">"), "line").alias("header")), ["input"])


def six_frame_translation(spark: SparkSession, d: str) -> DataFrame:
    return S.translations(view(spark, d, "dna")).select("seq_id", "frame", "protein")


def cigar_frameshifts(spark: SparkSession, d: str) -> DataFrame:
    h = view(spark, d, "hits")
    part = lambda n, op: F.concat((n).cast("bigint").cast("string"), F.lit(op))
    k, q = F.col("l_orderkey"), F.col("l_linenumber")
    cigar = F.concat(part(k % 50 + 1, "M"), part(q, "F"), part(k % 37 + 1, "M"), part(q * 100, "N"), part(k % 31, "M"), part(q % 3 + 1, "G"), part(k % 53, "M"), part(q, "D"), part(k % 11, "M"))
    out = h.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cigar.alias("cigar"))
    return out.withColumn("f", X.frameshifts(F.col("cigar"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("f.events").cast("long").alias("events"), F.col("f.length").cast("long").alias("length"))


def internal_stops(spark: SparkSession, d: str) -> DataFrame:
    raw = view(spark, d, "dna").select("seq_id", F.replace(X.translate(F.col("seq")), F.lit("X"), F.lit("*")).alias("protein"))
    return raw.select("seq_id", X.internal_stops(F.col("protein")).cast("long").alias("stops"), F.length(X.cleaned_protein(F.col("protein"))).cast("long").alias("length"))


def identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every identifier rule on targets marker_k|contig|with|pipes:start-end|strand."""
    h = view(spark, d, "hits")
    target = F.concat("marker", F.lit("_"), (F.col("l_linenumber") % 3).cast("string"), F.lit("|"), "contig", F.lit("|p:"), F.col("g_start").cast("string"), F.lit("-"), F.col("g_end").cast("string"), F.lit("|"), "strand")
    gene = X.gene_of_target(F.col("t"))
    start, end = X.reported_place(F.col("low"), F.col("high"), F.col("strand"))
    rows = h.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "strand", target.alias("t"))
    rows = rows.select("*", gene.alias("gene"), X.marker_base(F.col("t")).alias("base"), X.marker_in(F.col("t")).alias("marker"))
    rows = rows.select("*", X.marker_number(F.col("base")).alias("number"), X.gene_contig(F.col("gene")).alias("contig"), X.gene_start(F.col("gene")).alias("low"), X.gene_end(F.col("gene")).alias("high"), X.without_place(F.col("gene")).alias("bare"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "gene", "base", "marker", "number", "contig", "bare", start.alias("first"), end.alias("last"), X.frame(F.col("low")).alias("frame"))


def genes_per_marker(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "hits").withColumn("gene", F.col("contig"))
    return A.genes_per_marker(rows).select("marker", F.array_join("genes", ",").alias("genes"))


QUERIES = {f.__name__: f for f in (assembly_metrics, alphabet_check, fasta_header_audit, six_frame_translation, cigar_frameshifts, internal_stops, identifier_parts, genes_per_marker)}

_N50 = lambda src, name: f"""(SELECT input, min(len) AS {name} FROM (SELECT input, len, sum(len) OVER (PARTITION BY input ORDER BY len DESC, i) AS r, sum(len) OVER (PARTITION BY input) AS t, sum(len) OVER (PARTITION BY input ORDER BY len DESC, i) - len AS before FROM {src}) WHERE before * 2 < t GROUP BY input)"""
_CODONS = "map([" + ", ".join(f"'{a}{b}{c}'" for a in "TCAG" for b in "TCAG" for c in "TCAG") + "], [" + ", ".join(f"'{x}'" for x in X.AMINO_ACIDS.replace("*", "X")) + "])"
_TR = lambda s: f"array_to_string(list_transform(regexp_extract_all({s}, '...'), lambda c: coalesce({_CODONS}[c], 'X')), '')"
SQL = {
    "assembly_metrics": with_views("dna") + f""", sc AS (SELECT input, seq_id AS i, length(seq) AS len, length(regexp_replace(seq, '[^N]', '', 'g')) AS n FROM dna),
ct AS (SELECT input, row_number() OVER () AS i, length(p) AS len FROM (SELECT input, unnest(regexp_split_to_array(seq, 'NN+')) AS p FROM dna) WHERE length(p) > 0),
f AS (SELECT input, count(*) AS n_scaffolds, CAST(sum(len) AS BIGINT) AS total_length, CAST(sum(n) AS BIGINT) AS n_gap FROM sc GROUP BY input), c AS (SELECT input, count(*) AS n_contigs FROM ct GROUP BY input)
SELECT f.*, n_contigs, scaffold_n50, contig_n50, round(n_gap * 100 / total_length, 6) AS gap_percent FROM f JOIN c USING (input) JOIN {_N50('sc', 'scaffold_n50')} USING (input) JOIN {_N50('ct', 'contig_n50')} USING (input)""",
    "alphabet_check": """WITH q AS (SELECT source AS input, doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM documents),
s AS (SELECT input, doc_id, upper(CASE WHEN doc_id % 20 < 12 THEN translate(t, 'bdefhijklmopqrsuvwxyz', 'acgtacgtacgtacgtacgtn') ELSE t END) AS seq FROM q),
b AS (SELECT *, coalesce(sum(length(seq)) OVER (PARTITION BY input ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY input ORDER BY doc_id) AS k FROM s),
n AS (SELECT input, bool_and(regexp_full_match(substr(seq, 1, CAST(5001 - before AS BIGINT)), '[ACTGNYRWSKMDVHB]*')) AS nucleotide FROM b WHERE before < 5001 GROUP BY input),
p AS (SELECT input, coalesce(min_by(regexp_extract(seq, '([^ACGTN])', 1), k) FILTER (regexp_matches(seq, '[^ACGTN]')), '') AS odd FROM b WHERE k <= 11 GROUP BY input)
SELECT input, nucleotide, regexp_matches(odd, '[FLIMVSPTAYXHQNKDECWRG*]') AS protein FROM n JOIN p USING (input)""",
    "fasta_header_audit": f"""WITH l AS (SELECT source AS input, unnest(string_split(text, chr(10))) AS s FROM documents), h AS (SELECT input, '>' || s AS h FROM l WHERE s <> ''),
r AS (SELECT input, regexp_extract(h, '^>(\\S*)', 1) AS id, regexp_matches(h, '{'|'.join(S.FORBIDDEN)}') OR regexp_matches(regexp_extract(h, '^>(\\S*)', 1), '[/"]') AS bad, regexp_matches(h, '^>(\\s|$)') AS spaced FROM h),
g AS (SELECT input, id, count(*) AS n, count(*) FILTER (bad) AS b, count(*) FILTER (spaced) AS sp FROM r GROUP BY ALL)
SELECT input, CAST(sum(n) AS BIGINT) AS n_headers, CAST(sum(b) AS BIGINT) AS n_forbidden, CAST(sum(sp) AS BIGINT) AS n_spaced, count(*) FILTER (n > 1) AS n_repeated_ids FROM g GROUP BY input""",
    "six_frame_translation": with_views("dna") + f""", s AS (SELECT seq_id, seq AS f, translate(reverse(seq), 'ACGT', 'TGCA') AS r FROM dna),
fr AS (SELECT seq_id, unnest([1, 2, 3]) AS frame, f AS x FROM s UNION ALL SELECT seq_id, unnest([-1, -2, -3]) AS frame, r FROM s),
y AS (SELECT seq_id, frame, substr(x, abs(frame)) AS z FROM fr) SELECT seq_id, frame, {_TR('z')} AS protein FROM y""",
    "cigar_frameshifts": with_views("hits") + """, c AS (SELECT row_number() OVER () AS r, l_orderkey, l_linenumber, l_partkey, l_suppkey, concat(l_orderkey % 50 + 1, 'M', l_linenumber, 'F', l_orderkey % 37 + 1, 'M', l_linenumber * 100, 'N', l_orderkey % 31, 'M', l_linenumber % 3 + 1, 'G', l_orderkey % 53, 'M', l_linenumber, 'D', l_orderkey % 11, 'M') AS cigar FROM hits),
t AS (SELECT * EXCLUDE (cigar), unnest(regexp_extract_all(cigar, '[0-9]+[A-Z]')) AS x, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[A-Z]'), 1) AS i FROM c),
e AS (SELECT *, CAST(substr(x, 1, length(x) - 1) AS BIGINT) AS n, substr(x, length(x)) AS op, count(*) FILTER (substr(x, length(x)) IN ('N', 'U', 'V')) OVER (PARTITION BY r ORDER BY i) AS exon FROM t),
m AS (SELECT *, sum(CASE WHEN op = 'M' THEN n ELSE 0 END) OVER (PARTITION BY r, exon ORDER BY i) AS before, sum(CASE WHEN op = 'M' THEN n ELSE 0 END) OVER (PARTITION BY r, exon) AS whole FROM e),
f AS (SELECT *, op IN ('F', 'G') AND before >= 20 AND whole - before >= 20 AS hit FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) FILTER (hit) AS events, CAST(coalesce(sum(n) FILTER (hit), 0) AS BIGINT) AS length FROM f GROUP BY r, l_orderkey, l_linenumber, l_partkey, l_suppkey""",
    "identifier_parts": with_views("hits") + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat(contig, '|p:', g_start, '-', g_end) AS gene, marker AS base, marker, CAST(split_part(marker, 'at', 1) AS BIGINT) AS number, concat(contig, '|p') AS contig, concat(contig, '|p') AS bare,
CASE WHEN strand = '-' THEN g_end ELSE g_start END AS first, CASE WHEN strand = '-' THEN g_start ELSE g_end END AS last, g_start % 3 AS frame FROM hits""",
    "internal_stops": with_views("dna") + f""", t AS (SELECT seq_id, replace({_TR('seq')}, 'X', '*') AS p FROM dna)
SELECT seq_id, CAST(length(trim(p, '*')) - length(replace(trim(p, '*'), '*', '')) AS BIGINT) AS stops, length(replace(p, '*', '')) AS length FROM t""",
    "genes_per_marker": with_views("hits") + " SELECT marker, string_agg(DISTINCT contig, ',' ORDER BY contig) AS genes FROM hits GROUP BY marker",
}
