"""Queries from hits to statuses, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.scalars import percent, python_round
from lociq.operators import hits as H
from lociq.operators.intervals import union_length
from lociq.plans.adapters import view, with_views

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
GENE = "concat(contig, ':', CAST(g_start AS STRING), '-', CAST(g_end AS STRING))"


def _line() -> Column:
    return F.struct("l_orderkey", "l_linenumber", "l_suppkey", "score")


def _ties() -> list[Column]:
    return [F.col("file"), F.col("target")]


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, d, "hits"), view(spark, d, "cutoffs")


def hit_cutoff_filter(spark: SparkSession, d: str) -> DataFrame:
    h, c = _hits(spark, d)
    return H.pass_cutoff(h, c).select("marker", "target", "score", "cutoff", *KEY)


def interval_union_length(spark: SparkSession, d: str) -> DataFrame:
    return union_length(view(spark, d, "hits"), ["marker", "contig"], "g_start", "g_end")


def top_domain_filter(spark: SparkSession, d: str) -> DataFrame:
    return H.top_domains(view(spark, d, "hits"), ["marker", "contig"]).select("marker", "contig", "score", *KEY)


def target_facts(spark: SparkSession, d: str) -> DataFrame:
    """Targets are (marker, contig) here, so that each has several domains."""
    h = view(spark, d, "hits").withColumn("line", _line())
    return H.targets(h, ["marker", "contig"], "line")


def _targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h, c = _hits(spark, d)
    keys = ["marker", "target", "contig", "g_start", "g_end", "strand"]
    t = H.targets(h.withColumn("line", _line()), keys, "line")
    return t.withColumns({"gene": F.expr(GENE), "file": F.concat("marker", F.lit(".out"))}), c


def _passed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, c = _targets(spark, d)
    return t.join(c.select("marker", "cutoff"), "marker").where("first_score >= cutoff").withColumn("score", F.col("first_score")), c


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, c = _passed(spark, d)
    one = H.classify_by_length(t, c)
    return H.upsert_rounds(one, within="target"), c


def classify_zeta(spark: SparkSession, d: str) -> DataFrame:
    t, c = _passed(spark, d)
    return H.classify_by_length(t, c).select("marker", "target", "gene", "rank", "matched_length", F.round("zeta", 6).alias("zeta"))


def classify_ratio(spark: SparkSession, d: str) -> DataFrame:
    t, _ = _passed(spark, d)
    return H.classify_by_profile(t).select("marker", "target", "gene", "rank", "matched_length")


def rank_resolution(spark: SparkSession, d: str) -> DataFrame:
    r, _ = _ranked(spark, d)
    return H.resolve_ranks(r).select("marker", "gene", "rank", "score")


def best_marker_per_gene(spark: SparkSession, d: str) -> DataFrame:
    r, _ = _ranked(spark, d)
    return H.best_marker_per_gene(r, _ties()).select("marker", "gene", "rank", "score")


def relative_score_filter(spark: SparkSession, d: str) -> DataFrame:
    r, _ = _ranked(spark, d)
    return H.relative_score_filter(r).select("marker", "gene", "rank", "score")


def best_fragment(spark: SparkSession, d: str) -> DataFrame:
    r, _ = _ranked(spark, d)
    return H.best_fragment(r.where("rank = 'fragment'"), _ties()).select("marker", "gene", "score")


def _statuses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r, c = _ranked(spark, d)
    return H.status_flow(r, c, _ties())


def status_table(spark: SparkSession, d: str) -> DataFrame:
    return _statuses(spark, d)[1]


def status_summary(spark: SparkSession, d: str) -> DataFrame:
    s = H.summarise(_statuses(spark, d)[1])
    return s.withColumn("notation", H.notation(s))


def missing_markers(spark: SparkSession, d: str) -> DataFrame:
    return H.missing_markers(_statuses(spark, d)[1]).orderBy("marker")


def incomplete_markers(spark: SparkSession, d: str) -> DataFrame:
    return H.incomplete_markers(_statuses(spark, d)[1])


def result_table_sorted(spark: SparkSession, d: str) -> DataFrame:
    kept, statuses = _statuses(spark, d)
    annotation = view(spark, d, "cutoffs").select("marker", "description")
    return H.result_table(statuses, kept.withColumn("matched_length", F.col("matched_length").cast("double")), annotation)


def round_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds: odd and even line numbers; the second replaces equal (rank, marker, gene)."""
    h, c = _hits(spark, d)
    h = h.withColumns({"gene": F.concat("contig", F.lit(":"), (F.col("g_start") % 300).cast("string")), "rank": F.lit("complete"), "file": F.col("target")})
    order = F.struct(*KEY, "score")
    parts = [h.where(F.col("l_linenumber") % 2 == k).withColumn("order", order) for k in (1, 0)]
    return H.upsert_rounds(*parts, within="order").select("marker", "gene", "score", *KEY)


def greedy_target_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Greedy suppression among targets of a marker on a contig, by matched length, score and name, with the cutoff inside."""
    t, c = _targets(spark, d)
    return H.suppress_overlapping_genes(t, c.withColumn("cutoff", F.col("cutoff") / 4)).select("marker", "contig", "target", "g_start", "g_end", "strand", "best")


def stop_codon_summary(spark: SparkSession, d: str) -> DataFrame:
    kept, statuses = _statuses(spark, d)
    h = view(spark, d, "hits").groupBy("marker", F.expr(GENE).alias("gene")).agg(F.count_if(F.col("flag") == "O").alias("stops"), F.avg(F.lit(100) - F.col("discount") * 100).alias("identity"))
    genes = kept.select("marker", "gene").distinct().join(h, ["marker", "gene"]).join(statuses, "marker")
    return H.stop_summary(genes.withColumn("identity", F.round("identity", 0)))


def parasite_check(spark: SparkSession, d: str) -> DataFrame:
    listed = view(spark, d, "cutoffs").where("p_size % 25 = 3").select("marker")
    return H.parasite_check(_statuses(spark, d)[1], listed)


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row per input file (order priority stands for a file): counts and percentages of markers found in it."""
    h, c = _hits(spark, d)
    h = h.withColumn("input", F.concat(F.lit("in"), (F.col("l_orderkey") % 5).cast("string")))
    found = H.pass_cutoff(h, c).groupBy("input", "marker").agg(F.countDistinct("target").alias("n"))
    status = F.when(F.col("n") == 1, "Complete").otherwise("Duplicated")
    out = H.summarise_found(found.withColumn("status", status), found, c.agg(F.count("*").alias("n")), ["input"])
    return out.select("input", "s", "d", "f", "n", "m", "c", *(f"{k}_percent" for k in "csdfm"))


def plot_table(spark: SparkSession, d: str) -> DataFrame:
    """Tidy chart rows; here the missing share is what the others leave of 100."""
    s = H.summarise(_statuses(spark, d)[1])
    rest = F.col("s") + F.col("d") + F.col("f")
    p = {k: percent(F.col(k), F.col("n")) for k in "sdf"}
    p["m"] = python_round(F.lit(100.0) - p["s"] - p["d"] - p["f"], 1)
    rows = F.array(*(F.struct(F.lit(k.upper()).alias("category"), (F.col("n") - rest if k == "m" else F.col(k)).alias("n_markers"), p[k].alias("percent")) for k in "sdfm"))
    return s.select(F.explode(rows).alias("x")).select("x.*")


def dataset_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Jobs a profile search would run: markers with a cutoff times contigs that hold a target."""
    h, c = _hits(spark, d)
    return h.join(c.select("marker"), "marker", "left_semi").groupBy("contig").agg(F.countDistinct("marker").alias("n_jobs"))


QUERIES = {f.__name__: f for f in (hit_cutoff_filter, interval_union_length, top_domain_filter, target_facts, classify_zeta, classify_ratio, rank_resolution, best_marker_per_gene, relative_score_filter, best_fragment, status_table, status_summary, missing_markers, incomplete_markers, result_table_sorted, round_upsert, greedy_target_suppression, stop_codon_summary, parasite_check, batch_summary, plot_table, dataset_sizes)}

_FLOW = (
    with_views("hits", "cutoffs")
    + f""",
top AS (SELECT *, {GENE} AS gene, max(score) OVER (PARTITION BY marker, target, contig, g_start, g_end, strand) AS best FROM hits),
facts AS (SELECT marker, target, contig, g_start, g_end, strand, gene, max(best) AS best, min_by(score, ROW(l_orderkey, l_linenumber, l_suppkey, score)) AS score, min_by(qlen, ROW(l_orderkey, l_linenumber, l_suppkey, score)) AS qlen
  FROM top GROUP BY ALL),
pts AS (SELECT DISTINCT marker, target, contig, g_start, g_end, strand, unnest(range(hmm_from, hmm_to + 1)) AS p FROM top WHERE score = best),
lens AS (SELECT marker, target, contig, g_start, g_end, strand, count(*) AS matched_length FROM pts GROUP BY ALL),
targets AS (SELECT f.*, matched_length FROM facts f JOIN lens USING (marker, target, contig, g_start, g_end, strand)),
passed AS (SELECT t.*, c.length, c.sigma FROM targets t JOIN cutoffs c USING (marker) WHERE score >= cutoff),
classed AS (SELECT *, (length - matched_length) / sigma AS zeta, CASE WHEN abs((length - matched_length) / sigma) <= 2 THEN 'complete' WHEN (length - matched_length) / sigma < -2 THEN 'very_large' ELSE 'fragment' END AS rank FROM passed),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rank, marker, gene ORDER BY target DESC) AS n FROM classed) WHERE n = 1),
co AS (SELECT * FROM ranked WHERE rank = 'complete'),
vl AS (SELECT * FROM ranked WHERE rank = 'very_large' AND marker NOT IN (SELECT marker FROM co) AND gene NOT IN (SELECT gene FROM co)),
up AS (SELECT marker, gene FROM co UNION ALL SELECT marker, gene FROM vl),
fr AS (SELECT * FROM ranked WHERE rank = 'fragment' AND marker NOT IN (SELECT marker FROM up) AND gene NOT IN (SELECT gene FROM up)),
resolved AS (SELECT * FROM co UNION ALL SELECT * FROM vl UNION ALL SELECT * FROM fr),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rank, gene ORDER BY score DESC, marker || '.out', target) AS k FROM resolved) WHERE k = 1),
close AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY rank, marker) AS t FROM one) WHERE score >= 0.85 * t),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY marker, rank ORDER BY score DESC, matched_length DESC, target) AS place FROM close) WHERE rank <> 'fragment' OR place = 1),
per AS (SELECT marker, count(*) FILTER (rank <> 'fragment') AS w, count(*) FILTER (rank = 'fragment') AS f FROM kept GROUP BY marker),
statuses AS (SELECT c.marker, CASE WHEN w = 1 THEN 'Complete' WHEN w > 1 THEN 'Duplicated' WHEN f > 0 THEN 'Fragmented' ELSE 'Missing' END AS status FROM cutoffs c LEFT JOIN per USING (marker)),
counts AS (SELECT count(*) FILTER (status = 'Complete') AS s, count(*) FILTER (status = 'Duplicated') AS d, count(*) FILTER (status = 'Fragmented') AS f, count(*) AS n, count(*) FILTER (status = 'Missing') AS m,
  count(*) FILTER (status IN ('Complete', 'Duplicated')) AS c FROM statuses)
"""
)
_P = lambda x, n="n": f"CAST(format('{{:.1f}}', {x} * 1.0::DOUBLE / {n} * 100) AS DOUBLE)"
_PERCENTS = ", ".join(f"{_P(k)} AS {k}_percent" for k in "csdfm")
_KEYS = ", ".join(KEY)
SQL = {
    "hit_cutoff_filter": with_views("hits", "cutoffs") + f" SELECT marker, target, score, cutoff, {_KEYS} FROM hits JOIN cutoffs USING (marker) WHERE score >= cutoff",
    "interval_union_length": with_views("hits") + ", p AS (SELECT DISTINCT marker, contig, unnest(range(g_start, g_end + 1)) AS x FROM hits) SELECT marker, contig, count(*) AS matched_length FROM p GROUP BY ALL",
    "top_domain_filter": with_views("hits") + f" SELECT marker, contig, score, {_KEYS} FROM hits h WHERE score = (SELECT max(score) FROM hits g WHERE g.marker = h.marker AND g.contig = h.contig)",
    "target_facts": with_views("hits") + """, t AS (SELECT *, max(score) OVER (PARTITION BY marker, contig) AS best FROM hits),
p AS (SELECT DISTINCT marker, contig, unnest(range(hmm_from, hmm_to + 1)) AS x FROM t WHERE score = best), l AS (SELECT marker, contig, count(*) AS matched_length FROM p GROUP BY ALL),
f AS (SELECT marker, contig, max(score) AS best, min_by(score, ROW(l_orderkey, l_linenumber, l_suppkey, score)) AS first_score, min_by(qlen, ROW(l_orderkey, l_linenumber, l_suppkey, score)) AS qlen FROM hits GROUP BY ALL)
SELECT * FROM f JOIN l USING (marker, contig)""",
    "classify_zeta": _FLOW + "SELECT marker, target, gene, rank, matched_length, round(zeta, 6) AS zeta FROM classed",
    "classify_ratio": _FLOW + "SELECT marker, target, gene, CASE WHEN matched_length >= 0.8 * qlen THEN 'complete' ELSE 'fragment' END AS rank, matched_length FROM passed",
    "rank_resolution": _FLOW + "SELECT marker, gene, rank, score FROM resolved",
    "best_marker_per_gene": _FLOW + "SELECT marker, gene, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY rank, gene ORDER BY score DESC, marker || '.out', target) AS k FROM ranked) WHERE k = 1",
    "relative_score_filter": _FLOW + "SELECT marker, gene, rank, score FROM ranked r WHERE score >= 0.85 * (SELECT max(score) FROM ranked q WHERE q.rank = r.rank AND q.marker = r.marker)",
    "best_fragment": _FLOW + "SELECT marker, gene, score FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY score DESC, target) AS k FROM ranked WHERE rank = 'fragment') WHERE k = 1",
    "status_table": _FLOW + "SELECT * FROM statuses",
    "status_summary": _FLOW + f"""SELECT s, d, f, n, m, c, {_PERCENTS},
  format('C:{{:.1f}}%[S:{{:.1f}}%,D:{{:.1f}}%],F:{{:.1f}}%,M:{{:.1f}}%,n:{{}}', {', '.join(f'{k} * 1.0::DOUBLE / n * 100' for k in 'csdfm')}, n) AS notation FROM counts""",
    "missing_markers": _FLOW + "SELECT marker FROM statuses WHERE status = 'Missing'",
    "incomplete_markers": _FLOW + "SELECT marker FROM statuses WHERE status IN ('Missing', 'Fragmented')",
    "result_table_sorted": _FLOW + "SELECT s.marker, s.status, k.gene, k.score, CAST(k.matched_length AS DOUBLE) AS matched_length, c.description FROM statuses s LEFT JOIN kept k USING (marker) LEFT JOIN cutoffs c USING (marker)",
    "round_upsert": with_views("hits") + f""", h AS (SELECT *, concat(contig, ':', CAST(g_start % 300 AS STRING)) AS gene FROM hits)
SELECT marker, gene, score, {_KEYS} FROM (SELECT *, row_number() OVER (PARTITION BY marker, gene ORDER BY l_linenumber % 2, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, score DESC) AS k FROM h) WHERE k = 1""",
    "greedy_target_suppression": _FLOW + """, w AS (SELECT t.*, t.score >= c.cutoff / 4 AS ok FROM targets t JOIN cutoffs c USING (marker)),
g AS (SELECT list_reduce(list([{'r': ROW(contig, target, g_start, g_end, strand, best), 's': g_start, 'e': g_end, 'ok': ok}] ORDER BY matched_length DESC, best DESC, target),
  lambda a, x: CASE WHEN NOT x[1].ok OR len(list_filter(a, lambda y: y.ok AND y.s <= x[1].e AND x[1].s <= y.e)) > 0 THEN a ELSE list_concat(a, x) END) AS k, marker, contig FROM w GROUP BY marker, contig),
u AS (SELECT marker, unnest(k) AS x FROM g)
SELECT marker, x.r[1] AS contig, x.r[2] AS target, x.r[3] AS g_start, x.r[4] AS g_end, x.r[5] AS strand, x.r[6] AS best FROM u WHERE x.ok""",
    "stop_codon_summary": _FLOW + f""", h AS (SELECT marker, {GENE} AS gene, count(*) FILTER (flag = 'O') AS stops, round(avg(100 - discount * 100)) AS identity FROM hits GROUP BY ALL),
g AS (SELECT h.*, status FROM (SELECT DISTINCT marker, gene FROM kept) JOIN h USING (marker, gene) JOIN statuses USING (marker)),
m AS (SELECT marker, bool_and(stops > 0) AS b FROM g WHERE status IN ('Complete', 'Duplicated') GROUP BY marker)
SELECT count(*) FILTER (b) AS n_stopped, count(*) AS n_complete, {_P('count(*) FILTER (b)', 'count(*)')} AS e_percent, (SELECT CAST(format('{{:.2f}}', avg(identity)) AS DOUBLE) FROM g) AS avg_identity FROM m""",
    "parasite_check": _FLOW + f""", l AS (SELECT marker FROM cutoffs WHERE p_size % 25 = 3),
x AS (SELECT (SELECT count(*) FROM l) AS n_list, m AS n_missing, (SELECT count(*) FROM statuses JOIN l USING (marker) WHERE status = 'Missing') AS n_both, s, d, f, n - (SELECT count(*) FROM l) AS n FROM counts),
y AS (SELECT *, CASE WHEN n_missing > 0 THEN n_both / n_missing * 100 ELSE 0 END AS share, {_P('s')} AS s_percent, {_P('d')} AS d_percent, {_P('f')} AS f_percent FROM x)
SELECT n_list, n_missing, n_both, s, d, f, n, CAST(format('{{:.1f}}', share) AS DOUBLE) AS overlap_percent, n_missing >= 0.8 * n_list AND share >= 80 AS parasitic, s_percent, d_percent, f_percent,
  CAST(format('{{:.1f}}', s_percent + d_percent) AS DOUBLE) AS c_percent, CAST(format('{{:.1f}}', 100 - s_percent - d_percent - f_percent) AS DOUBLE) AS m_percent FROM y""",
    "batch_summary": with_views("hits", "cutoffs") + f""", f AS (SELECT concat('in', CAST(l_orderkey % 5 AS STRING)) AS input, marker, count(DISTINCT target) AS k FROM hits JOIN cutoffs USING (marker) WHERE score >= cutoff GROUP BY ALL),
g AS (SELECT i.input, c.marker, k FROM (SELECT DISTINCT input FROM f) i CROSS JOIN cutoffs c LEFT JOIN f ON f.input = i.input AND f.marker = c.marker),
counts AS (SELECT input, count(*) FILTER (k = 1) AS s, count(*) FILTER (k > 1) AS d, CAST(0 AS BIGINT) AS f, count(*) AS n, count(*) FILTER (k IS NULL) AS m, count(k) AS c FROM g GROUP BY input)
SELECT input, s, d, f, n, m, c, {_PERCENTS} FROM counts""",
    "plot_table": _FLOW + f""", p AS (SELECT *, {_P('s')} AS ps, {_P('d')} AS pd, {_P('f')} AS pf FROM counts)
SELECT 'S' AS category, s AS n_markers, ps AS percent FROM p UNION ALL SELECT 'D', d, pd FROM p UNION ALL SELECT 'F', f, pf FROM p UNION ALL SELECT 'M', m, CAST(format('{{:.1f}}', 100.0::DOUBLE - ps - pd - pf) AS DOUBLE) FROM p""",
    "dataset_sizes": with_views("hits", "cutoffs") + " SELECT contig, count(DISTINCT marker) AS n_jobs FROM hits WHERE marker IN (SELECT marker FROM cutoffs) GROUP BY contig",
}
