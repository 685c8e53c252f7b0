"""Queries over regions, alignments, exons and lineages, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators import alignments as A
from lociq.operators import exons as E
from lociq.operators import lineage as L
from lociq.operators import regions as R
from lociq.operators.intervals import greedy_accept, islands, merged_size
from lociq.plans.adapters import view, with_views


def _order() -> list[Column]:
    return [F.col("evalue"), F.col("event_id")]


def greedy_gene_suppression(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "regions")
    return greedy_accept(rows, ["marker", "contig"], [-F.col("evalue"), F.col("event_id")], "start", "end").select("marker", "contig", "event_id", "start", "end")


def overlap_islands(spark: SparkSession, d: str) -> DataFrame:
    return islands(view(spark, d, "regions"), ["contig"], "start", "end", width=1024).groupBy("contig", "island").agg(F.count("*").alias("n"), F.min("start").alias("low"), F.max("end").alias("high"))


def greedy_alignment_suppression(spark: SparkSession, d: str) -> DataFrame:
    return A.suppress_overlapping(view(spark, d, "alignments")).select("aln_id", "contig", "start", "end")


def region_accumulate(spark: SparkSession, d: str) -> DataFrame:
    return R.accumulate(view(spark, d, "far_regions"), _order()).select("marker", "contig", "start", "end", "evalue", F.size("spans").cast("long").alias("n_spans"))


def region_merge_sum(spark: SparkSession, d: str) -> DataFrame:
    return merged_size(view(spark, d, "regions"), ["marker", "contig"], "start", "end")


def topk_regions(spark: SparkSession, d: str) -> DataFrame:
    return R.top_contigs(view(spark, d, "regions"), 3, [F.col("event_id")]).select("marker", "contig", "event_id", "evalue")


def best_variant(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "regions").withColumn("marker", F.concat((F.split("marker", "at")[0].cast("bigint") % 40).cast("string"), F.lit("at7_"), (F.col("event_id") % 3).cast("string")))
    return R.best_variant(rows, [F.col("event_id")]).select("base", "marker", "contig", "event_id", "evalue")


def size_relative_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.large_enough(merged_size(view(spark, d, "regions"), ["marker", "contig"], "start", "end"))


def flank_extend(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "far_regions")
    width = R.flank((F.col("event_id") * 300_000).cast("double"))
    return R.extend(rows, width).select("event_id", "start", "end")


def region_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Accumulate, top contigs, size filter: the candidate regions of each marker."""
    made = R.top_contigs(R.accumulate(view(spark, d, "far_regions"), _order()), 3, [F.col("contig")])
    return R.large_enough(R.with_size(made)).select("marker", "contig", "start", "end", "size")


def exon_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.overlap_pairs(view(spark, d, "exons"), 300).groupBy("a_gene", "b_gene").agg(F.count("*").alias("n"))


def exon_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of exons per gene; genes after overlaps between markers are settled, with trims."""
    # dealt by gene first, as the operator needs it, so that nothing here moves rows again
    x = view(spark, d, "exons").repartition("marker", "gene")
    env = x.select("marker", "gene").distinct().select("marker", "gene", F.lit(1).alias("env_from"), F.lit(40).alias("env_to"))
    ends = F.array(*(F.struct((F.col("low") + a).alias("low"), (F.col("high") + b).alias("high")) for a, b in ((0, 0), (900, 930))))
    pairs = x.withColumn("x", F.explode(ends)).select("gene", "marker", "contig", "x.low", "x.high", "strand", "score").distinct()
    out = E.resolve_overlaps(pairs, env)
    return out.withColumns({"env": F.col("env").cast("string"), "exons": F.col("exons").cast("string")})


def same_marker_elimination(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "alignments").withColumns({"gene": F.col("aln_id").cast("string"), "low": F.col("start"), "high": F.col("end"), "strand": F.lit("+")})
    return E.eliminate_same_marker(rows.select("gene", "marker", "contig", "low", "high", "strand", "score"))


def _lineages(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    rows = o.groupBy((F.col("o_custkey") % 200).cast("long").alias("input"), F.col("o_orderpriority").alias("lineage")).agg(F.count_if(k % 4 < 2).alias("s"), F.count_if(k % 4 == 2).alias("d"), F.count_if(k % 4 == 3).alias("f"))
    n = F.col("s") + F.col("d") + F.col("f")
    return rows.withColumns({"s_percent": F.round(F.col("s") * 100 / n, 1), "ordinal": F.col("lineage")})


def lineage_choice(spark: SparkSession, d: str) -> DataFrame:
    return L.best_lineage(_lineages(spark, d), ["input"]).select("input", "lineage", "s", "d", "f")


def lineage_ties(spark: SparkSession, d: str) -> DataFrame:
    return L.all_best(_lineages(spark, d).withColumn("c", F.col("s") + F.col("d")), ["input"], "c").select("input", "lineage", "c")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    c = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.array(F.lit("root"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("taxid"), F.col("c_custkey").cast("long").alias("c_custkey"), path.alias("path"))


def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d)
    steps = p.select(F.explode("path").alias("taxid")).distinct()
    datasets = steps.where("taxid = 'root' or taxid like 'r%' or (taxid like 'n%' and cast(substring(taxid, 2) as int) % 3 = 0)")
    return L.nearest_dataset(p.select("taxid", "path"), datasets)


def common_ancestor(spark: SparkSession, d: str) -> DataFrame:
    return L.common_ancestor(_paths(spark, d).withColumn("grp", F.col("c_custkey") % 700), ["grp"])


def _weights(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{d}/orders.parquet")
    c = spark.read.parquet(f"{d}/customer.parquet")
    placed = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select((F.col("o_orderkey") % 30).cast("long").alias("grp"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("taxid"), F.col("o_orderkey").cast("long").alias("query"))
    n = spark.read.parquet(f"{d}/nation.parquet")
    paths = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("taxid"), F.array(F.lit("root"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).alias("path"))
    return placed, paths


def placement_weights(spark: SparkSession, d: str) -> DataFrame:
    placed, _ = _weights(spark, d)
    return L.trusted(L.marker_weights(placed, ["grp"]), ["grp"], 1.1).select("grp", "taxid", "weight")


def placement_choice(spark: SparkSession, d: str) -> DataFrame:
    placed, paths = _weights(spark, d)
    return L.choose_taxid(L.marker_weights(placed, ["grp"]), paths, ["grp"], "root", 1.02)


def first_resolvable(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d)
    nodes = p.select(F.explode("path").alias("node")).distinct().where("node like 'n%' or node like 'r%'").select("node", F.concat(F.lit("t"), F.col("node")).alias("taxid"))
    return L.first_resolvable(p.select(F.col("taxid").alias("query"), F.reverse("path").alias("nodes")), nodes)


def genetic_code_choice(spark: SparkSession, d: str) -> DataFrame:
    h = view(spark, d, "hits")
    runs = h.groupBy("contig", F.col("flag").alias("code")).agg(F.sum(F.col("g_end") - F.col("g_start")).alias("coding"), F.round(F.avg("score"), 4).alias("score"))
    runs = runs.withColumn("density", F.col("coding") / 1_000_000)
    return L.genetic_code_choice(runs, ["contig"]).select("contig", "code", "density", "score")


QUERIES = {f.__name__: f for f in (greedy_gene_suppression, overlap_islands, greedy_alignment_suppression, region_accumulate, region_merge_sum, topk_regions, best_variant, size_relative_filter, flank_extend, region_pipeline, exon_overlap_pairs, exon_resolution, same_marker_elimination, lineage_choice, lineage_ties, nearest_ancestor, common_ancestor, placement_weights, placement_choice, first_resolvable, genetic_code_choice)}

_ACC = """, g AS (SELECT marker, contig, list_reduce(list([{'s': start, 'e': "end", 'v': evalue, 'sp': [ROW(m_start, m_end)]}] ORDER BY evalue, event_id), lambda a, x:
  [{'s': CASE WHEN a[1].s - x[1].s BETWEEN 0 AND 50000 THEN x[1].s ELSE a[1].s END,
    'e': CASE WHEN x[1].e - a[1].e BETWEEN 0 AND 50000 THEN x[1].e WHEN a[1].e >= x[1].s AND x[1].s >= least(a[1].s, CASE WHEN a[1].s - x[1].s BETWEEN 0 AND 50000 THEN x[1].s ELSE a[1].s END) AND x[1].e > a[1].e THEN x[1].e ELSE a[1].e END,
    'v': CASE WHEN (a[1].s - x[1].s BETWEEN 0 AND 50000 OR x[1].e - a[1].e BETWEEN 0 AND 50000 OR (a[1].e >= x[1].s AND x[1].s >= a[1].s)) AND x[1].v < a[1].v THEN x[1].v ELSE a[1].v END,
    'sp': CASE WHEN a[1].s - x[1].s BETWEEN 0 AND 50000 OR x[1].e - a[1].e BETWEEN 0 AND 50000 OR (a[1].e >= x[1].s AND x[1].s >= a[1].s) THEN list_concat(a[1].sp, x[1].sp) ELSE a[1].sp END}]) AS r FROM far_regions GROUP BY marker, contig),
acc AS (SELECT marker, contig, r[1].s AS start, r[1].e AS "end", r[1].v AS evalue, r[1].sp AS spans FROM g)
"""
_MERGED = lambda src, keys: f""", o AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
i AS (SELECT *, sum(CASE WHEN start < reach THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM o),
m AS (SELECT {keys}, k, max("end") - min(start) AS len FROM i GROUP BY ALL), sz AS (SELECT {keys}, CAST(sum(len) AS BIGINT) AS size FROM m GROUP BY ALL)
"""  # noqa: E731
_LINEAGES = """WITH l AS (SELECT CAST(o_custkey % 200 AS BIGINT) AS input, o_orderpriority AS lineage, count(*) FILTER (o_orderkey % 4 < 2) AS s, count(*) FILTER (o_orderkey % 4 = 2) AS d, count(*) FILTER (o_orderkey % 4 = 3) AS f FROM orders GROUP BY ALL),
r AS (SELECT *, round(s * 100 / (s + d + f), 1) AS sp, max(s + d) OVER (PARTITION BY input) = 0 AND max(f) OVER (PARTITION BY input) = 0 AS none FROM l)
"""
_PATHS = """WITH p AS (SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS taxid, CAST(c_custkey AS BIGINT) AS k, ['root', concat('r', CAST(n_regionkey AS VARCHAR)), concat('n', CAST(n_nationkey AS VARCHAR)), concat('c', CAST(c_custkey AS VARCHAR))] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey),
st AS (SELECT taxid, k, unnest(path) AS node, unnest(range(4)) AS depth FROM p)
"""
_PLACED = """WITH pl AS (SELECT CAST(o_orderkey % 30 AS BIGINT) AS grp, concat('n', CAST(c_nationkey AS VARCHAR)) AS taxid, o_orderkey AS query FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT grp, taxid, count(*) AS weight FROM pl GROUP BY ALL), x AS (SELECT *, max(weight) OVER (PARTITION BY grp) AS most FROM w)
"""
SQL = {
    "greedy_gene_suppression": with_views("regions") + """, g AS (SELECT marker, contig, list_reduce(list([{'i': event_id, 's': start, 'e': "end"}] ORDER BY evalue DESC, event_id),
  lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s <= x[1].e AND x[1].s <= y.e)) > 0 THEN a ELSE list_concat(a, x) END) AS k FROM regions GROUP BY marker, contig),
u AS (SELECT marker, contig, unnest(k) AS x FROM g) SELECT marker, contig, x.i AS event_id, x.s AS start, x.e AS "end" FROM u""",
    "overlap_islands": with_views("regions") + """, o AS (SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM regions),
i AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT contig, CAST(k AS BIGINT) AS island, count(*) AS n, min(start) AS low, max("end") AS high FROM i GROUP BY ALL""",
    "greedy_alignment_suppression": with_views("alignments") + """, pr AS (SELECT i.contig, i.aln_id AS a, j.aln_id AS b, CASE WHEN j.score > i.score THEN i.aln_id ELSE j.aln_id END AS loser
  FROM alignments i JOIN alignments j ON i.contig = j.contig AND i.aln_id <> j.aln_id AND j.start > 0 AND ((j.start >= i.start AND j.start < i."end") OR (j."end" > i.start AND j."end" <= i."end"))
  WHERE least(i."end", j."end") - greatest(i.start, j.start) > 0.8 * greatest(i."end" - i.start, j."end" - j.start)),
g AS (SELECT contig, list_reduce(list_concat([[CAST(-1 AS BIGINT)]], list([a, b, loser] ORDER BY a, b)), lambda acc, x: CASE WHEN list_contains(acc, x[1]) OR list_contains(acc, x[2]) THEN acc ELSE list_append(acc, x[3]) END) AS gone FROM pr GROUP BY contig),
u AS (SELECT unnest(gone) AS aln_id FROM g) SELECT aln_id, contig, start, "end" FROM alignments WHERE aln_id NOT IN (SELECT aln_id FROM u)""",
    "same_marker_elimination": with_views("alignments") + """, x AS (SELECT *, CAST(aln_id AS VARCHAR) AS gene FROM alignments),
pr AS (SELECT a.contig, a.gene AS a, b.gene AS b, greatest(a.score, b.score) AS best, CASE WHEN a.score > b.score THEN b.gene ELSE a.gene END AS loser
  FROM x a JOIN x b ON a.contig = b.contig AND a.aln_id <> b.aln_id AND a.start <= b.start AND b.start < a."end" AND (a.start < b.start OR a.gene < b.gene) AND a.start % 3 = b.start % 3),
g AS (SELECT contig, list_reduce(list_concat([['']], list([a, b, loser] ORDER BY best DESC, a, b)), lambda acc, p: CASE WHEN list_contains(acc, p[1]) OR list_contains(acc, p[2]) THEN acc ELSE list_append(acc, p[3]) END) AS gone FROM pr GROUP BY contig),
u AS (SELECT unnest(gone) AS gene FROM g)
SELECT gene, marker, contig, start AS low, "end" AS high, '+' AS strand, score FROM x WHERE gene NOT IN (SELECT gene FROM u)""",
    "region_accumulate": with_views("far_regions") + _ACC + 'SELECT marker, contig, start, "end", evalue, len(spans) AS n_spans FROM acc',
    "region_merge_sum": with_views("regions") + _MERGED("regions", "marker, contig") + "SELECT * FROM sz",
    "topk_regions": with_views("regions") + " SELECT marker, contig, event_id, evalue FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY evalue, event_id) AS k FROM regions) WHERE k <= 3",
    "best_variant": with_views("regions") + """, v AS (SELECT *, concat(CAST(CAST(split_part(marker, 'at', 1) AS BIGINT) % 40 AS VARCHAR), 'at7') AS base FROM regions)
SELECT base, concat(base, '_', CAST(event_id % 3 AS VARCHAR)) AS marker, contig, event_id, evalue FROM (SELECT *, row_number() OVER (PARTITION BY base, contig ORDER BY evalue, event_id) AS k FROM v) WHERE k = 1""",
    "size_relative_filter": with_views("regions") + _MERGED("regions", "marker, contig") + "SELECT * FROM sz s WHERE size >= (SELECT CAST(floor(0.7::DOUBLE * max(size)) AS BIGINT) FROM sz t WHERE t.marker = s.marker)",
    "flank_extend": with_views("far_regions") + """, f AS (SELECT *, greatest(5000, least(20000, CAST(floor(event_id * 300000.0::DOUBLE / 1000 / 50) AS BIGINT))) AS w FROM far_regions)
SELECT event_id, greatest(0, start - w) AS start, "end" + w AS "end" FROM f""",
    "region_pipeline": with_views("far_regions") + _ACC + """, tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY evalue, contig) AS k FROM acc) WHERE k <= 3),
sp AS (SELECT marker, contig, x[1] AS start, x[2] AS "end" FROM (SELECT marker, contig, unnest(spans) AS x FROM tk))""" + _MERGED("sp", "marker, contig") + """,
q AS (SELECT tk.marker, tk.contig, tk.start, tk."end", size, max(size) OVER (PARTITION BY tk.marker) AS mx FROM tk JOIN sz USING (marker, contig))
SELECT marker, contig, start, "end", size FROM q WHERE size >= CAST(floor(0.7::DOUBLE * mx) AS BIGINT)""",
    "exon_overlap_pairs": with_views("exons") + """ SELECT a.gene AS a_gene, b.gene AS b_gene, count(*) AS n FROM exons a JOIN exons b ON a.contig = b.contig AND a.strand = b.strand AND a.low % 3 = b.low % 3 AND b.low >= a.low AND b.low < a.high
WHERE regexp_replace(a.gene, '\\|[^|]*$', '') <> regexp_replace(b.gene, '\\|[^|]*$', '') GROUP BY ALL""",
    "lineage_choice": _LINEAGES + "SELECT input, lineage, s, d, f FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY CASE WHEN none THEN lineage END, s + d DESC, f DESC, sp DESC, lineage) AS k FROM r) WHERE k = 1",
    "lineage_ties": _LINEAGES + "SELECT input, lineage, s + d AS c FROM r WHERE s + d = (SELECT max(s + d) FROM r q WHERE q.input = r.input)",
    "nearest_ancestor": _PATHS + "SELECT taxid, max_by(node, depth) AS dataset_taxid FROM st WHERE node = 'root' OR node LIKE 'r%' OR (node LIKE 'n%' AND CAST(substr(node, 2) AS INT) % 3 = 0) GROUP BY taxid",
    "common_ancestor": _PATHS + """, c AS (SELECT k % 700 AS grp, node, max(depth) AS depth, count(*) AS n FROM st GROUP BY ALL), t AS (SELECT k % 700 AS grp, count(*) AS n FROM p GROUP BY ALL)
SELECT grp, max_by(node, depth) AS ancestor FROM c JOIN t USING (grp, n) GROUP BY grp""",
    "placement_weights": _PLACED + "SELECT grp, taxid, weight FROM x WHERE weight * 1.1::DOUBLE >= most",
    "placement_choice": _PLACED + """, kept AS (SELECT grp, taxid, n_regionkey FROM x JOIN nation ON taxid = concat('n', CAST(n_nationkey AS VARCHAR)) WHERE weight * 1.02::DOUBLE >= most),
a AS (SELECT grp, CASE WHEN count(*) = 1 THEN min(taxid) WHEN count(DISTINCT n_regionkey) = 1 THEN concat('r', CAST(min(n_regionkey) AS VARCHAR)) ELSE 'root' END AS ancestor FROM kept GROUP BY grp),
f AS (SELECT grp, max(weight) AS most, CAST(sum(weight) AS BIGINT) AS placed FROM w GROUP BY grp)
SELECT grp, CASE WHEN most >= 12 THEN ancestor ELSE 'root' END AS taxid, most, placed FROM f JOIN a USING (grp)""",
    "first_resolvable": _PATHS + "SELECT taxid AS query, concat('t', max_by(node, depth)) AS taxid FROM st WHERE node LIKE 'n%' OR node LIKE 'r%' AND node <> 'root' GROUP BY taxid",
    "genetic_code_choice": with_views("hits") + """, r AS (SELECT contig, flag AS code, sum(g_end - g_start) / 1000000 AS density, round(avg(score), 4) AS score FROM hits GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS n, first_value(density) OVER w AS d1, first_value(score) OVER w AS s1 FROM r WINDOW w AS (PARTITION BY contig ORDER BY density DESC, code)),
p AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY (n = 2 AND d1 - density <= 0.05::DOUBLE AND score > s1) DESC, n) AS q FROM k)
SELECT contig, code, density, score FROM p WHERE q = 1""",
}
