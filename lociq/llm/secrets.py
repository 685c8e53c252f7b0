r"""Secret scan by corpus-wide ownership frequency, in Spark expressions only.

Base kinds (leftmost, non-overlapping matches of each, failing ones dropped
after matching): assign, access and hex.  The method looks at one more kind,
opaque: runs of 24 or more token characters with a digit, a lower and an upper
case letter that overlap no base span.  Every candidate value is hashed, and
the hashes are counted over the whole corpus by distinct repositories
(documents) and owners (sources): a value that more than MAX_OWNERS owners
hold, or more than MAX_REPOSITORIES documents, is a copied example; any other
is owner-specific and looks live.  An opaque run becomes a span if it looks
live; base spans always stay.

Matches come from regexp_extract_all and their places from the pieces between
them (split by the same pattern): a row each, summed up along their document by
windows, so no position is searched for, repeated values can't be confused, and
time grows with the count of matches.  Running bounds of the base spans decide
in the same order which opaque runs overlap one.  Counts are aggregated by
(value, owner, document), then (value, owner), then value, each with map-side
combine, so a value that a third of all documents hold is combined early.

Null text is empty, a null source is an owner of its own, repeated rows give a
row each, an empty table gives an empty result, extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.llm._common import Scratch, table

#: Fixed patterns: letters of the keywords in either case, all else as written.
KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
#: kind: number in the order of listing, pattern, group of the value, least length of the value
KINDS = {"assign": (0, ASSIGN, 2, 8), "access": (1, ACCESS, 0, 16), "hex": (2, HEX, 0, 32), "opaque": (3, OPAQUE, 0, 24)}
MAX_OWNERS, MAX_REPOSITORIES = 2, 8


def matches(text: Column, kind: str) -> Column:
    """array<struct<m, v, p>>: each match of a kind, its value, and the text between it and the one before; null without a match."""
    _, pattern, group, _ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return F.when(text.rlike(pattern), F.arrays_zip(found.alias("m"), values.alias("v"), F.split(text, pattern, -1).alias("p")))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, owner, kind, start, end, value) of every candidate."""
    each = F.array(*(F.struct(F.lit(KINDS[k][0]).alias("kind"), F.lit(KINDS[k][3]).alias("least"), matches(F.col("text"), k).alias("found")) for k in KINDS))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("source").cast("string").alias("owner"), F.monotonically_increasing_id().alias("row"), F.filter(each, lambda x: x["found"].isNotNull()).alias("each"))
    keys = ["doc_id", "text_key", "owner", "row"]
    rows = rows.where("size(each) > 0").select(*keys, F.inline("each")).select(*keys, "kind", "least", F.posexplode("found").alias("i", "x")).where("x.m is not null")
    rows = rows.select(*keys, "kind", "least", "i", F.length("x.p").alias("gap"), F.length("x.m").alias("size"), F.col("x.v").alias("v")).repartition("row")
    until = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(until).cast("int")).withColumn("start", F.col("end") - F.col("size")).where("length(v) >= least")
    mixed = F.col("v").rlike("[0-9]") & F.col("v").rlike("[a-z]") & F.col("v").rlike("[A-Z]")
    rows = rows.where((F.col("kind") < 3) | mixed)
    base = lambda c: F.when(F.col("kind") < 3, F.col(c))
    before = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.max(base("end")).over(before)).withColumn("next", F.min(base("start")).over(after))
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return rows.where((F.col("kind") < 3) | apart).select("doc_id", "text_key", "owner", "kind", "start", "end", F.sha2(F.col("v").cast("binary"), 256).alias("value"))


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(value, owners, repositories, live) of each candidate value."""
    by_doc = found.select("value", "owner", "doc_id").distinct()
    by_owner = by_doc.groupBy("value", "owner").agg(F.count("*").alias("n"))
    each = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    return each.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))


def _names(number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k in KINDS)), number + 1)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", _names(s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and spans."""
    spark = docs.sparkSession
    found = Scratch(spark).save(candidates(docs).distinct())
    judged = found.join(ownership(found), "value")
    span = F.struct("start", "kind", "end")
    kind = F.col("kind")
    per_doc = judged.groupBy("doc_id", "text_key").agg(
        *(F.count_if(kind == KINDS[k][0]).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.collect_list(F.when(kind < 3, span)).alias("base"),
        F.collect_list(F.when((kind < 3) | F.col("live"), span)).alias("all"),
        F.count_if((kind < 3) & F.col("live")).alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    keys = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"))
    out = keys.join(per_doc, keys["doc_id"].eqNullSafe(per_doc["doc_id"]) & (keys["text_key"] == per_doc["text_key"]), "left").select(keys["doc_id"], *(c for c in per_doc.columns if c not in ("doc_id", "text_key")))
    none = F.lit("")
    return out.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(F.coalesce(_joined(F.col("base")), none).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all")), none).alias("spans"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example")),
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _sql() -> str:
    kind = lambda k, n, p, g, least: rf"""
  SELECT doc_id, owner, {n} AS kind, start, start + length(m) AS stop, v AS value FROM (
    SELECT doc_id, owner, m, v, CAST(sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM (SELECT doc_id, owner, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[1:len(ms)]) AS p, unnest(range(len(ms))) AS i FROM (
      SELECT doc_id, owner, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {g}) AS vs, regexp_split_to_array(t, '{p}') AS ps FROM docs))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(v) >= {least}"""  # noqa: E731
    parts = {k: kind(k, n, p.replace("'", "''"), g, least) for k, (n, p, g, least) in KINDS.items()}
    return rf"""
WITH docs AS (SELECT doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
base AS ({parts['assign']} UNION ALL {parts['access']} UNION ALL {parts['hex']}),
opaque AS (SELECT * FROM ({parts['opaque']}) o WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.start < o.stop AND o.start < b.stop)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
own AS (SELECT value, count(DISTINCT coalesce(owner, chr(0))) <= {MAX_OWNERS} AND count(DISTINCT doc_id) <= {MAX_REPOSITORIES} AS live FROM found GROUP BY value),
judged AS (SELECT f.*, live, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || start || ':' || stop AS s FROM found f JOIN own USING (value))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3 OR live), '') AS spans,
  count(*) FILTER (kind < 3 AND live) AS n_live, count(*) FILTER (NOT live) AS n_example
FROM docs d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""


QUERIES = {"op9_secret_scans": op9_secret_scans}
SQL = {"op9_secret_scans": _sql()}
