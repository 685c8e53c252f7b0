"""Views that give the test tables the shape of the engine's inputs.

The expressions are plain SQL, so the same text serves Spark and the oracle.
Every view holds all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "hits": (
        "lineitem",
        """concat(CAST(l_partkey AS STRING), 'at2') AS marker, concat('ctg', CAST(l_suppkey % 50 AS STRING)) AS contig,
  (l_orderkey * 7 % 5000) * 3 + 1 AS g_start, (l_orderkey * 7 % 5000) * 3 + 1 + CAST(l_quantity AS BIGINT) * 60 AS g_end,
  CASE WHEN l_returnflag = 'A' THEN '-' ELSE '+' END AS strand, CAST(l_linenumber AS BIGINT) * 10 + 1 AS hmm_from,
  CAST(l_linenumber AS BIGINT) * 10 + 1 + CAST(l_quantity AS BIGINT) * 4 AS hmm_to, CAST(200 AS BIGINT) AS qlen, l_extendedprice AS score,
  concat(CAST(l_orderkey AS STRING), '_', CAST(l_suppkey AS STRING)) AS target, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
  l_linestatus AS flag, l_discount AS discount""",
    ),
    "cutoffs": (
        "part",
        """concat(CAST(p_partkey AS STRING), 'at2') AS marker, CAST(60000 + p_size * 700 AS DOUBLE) AS cutoff, CAST(120 + p_size AS DOUBLE) AS length,
  CAST(CASE WHEN p_size % 10 = 0 THEN 1 ELSE p_size END AS DOUBLE) AS sigma, p_brand AS description, p_size""",
    ),
    "regions": (
        "events",
        """concat(CAST(user_id AS STRING), 'at7') AS marker, event_type AS contig, event_id, CAST(event_id * 37 % 4000 AS BIGINT) AS start,
  CAST(event_id * 37 % 4000 + 20 + event_id % 60 AS BIGINT) AS "end", CAST(event_id % 300 AS BIGINT) AS m_start, CAST(event_id % 300 + 10 + event_id % 90 AS BIGINT) AS m_end, value AS evalue""",
    ),
    "far_regions": (
        "events",
        """concat(CAST(user_id AS STRING), 'at7') AS marker, event_type AS contig, event_id, CAST(event_id * 7919 % 400000 AS BIGINT) AS start,
  CAST(event_id * 7919 % 400000 + 200 + event_id % 600 AS BIGINT) AS "end", CAST(event_id % 300 AS BIGINT) AS m_start, CAST(event_id % 300 + 10 + event_id % 90 AS BIGINT) AS m_end, value AS evalue""",
    ),
    "alignments": (
        "events",
        """CAST(event_id AS BIGINT) AS aln_id, 'm' AS marker, concat('c', CAST(user_id % 20 AS STRING)) AS contig, CAST(event_id * 37 % 600 AS BIGINT) AS start,
  CAST(event_id * 37 % 600 + 40 + event_id % 25 AS BIGINT) AS "end", value AS score""",
    ),
    "exons": (
        "lineitem",
        """concat(CAST(l_partkey AS STRING), 'at2|ctg', CAST(l_suppkey % 50 AS STRING), ':', CAST((l_orderkey * 7 % 5000) * 3 + 1 AS STRING), '-', CAST(l_linenumber AS STRING), '|', CASE WHEN l_returnflag = 'A' THEN '-' ELSE '+' END) AS gene,
  concat(CAST(l_partkey AS STRING), 'at2') AS marker, concat('ctg', CAST(l_suppkey AS STRING)) AS contig, (l_orderkey * 7 % 500000) * 3 + l_partkey % 3 AS low,
  (l_orderkey * 7 % 500000) * 3 + l_partkey % 3 + CAST(l_quantity AS BIGINT) * 6 + 20 AS high, CASE WHEN l_returnflag = 'A' THEN '-' ELSE '+' END AS strand, CAST(l_extendedprice AS FLOAT) AS score""",
    ),
    "dna": (
        "documents",
        """doc_id AS seq_id, source AS input, translate(regexp_replace(lower(text), '[^a-z]', ''), 'abcdefghijklmnopqrstuvwxyz', 'ACGTNACGTACGTNACGTACGTACGT') AS seq""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, exprs = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return df.selectExpr(*split_list(exprs.replace('"end"', "end")))


def split_list(exprs: str) -> list[str]:
    """Parts of a select list at its outer commas."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(exprs):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(exprs[at:i].strip())
            at = i + 1
    return [*out, exprs[at:].strip()]


def with_views(*names: str) -> str:
    """WITH clause of the oracle for some views; ends open, for more."""
    def one(n: str) -> str:
        source, exprs = VIEWS[n]
        exprs = exprs.replace("'[^a-z]', '')", "'[^a-z]', '', 'g')")
        return f"{n} AS (SELECT {exprs} FROM {source})"

    return "WITH " + ",\n".join(map(one, names))
