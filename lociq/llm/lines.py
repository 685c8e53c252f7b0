"""Deletion of repeated runs of lines, from a suffix array over line-id sequences.

Lines (parted by \\n) become ids: equal lines share one.  A run of lines goes if
it also starts earlier in the order (doc_id, line) and holds MIN_CHARS
characters; all such runs are judged at their full, maximal length, so short
lines go with the long ones they were copied with, and short lines that meet by
chance stay.

Prefix doubling names, for every position, the run of 1, 2, 4, ... lines that
starts there: the rank of 2k lines is the rank of the pair (rank of k lines
here, rank of k lines k further on).  Positions of one rank are an interval of
the suffix array whose common prefix is that long at least.  A run of any other
length k is the overlap of two runs of the power of two below it, so the pair of
their ranks names the interval at depth k exactly.  A maximal run that counts is
the union of its shortest parts that hold MIN_CHARS characters, one from each
line on and one up to each line: if a..b repeats, then so does the shortest such
part from any line of a..b that ends by b, and the one up to any line that
begins by a.  (A line between the two lies in the part from a or the part up to
b.)  So each position asks for the common prefix at two depths only, and
doubling goes on until no position is left that asks for more; copies of whole
documents take no more rounds than their first lines need.

The first position of an interval stays, later ones lose the part.  A position
whose rank is unique has no twin at any greater depth and leaves; so do
positions that no undecided part covers.  Ranks are 128-bit digests of the pair
instead of dense numbers: they part the suffixes as well as any numbering and
need no global sort.  Ranks that very many positions share are joined by
broadcast (join_back), so no line, however common, is dealt to one task.

With min_lines only runs of exactly so many lines are judged, each by its own
characters, and longer ones through the runs they consist of; line_chars adds
lone lines of so many characters.  The pipeline's line stage does so, since a
near copy that has lost one line of a few words more than MIN_CHARS is no
longer near enough for the stage after it.

Null text stays null, empty text stays as it is.  A document that loses all
its lines keeps its row with empty text.  Repeated rows: equal (doc_id, text)
rows are one document; rows of one doc_id with different texts are told apart
by a hash of the text.  Rows with a null doc_id are left as they are.  Extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm._common import Scratch, join_back, small_side, table

MIN_CHARS = 40
AT = ["doc_id", "text_key", "line"]
POSITIONS = "doc_id long, text_key long, line int, rank binary, ahead int, back int, wide boolean"


def depths(sizes: np.ndarray, min_lines: int | None, min_chars: int, line_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest part of min_chars characters from each line on, and up to each line; 0 if there is none."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(n)
    if min_lines is not None:
        begin = np.maximum(at + 1 - min_lines, 0)
        lone = np.zeros(n, np.int64) if line_chars is None else (sizes >= line_chars).astype(np.int64)
        return lone, np.where((at + 1 >= min_lines) & (total[at + 1] - total[begin] >= min_chars), min_lines, 0)
    end = np.searchsorted(total, total[:-1] + min_chars)  # the least e with total[e] - total[at] >= min_chars
    begin = np.searchsorted(total, total[1:] - min_chars, side="right") - 1
    return np.where(end <= n, np.maximum(end - at, 1), 0), np.where(begin >= 0, np.maximum(at + 1 - begin, 1), 0)


def _positions(*rule: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, ranks, ahead, back, wide = [], [], [], [], []
            for text in b.column("text"):
                ls = text.as_py().split("\n")
                n = len(ls)
                x, y = depths(np.fromiter(map(len, ls), np.int64, n), *rule)
                cover = np.zeros(n + 1, np.int64)  # lines in a part of several lines
                for start, size in ((np.arange(n), x), (np.arange(n) - y + 1, y)):
                    some = size > 1
                    np.add.at(cover, start[some], 1)
                    np.add.at(cover, start[some] + size[some], -1)
                counts.append(n)
                ranks += [hashlib.blake2b(s.encode(), digest_size=16).digest() for s in ls]
                ahead.append(x)
                back.append(y)
                wide.append(np.cumsum(cover[:-1]) > 0)
            lines = np.concatenate([np.arange(n) for n in counts]) if counts else np.zeros(0)
            rows = np.repeat(np.arange(len(counts)), counts)
            both = lambda c: pa.array(c.to_numpy()[rows], pa.int64())
            joined = lambda xs, kind: pa.array(np.concatenate(xs) if xs else np.zeros(0), kind)
            yield pa.RecordBatch.from_arrays([both(b.column("doc_id")), both(b.column("text_key")), pa.array(lines, pa.int32()), pa.array(ranks, pa.binary()), joined(ahead, pa.int32()), joined(back, pa.int32()), joined(wide, pa.bool_())], names=[c.split()[0] for c in POSITIONS.split(", ")])

    return run


def _ties(ranked: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of a saved table whose rank occurs at several places, with the first of these."""
    here = F.struct(*AT)
    first = scratch.save(ranked.groupBy("rank").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.count("*").alias("n")).where("first <> last").select("rank", "first", "n"))
    return join_back(ranked, "rank", first)


def _digest(*parts) -> F.Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _later(ties: DataFrame, size) -> DataFrame:
    return ties.where(F.struct(*AT) != F.col("first")).select(*AT, size.alias("size"))


def repeated_runs(docs: DataFrame, scratch: Scratch, min_lines: int | None = None, min_chars: int = MIN_CHARS, line_chars: int | None = None) -> DataFrame:
    """(doc_id, text_key, line, size): parts of runs that also start earlier and hold min_chars characters."""
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text_key", F.col("text").cast("string").alias("text"))
    ties = scratch.save(_ties(scratch.save(known.mapInArrow(_positions(min_lines, min_chars, line_chars), POSITIONS)), scratch))
    found = [_later(ties.where("ahead = 1 or back = 1"), F.lit(1))]
    level = scratch.save(ties.where("wide").select(*AT, "rank", "ahead", "back").dropDuplicates(AT))
    parts = level.select("doc_id", "text_key", F.explode(F.array(F.struct("line", F.col("ahead").alias("size")), F.struct((F.col("line") - F.col("back") + 1).alias("line"), F.col("back").alias("size")))).alias("x"))
    parts = scratch.save(parts.select("doc_id", "text_key", "x.*").where("size > 1").distinct())
    longest = parts.agg(F.max("size")).first()[0] or 0
    level, depth = level.select(*AT, "rank"), 1
    while longest >= 2 * depth and not level.isEmpty():
        after = level.select("doc_id", "text_key", (F.col("line") - depth).alias("line"), F.col("rank").alias("next"))
        pairs = scratch.save(level.join(after, AT).select(*AT, _digest("rank", "next").alias("rank")))
        level, depth = scratch.save(_ties(pairs, scratch).select(*AT, "rank")), 2 * depth
        asked = parts.where((F.col("size") >= depth) & (F.col("size") < 2 * depth))
        tail = level.select("doc_id", "text_key", F.col("line").alias("to"), F.col("rank").alias("next"))
        named = asked.join(level, AT).withColumn("to", F.col("line") + F.col("size") - depth).join(tail, ["doc_id", "text_key", "to"])
        named = scratch.save(named.select(*AT, "size", _digest("rank", "next", F.col("size").cast("string").cast("binary")).alias("rank")))
        found.append(_later(_ties(named, scratch), F.col("size")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of each document -> which of its lines go, how many, and in how many maximal runs."""
    for b in batches:
        masks, removed, runs = [], [], []
        for parts in b.column("parts"):
            cover = np.zeros(max(x["line"].as_py() + x["size"].as_py() for x in parts) + 1, np.int64)
            for x in parts:
                cover[x["line"].as_py()] += 1
                cover[x["line"].as_py() + x["size"].as_py()] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            masks.append(gone)
            removed.append(int(gone.sum()))
            runs.append(int(np.diff(gone, prepend=False).astype(bool)[gone].sum()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(masks, pa.list_(pa.bool_())), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=["doc_id", "text_key", "lost", "n_lost", "n_stretches"])


def drop_repeated_lines(docs: DataFrame, min_lines: int | None = None, min_chars: int = MIN_CHARS, line_chars: int | None = None) -> DataFrame:
    """docs with repeated runs of lines gone from text, and n_lines, n_removed, n_runs (maximal removed runs), which replace columns of their names."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.struct("*").alias("row"))
    parts = repeated_runs(rows.select("doc_id", "text", "text_key"), scratch, min_lines, min_chars, line_chars)
    per_doc = parts.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("line", "size")).alias("parts"))
    lost = scratch.save(per_doc.mapInArrow(_masks, "doc_id long, text_key long, lost array<boolean>, n_lost long, n_stretches long"))
    both = rows.join(small_side(lost, F.size("lost") + 64), ["doc_id", "text_key"], "left")
    lines = F.split("text", "\n")
    text = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get("lost", i), F.lit(False))), "\n")
    made = {
        "n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"),
        "n_removed": F.coalesce("n_lost", F.lit(0)).cast("long"),
        "n_runs": F.coalesce("n_stretches", F.lit(0)).cast("long"),
    }
    new_text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(text)
    passed = [(new_text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in made]
    return both.select(*passed, *(c.alias(k) for k, c in made.items()))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL = {
    "op4_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
p AS (SELECT a.doc_id, a.i, length(a.s) AS n, b.doc_id AS q, a.i - b.i AS shift FROM l a JOIN l b ON a.s = b.s AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.i < a.i)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q, shift ORDER BY i) AS run FROM p),
r AS (SELECT doc_id, min(i) AS low, max(i) AS high FROM g GROUP BY doc_id, q, shift, run HAVING sum(n) >= {MIN_CHARS}),
x AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS i FROM r),
m AS (SELECT l.*, x.i IS NOT NULL AS gone FROM l LEFT JOIN x USING (doc_id, i)),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM m)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs,
  sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM e GROUP BY doc_id
""",
}
