"""The corpus pipeline: documents to packed training sequences.

Each stage takes the documents that the one before it kept and returns the
same columns; the last returns the packing.  Stages hand columns through as
one struct, so columns of any name pass unharmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm import decontaminate, lines, neardup, packing, toxicity
from lociq.llm._common import Scratch, small_side, table

#: Characters of a lone line (some fifty words) that goes even between different neighbours.
PASSAGE_CHARS = 250
#: Most whole texts that go to Python at a time: an executor holds each batch several times over on its way there and back.
TEXTS = 512


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier chain calls toxic."""
    models, thresholds = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*("`" + c.replace("`", "``") + "`" for c in docs.columns if c != "text")).alias("row"), "text")
    kept = toxicity.score(rows, models).where(F.col("p_toxic") < thresholds[-1])
    return Scratch(spark).save(kept.select(*((F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns)), batch=TEXTS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; a document that was nothing else goes."""
    rows = lines.drop_repeated_lines(docs.select("doc_id", "text", F.struct("*").alias("row")), min_lines=2, line_chars=PASSAGE_CHARS)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    kept = rows.where("n_removed = 0 or n_removed < n_lines")
    return kept.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group."""
    gone = neardup.near_duplicates(docs.select("doc_id", "text")).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(small_side(Scratch(spark).save(gone), F.lit(16)), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    found = decontaminate.find_items(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(small_side(Scratch(spark).save(found, batch=TEXTS), F.lit(16)), "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("pack", pack)]
#: A trained classifier and best-fit packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again by the next."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
