"""Sequence checks and assembly metrics. Sequences: input, seq_id, seq."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.functions.scalars import AMINO_ACIDS, BASES, COMPLEMENTS

#: Nucleotides with ambiguity codes, letters looked at.
NUCLEOTIDES, LETTERS, RECORDS = "ACTGNYRWSKMDVHB", 5001, 11
#: Letters of proteins.
AMINO_LETTERS = "FLIMVSPTAYXHQNKDECWRG*"
#: What a header must not hold anywhere, and what its first word must not hold.
FORBIDDEN = ("ç", "¬", "¢", "´", "ê", "î", "ô", "ŵ", "ẑ", "û", "â", "ŝ", "ĝ", "ĥ", "ĵ", "ŷ", "ĉ", "é", "ï", "ẅ", "ë", "ẗ,", "ü", "í", "ö", "ḧ", "ÿ", "ẍ", "è", "à", "ä", "¨", "€", "£", "á")
FORBIDDEN_IN_ID = ("/", '"')
#: Sequences translated at a time; frames; digits of the bases (64: none), and the letters of the codons, in the genetic code's order.
SLICE, FRAMES = 256, np.array([1, 2, 3, -1, -2, -3])
CODES, PLACES = np.full(256, 64), np.array([16, 4, 1])
CODES[[ord(c) for c in "TCAGUtcagu"]] = [0, 1, 2, 3, 0] * 2
AMINO = np.frombuffer((AMINO_ACIDS.replace("*", "X") + "X").encode(), np.uint8)


def n50(lengths: DataFrame, keys: list[str], length: str, name: str) -> DataFrame:
    """The length at which the running sum, longest first, reaches half; lengths are counted first, so the window is over distinct lengths."""
    each = lengths.groupBy(*keys, length).agg(F.count("*").alias("_c")).withColumn("_s", F.col("_c") * F.col(length))
    w = Window.partitionBy(*keys)
    run = each.withColumns({"_t": F.sum("_s").over(w), "_r": F.sum("_s").over(w.orderBy(F.desc(length)))})
    return run.where(F.col("_r") * 2 >= F.col("_t")).groupBy(*keys).agg(F.max(length).alias(name))


def metrics(seqs: DataFrame, keys: list[str], gap: int = 10) -> DataFrame:
    """Scaffolds, contigs (parted by gap or more Ns), total length, gap share and both N50s.

    Each sequence is gone through once: lengths of both kinds are counted
    together, and what follows is over distinct lengths.
    """
    ns = F.length("seq") - F.length(F.replace(F.replace(F.col("seq"), F.lit("N")), F.lit("n")))
    parts = F.filter(F.transform(F.split("seq", f"[Nn]{{{gap},}}"), lambda x: F.struct(F.lit(1).alias("kind"), F.length(x).alias("len"), F.lit(0).alias("n"))), lambda x: x["len"] > 0)
    own = F.array(F.struct(F.lit(0).alias("kind"), F.length("seq").alias("len"), ns.alias("n")))
    rows = seqs.select(*keys, F.explode(F.concat(own, F.coalesce(parts, F.slice(own, 1, 0)))).alias("x")).select(*keys, "x.*")
    each = rows.groupBy(*keys, "kind", "len").agg(F.count("*").alias("c"), F.sum("n").alias("n")).withColumn("s", F.col("c") * F.col("len"))
    w = Window.partitionBy(*keys, "kind")
    each = each.withColumns({"t": F.sum("s").over(w), "r": F.sum("s").over(w.orderBy(F.desc("len")))})
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    half = F.when(F.col("r") * 2 >= F.col("t"), F.col("len"))
    facts = each.groupBy(*keys).agg(F.sum(of(0, F.col("c"))).alias("n_scaffolds"), F.sum(of(0, F.col("s"))).alias("total_length"), F.sum(of(0, F.col("n"))).alias("n_gap"), F.sum(of(1, F.col("c"))).alias("n_contigs"), F.max(of(0, half)).alias("scaffold_n50"), F.max(of(1, half)).alias("contig_n50"))
    return facts.withColumn("gap_percent", F.when(F.col("total_length") > 0, F.col("n_gap") * 100 / F.col("total_length")).otherwise(0.0)).fillna({"n_contigs": 0})


def is_nucleotide(seqs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Whether the first 5,001 letters over all records, in order, are nucleotide codes; a table without a record has no row."""
    w = Window.partitionBy(*keys).orderBy(order)
    # no more than the first letters of so many records can count, so only these are moved
    some = seqs.where(F.length("seq") > 0).select(*keys, order, F.substring("seq", 1, LETTERS).alias("_p"), F.length("seq").alias("_l"))
    some = some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= LETTERS)
    before = F.coalesce(F.sum("_l").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = some.withColumn("_b", before).where(F.col("_b") < LETTERS).withColumn("_p", F.substring("_p", F.lit(1), (LETTERS - F.col("_b")).cast("int")))
    found = part.groupBy(*keys).agg(F.bool_and(F.upper("_p").rlike(f"^[{NUCLEOTIDES}]*$")).alias("nucleotide"))
    return seqs.select(*keys).distinct().join(found, keys, "left").fillna(True, ["nucleotide"])


def is_protein(seqs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Whether the first letter outside ACGTN in the first 11 records is a letter of proteins."""
    w = Window.partitionBy(*keys).orderBy(order)
    odd = F.regexp_extract(F.upper("seq"), "([^ACGTN])", 1)
    first = seqs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= RECORDS).withColumn("_o", odd)
    found = first.groupBy(*keys).agg(F.min_by("_o", F.when(F.col("_o") != "", F.col("_n"))).alias("odd"))
    return found.select(*keys, (F.coalesce("odd", F.lit("")).rlike(f"[{AMINO_LETTERS}]")).alias("protein"))


def header_audit(headers: DataFrame, keys: list[str], header: str = "header") -> DataFrame:
    """Counts of headers with forbidden characters, of a space right after the sign, and of repeated ids."""
    id_ = F.regexp_extract(header, r"^>(\S*)", 1)
    bad = F.col(header).rlike("|".join(FORBIDDEN)) | id_.rlike(f"[{''.join(FORBIDDEN_IN_ID)}]")
    rows = headers.select(*keys, id_.alias("id"), bad.alias("bad"), F.col(header).rlike(r"^>(\s|$)").alias("spaced"))
    per_id = rows.groupBy(*keys, "id").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count_if("spaced").alias("spaced"))
    return per_id.groupBy(*keys).agg(F.sum("n").alias("n_headers"), F.sum("bad").alias("n_forbidden"), F.sum("spaced").alias("n_spaced"), F.count_if(F.col("n") > 1).alias("n_repeated_ids"))


def _six_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    complement = str.maketrans(BASES, COMPLEMENTS)
    for b in batches:
        for at in range(0, len(b), SLICE):
            part, proteins = b.slice(at, SLICE), []
            for s in part.column(part.schema.get_field_index("seq")).to_pylist():
                for x in (s, s and s[::-1].translate(complement)):
                    if x is None:
                        proteins += [None] * 3
                        continue
                    code = CODES[np.frombuffer(x.encode("latin-1", "replace"), np.uint8)]
                    for k in range(3):
                        codon = code[k : k + max(0, len(code) - k) // 3 * 3].reshape(-1, 3) @ PLACES
                        proteins.append(AMINO[np.minimum(codon, 64)].tobytes().decode())
            rows = part.take(pa.array(np.repeat(np.arange(len(part)), 6)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.tile(FRAMES, len(part)), pa.int32()), pa.array(proteins, pa.string())], names=[*rows.schema.names, "frame", "protein"])


def translations(seqs: DataFrame) -> DataFrame:
    """A row per sequence and frame (1, 2, 3, -1, -2, -3), by the rule of functions.six_frames; whole codons are looked up together."""
    added = T.StructType([T.StructField("frame", T.IntegerType()), T.StructField("protein", T.StringType())])
    return seqs.mapInArrow(_six_frames, T.StructType([*seqs.schema.fields, *added.fields]))


def coding_density(genes: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Coding bases (end - start) over all bases, and the mean gene score."""
    coding = genes.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("coding"), F.avg("score").alias("score"))
    return coding.join(lengths, [k for k in keys if k in lengths.columns]).withColumn("density", F.col("coding") / F.col("length"))


def with_translation(results: DataFrame, translated: DataFrame, keys: tuple[str, ...] = ("gene", "frame")) -> DataFrame:
    """Results with the nucleotides and the protein of the frame that was found: translated has gene, frame, seq, protein."""
    return results.join(translated.select(*keys, F.col("seq").alias("nt"), F.col("protein").alias("aa")), list(keys))


#: How a frame is written in the description of a translated sequence.
FRAME_LABELS = {1: "orig_seq_frame_1", 2: "orig_seq_frame_2", 3: "orig_seq_frame_3", -1: "rev_comp_frame_1", -2: "rev_comp_frame_2", -3: "rev_comp_frame_3"}


def frame_label(frame: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in FRAME_LABELS.items() for x in pair))[frame]
