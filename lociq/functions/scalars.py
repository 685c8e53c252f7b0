"""Scalar expressions: rounding, identifiers, intervals, sequences, CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def python_round(x: Column, digits: int = 1) -> Column:
    """Half-even rounding of the exact binary value, as Python's round does."""
    return F.regexp_replace(F.format_number(x, digits), ",", "").cast("double")


def percent(part: Column, whole: Column) -> Column:
    return python_round(F.abs(part.cast("double") / whole.cast("double") * 100), 1)


def marker_number(marker: Column) -> Column:
    """Sort key of a marker: the integer before "at"."""
    return F.split(marker, "at")[0].try_cast("bigint")


def marker_base(target: Column) -> Column:
    """Marker of a variant id: what stands before the first underscore."""
    return F.split(target, "_")[0]


def marker_in(text: Column) -> Column:
    """First marker id inside a text."""
    return F.regexp_extract(text, r"(\d+at\d+)", 1)


def gene_of_target(target: Column) -> Column:
    """Gene id of a target: its pipe parts without the first and last if there are more than two, else the last but one."""
    p = F.split(target, r"\|")
    n = F.size(p)
    return F.when(n > 2, F.array_join(F.slice(p, 2, F.greatest(n - 2, F.lit(0))), "|")).when(n == 2, F.get(p, F.lit(0))).otherwise(target)


_PLACE = r"^(.*):(\d+)-(\d+)(?:\|[+-])?$"


def gene_contig(gene: Column) -> Column:
    return F.regexp_extract(gene, _PLACE, 1)


def gene_start(gene: Column) -> Column:
    return F.regexp_extract(gene, _PLACE, 2).try_cast("bigint")


def gene_end(gene: Column) -> Column:
    return F.regexp_extract(gene, _PLACE, 3).try_cast("bigint")


def without_place(gene: Column) -> Column:
    """Gene id without a :start-end suffix."""
    return F.regexp_replace(gene, r":\d+-\d+$", "")


def reported_place(start: Column, end: Column, strand: Column) -> tuple[Column, Column]:
    """Ends ascending, descending on the minus strand."""
    low, high = F.least(start, end), F.greatest(start, end)
    return F.when(strand == "-", high).otherwise(low), F.when(strand == "-", low).otherwise(high)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length of two regions by min(end) - max(start), 0 if they are apart."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def hull(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.struct(F.least(s1, s2).alias("start"), F.greatest(e1, e2).alias("end"))


def interval_sum(intervals: Column) -> Column:
    """Sum of end - start over array<struct<start, end>>."""
    return F.aggregate(intervals, F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])


def frame(low: Column) -> Column:
    return low % 3


def key_values(line: Column, pair: str = ";", kv: str = "=") -> Column:
    return F.str_to_map(line, F.lit(pair), F.lit(kv))


def dataset_version(name: Column) -> Column:
    """Number behind _odb at the end of a dataset's name; null if there is none or it is below 10."""
    v = F.regexp_extract(name, r"_odb(\d+(?:\.\d+)?)$", 1).try_cast("double")
    return F.when(v >= 10, v)


def display_length(n: Column) -> Column:
    """n MB above a million, n KB above a thousand, rounded down."""
    return F.when(n > 1e6, F.concat(F.floor(n / 1e6).cast("string"), F.lit(" MB"))).when(n > 1e3, F.concat(F.floor(n / 1e3).cast("string"), F.lit(" KB"))).otherwise(n.cast("bigint").cast("string"))


#: Bases and their complements, ambiguity codes included.
BASES, COMPLEMENTS = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), BASES, COMPLEMENTS)


#: The standard genetic code, codons in the order TCAG x TCAG x TCAG.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate(seq: Column, stop: str = "X") -> Column:
    """Protein of a coding sequence: whole codons, stops and codons with other letters as given or X."""
    table = AMINO_ACIDS.replace("*", stop)
    codons = F.regexp_extract_all(F.translate(F.upper(seq), "U", "T"), F.lit("(?s)(...)"), F.lit(1))

    def amino(codon: Column) -> Column:
        digits = F.translate(codon, "TCAG", "0123")
        return F.when(digits.rlike("^[0-3]{3}$"), F.substring(F.lit(table), F.conv(digits, 4, 10).cast("int") + 1, F.lit(1))).otherwise("X")

    return F.array_join(F.transform(codons, amino), "")


def six_frames(seq: Column) -> Column:
    """array<struct<frame, protein>> of the frames 1, 2, 3, -1, -2, -3."""
    back = reverse_complement(seq)
    frames = [F.struct(F.lit(sign * (k + 1)).alias("frame"), translate(F.substring(s, F.lit(k + 1), F.length(s))).alias("protein")) for sign, s in ((1, seq), (-1, back)) for k in range(3)]
    return F.array(*frames)


def cigar_tokens(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string."""
    parts = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDFGNUV])"), F.lit(1))
    return F.transform(parts, lambda t: F.struct(F.substring(t, F.lit(1), F.length(t) - 1).cast("int").alias("n"), F.right(t, F.lit(1)).alias("op")))


#: Matches that must stand on both sides of a frameshift for it to count.
FLANKING_MATCHES = 20


def frameshifts(cigar: Column) -> Column:
    """struct<events, length>: F and G operations with 20 or more matches on both sides within their exon (exons part at N, U, V)."""
    none = F.struct(F.lit(0).alias("events"), F.lit(0).alias("length"))
    begin = F.struct(F.lit(0).alias("m"), F.array().cast("array<struct<before:int,n:int>>").alias("seen"))

    def step(acc: Column, t: Column) -> Column:
        m = F.when(t["op"] == "M", acc["m"] + t["n"]).otherwise(acc["m"])
        shift = t["op"].isin("F", "G") & (acc["m"] >= FLANKING_MATCHES)
        return F.struct(m.alias("m"), F.when(shift, F.array_append(acc["seen"], F.struct(acc["m"].alias("before"), t["n"].alias("n")))).otherwise(acc["seen"]).alias("seen"))

    def add(acc: Column, n: Column) -> Column:
        return F.struct((acc["events"] + 1).alias("events"), (acc["length"] + n).alias("length"))

    def of_exon(total: Column, exon: Column) -> Column:
        """What the exon's operations add; its tokens are gone through once."""
        inside = F.aggregate(cigar_tokens(exon), begin, step, lambda acc: F.transform(F.filter(acc["seen"], lambda x: acc["m"] - x["before"] >= FLANKING_MATCHES), lambda x: x["n"]))
        return F.aggregate(inside, total, add)

    return F.aggregate(F.filter(F.split(cigar, r"[0-9]+[NUV]"), lambda e: e.rlike("[FG]")), none, of_exon)


def internal_stops(protein: Column) -> Column:
    """Stops inside a protein: stars but those at its ends."""
    return F.regexp_count(F.regexp_replace(F.upper(protein), r"^\*+|\*+$", ""), F.lit(r"\*"))


def cleaned_protein(protein: Column) -> Column:
    return F.replace(F.upper(protein), F.lit("*"), F.lit(""))
