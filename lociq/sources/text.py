"""Readers of the text formats.

Formats of blocks are read with the block's own separator (lineSep), so a block
arrives as one row, files stay splittable and no global line numbers are
needed.  Where the order of lines counts, it is carried as (file, offset of
the split, position in the split).  .gz files are read by Spark itself.
Schemas are fixed; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.scalars import key_values
from lociq.sources.sinks import RECORD

FILE = "_metadata.file_name"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_order, line) of text files."""
    df = spark.read.text(path)
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return df.select(F.col(FILE).alias("file"), order.alias("line_order"), F.col("value").alias("line"))


def marker_of_file(file: Column) -> Column:
    """Base name up to the first dot."""
    return F.regexp_extract(file, r"([^/.]+)[^/]*$", 1)


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq_id, description, seq): a row per record, sequence lines joined."""
    df = spark.read.option("lineSep", "\n>").text(path).select(F.col(FILE).alias("file"), F.regexp_replace("value", "^>", "").alias("rec"))
    head = F.regexp_replace(F.substring_index("rec", "\n", 1), "\r$", "")
    body = F.when(F.locate("\n", F.col("rec")) > 0, F.substring(F.col("rec"), F.locate("\n", F.col("rec")) + 1, F.length("rec"))).otherwise("")
    return df.where("trim(rec) <> ''").select("file", F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), head.alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"))


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header) of every line that starts with the sign of a header."""
    return lines(spark, path).where(F.col("line").startswith(">")).select("file", F.col("line").alias("header"))


#: Columns of a domain table.
DOMAIN_COLUMNS = "target:string target_accession:string tlen:int query:string query_accession:string qlen:int evalue:double full_score:double bias:double dom_num:int ndom:int c_evalue:double i_evalue:double dom_score:double dom_bias:double hmm_from:int hmm_to:int ali_from:int ali_to:int env_from:int env_to:int acc:double"


def domain_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Domain rows: 22 columns by white space, the rest joined without spaces as description; marker from the file name."""
    rows = lines(spark, path).where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    p = F.split(F.trim("line"), r"\s+")
    columns = [F.get(p, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(c.split(":") for c in DOMAIN_COLUMNS.split())]
    rest = F.array_join(F.slice(p, F.lit(23), F.greatest(F.size(p) - 22, F.lit(0))), "").alias("description")
    return rows.select(marker_of_file(F.col("file")).alias("marker"), "file", "line_order", *columns, rest)


def translated_search(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of a translated search: malformed ones are left out, contig ends put in order, strand always plus."""
    p = F.split("line", "\t")
    at = lambda i, t: F.get(p, F.lit(i)).try_cast(t)
    rows = lines(spark, path).where(~F.col("line").startswith("#"))
    rows = rows.select("file", "line_order", at(0, "string").alias("marker"), at(1, "string").alias("contig"), at(6, "bigint").alias("m_start"), at(7, "bigint").alias("m_end"), at(8, "bigint").alias("a"), at(9, "bigint").alias("b"), at(10, "double").alias("evalue")).dropna()
    return rows.select("file", "line_order", "marker", "contig", "m_start", "m_end", F.least("a", "b").alias("start"), F.greatest("a", "b").alias("end"), "evalue", F.lit("+").alias("strand"))


def finished_searches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, complete): whether the last line of each file says that all was processed."""
    last = lines(spark, path).groupBy("file").agg(F.max_by("line", "line_order").alias("last"))
    return last.select("file", F.col("last").contains("processed").alias("complete"))


def search_is_complete(spark: SparkSession, path: str) -> bool:
    """Whether all searches ended; an empty file is complete."""
    return finished_searches(spark, path).where("not complete").isEmpty()


def alignment_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments: PAF line, translated sequence and GFF rows of one block each; unmapped proteins are left out.

    gff keeps the block's own GFF lines, which is what a per-marker GFF needs.
    """
    df = spark.read.option("lineSep", "##PAF\t").text(path).select(F.col(FILE).alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("line_order"), F.split("value", "\n").alias("ls"))
    p = F.split(F.get("ls", F.lit(0)), "\t")
    at = lambda i, t="string": F.get(p, F.lit(i)).try_cast(t)
    tag = lambda i: F.get(F.split(F.trim(at(i)), ":"), F.lit(2))
    rows = df.where((F.size(p) > 8) & (at(5) != "*"))
    gff = F.filter(F.slice("ls", F.lit(3), F.greatest(F.size("ls") - 2, F.lit(0))), lambda x: F.size(F.split(x, "\t")) >= 9)
    of = lambda kind: F.filter(gff, lambda x: F.split(x, "\t")[2] == kind)
    part = lambda x, i: F.split(x, "\t")[i]
    exons = F.transform(of("CDS"), lambda x: F.struct(part(x, 3).cast("bigint").alias("start"), part(x, 4).cast("bigint").alias("stop"), part(x, 5).try_cast("double").alias("score"), part(x, 6).alias("strand")))
    attributes = F.get(F.split(part(F.get(of("mRNA"), F.lit(0)), 8), " "), F.lit(0))
    rows = rows.select(
        "file", "line_order", at(0).alias("target"), at(1, "bigint").alias("protein_length"), at(2, "bigint").alias("protein_start"), at(3, "bigint").alias("protein_end"), at(4).alias("strand"), at(5).alias("contig"),
        at(7, "bigint").alias("start"), at(8, "bigint").alias("end"), tag(13).try_cast("bigint").alias("score"), tag(17).alias("cigar"),
        F.upper(F.get(F.split(F.get("ls", F.lit(1)), "\t"), F.lit(1))).alias("protein"), exons.alias("exons"), key_values(attributes)["Identity"].try_cast("double").alias("identity"), gff.alias("gff"),
    )
    gene = F.concat("target", F.lit("|"), "contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("|"), "strand")
    return rows.where("identity is not null and size(exons) > 0").select(gene.alias("gene"), F.split("target", "_")[0].alias("marker"), "*")


def predictor_header(header: Column) -> Column:
    """Struct of a pipe-encoded header: target|contig|strand|score|evalue|n|low|high|exon|exon...; contigs may hold pipes.

    Exon parts are low[taken]:high[taken]:length[taken]; on the minus strand a
    taken low that does not fit is high + length - 1 in taken, and as written in
    recorded.
    """
    m = lambda g: F.regexp_extract(header, r"^([^|]*)\|(.*?)\|([+-])\|([^|]*)\|([^|]*)\|(\d+)\|(\d+)\|(\d+)((?:\|.*)?)$", g)
    exons = F.filter(F.split(m(9), r"\|"), lambda x: x != "")
    pair = lambda x, i, g: F.regexp_extract(F.split(x, ":")[i], r"^(\d+)\[(\d+)\]", g).try_cast("bigint")
    strand = m(3)

    def taken(x: Column) -> Column:
        low, high, n = pair(x, 0, 2), pair(x, 1, 2), pair(x, 2, 2)
        return F.struct(F.when((strand == "-") & (high + n - 1 != low), high + n - 1).otherwise(low).alias("low"), high.alias("high"), n.alias("length"))

    low, high = m(7), m(8)
    return F.struct(
        m(1).alias("target"), m(2).alias("contig"), strand.alias("strand"), m(4).try_cast("double").alias("score"), m(5).try_cast("double").alias("evalue"), m(6).try_cast("int").alias("n_exons"), low.try_cast("bigint").alias("low"), high.try_cast("bigint").alias("high"),
        F.transform(exons, taken).alias("taken"), F.transform(exons, lambda x: F.struct(pair(x, 0, 2).alias("a"), pair(x, 1, 2).alias("b"))).alias("exons"), F.transform(exons, lambda x: F.struct(pair(x, 0, 1).alias("low"), pair(x, 1, 1).alias("high"), pair(x, 2, 1).alias("length"))).alias("planned"),
        F.concat(m(1), F.lit("|"), m(2), F.lit(":"), low, F.lit("-"), high, F.lit("|"), strand).alias("gene"),
    )


def predicted_genes(proteins: DataFrame, codons: DataFrame) -> DataFrame:
    """Predicted genes with both sequences, joined on the gene id (FASTA rows of the two files); an id that a file repeats ends the run."""

    def one(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(predictor_header(F.col("seq_id")).alias("h"), F.col("seq").alias(name))
        per_gene = rows.groupBy("h.gene").agg(F.count("*").alias("n"), F.first(F.struct("h", name)).alias("r"))
        only = F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("the gene id is not unique: "), "gene")))
        return per_gene.select(only.alias("r")).select("r.h.*", f"r.{name}")

    return one(codons, "nt").join(one(proteins, "aa").select("gene", "aa"), "gene")


def repeated_ids(df: DataFrame, column: str) -> DataFrame:
    """Ids that occur more than once."""
    return df.groupBy(column).count().where("count > 1").select(column)


def marker_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(marker, value, columns of folders) of the records that sinks.write_by_marker wrote."""
    df = spark.read.option("lineSep", RECORD).text(path).where("value <> ''")
    at = F.locate("\n", F.col("value"))
    body = F.substring("value", at + 1, F.length("value") - at - 1)
    return df.select(F.substring("value", F.lit(1), at - 1).alias("marker"), body.alias("value"), *(c for c in df.columns if c != "value"))


def prokaryotic_genes(fasta_rows: DataFrame) -> DataFrame:
    """Genes of a prokaryotic predictor: places from the description, contig from the id, a new id contig:start-end|strand."""
    p = F.split("description", " # ")
    strand = F.when(F.trim(p[3]) == "1", "+").otherwise("-")
    contig = F.regexp_replace("seq_id", r"_[^_]*$", "")
    out = fasta_rows.select("*", contig.alias("contig"), F.trim(p[1]).try_cast("bigint").alias("start"), F.trim(p[2]).try_cast("bigint").alias("end"), strand.alias("strand"))
    return out.withColumn("gene", F.format_string("%s:%d-%d|%s", "contig", "start", "end", "strand"))


def mean_gene_score(gff: DataFrame, keys: list[str], attributes: str = "attributes") -> DataFrame:
    """Mean score of the genes of a GFF, from its attributes; genes without one don't count."""
    return gff.groupBy(*keys).agg(F.avg(gene_score(F.col(attributes))).alias("score"))


def gene_score(attributes: Column) -> Column:
    return F.regexp_extract(attributes, r";score=(.+?);", 1).try_cast("double")


def hmm_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Genes of an HMM predictor's output: a block per gene with GFF rows, coding sequence and protein.

    Each gene has its own exons.  A block without a finished protein (a file cut
    short) is left out.
    """
    df = spark.read.option("lineSep", "# start gene ").text(path).select(F.col(FILE).alias("file"), F.col("value").alias("v"))
    joined = lambda name: F.regexp_replace(F.regexp_extract("v", rf"(?s)# {name} = \[([^\]]*)\]", 1), r"[\s#]", "")
    gff = F.filter(F.split("v", "\n"), lambda x: ~x.startswith("#") & (F.size(F.split(x, "\t")) >= 9))
    part = lambda x, i: F.split(x, "\t")[i]
    gene = F.get(F.filter(gff, lambda x: part(x, 2) == "gene"), F.lit(0))
    exons = F.transform(F.filter(gff, lambda x: part(x, 2) == "CDS"), lambda x: F.struct(part(x, 3).cast("bigint").alias("a"), part(x, 4).cast("bigint").alias("b")))
    rows = df.select(marker_of_file(F.col("file")).alias("marker"), "file", gene.alias("g"), exons.alias("exons"), F.upper(joined("coding sequence")).alias("nt"), F.upper(joined("protein sequence")).alias("aa")).where("g is not null and aa <> ''")
    rows = rows.select("marker", "file", part(F.col("g"), 0).alias("contig"), part(F.col("g"), 3).cast("bigint").alias("start"), part(F.col("g"), 4).cast("bigint").alias("end"), part(F.col("g"), 6).alias("strand"), "exons", "nt", "aa")
    return rows.withColumn("gene", F.format_string("%s:%d-%d|%s", "contig", "start", "end", "strand"))


def score_cutoffs(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("line"), r"\s+")
    return lines(spark, path).where("trim(line) <> ''").select(p[0].alias("marker"), F.get(p, F.lit(1)).cast("double").alias("cutoff"))


def length_cutoffs(spark: SparkSession, path: str) -> DataFrame:
    """marker, sigma (0 becomes 1), length."""
    p = F.split(F.trim("line"), r"\s+")
    sigma = F.get(p, F.lit(2)).cast("double")
    return lines(spark, path).where("trim(line) <> ''").select(p[0].alias("marker"), F.when(sigma == 0, 1.0).otherwise(sigma).alias("sigma"), F.get(p, F.lit(3)).cast("double").alias("length"))


def annotation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="marker string, description string, link string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="dataset string, date string, hash string, domain string, type string")


def id_list(spark: SparkSession, path: str, name: str = "marker") -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias(name))


def virus_datasets(spark: SparkSession, path: str) -> DataFrame:
    return id_list(spark, path, "dataset").select(F.regexp_replace("dataset", r"_odb.*$", "").alias("dataset"))


def taxid_datasets(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "\t")
    return spark.read.text(path).select(F.trim(p[0]).alias("taxid"), F.split(F.trim(F.get(p, F.lit(1))), ",")[0].alias("dataset"))


def taxid_paths(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, path) of every node on a lineage, root first."""
    levels = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split(F.trim(F.get(F.split("value", "\t"), F.lit(4))), ",").alias("l"))
    return levels.select(F.posexplode("l").alias("i", "taxid"), "l").select("taxid", F.slice("l", F.lit(1), F.col("i") + 1).alias("path")).distinct()


def placements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(query, nodes) of a placement file, and (node, taxid) labels found in its tree."""
    doc = spark.read.schema("tree string, placements array<struct<p: array<array<double>>>>").json(path, multiLine=True)
    rows = doc.select(F.posexplode("placements").alias("query", "x")).select("query", F.transform("x.p", lambda v: v[0].cast("bigint").cast("string")).alias("nodes"))
    found = F.regexp_extract_all("tree", F.lit(r"([A-Za-z]*_?[0-9]*:[0-9.eE+-]*[^\[\(\),]{0,4}\[[0-9]+\])"), F.lit(1))
    nodes = doc.select(F.explode(found).alias("x")).select(F.regexp_extract("x", r"\[([0-9]+)\]", 1).alias("node"), F.regexp_extract("x", r"([0-9]*):", 1).alias("taxid")).where("taxid <> ''")
    return rows, nodes.dropDuplicates(["node"])


def dataset_config(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value lines of a data set's small config file; a domain is required."""
    out = dict(r["value"].strip().split("=", 1) for r in spark.read.text(path).where("value like '%=%'").collect())
    if "domain" not in out:
        raise ValueError("the data set's config names no domain")
    return out


#: Labels of a text summary.
SUMMARY_LABELS = {"single-copy": "s", "duplicated": "d", "Fragmented": "f", "Missing": "m"}


def short_summaries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, s, d, f, m) counts of text summaries."""
    rows = lines(spark, path).select("file", F.regexp_extract("line", r"^\s*(\d+)\s", 1).try_cast("bigint").alias("n"), "line").where("n is not null")
    return rows.groupBy("file").agg(*(F.max(F.when(F.col("line").contains(label), F.col("n"))).alias(k) for label, k in SUMMARY_LABELS.items()))


def metrics_log(spark: SparkSession, path: str) -> DataFrame:
    """Six figures of an assembly statistics log; of an N/L pair the larger is the length."""
    after = lambda prefix: F.max(F.when(F.col("line").startswith(prefix), F.regexp_replace(F.element_at(F.split("line", ":"), -1), r"^\s+|\s+$", "")))
    larger = lambda c: F.greatest(*(F.trim(F.get(F.split(c, "/"), F.lit(i))).try_cast("bigint") for i in (0, 1)))
    gap = F.max(F.when(F.col("line").startswith("Main genome contig sequence total:"), F.regexp_replace(F.trim(F.element_at(F.split("line", "\t"), -1)), " ?gap$", "")))
    row = lines(spark, path).agg(after("Main genome scaffold total:").alias("n_scaffolds"), after("Main genome contig total:").alias("n_contigs"), after("Main genome scaffold sequence total:").alias("total_length"), gap.alias("gap"), after("Main genome scaffold N/L50:").alias("a"), after("Main genome contig N/L50:").alias("b"))
    return row.select("n_scaffolds", "n_contigs", "total_length", "gap", larger(F.col("a")).alias("scaffold_n50"), larger(F.col("b")).alias("contig_n50"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))
