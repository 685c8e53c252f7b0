"""Whole runs: one input, the automatic choice of a lineage, and batches.

An input is a folder with what the external programs made of it:

    hits/<lineage>/        domain tables, one for each marker and round (or hits/, or the folder itself)
    genes/<lineage>/       genomes: alignments.gff, predicted.faa and .fna, found.faa, or predictions.txt
    sequences.fna          the sequences that were searched, for metrics and translated transcripts
    placement/<root>.json  placements of a root lineage's markers

Data sets lie in <download_path>/lineages, lists and mappings in
<download_path>/information and <download_path>/placement_files.
"""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq import pipeline, storage
from lociq.config import Config, unused_options
from lociq.errors import ConfigError, NoGenesError, is_fatal
from lociq.log import timestamp
from lociq.operators import alignments, assembly, exons, lineage
from lociq.operators import hits as H
from lociq.runs import RunFolder, boxed, stage
from lociq.sources import sinks, text

LOG = logging.getLogger("lociq")
#: The version that root lineages fall back to.
OLDEST = "odb10"
VERSION = "0.2"


@dataclass
class Result:
    """A lineage's run of one input."""

    dataset: str
    domain: str
    kept: DataFrame
    statuses: DataFrame
    genes: DataFrame | None
    summary: dict
    notation: str


def resolve_dataset(config: Config, name: str) -> str:
    """A data set's folder: a path as given, the exact name, the newest of its versions, or the oldest version with a warning."""
    if "/" in name:
        if not storage.exists(name):
            raise ConfigError(f"{name} does not exist")
        return name
    base = f"{config.download_path}/lineages"
    known = storage.names(base)
    if name in known:
        return f"{base}/{name}"
    dated = [n for n in known if n.startswith(name + ".")]
    if dated:
        return f"{base}/{dated[-1]}"
    old = name.split("_odb")[0] + f"_{OLDEST}"
    if old in known:
        LOG.warning("the data set %s is not there, %s is used", name, old)
        return f"{base}/{old}"
    raise ConfigError(f"{name} is not a valid data set")


def gene_details(spark: SparkSession, folder: str) -> DataFrame | None:
    """What a predictor knows of its genes: gene, contig, start, end, strand, exons, nt, aa, and identity, stops, gff of alignments."""
    none = lambda kind: F.lit(None).cast(kind)
    pair = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    extra = {"identity": none("double"), "stops": none("int"), "gff": none("array<string>")}
    columns = ["gene", "contig", "start", "end", "strand", "exons", "nt", "aa", *extra]
    here = set(storage.names(folder))
    if "alignments.gff" in here:
        rows = alignments.with_facts(alignments.suppress_overlapping(text.alignment_blocks(spark, f"{folder}/alignments.gff").withColumn("aln_id", F.monotonically_increasing_id())))
        rows = rows.withColumns({"exons": F.transform("exons", lambda x: pair(x["start"], x["stop"])), "nt": none("string"), "aa": F.col("protein"), "stops": F.col("stops").cast("int")})
    elif {"predicted.faa", "predicted.fna"} <= here:
        rows = text.predicted_genes(*(text.fasta(spark, f"{folder}/predicted.{k}") for k in ("faa", "fna")))
        rows = rows.withColumnsRenamed({"low": "start", "high": "end"}).withColumns({"exons": F.transform("exons", lambda x: pair(x["a"], x["b"])), **extra})
    elif "found.faa" in here:
        rows = text.prokaryotic_genes(text.fasta(spark, f"{folder}/found.faa")).withColumns({"exons": F.array(pair(F.col("start"), F.col("end"))), "nt": none("string"), "aa": F.col("seq"), **extra})
    elif "predictions.txt" in here:
        rows = text.hmm_predictions(spark, f"{folder}/predictions.txt").withColumns(extra)
    else:
        return None
    return rows.select(*columns).dropDuplicates(["gene"])


def settle_overlaps(ranks: DataFrame, details: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked targets and gene details after exons that genes of different markers share have gone to one of them."""
    matches = ranks.select("marker", F.col("target").alias("gene"), "score", F.lit(1).alias("run")).distinct()
    shared = exons.exon_records(matches, details)
    env = hits.select("marker", F.col("target").alias("gene"), "env_from", "env_to")
    left = exons.resolve_overlaps(shared.drop("run"), env).select("marker", F.col("gene").alias("target"), "new_gene", "new_low", "new_high", "start_trim", "end_trim")
    cut = left.withColumnRenamed("target", "gene").join(details, "gene")
    nt, aa = exons.trimmed(F.col("nt"), F.col("aa"), F.col("start_trim").cast("int"), F.col("end_trim").cast("int"))
    inside = F.filter("exons", lambda x: (F.least(x["a"], x["b"]) >= F.col("new_low")) & (F.greatest(x["a"], x["b"]) <= F.col("new_high")))
    changed = F.col("new_gene") != F.col("gene")
    cut = cut.withColumns({"nt": nt, "aa": aa, "exons": inside, "start": F.when(changed, F.col("new_low")).otherwise(F.col("start")), "end": F.when(changed, F.col("new_high")).otherwise(F.col("end"))})
    cut = cut.select("marker", F.col("new_gene").alias("gene"), *(c for c in details.columns if c != "gene")).dropDuplicates(["marker", "gene"])
    new_id = F.when(F.col("new_gene") != F.col("target"), F.concat(F.regexp_replace("gene", r":[^:]*$", ":"), F.col("new_low").cast("string"), F.lit("-"), F.col("new_high").cast("string"))).otherwise(F.col("gene"))
    moved = ranks.join(left, ["marker", "target"]).withColumn("gene", new_id).withColumn("target", F.col("new_gene"))
    return moved.select(*ranks.columns), cut


def run_lineage(spark: SparkSession, config: Config, given: str, dataset: str, folder: RunFolder) -> Result:
    """One input against one data set; what it finds is written to the run's folder and can be taken up again by a restart."""
    name = os.path.basename(dataset.rstrip("/"))
    facts = text.dataset_config(spark, f"{dataset}/dataset.cfg") if storage.exists(f"{dataset}/dataset.cfg") else {}
    domain = facts.get("domain", "eukaryota")
    which = config.pipeline(domain)
    for option in unused_options(config, which):
        LOG.warning("option %s is not used by %s", option, which)
    cutoffs = pipeline.read_dataset(spark, dataset)
    by_length = name.endswith("_odb10") or (config.datasets_version == "odb10" and "_odb" not in name)
    search = next(p for p in (f"{given}/hits/{name}", f"{given}/hits", given) if storage.exists(p))
    hits = text.domain_hits(spark, search)
    if hits.isEmpty():
        raise NoGenesError("the profile search")
    has_places = config.mode == "genome" or which == "transcriptome_aligner_a"
    ties = [F.col(c) for c in pipeline.TIES]
    columns = ["marker", "file", "target", "gene", "score", "matched_length", "rank"]
    make = lambda: H.filter_ranks(pipeline.classified(hits, cutoffs, not has_places, by_length), ties).select(*columns)
    ranks = stage(spark, folder, "ranks", make, config.restart)
    details = gene_details(spark, f"{given}/genes/{name}") if has_places else None
    if details is not None:
        details = stage(spark, folder, "genes", lambda: details, config.restart)
        details = details.join(ranks.select("marker", F.col("target").alias("gene")).distinct(), "gene").select("marker", *details.columns)
        if domain == "eukaryota":
            ranks, details = settle_overlaps(ranks, details.drop("marker").distinct(), hits)
            ranks, details = stage(spark, folder, "settled", lambda: ranks, config.restart), stage(spark, folder, "settled_genes", lambda: details, config.restart)
    kept = H.only_best_fragments(ranks, ties)
    statuses = H.consolidate(kept, cutoffs)
    genes = None
    if details is not None:
        genes = kept.select("marker", F.col("target").alias("gene")).join(details, ["marker", "gene"]).join(statuses, "marker")
    elif config.mode == "transcriptome" and storage.exists(f"{given}/sequences.fna"):
        genes = translated_genes(spark, f"{given}/sequences.fna", hits, kept).join(statuses, "marker")
    summary = H.summarise(statuses)
    stops = None
    if genes is not None and details is not None and which.startswith("genome_aligner_b"):
        stops = H.stop_summary(genes.where("status <> 'Missing'")).first().asDict()
    shown = H.notation(summary, F.lit(stops["e_percent"]) if stops else None)
    row = summary.withColumn("notation", shown).first().asDict()
    shown = row.pop("notation")
    if not row["s"] + row["d"] + row["f"] and not config.auto_lineage:
        raise NoGenesError("the profile search")
    return Result(name, domain, kept, statuses, genes, row | (stops or {}), shown)


def translated_genes(spark: SparkSession, sequences: str, hits: DataFrame, kept: DataFrame) -> DataFrame:
    """Reported transcripts with the protein of the frame that their best hit names in its description."""
    seqs = text.fasta(spark, sequences).select("seq_id", "seq")
    wanted = seqs.join(kept.select(F.col("target").alias("seq_id")).distinct(), "seq_id", "left_semi")
    made = assembly.translations(wanted).select(F.col("seq_id").alias("gene"), "seq", "protein", assembly.frame_label(F.col("frame")).alias("frame"))
    framed = hits.where("description like '%frame%'").groupBy("marker", F.col("target").alias("gene")).agg(F.min_by("description", "line_order").alias("frame"))
    rows = kept.select("marker", F.col("target").alias("gene")).distinct().join(framed, ["marker", "gene"])
    return assembly.with_translation(rows, made)


def write_run(config: Config, folder: RunFolder, r: Result, specific: bool, metrics: dict | None, warnings: list[str] | None = None) -> None:
    """Table, missing list, sequences, GFF, and the text and JSON summaries."""
    annotation, places = None, r.genes is not None and "contig" in r.genes.columns
    links = f"{r_dataset(config, r)}/links.txt"
    spark = r.kept.sparkSession
    if storage.exists(links):
        annotation = text.annotation(spark, links)
    rows = r.kept
    if places:
        rows = rows.join(r.genes.select("marker", F.col("gene").alias("target"), "start", "end", "strand"), ["marker", "target"], "left")
    table = H.result_table(r.statuses, rows.withColumn("matched_length", F.col("matched_length").cast("double")), annotation)
    if places:
        table = table.join(rows.select("marker", "gene", "start", "end", "strand"), ["marker", "gene"], "left")
    out = sinks.full_table_rows(table, places, annotation is not None)
    sinks.write_report(out, sinks.table_header(VERSION, r.dataset, places, annotation is not None), folder.path("full_table"))
    sinks.write_report(H.missing_markers(r.statuses).orderBy("marker"), sinks.table_header(VERSION, r.dataset, False, False).rsplit("\n", 1)[0] + "\n# Marker id", folder.path("missing"))
    if r.genes is not None:
        named = r.genes.withColumn("seq_id", F.col("gene"))
        for kind in ("aa", "nt"):
            sinks.write_fasta(named.withColumn("seq", F.col(kind)), folder.path("sequences", kind), ("status", "marker"))
        sinks.write_fasta(sinks.single_copy(named.withColumn("seq", F.col("aa")), r.statuses), folder.path("single_copy_proteins"))
        if places:
            sinks.write_gff(sinks.gff_lines(r.genes.where("gff is not null")), folder.path("gff"))
    for path, body in zip(folder.summary_names(specific), (sinks.text_summary(r.summary, r.notation, metrics), sinks.json_summary({"date": timestamp(), "dataset": r.dataset, "results": r.summary, "one_line_summary": r.notation, "metrics": metrics or {}, "warnings": warnings or []})), strict=True):
        storage.write_text(path, body)


def r_dataset(config: Config, r: Result) -> str:
    return config.lineage_dataset if config.lineage_dataset and "/" in config.lineage_dataset else f"{config.download_path}/lineages/{r.dataset}"


def assembly_facts(spark: SparkSession, config: Config, given: str) -> dict | None:
    """Metrics of a genome's sequences, unless they are left out."""
    path = f"{given}/sequences.fna"
    if config.mode != "genome" or config.skip_metrics or not storage.exists(path):
        return None
    seqs = text.fasta(spark, path).withColumn("input", F.lit(0))
    return sinks.display_metrics(assembly.metrics(seqs, ["input"], config.contig_break).drop("input")).first().asDict()


def chosen(results: list[Result]) -> Result:
    """The result of the lineage that fits best, by the same rule for roots and viruses."""
    spark = results[0].kept.sparkSession
    rows = [(0, i, str(i), *(r.summary[k] for k in ("s", "d", "f", "s_percent", "d_percent", "f_percent"))) for i, r in enumerate(results)]
    best = lineage.best_lineage(spark.createDataFrame(rows, "input int, ordinal int, lineage string, s long, d long, f long, s_percent double, d_percent double, f_percent double"), ["input"])
    return results[best.first()["ordinal"]]


def placed_dataset(spark: SparkSession, config: Config, given: str, root: Result) -> str | None:
    """The data set nearest to where a root's markers were placed in the tree; none if it is the root's own or can't be told."""
    name, files = root.dataset.split("_odb")[0], f"{config.download_path}/placement_files"
    jplace, tree, sets = f"{given}/placement/{name}.json", f"{files}/taxid_paths.{root.dataset}.txt", f"{files}/taxid_datasets.{root.dataset}.txt"
    if not all(map(storage.exists, (jplace, tree, sets))):
        return None
    paths, datasets = text.taxid_paths(spark, tree), text.taxid_datasets(spark, sets)
    weights = lineage.marker_weights(lineage.first_resolvable(*text.placements(spark, jplace))).withColumn("input", F.lit(0))
    top = paths.orderBy(F.size("path")).first()
    ratio = lineage.ARCHAEA_RATIO if name == "archaea" else lineage.RATIO
    taxid = lineage.choose_taxid(weights, paths, ["input"], top["taxid"], ratio).first()
    near = lineage.nearest_dataset(paths.where(F.col("taxid") == taxid["taxid"]), datasets).join(datasets.withColumnRenamed("taxid", "dataset_taxid"), "dataset_taxid").first()
    if near is None or near["dataset"] == root.dataset:
        return None
    return near["dataset"] if "_odb" in near["dataset"] else f"{near['dataset']}_{root.dataset.rpartition('_')[2]}"


def auto_lineage(spark: SparkSession, config: Config, given: str, open_folder) -> tuple[Result, list[Result], bool]:
    """(best result, all results, whether it is a specific lineage's): roots, viruses where nothing else fits, then the nearest data set."""
    def run(name: str) -> Result:
        dataset = resolve_dataset(config, name)
        folder = open_folder(os.path.basename(dataset))
        return run_lineage(spark, config, given, dataset, folder)

    results = [run(f"{root}_{config.datasets_version}") for root in config.roots()]
    best, viral = chosen(results), False
    listed = f"{config.download_path}/information/virus_datasets.txt"
    if best.summary["s_percent"] < 3.0 and storage.size(f"{given}/sequences.fna") < 500_000 and not config.auto_lineage_euk and storage.exists(listed):
        for r in text.virus_datasets(spark, listed).orderBy("dataset").collect():  # a short list
            try:
                results.append(run(f"{r['dataset']}_{config.datasets_version}"))
            except NoGenesError:
                LOG.info("nothing of %s was found", r["dataset"])
        best = chosen(results)
        viral = best.domain == "viruses"
    if not best.summary["s"] + best.summary["d"] + best.summary["f"]:
        raise NoGenesError("no root lineage")
    LOG.info("%s selected", best.dataset)
    near = None if viral else placed_dataset(spark, config, given, best)
    if near is None:
        return best, results, False
    best = run(near)
    return best, [*results, best], True


def run_input(spark: SparkSession, config: Config, given: str, out: str) -> dict:
    """One input; the row that a batch table has of it."""
    def open_folder(name: str) -> RunFolder:
        return RunFolder(config.out_path, out, name, config.force, config.restart)

    metrics = assembly_facts(spark, config, given)
    if config.auto_lineage:
        best, results, specific = auto_lineage(spark, config, given, open_folder)
    else:
        dataset = resolve_dataset(config, config.lineage_dataset)
        best, specific = run_lineage(spark, config, given, dataset, open_folder(os.path.basename(dataset.rstrip("/")))), True
        results = [best]
    kept = next((h for h in LOG.handlers if hasattr(h, "messages")), None)
    for r in results:
        folder = RunFolder(config.out_path, out, r.dataset, restart=True)
        write_run(config, folder, r, specific and r is best, metrics, kept.messages if kept else None)
    sinks.write_list(H.missing_markers(best.statuses), "marker", f"{config.out_path.rstrip('/')}/{out}/missing")
    roots = {r.dataset.split("_odb")[0]: r.notation for r in results} if config.auto_lineage else {}
    row = {"input": os.path.basename(given.rstrip("/")), "dataset": best.dataset, **{f"{k}_percent": best.summary[f"{k}_percent"] for k in "csdfm"}, "n": best.summary["n"]}
    row |= {"e_percent": best.summary.get("e_percent"), "scores": roots, "metrics": metrics or {}}
    print_report(config, best, metrics)
    return row


def print_report(config: Config, best: Result, metrics: dict | None) -> None:
    if not config.quiet:
        labels = (("c", "Complete"), ("s", "Complete, single"), ("d", "Complete, duplicated"), ("f", "Fragmented"), ("m", "Missing"), ("n", "Total markers searched"))
        print(boxed([f"Results from dataset {best.dataset}", best.notation, *(f"{best.summary[k]}\t{label}" for k, label in labels)]))


def batch_lines(config: Config, rows: list[dict]) -> str:
    """The batch table: eight columns, then what the mode adds; an input without a result keeps a row that says why."""
    genome, stops = config.mode == "genome", config.mode == "genome" and config.predictor in (None, "aligner_b")
    roots, figures = config.roots(), ("scaffold_n50", "contig_n50", "gap_percent", "n_scaffolds")
    head = ["Input_file", "Dataset", "Complete", "Single", "Duplicated", "Fragmented", "Missing", "n_markers"]
    head += (["Internal stop codon percent"] if stops else []) + [f"Scores_{r}_{config.datasets_version}" for r in roots] + (["Scaffold N50", "Contigs N50", "Percent gaps", "Number of scaffolds"] if genome else [])
    out = ["\t".join(head)]
    for r in rows:
        if "error" in r:
            values = [r["input"], r["error"], *[""] * (len(head) - 2)]
        else:
            values = [r["input"], r["dataset"], *(r[f"{k}_percent"] for k in "csdfm"), r["n"]]
            values += ([r["e_percent"]] if stops else []) + [r["scores"].get(k, "Not run") for k in roots] + ([r["metrics"].get(k) for k in figures] if genome else [])
        out.append("\t".join("" if v is None else str(v) for v in values))
    return "\n".join(out) + "\n"


def run(spark: SparkSession, config: Config) -> list[dict]:
    """A run by its settings: one input, or each entry of a folder of inputs."""
    name = config.out or "lociq_run"
    is_input = any(storage.exists(f"{config.in_}/{p}") for p in ("hits", "genes", "sequences.fna")) or any(n.endswith((".out", ".gz")) or ".out." in n for n in storage.names(config.in_))
    if not storage.exists(config.in_):
        raise ConfigError(f"{config.in_} does not exist")
    if is_input or not storage.is_folder(config.in_):
        return [run_input(spark, replace(config, batch=False), config.in_, name)]
    rows = []
    for entry in storage.names(config.in_):
        try:
            rows.append(run_input(spark, config, f"{config.in_}/{entry}", f"{name}/{entry}"))
        except Exception as e:
            if is_fatal(e, True):
                raise
            LOG.error("%s: %s", entry, e)
            rows.append({"input": entry, "error": "No genes found" if isinstance(e, NoGenesError) else "Run failed; check logs"})
    storage.write_text(f"{config.out_path.rstrip('/')}/{name}/batch_summary.txt", batch_lines(config, rows))
    return rows
