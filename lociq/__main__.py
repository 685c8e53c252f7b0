"""Command line: assess what a profile search found, of one input or a folder of them."""

from __future__ import annotations

import argparse
import glob
import sys

from lociq.config import load
from lociq.errors import LociqError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lociq", description=__doc__)
    p.add_argument("-i", "--in", dest="in", metavar="HITS", help="folder of an input (see workflow), of domain tables, or of several inputs")
    p.add_argument("-o", "--out", help="name of the run")
    p.add_argument("--out_path", help="where the run's folder goes")
    p.add_argument("-m", "--mode", help="genome, transcriptome or proteins")
    p.add_argument("-l", "--lineage_dataset", help="folder of the lineage data set")
    p.add_argument("--config", help="config file with a [run] section")
    for name in ("auto-lineage", "auto-lineage-prok", "auto-lineage-euk", "force", "restart", "quiet", "offline", "skip-metrics", "scaffold-composition", "tar", "long"):
        p.add_argument(f"--{name}", dest=name.replace("-", "_"), action="store_const", const=True)
    p.add_argument("-c", "--cpu", type=int)
    p.add_argument("-e", "--evalue", type=float)
    p.add_argument("--limit", type=int)
    p.add_argument("--contig_break", type=int)
    p.add_argument("--datasets_version")
    p.add_argument("--download_path", help="folder of data sets and lists")
    p.add_argument("--list-datasets", nargs="?", const="all", help="show the data sets of the manifest: all, one domain, or one by name")
    p.add_argument("--predictor", choices=("aligner_a", "aligner_b", "hmm"))
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    path, list_kind = args.pop("config"), args.pop("list_datasets")
    if list_kind:
        args |= {"in": args["in"] or "-", "mode": args["mode"] or "proteins"}
    try:
        config = load(args, path)
    except LociqError as e:
        print(e, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from lociq import log, workflow

    spark = SparkSession.builder.appName("lociq").getOrCreate()
    local = "://" not in config.out_path
    log.set_up(f"{config.out_path.rstrip('/')}/{config.out or 'lociq_run'}/logs" if local else None, config.quiet)
    if list_kind:
        from lociq.runs import list_datasets

        list_datasets(workflow.text.manifest(spark, f"{config.download_path}/file_versions.tsv"), list_kind).show(1000, truncate=False)
        return 0
    try:
        rows = workflow.run(spark, config)
    except LociqError as e:
        print(e, file=sys.stderr)
        return 1
    if config.tar and local:
        from lociq.runs import archive

        for name in ("sequences", "gff"):
            for folder in glob.glob(f"{config.out_path.rstrip('/')}/{config.out or 'lociq_run'}/**/{name}", recursive=True):
                archive(folder)
    return 0 if rows else 1


if __name__ == "__main__":
    sys.exit(main())
