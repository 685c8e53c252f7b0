"""Folders, restarts, listings and the console report of a run."""

from __future__ import annotations

import logging
import os
import shutil
import textwrap

from pyspark.sql import DataFrame, SparkSession

from lociq import storage
from lociq.errors import ConfigError

LOG = logging.getLogger("lociq")


class RunFolder:
    """Where a run's files go: <out_path>/<out>/run_<lineage>/..., summaries beside them."""

    def __init__(self, out_path: str, out: str, lineage: str, force: bool = False, restart: bool = False):
        self.base = os.path.join(out_path, out)
        self.run = os.path.join(self.base, f"run_{lineage}")
        if storage.exists(self.run) and not (force or restart):
            raise ConfigError(f"{self.run} exists; use force or restart")
        if force:
            storage.delete(self.run)
        storage.make_folder(self.run)
        self.lineage, self.name = lineage, out

    def path(self, *parts: str) -> str:
        return os.path.join(self.run, *parts)

    def summary_names(self, specific: bool) -> tuple[str, str]:
        """Names of the text and JSON summary: generic ones for a root lineage of an automatic choice."""
        kind = "specific" if specific else "generic"
        stem = os.path.join(self.base, f"short_summary.{kind}.{self.lineage}.{self.name}")
        return f"{stem}.txt", f"{stem}.json"


def stage(spark: SparkSession, folder: RunFolder, name: str, make, restart: bool = False) -> DataFrame:
    """A step's table: read if a restarted run has finished it before, else made and written.

    A stage counts as finished by the marker that Spark writes last, so a run cut
    short makes it again.
    """
    path = folder.path("stages", name)
    if not (restart and storage.exists(os.path.join(path, "_SUCCESS"))):
        make().write.mode("overwrite").parquet(path)
    else:
        LOG.info("%s was done before", name)
    return spark.read.parquet(path)


def profiles(folder: str) -> list[str]:
    """Markers that a data set has a profile of, sorted."""
    return sorted(os.path.splitext(f)[0] for f in storage.names(folder))


def check_dataset(folder: str, variants: bool = False) -> None:
    """A data set needs profiles, a config and, for translated searches, sequences."""
    for part in ("hmms", "dataset.cfg", *(["ancestral_variants"] if variants else [])):
        p = os.path.join(folder, part)
        if not storage.exists(p) or (storage.is_folder(p) and not storage.names(p)):
            raise ConfigError(f"the data set {folder} lacks {part}")


def inputs_of(folder: str) -> list[str]:
    """Entries of a batch folder that are not hidden."""
    return [os.path.join(folder, f) for f in storage.names(folder)]


def list_datasets(manifest: DataFrame, kind: str = "all") -> DataFrame:
    """Lineage data sets of a manifest: all, one domain, or one by name."""
    rows = manifest.where("type = 'lineages'")
    if kind == "all":
        return rows.orderBy("dataset")
    if kind in ("prokaryota", "eukaryota", "viruses"):
        return rows.where(rows.domain == kind).orderBy("dataset")
    return rows.where(rows.dataset == kind)


def expected_hash(manifest: DataFrame, name: str) -> str:
    row = manifest.where(manifest.dataset == name).select("hash").first()
    if row is None:
        raise ConfigError(f"{name} is not a valid data set")
    return row["hash"]


def boxed(lines: list[str], least: int = 50, most: int = 80) -> str:
    """Lines in a box as wide as they need, between two widths; longer ones wrap."""
    lines = [x.expandtabs(4) for x in lines]
    width = max(least, min(most, max(map(len, lines), default=0) + 4))
    body = [part for x in lines for part in (textwrap.wrap(x, width - 4) or [""])]
    edge = "-" * (width - 2)
    return "\n".join([f" {edge} ", *(f"|{x:<{width - 2}}|" for x in body), f" {edge} "])


def archive(folder: str) -> str:
    """Packs a folder as .tar.gz beside it and removes it."""
    made = shutil.make_archive(folder, "gztar", os.path.dirname(folder), os.path.basename(folder))
    shutil.rmtree(folder)
    return made
