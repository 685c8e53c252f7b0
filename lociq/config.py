"""Run configuration: a frozen record, validated once, never changed between inputs."""

from __future__ import annotations

import configparser
import os
import re
from dataclasses import dataclass, fields, replace

from lociq.errors import ConfigError

#: Spellings of the modes, in either case.
MODES = {
    "genome": ("genome", "geno", "genomes"),
    "transcriptome": ("transcriptome", "tran", "transcriptomes", "trans"),
    "proteins": ("proteins", "prot", "protein", "proteome", "proteomes"),
}
ENVIRONMENT = "LOCIQ_CONFIG_FILE"


@dataclass(frozen=True)
class Config:
    """Options of a run; None means that a mode's own default holds."""

    in_: str = ""
    out: str = ""
    out_path: str = "."
    mode: str = ""
    lineage_dataset: str | None = None
    auto_lineage: bool = False
    auto_lineage_prok: bool = False
    auto_lineage_euk: bool = False
    datasets_version: str = "odb12"
    download_path: str = "downloads"
    cpu: int = 1
    evalue: float = 1e-3
    limit: int = 3
    contig_break: int = 10
    scaffold_composition: bool = False
    skip_metrics: bool = False
    force: bool = False
    restart: bool = False
    quiet: bool = False
    offline: bool = False
    tar: bool = False
    long: bool = False
    predictor: str | None = None
    batch: bool = False

    def validated(self) -> Config:
        """The record with mode and lineage settled, or an error that names what is wrong."""
        if not self.in_ or not self.mode:
            raise ConfigError("an input and a mode are needed")
        mode = next((m for m, names in MODES.items() if self.mode.lower() in names), None)
        if mode is None:
            raise ConfigError(f"unknown mode {self.mode}")
        if self.force and self.restart:
            raise ConfigError("force and restart exclude each other")
        if not 1 <= self.limit <= 20:
            raise ConfigError("limit must lie between 1 and 20")
        if not 0 < self.evalue <= 1:
            raise ConfigError("evalue must lie between 0 and 1")
        if self.predictor not in (None, "aligner_a", "aligner_b", "hmm"):
            raise ConfigError(f"unknown predictor {self.predictor}")
        if os.path.sep in self.out:
            raise ConfigError("out is a name, not a path; use out_path")
        new = replace(self, mode=mode, batch=self.batch or os.path.isdir(self.in_))
        if self.lineage_dataset:
            name, version = dataset_name(self.lineage_dataset, self.datasets_version)
            return replace(new, lineage_dataset=name, datasets_version=version, auto_lineage=False, auto_lineage_prok=False, auto_lineage_euk=False)
        both = self.auto_lineage_prok and self.auto_lineage_euk
        return replace(new, auto_lineage=True, auto_lineage_prok=self.auto_lineage_prok and not both, auto_lineage_euk=self.auto_lineage_euk and not both)

    def roots(self) -> list[str]:
        """Root lineages of an automatic choice."""
        if not self.auto_lineage:
            return []
        return ["archaea", "bacteria"] if self.auto_lineage_prok else ["eukaryota"] if self.auto_lineage_euk else ["archaea", "bacteria", "eukaryota"]

    def pipeline(self, domain: str) -> str:
        """Which of the eight pipelines a mode and domain run."""
        if self.mode == "proteins":
            return "proteins"
        if self.mode == "transcriptome":
            return {"prokaryota": "transcriptome_translated_search", "eukaryota": "transcriptome_aligner_a", "viruses": "transcriptome_gene_finder"}[domain]
        if domain in ("prokaryota", "viruses"):
            return "genome_aligner_b_prokaryota" if self.predictor == "aligner_b" else "genome_gene_finder"
        return {"aligner_a": "genome_aligner_a", "hmm": "genome_hmm", None: "genome_aligner_b", "aligner_b": "genome_aligner_b"}[self.predictor]


#: Options that only some pipelines use, with their defaults.
TRAINING = {"long": False}
SEARCH = {"evalue": 1e-3, "limit": 3}
METRICS = {"contig_break": 10, "scaffold_composition": False, "skip_metrics": False}
PIPELINE_OPTIONS = {
    "genome_hmm": TRAINING | SEARCH | METRICS,
    "genome_aligner_a": METRICS,
    "genome_aligner_b": METRICS,
    "genome_aligner_b_prokaryota": METRICS,
    "genome_gene_finder": METRICS,
    "transcriptome_translated_search": SEARCH,
    "transcriptome_aligner_a": {},
    "transcriptome_gene_finder": {},
    "proteins": {},
}


def unused_options(config: Config, pipeline: str) -> list[str]:
    """Options that were given another value than their default but that the pipeline does not use."""
    every = {k: v for part in PIPELINE_OPTIONS.values() for k, v in part.items()}
    return sorted(k for k, v in every.items() if k not in PIPELINE_OPTIONS[pipeline] and getattr(config, k) != v)


def dataset_name(name: str, default_version: str) -> tuple[str, str]:
    """A data set's full name and version; a version in the name wins, below 10 is refused; a path stays as it is."""
    base = os.path.basename(name.rstrip("/"))
    m = re.search(r"_odb(\d+(?:\.\d+)?)$", base)
    if not m and "/" in name:
        return name, default_version
    if not m:
        return f"{name}_{default_version}", default_version
    if float(m[1]) < 10:
        raise ConfigError(f"{base} is older than version 10")
    return name, f"odb{m[1]}"


def load(arguments: dict, path: str | None = None) -> Config:
    """Arguments over a config file; the file is the one named, else the environment's, else none."""
    path = path or os.environ.get(ENVIRONMENT)
    values: dict = {}
    if path:
        parser = configparser.ConfigParser()
        if not parser.read(path):
            raise ConfigError(f"config file {path} can't be read")
        if parser.has_section("run"):
            values = dict(parser["run"])
    values |= {k: v for k, v in arguments.items() if v is not None}
    kinds = {f.name.rstrip("_"): f for f in fields(Config)}
    if unknown := sorted(set(values) - set(kinds)):
        raise ConfigError(f"unknown options: {', '.join(unknown)}")
    return Config(**{kinds[k].name: _typed(k, v, kinds[k].type) for k, v in values.items()}).validated()


def _typed(name: str, value: object, kind: str) -> object:
    try:
        if kind == "bool":
            if str(value).lower() not in ("true", "false", "1", "0", "yes", "no"):
                raise ValueError
            return str(value).lower() in ("true", "1", "yes")
        return int(value) if kind == "int" else float(value) if kind == "float" else value
    except ValueError:
        raise ConfigError(f"{name} has the value {value}") from None


def tool_parameters(text: str, allowed: set[str]) -> dict[str, str]:
    """--key=value words of a pass-through string, of a list of allowed keys."""
    out = {}
    for word in text.replace('"', "").split():
        key, eq, value = word.lstrip("-").partition("=")
        if not word.startswith("--") or not eq or key not in allowed:
            raise ConfigError(f"parameter {word} is not accepted")
        out[key] = value
    return out


def extra_parameters(text: str, allowed: set[str]) -> tuple[dict[str, str], list[str]]:
    """Accepted --key=value words of a pass-through string, and warnings: of keys left out, or that the whole is not in that form."""
    words = text.strip("\"' ").split()
    if not all(w.startswith("-") and w.count("=") == 1 for w in words):
        return {}, ["parameters must have the form --name=value; none is used"]
    pairs = [w.lstrip("-").split("=") for w in words]
    return {k: v for k, v in pairs if k in allowed}, [f"{k} is not an accepted parameter" for k, _ in pairs if k not in allowed]


def newest_dataset(folder: str, name: str) -> str:
    """A data set's folder by its exact name, else the last of its versions in the order of names."""
    if os.path.isdir(os.path.join(folder, name)):
        return os.path.join(folder, name)
    found = sorted(d for d in (os.listdir(folder) if os.path.isdir(folder) else []) if d.startswith(name + "_odb") or d.startswith(name + "."))
    if not found:
        raise ConfigError(f"no data set {name} in {folder}")
    return os.path.join(folder, found[-1])
