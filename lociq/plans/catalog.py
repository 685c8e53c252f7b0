"""Queries of the engine and their SQL."""

from lociq.plans import files, genes, selections, sequences, status

MODULES = (status, files, genes, selections, sequences)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
