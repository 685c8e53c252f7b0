"""The queries of the training-data operators and their SQL."""

from lociq.llm import ann, chat, decontaminate, licenses, lines, neardup, packing, secrets, suffix, toxicity

MODULES = (packing, ann, neardup, lines, licenses, toxicity, chat, decontaminate, secrets, suffix)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
