"""All queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lociframe.llm import bpe, edits, fingerprint, lexical, linedup, minhash, mixing, quality, surrogates, toxicity, urlrules, variants, warc

MODULES = (urlrules, quality, bpe, surrogates, fingerprint, warc, mixing, edits, linedup, minhash, lexical, toxicity, variants)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
