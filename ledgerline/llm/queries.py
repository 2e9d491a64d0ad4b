"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from ledgerline.llm import bpe, embedding_dedup, packing, pii, quality, sharding, simhash, simhash_dedup, suffix_dedup, toxicity

MODULES = (quality, simhash, pii, bpe, embedding_dedup, simhash_dedup, sharding, packing, toxicity, suffix_dedup)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
