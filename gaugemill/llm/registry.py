"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: One module for each operator; all of them must import.
MODULES = ("sharding", "mixing", "exact_dedup", "warc", "packing", "quality", "embedding_dedup", "ngram_join", "substring_dedup", "suffix_dedup", "conversation", "token_files", "centroids")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
