"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sharding", "linededup", "toxicity", "search", "quality", "warc", "packing", "secrets", "simhash", "bpe")


def _merged(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), name).items()}


def queries() -> dict:
    pipeline = import_module("corpus_pipeline")
    return _merged("QUERIES") | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    pipeline = import_module("corpus_pipeline").ORACLE_SQL
    return _merged("ORACLE_SQL") | ({"pipeline": pipeline} if pipeline else {})
