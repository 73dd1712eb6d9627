"""The operators' queries and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

import importlib

import corpus_pipeline

MODULES = ("url_filter", "pii", "decontam", "simhash", "ivfpq", "substring", "secret_scan", "license_scan", "toxicity", "mixing", "conversations", "kdmeans", "quality")


def queries() -> dict:
    found = {"pipeline": corpus_pipeline.run}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").ORACLE_SQL
    return found
