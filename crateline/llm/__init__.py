"""Operators of a training-data pipeline over documents and pages."""

from __future__ import annotations

import importlib

from . import registry

MODULES = ("line_dedup", "language_id", "token_file", "exact_dedup", "packing", "decontamination", "jaccard_join", "warc", "suffix_dedup", "katz", "secret_scan", "importance",
           "lexical_search")


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")


def queries():
    load_all()
    return dict(registry.QUERIES)


def oracle_sql():
    load_all()
    return dict(registry.SQL)
