"""Query bindings over the driver tables, with their DuckDB oracles."""

from __future__ import annotations

import importlib

from corpusloom.plans.registry import ORACLES, QUERIES

_MODULES = ["corpus", "corpus_examples", "tasks_q", "alloc_q", "pages_q", "vocab_q", "sources_q"]


def _load():
    for m in _MODULES:
        importlib.import_module(f"corpusloom.plans.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
