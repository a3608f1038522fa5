"""Registry of queries over the given tables."""

from __future__ import annotations

import importlib

_MODULES = ["core", "ingest", "evaluation", "learning"]


def _loaded():
    for m in _MODULES:
        yield importlib.import_module(f"alleleflow.catalog.{m}")


def queries() -> dict:
    out: dict = {}
    for m in _loaded():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _loaded():
        out.update(m.ORACLES)
    return out
