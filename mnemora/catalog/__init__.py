"""All registered queries."""

from __future__ import annotations

import importlib

from . import base

MODULES = ["learning", "corpus", "plans", "answers", "identity", "domains", "migration", "datasets", "streams"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def queries():
    _load()
    return dict(base.QUERIES)


def oracle_sql():
    _load()
    return dict(base.ORACLES)
