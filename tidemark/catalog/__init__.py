"""All registered queries over the given tables, with their SQL twins."""

from __future__ import annotations

import importlib

from tidemark.catalog import base
from tidemark.session import configure

MODULES = ("features", "datasets", "outcomes", "snapshots", "records", "stored")


def _load():
    for name in MODULES:
        importlib.import_module(f"tidemark.catalog.{name}")


def _configured(fn):
    def run(spark, sf_dir):
        return fn(configure(spark), sf_dir)
    run.__name__ = fn.__name__
    return run


def queries():
    _load()
    return {key: _configured(fn) for key, fn in base.QUERIES.items()}


def oracles():
    _load()
    return dict(base.ORACLES)
