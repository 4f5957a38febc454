"""The registered queries of the training-data operators, each beside its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from functools import wraps

from leadlode.session import tune

MODULES = ("langid", "mixing", "line_dedup", "packing", "simhash", "quality", "substring", "media", "lm_scoring", "warc", "lexical_search", "parity_join", "conversation_repair")


def _tuned(fn):
    @wraps(fn)
    def run(spark, folder):
        return fn(tune(spark), folder)

    return run


def _modules():
    return [importlib.import_module(f"{__name__}.{name}") for name in MODULES]


def all_queries():
    return {name: _tuned(fn) for m in _modules() for name, fn in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
