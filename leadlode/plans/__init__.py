"""Runnable queries over the standard tables, each beside the SQL that checks it."""

from __future__ import annotations

from functools import wraps

from leadlode.plans import board, candidates, clients, contacts, outreach, qualification, scores
from leadlode.session import tune

MODULES = (candidates, contacts, qualification, clients, board, scores, outreach)


def _tuned(fn):
    @wraps(fn)
    def run(spark, folder):
        return fn(tune(spark), folder)

    return run


def all_queries():
    return {name: _tuned(fn) for m in MODULES for name, fn in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
