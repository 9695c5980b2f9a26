"""All queries by name."""

from __future__ import annotations

from fleetframe.plans import alloc, fanout, files, lookup, names, status, streams, text, times
from fleetframe.session import configure

MODULES = (status, alloc, lookup, text, names, times, fanout, streams, files)


def _configured(fn):
    def query(spark, sf_dir):
        return fn(configure(spark), sf_dir)

    query.__name__ = fn.__name__
    query.__doc__ = fn.__doc__
    return query


def queries() -> dict:
    return {name: _configured(fn) for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
