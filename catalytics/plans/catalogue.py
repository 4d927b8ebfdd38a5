"""The registered query catalogue: name -> (spark callable, oracle SQL or None)."""

from __future__ import annotations

import functools

from . import html_queries, io_queries, listing_queries, ml_queries, retrieval_queries, variant_queries

_MODULES = [listing_queries, variant_queries, ml_queries, retrieval_queries, html_queries, io_queries]


def _pinned(fn):
    """Timestamps are parsed and printed in UTC whatever session the caller passes in."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    return run


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update({name: _pinned(fn) for name, fn in m.QUERIES.items()})
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(getattr(m, "ORACLE", {}))
    return out
