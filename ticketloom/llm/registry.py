"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if check is not None:
            ORACLE[name] = check
        return fn

    return wrap
