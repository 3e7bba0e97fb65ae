"""The registered queries by name."""

from __future__ import annotations

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f
