"""Every operator as a query over the given tables."""

from __future__ import annotations

from . import corpus, files, topics  # noqa: F401
from .tables import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
