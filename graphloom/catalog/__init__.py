"""All registered queries."""

from __future__ import annotations

from graphloom.catalog import generated, graphs, learning, prep, scoring, text, textkeys  # noqa: F401
from graphloom.catalog.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
