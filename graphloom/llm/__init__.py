"""Operators of a training-data pipeline, and their queries."""

from __future__ import annotations

from graphloom.llm import registered as _registered  # noqa: F401
from graphloom.llm.common import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
