"""All registered queries of the engine."""

from __future__ import annotations

from . import flagship, metrics, ordered, rules, signals, store, streams
from .base import Query

_MODULES = (flagship, store, rules, ordered, metrics, signals, streams)


def queries() -> dict[str, Query]:
    return {k: f for m in _MODULES for k, f in m.R.functions.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.R.sql.items()}
