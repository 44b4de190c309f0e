"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from textloom.llm import crosssplit, leakage, mixing, neardup, packing, pii, quota, sentences, sql as by_sql
from textloom.session import shipping

_MODULES = [leakage, neardup, crosssplit, sentences, quota, packing, mixing, pii]


def queries() -> dict:
    return {name: shipping(f) for m in _MODULES for name, f in vars(m).items() if name[:1] == "p" and name[1:2].isdigit() and callable(f)}


def oracles() -> dict[str, str]:
    return by_sql.ORACLES | {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
