"""All core queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from textloom.plans import q_audit, q_build, q_joins, q_lines, q_more, q_records, q_scores, q_sets, q_tables
from textloom.session import shipping

_MODULES = [q_lines, q_records, q_scores, q_joins, q_tables, q_build, q_audit, q_more, q_sets]


def queries() -> dict:
    return {name: shipping(f) for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark, sf_dir):
    """Documents leaking held-out units, by language and source."""
    return q_lines.contamination_units(spark, sf_dir)
