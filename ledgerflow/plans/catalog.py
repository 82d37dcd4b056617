"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

MODULES = ("q_scalars", "q_sequence", "q_rollups", "q_joins", "q_quality", "q_sources", "q_streams")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"{__package__}.{m}"), name))
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
