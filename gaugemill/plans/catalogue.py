"""All registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("profile_queries", "contract_queries", "drift_queries", "monitor_queries", "stream_queries", "study_queries", "source_queries", "report_queries")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"gaugemill.plans.{m}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
