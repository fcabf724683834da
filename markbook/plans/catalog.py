"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

from markbook.plans.registry import Query

_MODULES = ("report_queries", "scoring_queries", "text_queries", "label_queries", "builder_queries", "evaluation_queries", "source_queries", "adapter_queries")


def _registries():
    return [importlib.import_module(f"markbook.plans.{m}").registry for m in _MODULES]


def queries() -> dict[str, Query]:
    return {name: q for r in _registries() for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for r in _registries() for name, s in r.sql.items()}
