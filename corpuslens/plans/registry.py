"""Registered queries: a plan over ``Tables`` and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from corpuslens.sources.corpus import BASE_TABLES, Tables, view_sql


class Query(NamedTuple):
    plan: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def oracle(select: str, views: tuple[str, ...] = (), ctes: dict[str, str] | None = None) -> str:
    """Complete check SQL: view definitions, extra CTEs, then the select."""
    head = view_sql(*views).format(**{t: t for t in BASE_TABLES}) if views else ""
    extra = ",\n".join(f"{n} AS ({q})" for n, q in (ctes or {}).items())
    if extra:
        head = f"{head},\n{extra}" if head else f"WITH {extra}"
    return f"{head}\n{select}".strip()


def query(name: str, select: str | None = None, views: tuple[str, ...] = (),
          ctes: dict[str, str] | None = None):
    def register(plan):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(plan, oracle(select, views, ctes) if select else None)
        return plan
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan):
        return lambda spark, sf_dir: plan(Tables(spark, sf_dir))
    return {name: bind(q.plan) for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
