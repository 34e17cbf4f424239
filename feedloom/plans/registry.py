"""Queries by name: a function of Tables and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from feedloom.sources.posts import SQL_VIEWS, Tables

_FOUND: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None, **given):
    """Registers a function of Tables under its name. sql may use the views of SQL_VIEWS. given: arguments of the registered
    query where a function's defaults, made for years of posts, would find nothing in a month of them."""

    def add(f: Callable[..., DataFrame]):
        _FOUND[f.__name__] = (partial(f, **given), sql)
        return f

    return add


def _load() -> None:
    from feedloom.functions import reviews, text  # noqa: F401
    from feedloom.operators import alerting, analytics, claims, community, deep, details, health, jobs, monitoring, parts, primitives, reports, rollups, sampling, writes  # noqa: F401
    from feedloom.sources import files, landed  # noqa: F401
    from feedloom.streaming import cooldown, events  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in _FOUND.items()}


def oracles() -> dict[str, str]:
    _load()
    return {name: SQL_VIEWS + sql for name, (_, sql) in _FOUND.items() if sql}
