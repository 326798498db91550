"""The queries of all plan modules, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .adapters import sharing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, share: bool = False):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL where there is one.

    share: what it reads more than once is made once (adapters.sharing()).
    """

    def add(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with sharing(share):
                return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    from . import days, learning, scoring_log, states, surroundings  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import evaluation
    from .adapters import view

    return evaluation.last_year_error(view(spark, sf_dir, "region_activity"))
