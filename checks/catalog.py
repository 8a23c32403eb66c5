"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import board_queries, config_queries, import_queries, probe_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES, Query
from linkscope.session import configure


def _configured(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _configured(function) for name, function in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
