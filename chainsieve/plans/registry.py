"""Registry of runnable queries, each with its independent SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainsieve.tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of decimals, so equal results compare equal."""
    cols = [
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes
    ]
    return df.select(*cols)


def query(name: str, check: str | None = None, digits: int = 6):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Tables(spark, sf_dir)), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if check:
            CHECKS[name] = with_views(check)
        return fn

    return register
