"""Registry of named queries: a Spark builder plus an optional DuckDB oracle.

Every registered query reads the driver's tables through the adapters (so
its work grows with the data) and returns scalar columns only; integral
columns are widened to bigint so both engines report the same types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactica.plans.oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def normalise(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: Builder) -> Builder:
        def built(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalise(fn(spark, sf_dir))
        built.__name__ = fn.__name__
        built.__doc__ = fn.__doc__
        QUERIES[name] = built
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn
    return deco


def r6(c):
    """Round a floating result so engines that sum in another order agree."""
    return F.round(c, 6)
