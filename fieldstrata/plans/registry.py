"""Queries by name, each with the SQL that another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as long, fractions as double rounded to six places: the form that the SQL side gives as well."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(sql: str, *columns: str, rest: str = "") -> str:
    """select with fractions rounded to six places."""
    return f"select {rest}{', ' if rest else ''}{', '.join(f'round({c}, 6) as {c}' for c in columns)} from ({sql})"
