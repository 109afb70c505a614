"""Where queries and their checks are collected."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round the doubles by the arithmetic that the statements use, so that the order of a sum does not show."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    scale = F.lit(float(10**digits))

    def value(name: str) -> Column:
        c = F.col(f"`{name}`")
        if name not in doubles:
            return c
        # From 2^53 on a double has no digits to round, and floor() to a whole number of 64 bits would saturate.
        small = F.abs(c * scale) < F.lit(float(2**53))
        return F.when(small, F.floor(c * scale + F.lit(0.5)).cast("double") / scale).otherwise(c).alias(name)

    return df.select(*[value(c) for c in df.columns])


def query(name: str, sql: str | None = None, *, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query, with the statement that must give the same rows if there is one."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
