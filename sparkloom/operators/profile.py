"""Column profiles of data tables: the statistics that a model's catalog holds."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def columns(tables: Mapping[str, DataFrame], exact: bool = True) -> DataFrame:
    """t, c, d (distinct values), n (rows), nulls of every column; exact=False estimates d in one pass without an expansion."""
    parts = []
    for name, df in tables.items():
        distinct = F.count_distinct if exact else F.approx_count_distinct
        stats = df.agg(F.count(F.lit(1)).alias("n"), *(x for i, c in enumerate(df.columns) for x in (distinct(F.col(f"`{c}`")).alias(f"d{i}"), F.count(F.col(f"`{c}`")).alias(f"v{i}"))))
        rows = F.array(*(F.struct(F.lit(name).alias("t"), F.lit(c).alias("c"), F.col(f"d{i}").alias("d"), F.col("n"), (F.col("n") - F.col(f"v{i}")).alias("nulls")) for i, c in enumerate(df.columns)))
        parts.append(stats.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values and their counts; ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(column)).limit(k)


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value; the smallest of ties."""
    return top_values(df.where(F.col(column).isNotNull()), column, 1).select(column)
