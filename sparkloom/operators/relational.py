"""Searches, comparisons and set operations that the analyses share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, pattern: str, columns: list[str], literal: bool = False) -> DataFrame:
    """Rows with a case-insensitive match of a regular expression (or a literal) in any of the columns; nulls never match."""
    test = lambda c: F.contains(F.lower(c), F.lit(pattern.lower())) if literal else F.col(c).rlike(f"(?i){pattern}")
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(test(c), F.lit(False)) for c in columns]))


def repeated(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows whose keys (nulls alike) occur more than once.

    Keys are counted first and joined back, so a key that many rows share is counted in partial sums.
    """
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    rows = df.withColumns(named)
    often = rows.groupBy(*named).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n").toDF(*(f"{n}r" for n in named))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in named])
    return rows.join(often, same, "left_semi").select(*df.columns)


def changes(base: DataFrame, other: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys, base and other values, and change (added, removed, changed), for keys that differ."""
    a = base.select(*keys, *(F.col(v).alias(f"base_{v}") for v in values), F.lit(1).alias("_base"))
    b = other.select(*keys, *(F.col(v).alias(f"other_{v}") for v in values), F.lit(1).alias("_other"))
    same = reduce(lambda x, y: x & y, [F.col(f"base_{v}").eqNullSafe(F.col(f"other_{v}")) for v in values], F.lit(True))
    change = F.when(F.col("_base").isNull(), "added").when(F.col("_other").isNull(), "removed").when(~same, "changed")
    return a.join(b, keys, "full_outer").withColumn("change", change).where("change IS NOT NULL").drop("_base", "_other")


def listed(df: DataFrame, keys: list[str], value: str, separator: str = ", ") -> DataFrame:
    """Distinct values of each group, sorted and joined to text."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias(value))


def unreferenced(objects: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    return objects.join(references, keys, "left_anti")
