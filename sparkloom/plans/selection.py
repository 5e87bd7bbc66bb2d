"""Exact medians of groups of any size, by selection on histograms of digits.

A value's bits, ordered like the values, are four digits of 16 bits. Each pass counts the digits of the values that
share a group's digits so far, and keeps the digit in which the wanted rank lies: after four passes one value
is left. Counts aggregate before they are shuffled, so a group's values are never together in a task, and
repeated values count once with a weight. Passes read a written table of distinct values. Where that table
shows that no group has more than `FEW` of them, one running count in each group takes the place of the passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

DIGITS, BITS = 4, 16
#: Distinct values of a group that one task may sort.
FEW = 100_000


def ordered_bits(value: Column) -> Column:
    """A double as a long in the same order (NaN last; nulls are set apart before)."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value.cast("double"), F.lit(0.0)) + F.lit(0.0)).cast("long")  # + 0.0: one zero
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys), F.lit(True))


def medians(df: DataFrame, keys: list[str], value: Column, name: str, weight: Column | None = None) -> DataFrame:
    """keys and name: the median of each group's values, as a double. weight: how many rows a row stands for.

    Nulls don't count; a group without a value has none. Two middle values give their mean.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    own = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)), value.cast("double").alias("_v"), weight.alias("_w"))
    values = cut(rows.groupBy(*own, "_v").agg(F.sum("_w").alias("_w")).withColumn("_bits", ordered_bits(F.col("_v"))))
    groups = values.groupBy(*own).agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")).otherwise(0)).alias("_n"), F.count("_v").alias("_distinct"))
    most = groups.agg(F.max("_distinct")).first()[0]
    if (most or 0) <= FEW:
        return _counted(values, own, name, keys)
    values = values.where("_v IS NOT NULL")
    # the wanted rank among what shares the digits so far, counted from 0
    at = groups.where("_n > 0").select(*own, "_n", F.floor((F.col("_n") - 1) / 2).alias("_rank"), F.lit(0).cast("long").alias("_prefix"))
    for digit in range(DIGITS):
        shift = BITS * (DIGITS - 1 - digit)
        prefix = F.shiftright(F.col("v._bits"), shift + BITS) if digit else F.lit(0).cast("long")
        near = values.alias("v").join(at.alias("a"), _same("v", "a", own) & (prefix == F.col("a._prefix")))
        counts = near.groupBy(*(F.col(f"v.{o}").alias(o) for o in own), F.shiftright(F.col("v._bits"), shift).alias("_digits")).agg(F.sum("v._w").alias("_c"), F.first("a._n").alias("_n"), F.first("a._rank").alias("_rank"))
        up_to = F.sum("_c").over(Window.partitionBy(*own).orderBy("_digits"))  # at most 2**BITS rows a group
        below = F.col("_up") - F.col("_c")
        at = counts.withColumn("_up", up_to).where((below <= F.col("_rank")) & (F.col("_rank") < F.col("_up"))).select(*own, "_n", (F.col("_rank") - below).alias("_rank"), F.col("_digits").alias("_prefix"), "_c")
    low = at.alias("a").join(values.alias("v"), _same("a", "v", own) & (F.col("a._prefix") == F.col("v._bits"))).select(*(F.col(f"a.{o}").alias(o) for o in own), F.col("v._v").alias("_low"), F.col("v._bits").alias("_bits"), (F.col("_n") % 2 == 0).alias("_even"), (F.col("_rank") + 1 < F.col("_c")).alias("_again"))
    after = values.alias("v").join(low.where("_even AND NOT _again").alias("a"), _same("v", "a", own) & (F.col("v._bits") > F.col("a._bits")))
    above = after.groupBy(*(F.col(f"v.{o}").alias(o) for o in own)).agg(F.min_by("v._v", "v._bits").alias("_high"))
    found = low.alias("a").join(above.alias("b"), _same("a", "b", own), "left").select(*(F.col(f"a.{o}").alias(o) for o in own), F.when(F.col("_even") & ~F.col("_again"), (F.col("_low") + F.col("_high")) / 2).otherwise(F.col("_low")).alias("_median"))
    out = groups.alias("g").join(found.alias("f"), _same("g", "f", own), "left")
    return out.select(*(F.col(f"g.{o}").alias(k) for k, o in zip(keys, own, strict=True)), F.col("_median").alias(name))


def _counted(values: DataFrame, own: list[str], name: str, keys: list[str]) -> DataFrame:
    """The same from running counts, where a group's distinct values are few."""
    group, known = Window.partitionBy(*own), F.col("_v").isNotNull()
    w = F.when(known, F.col("_w")).otherwise(0)
    rows = values.withColumns({"_up": F.sum(w).over(group.orderBy("_bits", "_v").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum(w).over(group)})
    middle = lambda rank: F.max(F.when(known & (F.col("_up") - F.col("_w") <= rank) & (rank < F.col("_up")), F.col("_v")))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    out = rows.groupBy(*own).agg(middle(low).alias("_low"), middle(high).alias("_high"))
    return out.select(*(F.col(o).alias(k) for o, k in zip(own, keys, strict=True)), ((F.col("_low") + F.col("_high")) / 2).alias(name))
