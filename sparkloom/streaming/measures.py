"""Measures in event-time windows: the same formulas as on tables, on a stream that may come late."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..formulas import measures
from ..formulas.syntax import Refused


def windowed(events: DataFrame, time: str, width: str, wanted: Mapping[str, str], dimensions: list[str] = [], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window start and end, dimensions and measures; rows later than `late` are dropped by the watermark.

    Distinct counts are exact on streams too: the state of a window and group holds its distinct values, so
    it grows with their number until the watermark passes (in complete mode it stays). wanted: name -> measure over the events' columns.
    """
    parsed = {n: measures.translate(m) for n, m in wanted.items()}
    column = lambda ref: F.col(f"`{ref[1]}`")
    for n, m in parsed.items():
        if unknown := [r for r in m.columns() if r[1] not in events.columns]:
            raise Refused(f"{n}: unknown column {unknown[0][1]!r}")
    out = []
    for n, m in parsed.items():
        if m.distinct and events.isStreaming:
            tests = [column(r) == v if op == "=" else column(r) != v for r, op, v in m.filters]
            value, kind = column(m.column), events.schema[m.column[1]].dataType
            if isinstance(kind, (T.ArrayType, T.StructType)):
                raise Refused(f"{n}: a distinct count of nested values on a stream")
            if isinstance(kind, (T.FloatType, T.DoubleType)):  # one NaN and one zero, as count(DISTINCT) has
                value = (value + F.lit(0.0)).cast("string")
            for test in tests:
                value = F.when(test, value)
            # streams refuse count(DISTINCT); a set of values is state that they can keep
            out.append(F.size(F.collect_set(value)).cast("long").alias(n))
        else:
            out.append(measures.aggregate(m, column).alias(n))
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = events.withWatermark(time, late).groupBy(window.alias("window"), *dimensions).agg(*out)
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *dimensions, *parsed)
