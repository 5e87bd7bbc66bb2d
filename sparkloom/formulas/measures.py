"""Measures: the translatable shapes, as Spark aggregates and as SQL text.

measure := [COALESCE(] body {, default} [)];  body := CALCULATE(agg {, filter}) | agg;
agg := SUM | AVERAGE | MIN | MAX | COUNT | DISTINCTCOUNT | DISTINCTCOUNTNOBLANK (column) | COUNTROWS(table);
filter := [KEEPFILTERS(] column (= | <>) literal [)].  Filters fold into the aggregate, so measures
with different filters share one scan. Everything else is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import ship
from .syntax import Refused, parse_measure

#: measure function -> (SQL name, distinct). Fixed values.
AGGREGATES = {
    "SUM": ("SUM", False),
    "AVERAGE": ("AVG", False),
    "MIN": ("MIN", False),
    "MAX": ("MAX", False),
    "COUNT": ("COUNT", False),
    "DISTINCTCOUNT": ("COUNT", True),
    "DISTINCTCOUNTNOBLANK": ("COUNT", True),
}
_SPARK = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}


@dataclass(frozen=True)
class Measure:
    function: str  # SQL name
    distinct: bool
    column: tuple[str | None, str] | None  # None: rows
    table: str | None
    filters: tuple[tuple[tuple[str | None, str], str, object], ...]
    defaults: tuple

    @property
    def home(self) -> str | None:
        return self.table or (self.column or (None,))[0]

    def columns(self) -> set[tuple[str | None, str]]:
        return {f[0] for f in self.filters} | ({self.column} if self.column else set())


def _filter(node) -> tuple:
    if node[0] == "call" and node[1] == "KEEPFILTERS" and len(node[2]) == 1:
        node = node[2][0]
    if node[0] == "op" and node[1] in ("=", "<>") and node[2][0] == "field" and node[3][0] == "lit" and isinstance(node[3][1], str):
        return (node[2][1], node[2][2]), node[1], node[3][1]
    raise Refused("filter is not a plain equality on a column")


def translate(text: str) -> Measure:
    node, defaults = parse_measure(text), ()
    if node[0] == "call" and node[1] == "COALESCE" and len(node[2]) > 1:
        node, *rest = node[2]
        if any(x[0] != "lit" for x in rest):
            raise Refused("COALESCE default is not a literal")
        defaults = tuple(x[1] for x in rest)
    filters = ()
    if node[0] == "call" and node[1] == "CALCULATE" and node[2]:
        node, *rest = node[2]
        filters = tuple(map(_filter, rest))
    if node[0] != "call" or len(node[2]) != 1:
        raise Refused("unsupported measure shape")
    name, arg = node[1], node[2][0]
    if name == "COUNTROWS":
        if arg[0] != "table":
            raise Refused("COUNTROWS over a table expression")
        return Measure("COUNT", False, None, arg[1], filters, defaults)
    if name not in AGGREGATES:
        raise Refused(f"{name} is not a supported aggregate")
    if arg[0] != "field":
        raise Refused(f"{name} over an expression")
    return Measure(*AGGREGATES[name], (arg[1], arg[2]), None, filters, defaults)


def aggregate(measure: Measure, column: Callable[[tuple], Column], count_blank: bool = False) -> Column:
    """The measure as an aggregate; column() gives the Spark column of a reference.

    count_blank: a distinct count counts null once, as the source language does.
    """
    value = column(measure.column) if measure.column else F.lit(1)
    condition = None
    for ref, op, literal in measure.filters:
        own = column(ref) == literal if op == "=" else column(ref) != literal
        condition = own if condition is None else condition & own
    if condition is not None:
        value = F.when(condition, value)
    if measure.distinct:
        out = F.count_distinct(value)
        if count_blank:
            null = column(measure.column).isNull() if condition is None else column(measure.column).isNull() & condition
            out = out + F.coalesce(F.max(F.when(null, 1)), F.lit(0))
    else:
        out = _SPARK[measure.function](value)
    return F.coalesce(out, *map(F.lit, measure.defaults)) if measure.defaults else out


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def to_sql(text: str) -> tuple[str | None, str]:
    """(SQL, "") or (None, reason)."""
    try:
        m = translate(text)
    except Refused as reason:
        return None, str(reason)
    quote = lambda ref: "`" + ref[1].replace("`", "``") + "`"
    value = quote(m.column) if m.column else "*"
    if m.filters:
        tests = " AND ".join(f"{quote(ref)} {op} {_literal(v)}" for ref, op, v in m.filters)
        value = f"CASE WHEN {tests} THEN {'1' if value == '*' else value} END"
    sql = f"{m.function}({'DISTINCT ' * m.distinct}{value})"
    return (f"COALESCE({sql}, {', '.join(map(_literal, m.defaults))})" if m.defaults else sql), ""


def compiled(text: pd.Series) -> pd.DataFrame:
    """sql_text and reason of a batch of measures; a text that stands in many models is compiled once."""
    text = text.fillna("")
    made = {t: to_sql(t) for t in text.unique()}
    return pd.DataFrame([made[t] for t in text], columns=["sql_text", "reason"])


def measure_sql(c) -> DataFrame:
    """model, table, measure, sql_text (null where refused), reason: the measures of a catalog, compiled in batches on the executors."""
    ship(c.measures.sparkSession)
    udf = F.pandas_udf(compiled, "struct<sql_text: string, reason: string>")
    return c.measures.withColumn("m", udf("expression")).select("model", "table", "measure", "m.sql_text", "m.reason")
