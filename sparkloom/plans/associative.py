"""Associative filters: which values of a field other selections leave possible, over all related tables.

Selections reach every table that relationships connect, up and down, as in a full reducer: over each
relationship, in each direction that is needed, goes one message, the distinct keys of the rows that meet their own
table's selections and have a partner in every message from behind them. On the way rows are filtered by
semi-joins; the table of the field itself is joined with distinct keys, so no row ever multiplies, and one
conditional count gives each value's possible rows. Messages are made once and serve all fields that are asked for.

A field's own selection doesn't bear on its values. A table that no selection stands behind sends nothing, so
rows without a partner there stay possible. A role hides rows, by the filters that reach their table
(StarModel.restricted), and hidden rows pass no message. More than one path between a field and a selection is refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formulas.syntax import Refused, parse_measure
from .star import Ref, Relationship, StarModel, predicate

#: Values to choose, or a condition on the field's table.
Selection = Iterable | str


class Associations:
    """selections: field -> its chosen values (None among them: rows without one), or a condition."""

    def __init__(self, model: StarModel, selections: Mapping[tuple[str | None, str], Selection], role: str | None = None):
        self.model, self.role = model, role
        self.selections = {model.ref(r): s for r, s in selections.items()}
        self._sent: dict[tuple[Relationship, str], DataFrame] = {}

    def _condition(self, table: str, df: DataFrame, but: Ref | None = None) -> Column | None:
        """What a table's own selections ask of its rows."""
        own = [(r, s) for r, s in self.selections.items() if r[0] == table and r != but]
        return reduce(lambda a, b: a & b, (F.coalesce(self._one(df, r, s), F.lit(False)) for r, s in own)) if own else None

    def _one(self, df: DataFrame, ref: Ref, chosen: Selection) -> Column:
        if isinstance(chosen, str):
            return predicate(parse_measure(chosen), df)
        values, field = list(chosen), df[f"`{ref[1]}`"]
        met = field.isin([v for v in values if v is not None])
        return met | field.isNull() if None in values else met

    def _ways(self, start: str, ends: set[str]) -> dict[str, list[Relationship]]:
        """The relationships from start to each of the tables."""
        found: dict[str, list[list[Relationship]]] = {}

        def walk(table: str, way: list[Relationship], seen: frozenset[str]) -> None:
            if table in ends:
                found.setdefault(table, []).append(way)
            for r in self.model.relationships:
                if r.active and table in (r.from_table, r.to_table):
                    other = r.to_table if table == r.from_table else r.from_table
                    if other not in seen:
                        walk(other, [*way, r], seen | {other})

        walk(start, [], frozenset({start}))
        for end, ways in found.items():
            if len(ways) > 1:
                raise Refused(f"{len(ways)} paths from {start} to {end}")
        return {end: ways[0] for end, ways in found.items()}

    def _steps(self, table: str, but: Relationship | None = None) -> list[tuple[Relationship, str]]:
        """The table's neighbours behind which there are selections, without the one that it answers to."""
        ways = self._ways(table, {t for t, _ in self.selections} - {table})
        firsts = dict.fromkeys(way[0] for way in ways.values() if way and way[0] != but)
        return [(r, r.to_table if r.from_table == table else r.from_table) for r in firsts]

    def _message(self, over: Relationship, source: str) -> DataFrame:
        """_key: the distinct keys of the source's rows that are possible as seen from the relationship's other end."""
        if (over, source) not in self._sent:
            df = self.model.restricted(source, self.role)[0]
            condition = self._condition(source, df)
            if condition is not None:
                df = df.where(condition)
            for r, other in self._steps(source, over):
                keys = self._message(r, other)
                df = df.join(keys, df[_end(r, source)] == keys["_key"], "left_semi")
            self._sent[over, source] = df.select(F.col(f"`{_end(over, source)}`").alias("_key")).distinct()
        return self._sent[over, source]

    def values(self, ref: tuple[str | None, str]) -> DataFrame:
        """value, n_rows and n_possible: of each value of a field, its rows, and those that the other selections leave."""
        table, name = own = self.model.ref(ref)
        df = self.model.restricted(table, self.role)[0]
        met = self._condition(table, df, own)
        met = F.lit(True) if met is None else met
        steps = self._steps(table)
        needed = dict.fromkeys([name, *(_end(r, table) for r, _ in steps)])
        rows = df.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(needed)), met.alias("_met"))
        at = {c: f"_{i}" for i, c in enumerate(needed)}
        for i, (r, other) in enumerate(steps):
            keys = self._message(r, other).select(F.col("_key").alias(f"_key{i}"))
            rows = rows.join(keys, F.col(at[_end(r, table)]) == F.col(f"_key{i}"), "left")
        possible = reduce(lambda a, b: a & b, (F.col(f"_key{i}").isNotNull() for i in range(len(steps))), F.col("_met"))
        return rows.groupBy(F.col(at[name]).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(possible).alias("n_possible"))

    def all_values(self, refs: Iterable[tuple[str | None, str]]) -> DataFrame:
        """field (as table[column]), value (as text), n_rows and n_possible of several fields."""
        parts = []
        for ref in refs:
            table, name = self.model.ref(ref)
            parts.append(self.values(ref).select(F.lit(f"{table}[{name}]").alias("field"), F.col("value").cast("string").alias("value"), "n_rows", "n_possible"))
        return reduce(DataFrame.unionByName, parts)


def _end(r: Relationship, table: str) -> str:
    return r.from_column if table == r.from_table else r.to_column
