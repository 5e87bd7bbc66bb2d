"""Star models over Spark tables, and queries on them.

A query names dimensions and measures; the planner reads the fact table of each measure, joins only
the tables that a dimension, filter or measure needs, walking from many to one, and leaves the
physical joins to Catalyst (the one side is broadcast where its size allows, otherwise AQE splits
skewed keys). Facts are kept by left joins. Measures of different facts are aggregated apart and then
joined on their dimensions. More than one shortest active path between two tables is refused, and
so is a dimension that only a one-to-many step could reach.

Roles restrict every table they reach: filters flow from the one side to the many side, and back
where a relationship filters both ways, as left semi joins below the star join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formulas import fields, measures
from ..formulas.syntax import Refused, parse_measure, walk

Ref = tuple[str, str]


@dataclass(frozen=True)
class Relationship:
    """Many (from) to one (to)."""

    from_table: str
    from_column: str
    to_table: str
    to_column: str
    active: bool = True
    both: bool = False


@dataclass
class StarModel:
    tables: Mapping[str, DataFrame]
    relationships: list[Relationship]
    measures: Mapping[str, str] = field(default_factory=dict)
    roles: Mapping[str, Mapping[str, str]] = field(default_factory=dict)  # role -> table -> filter expression

    def __post_init__(self):
        self.owners: dict[str, list[str]] = {}
        for name, df in self.tables.items():
            for c in df.columns:
                self.owners.setdefault(c, []).append(name)

    def ref(self, ref: tuple[str | None, str], home: str | None = None) -> Ref:
        """A reference with its table: the named one, the home table, or the only owner."""
        table, column = ref
        if table is None:
            owners = self.owners.get(column, [])
            table = home if home in owners else owners[0] if len(owners) == 1 else None
            if table is None:
                raise Refused(f"[{column}] belongs to {len(owners)} tables")
        if table not in self.tables or column not in self.tables[table].columns:
            raise Refused(f"unknown column {table}[{column}]")
        return table, column

    def path(self, fact: str, table: str) -> list[Relationship]:
        """The steps from fact to table, many to one."""
        paths, seen = [[]], {fact}
        ends = {fact: paths}
        while table not in ends:
            step: dict[str, list] = {}
            for end, ways in ends.items():
                for r in self.relationships:
                    if r.active and r.from_table == end and r.to_table not in seen:
                        step.setdefault(r.to_table, []).extend([*w, r] for w in ways)
            if not step:
                raise Refused(f"no many-to-one path from {fact} to {table}")
            seen |= set(step)
            ends = step
        if len(ends[table]) > 1:
            raise Refused(f"{len(ends[table])} paths from {fact} to {table}")
        return ends[table][0]

    def restricted(self, table: str, role: str | None, seen: frozenset[str] = frozenset()) -> tuple[DataFrame, bool]:
        """The table's rows that a role may see, and whether the role restricts it."""
        df, hit = self.tables[table], False
        filters = self.roles.get(role, {}) if role else {}
        if not filters:
            return df, False
        if table in filters:
            df, hit = df.where(predicate(parse_measure(filters[table]), df)), True
        seen = seen | {table}
        for r in self.relationships:
            if not r.active:
                continue
            if r.from_table == table and r.to_table not in seen:
                parent, own = self.restricted(r.to_table, role, seen)
                if own:
                    keys = parent.select(F.col(r.to_column).alias("_key"))
                    df, hit = df.join(keys, df[r.from_column] == keys["_key"], "left_semi"), True
            if r.both and r.to_table == table and r.from_table not in seen:
                child, own = self.restricted(r.from_table, role, seen)
                if own:
                    keys = child.select(F.col(r.from_column).alias("_key"))
                    df, hit = df.join(keys, df[r.to_column] == keys["_key"], "left_semi"), True
        return df, hit

    def frame(self, fact: str, refs: set[Ref], role: str | None = None) -> DataFrame:
        """The fact's rows with the referenced columns, named table.column."""
        steps: list[Relationship] = []
        for table in sorted({t for t, _ in refs} - {fact}):
            steps += [r for r in self.path(fact, table) if r not in steps]
        wanted = set(refs) | {(r.from_table, r.from_column) for r in steps} | {(r.to_table, r.to_column) for r in steps}

        def read(table: str, df: DataFrame) -> DataFrame:
            own = sorted(c for t, c in wanted if t == table)
            return df.select(*(F.col(f"`{c}`").alias(f"{table}.{c}") for c in own)) if own else df.select()

        out = read(fact, self.restricted(fact, role)[0])
        for r in steps:  # by path, so that the many side is always there
            out = out.join(read(r.to_table, self.tables[r.to_table]), column((r.from_table, r.from_column)) == column((r.to_table, r.to_column)), "left")
        return out

    def query(self, dimensions: Mapping[str, tuple[str | None, str]], wanted: Mapping[str, str], role: str | None = None, where: str | None = None, count_blank: bool = False) -> DataFrame:
        """dimensions: output name -> column; wanted: output name -> measure (a name or an expression); where: a row filter."""
        dims = {n: self.ref(r) for n, r in dimensions.items()}
        parsed = {n: measures.translate(self.measures.get(m, m)) for n, m in wanted.items()}
        condition = parse_measure(where) if where else None
        facts: dict[str, dict[str, measures.Measure]] = {}
        for n, m in parsed.items():
            home = m.home or self.ref(m.column)[0]
            if home not in self.tables:
                raise Refused(f"unknown table {home!r}")
            facts.setdefault(home, {})[n] = m
        if not facts:
            raise Refused("a query needs a measure")
        parts = []
        for fact, own in facts.items():
            resolve = lambda ref, fact=fact: self.ref(ref, fact)
            refs = set(dims.values()) | {resolve(r) for m in own.values() for r in m.columns()}
            if condition:
                refs |= {resolve((x[1], x[2])) for x in walk(condition) if x[0] == "field"}
            rows = self.frame(fact, refs, role)
            if condition:
                rows = rows.where(predicate(condition, rows, lambda ref: column(self.ref(ref, fact))))
            aggregates = [measures.aggregate(m, lambda r, fact=fact: column(self.ref(r, fact)), count_blank).alias(n) for n, m in own.items()]
            parts.append(rows.groupBy(*(column(r).alias(n) for n, r in dims.items())).agg(*aggregates))
        return reduce(lambda a, b: null_safe_join(a, b, list(dims), "full_outer"), parts).select(*dims, *wanted)

    def filter_values(self, ref: tuple[str | None, str], condition: str) -> DataFrame:
        """A column's values, and how many rows of each the other selections keep."""
        table, name = self.ref(ref)
        df = self.tables[table]
        return df.groupBy(F.col(f"`{name}`").alias(name)).agg(F.count_if(predicate(parse_measure(condition), df)).alias("associated"))


def column(ref: Ref) -> Column:
    return F.col(f"`{ref[0]}.{ref[1]}`")


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys that may be null; the keys stand once in the result."""
    if not keys:
        return a.join(b, how="cross") if how == "inner" else a.join(b, F.lit(True), how)  # one row on either side
    other = b.select(*(F.col(f"`{k}`").alias(f"_{k}") for k in keys), *(F.col(f"`{c}`") for c in b.columns if c not in keys))
    out = a.join(other, reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_{k}`")) for k in keys]), how)
    both = how == "full_outer"
    return out.select(*((F.coalesce(F.col(f"`{k}`"), F.col(f"`_{k}`")) if both else F.col(f"`{k}`")).alias(k) for k in keys), *(F.col(f"`{c}`") for c in (*a.columns, *b.columns) if c not in keys))


def predicate(node, df: DataFrame, named=None) -> Column:
    """A filter expression as a condition on rows."""
    of = named or (lambda ref: df[f"`{ref[1]}`"])

    def show(x) -> Column:
        kind = x[0]
        if kind == "field":
            return of((x[1], x[2]))
        if kind in ("call", "table", "lod", "if", "case"):
            raise Refused("a filter holds comparisons of columns and literals")
        return fields.to_column(x, fields.Scope({}), lambda y: of((y[1], y[2])) if y[0] == "field" else None)

    return show(node)
