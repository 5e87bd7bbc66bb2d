"""Workbook sheets as queries: calculated fields and level-of-detail expressions over joined rows.

A sheet has dimensions and measures (formulas). Where levels of detail take part, the rows are read once: one
grouping by everything that any level groups by, or that stands beside a level in an expression, keeps
partial aggregates (sums, counts, extremes, moments) of all measures. Every level is then a grouping of that finer, written
table, from the inner ones outwards: FIXED levels, which may hold other FIXED levels, are joined back to it and
don't heed the sheet's filter; INCLUDE, EXCLUDE and the sheet's own level are grouped from what the filter leaves.
An expression over a level counts once for each row, as a level's value belongs to rows. Groupings
aggregate partially before they shuffle, and a join with few groups is a broadcast that Catalyst picks by size.

MEDIAN is exact for groups of any size: selection.medians() takes the place of an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formulas import fields
from ..formulas.syntax import Refused, walk
from ..storage import cut
from .selection import medians
from .star import null_safe_join


class Sheet:
    """rows: the joined rows; calculated: field name -> formula; parameters: name -> value."""

    def __init__(self, rows: DataFrame, calculated: Mapping[str, str] = {}, parameters: Mapping[str, object] = {}, groups: frozenset[str] = frozenset()):
        self.rows = rows
        self.scope = fields.Scope({c: F.col(f"`{c}`") for c in rows.columns}, dict(rows.dtypes), calculated, parameters, groups)

    def rows_with(self, columns: Mapping[str, str], where: str | None = None) -> DataFrame:
        """Row-level fields: output name -> formula."""
        trees = {n: self.scope.tree(f) for n, f in columns.items()}
        condition = self.scope.tree(where) if where else None
        for n, t in trees.items():
            if any(fields.is_aggregate(x) for x in _outside(t)) and not any(x[0] == "lod" for x in walk(t)):
                raise Refused(f"{n} is a measure")
        every = [*trees.values(), *([condition] if condition else [])]
        rows, names = self.rows, {}
        if any(_has_level(t) for t in every):
            grain = _Shared(self, every, [])
            _, names, levels = grain.attached()
            rows = rows.withColumns({name: fields.to_column(node, self.scope) for name, node in grain.atoms.values() if any(name in dims for _, dims in levels)})
            for level, dims in levels:
                rows = _joined(rows, level, dims)
        row = lambda x: F.col(names[str(x)]) if str(x) in names else None
        if condition:
            rows = rows.where(fields.to_column(condition, self.scope, row))
        return rows.select(*(fields.to_column(t, self.scope, row).alias(n) for n, t in trees.items()))

    def query(self, dimensions: Mapping[str, str], measures: Mapping[str, str], where: str | None = None) -> DataFrame:
        """dimensions and measures: output name -> formula; where: a row-level condition."""
        dim_trees = {n: self.scope.tree(f) for n, f in dimensions.items()}
        trees = {n: self.scope.tree(f) for n, f in measures.items()}
        question = Question(dim_trees, trees, self.scope.tree(where) if where else None)
        grain = _Shared(self, question.trees(), question.rowwise()) if any(map(_has_level, question.trees())) else _Plain(self)
        return _answer(self.scope, grain, question)

    def answers(self, questions: Mapping) -> tuple[dict, dict]:
        """Answers to several questions from one reading of the rows, and the reasons of those refused, by the questions' names.

        Answers under a policy have a column _role.
        """
        refused, asked, out = {}, {}, {}
        for name, q in questions.items():
            try:
                for tree in q.trees():
                    fields.checked(tree, self.scope)
                asked[name] = q
            except Refused as reason:
                refused[name] = str(reason)
        if asked:
            whole = [t for q in asked.values() for t in q.rowwise()] + [("field", None, q.policy[0]) for q in asked.values() if q.policy]
            grain = _Shared(self, [t for q in asked.values() for t in q.trees()], whole)
        for name, q in asked.items():
            try:
                out[name] = _answer(self.scope, grain, q)
            except Refused as reason:
                refused[name] = str(reason)
        return out, refused


@dataclass(frozen=True)
class Question:
    """Trees of dimensions and measures by output name, and of a filter.

    policy: a column, and the values of it that each role sees (_role, _value). Every level of detail is then
    a role's own, as what a role doesn't see is not there for it.
    """

    dimensions: dict
    measures: dict
    condition: tuple | None = None
    policy: tuple[str, DataFrame] | None = None

    def rowwise(self) -> list:
        return [*self.dimensions.values(), *([self.condition] if self.condition else [])]

    def trees(self) -> list:
        return [*self.rowwise(), *self.measures.values()]


def _answer(scope: fields.Scope, grain, question: Question) -> DataFrame:
    dim_trees, trees, condition = question.dimensions, question.measures, question.condition
    rows, fixed, _ = grain.attached(question.policy, question.trees())
    row = lambda x: F.col(fixed[str(x)]) if str(x) in fixed else grain.part(x)
    if condition:
        rows = rows.where(fields.to_column(condition, scope, row))
    role = ["_role"] if question.policy else []
    dims = [*role, *dim_trees]
    rows = rows.withColumns({f"_dim{i}": fields.to_column(t, scope, row) for i, t in enumerate(dim_trees.values())})
    keys = [*map(F.col, role), *(F.col(f"_dim{i}").alias(n) for i, n in enumerate(dim_trees))]
    of_field = {str(t): n for n, t in dim_trees.items()}

    plain: dict[str, Column] = {}  # aggregates on the sheet's own level
    apart: list[tuple[DataFrame, list[str]]] = []  # other levels, and the dimensions that join them
    stands: dict[str, str] = {}

    def grouped(by: list[Column], names: list[str], tree, name: str, outer: tuple[str, list[str]] | None = None) -> DataFrame:
        """A level: the tree's aggregates by some columns; outer: an aggregate of these by fewer."""
        out, got = _aggregated(grain, rows.select("*", *(c for c, n in zip(by, names, strict=True) if n != "_role")), names, tree, row)
        value = fields.to_column(tree, scope, lambda x: F.col(got[str(x)]) if str(x) in got else None)
        if outer is None:
            return out.select(*(F.col(f"`{n}`") for n in names), value.alias(name))
        fine = out.select(*(F.col(f"`{n}`") for n in names), value.alias("_value"))
        if outer[0] == "MEDIAN":
            return medians(fine, outer[1], F.col("_value"), name)  # of a finer level's values, each once
        return fine.groupBy(*(F.col(f"`{n}`") for n in outer[1])).agg(fields.AGGREGATES[outer[0]](F.col("_value")).alias(name))

    def level(node, outer: str) -> str:
        name = f"_level{len(apart)}"
        if node[1] == "INCLUDE":
            more = [d for d in node[2] if str(d) not in of_field]
            fine = [*keys, *(row_or(d).alias(f"_inc{i}") for i, d in enumerate(more))]
            apart.append((grouped(fine, [*dims, *(f"_inc{i}" for i in range(len(more)))], node[3], name, (outer, dims)), dims))
        else:
            gone = {of_field.get(str(d)) for d in node[2]}
            left = [n for n in dims if n not in gone]
            apart.append((grouped([k for k, n in zip(keys, dims, strict=True) if n in left], left, node[3], name), left))
        return name

    row_or = lambda d: fields.to_column(d, scope, row)

    def collect(node) -> None:
        """Give every aggregate and level of a measure a column."""
        if str(node) in stands:
            return
        if fields.is_aggregate(node):
            inner = node[2][0]
            if inner[0] == "lod" and inner[1] == "INCLUDE":
                stands[str(node)] = level(inner, node[1])
                return
            if _nested(inner):
                raise Refused("aggregate of an aggregate")
            if any(x[0] == "lod" and x[1] != "FIXED" for x in walk(inner)):
                raise Refused(f"{node[1]} over a level of detail inside an expression")
            stands[str(node)] = name = f"_agg{len(plain) + len(apart)}"
            if node[1] == "MEDIAN":
                value, weight = grain.values(inner, row)
                apart.append((medians(rows.select(*keys, value.alias("_value"), weight.alias("_weight")), dims, F.col("_value"), name, F.col("_weight")), dims))
            else:
                plain[name] = grain.aggregate(node, row)
        elif node[0] == "lod":
            if node[1] == "FIXED":
                if not {str(d) for d in node[2]} <= set(of_field):
                    raise Refused("a FIXED level finer than the sheet needs an aggregate")
                stands[str(node)] = name = f"_agg{len(plain) + len(apart)}"
                plain[name] = F.max(row(node))  # one value in each group
            else:
                stands[str(node)] = level(node, "SUM")
        elif node[0] == "field":
            if str(node) not in of_field:
                raise Refused(f"[{node[2]}] stands outside of an aggregate")
            stands[str(node)] = of_field[str(node)]
        else:
            for child in _parts(node):
                collect(child)

    for tree in trees.values():
        collect(tree)
    out = rows.groupBy(*keys).agg(*(c.alias(n) for n, c in plain.items())) if plain or not apart else rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    for part, on in apart:
        out = null_safe_join(out, part, on, "inner")
    whole = lambda x: F.col(f"`{stands[str(x)]}`") if str(x) in stands else None
    return out.select(*(F.col(f"`{n}`") for n in dims), *(fields.to_column(t, scope, whole).alias(n) for n, t in trees.items()))


class _Plain:
    """Rows as they are: no levels of detail."""

    def __init__(self, sheet: Sheet):
        self.sheet = sheet

    def attached(self, policy, trees) -> tuple[DataFrame, dict[str, str], list]:
        return self.sheet.rows, {}, []

    def part(self, node) -> None:
        return None

    def values(self, inner, row) -> tuple[Column, Column]:
        return fields.to_column(inner, self.sheet.scope, row), F.lit(1).cast("long")

    def aggregate(self, node, row) -> Column:
        return fields.AGGREGATES[node[1]](fields.to_column(node[2][0], self.sheet.scope, row))


class _Shared:
    """One grouping of the rows that all levels are computed from.

    trees: all formulas; whole: those that are wanted for each row of the grouping (dimensions and the filter).
    Columns: an atom for each row-level part that has to be told apart, partial aggregates, and the number of rows.
    """

    def __init__(self, sheet: Sheet, trees: list, whole: list):
        self.scope, self.atoms, self.states = sheet.scope, {}, {}
        self.partial: dict[str, Column] = {}
        self.levels: list = []  # FIXED levels, inner ones first
        for tree in trees:
            self._visit(tree)
        for tree in whole:
            self._atom(tree) if not _has_level(tree) else [self._atom(x) for x in _row_fields(tree)]
        rows = sheet.rows.groupBy(*(fields.to_column(node, self.scope).alias(name) for name, node in self.atoms.values())).agg(*(c.alias(n) for n, c in self.partial.items()), F.count(F.lit(1)).alias("_n"))
        self.rows = cut(rows)  # written once, read by every level

    def _atom(self, node) -> str:
        if node[0] != "lit" and str(node) not in self.atoms:
            self.atoms[str(node)] = (f"_atom{len(self.atoms)}", node)
        return self.atoms.get(str(node), ("", None))[0]

    def _visit(self, node) -> None:
        """Note the atoms, partial aggregates and FIXED levels of a formula."""
        if fields.is_aggregate(node):
            inner = node[2][0]
            if _has_level(inner):
                for x in _row_fields(inner):
                    self._atom(x)
                self._visit(inner)
            elif node[1] in ("COUNTD", "MEDIAN"):
                self._atom(inner)  # not to be had from partial results
            elif str(node) not in self.states:
                self.states[str(node)] = self._partial(node[1], fields.to_column(inner, self.scope))
            return
        if node[0] == "lod":
            for d in node[2]:
                self._atom(d)
            self._visit(node[3])
            if node[1] == "FIXED" and str(node) not in map(str, self.levels):
                self.levels.append(node)
            return
        for child in _parts(node):
            self._visit(child)

    def _partial(self, name: str, value: Column) -> list[str]:
        made = {"SUM": [F.sum(value)], "COUNT": [F.count(value)], "MIN": [F.min(value)], "MAX": [F.max(value)], "AVG": [F.sum(value), F.count(value)]}.get(name)
        if made is None:  # moments: count, mean and squares about it
            made = [F.count(value), F.avg(value), F.var_pop(value) * F.count(value)]
        names = [f"_part{len(self.partial) + i}" for i in range(len(made))]
        self.partial |= dict(zip(names, made, strict=True))
        return names

    def part(self, node) -> Column | None:
        """The column that stands for a row-level part."""
        name = self.atoms.get(str(node), ("",))[0]
        return F.col(name) if name else None

    def values(self, inner, row) -> tuple[Column, Column]:
        return fields.to_column(inner, self.scope, row), F.col("_n")

    def aggregate(self, node, row) -> Column:
        """An aggregate over the rows that the grouping's rows stand for."""
        name, parts = node[1], [F.col(x) for x in self.states.get(str(node), [])]
        if name == "COUNTD":
            return F.count_distinct(fields.to_column(node[2][0], self.scope, row))
        if not parts:  # over a level: each row of the grouping counts as often as it has rows
            value = fields.to_column(node[2][0], self.scope, row)
            n = F.when(value.isNotNull(), F.col("_n")).otherwise(0)
            parts = {"SUM": [value * F.col("_n")], "COUNT": [n], "MIN": [value], "MAX": [value], "AVG": [value * F.col("_n"), n]}.get(name, [n, value, F.lit(0.0)])
        match name:
            case "SUM":
                return F.sum(parts[0])
            case "COUNT":
                return F.coalesce(F.sum(parts[0]), F.lit(0).cast("long"))
            case "MIN":
                return F.min(parts[0])
            case "MAX":
                return F.max(parts[0])
            case "AVG":
                return F.try_divide(F.sum(parts[0]), F.sum(parts[1]))
        n, mean, squares = parts
        total = F.sum(n)
        about = F.greatest(F.sum(F.coalesce(squares, F.lit(0.0)) + n * mean * mean) - F.try_divide(F.sum(n * mean) * F.sum(n * mean), total), F.lit(0.0))
        variance = F.when(total > 1, F.try_divide(about, total - 1))
        return F.sqrt(variance) if name == "STDEV" else variance

    def attached(self, policy=None, trees: list | None = None) -> tuple[DataFrame, dict[str, str], list[tuple[DataFrame, list[str]]]]:
        """The grouping's rows with a column for every FIXED level of the trees, the columns' names, and the levels with what they group by.

        With a policy, the rows that each role sees, with the role.
        """
        rows, names, levels = self.rows, {}, []
        if policy:
            seen = self._atom(("field", None, policy[0]))
            rows = rows.join(policy[1], F.col(seen) == F.col("_value")).drop("_value")
        role = ["_role"] if policy else []
        row = lambda x: F.col(names[str(x)]) if str(x) in names else self.part(x)
        wanted = {str(x) for t in trees for x in walk(t)} if trees is not None else None
        for i, node in enumerate(self.levels):
            if wanted is not None and str(node) not in wanted:
                continue
            dims = [*role, *(self._atom(d) for d in node[2])]
            out, got = _aggregated(self, rows, dims, node[3], row)
            value = fields.to_column(node[3], self.scope, lambda x, got=got: F.col(got[str(x)]) if str(x) in got else None)
            # written, so its size is known when the join to the rows is planned: a level of few groups never deals the rows out by them
            level = cut(out.select(*(F.col(f"`{d}`") for d in dims), value.alias(f"_fixed{i}")))
            rows = _joined(rows, level, dims)
            names[str(node)] = f"_fixed{i}"
            levels.append((level, dims))
        return rows, names, levels


def _aggregated(grain, rows: DataFrame, names: list[str], tree, row) -> tuple[DataFrame, dict[str, str]]:
    """The aggregates of a level's formula by the columns of these names, and the columns that hold them."""
    found = {str(x): x for x in _aggregates(tree)}
    if any(x[0] == "field" for x in _outside(tree)):
        raise Refused("a level of detail needs an aggregate")
    got = {key: f"_got{i}" for i, key in enumerate(found)}
    keys = [F.col(f"`{n}`") for n in names]
    plain = [grain.aggregate(x, row).alias(got[key]) for key, x in found.items() if x[1] != "MEDIAN"]
    out = rows.groupBy(*keys).agg(*plain) if plain or not found else None
    for key, x in found.items():
        if x[1] == "MEDIAN":
            values = grain.values(x[2][0], row)
            part = medians(rows, names, values[0], got[key], values[1])
            out = part if out is None else null_safe_join(out, part, names, "inner")
    return out, got


def _joined(rows: DataFrame, level: DataFrame, dims: list[str]) -> DataFrame:
    return null_safe_join(rows, level, dims, "left") if dims else rows.crossJoin(F.broadcast(level))  # one row


def _aggregates(tree) -> Iterator:
    """The outermost aggregates of a formula."""
    if fields.is_aggregate(tree):
        yield tree
    elif tree[0] != "lod":
        for child in _parts(tree):
            yield from _aggregates(child)


def _outside(tree) -> Iterator:
    """The nodes of a formula that stand in no aggregate's argument and in no level."""
    yield tree
    if tree[0] != "lod" and not fields.is_aggregate(tree):
        for child in _parts(tree):
            yield from _outside(child)


def _row_fields(tree) -> Iterator:
    """The fields of a row-level formula that stand in no level."""
    if tree[0] == "field":
        yield tree
    elif tree[0] != "lod":
        for child in _parts(tree):
            yield from _row_fields(child)


def _has_level(tree) -> bool:
    return any(x[0] == "lod" for x in walk(tree))


def _nested(node) -> bool:
    """Whether an aggregate stands in a tree, other than inside a level of detail."""
    return node[0] != "lod" and (fields.is_aggregate(node) or any(map(_nested, _parts(node))))


def _parts(node) -> list:
    if node[0] == "if":
        return [x for b in node[1] for x in b] + [node[2]]
    if node[0] == "case":
        return [node[1], *(x for b in node[2] for x in b), node[3]]
    return {"call": lambda: node[2], "op": lambda: [node[2], node[3]], "not": lambda: [node[1]], "neg": lambda: [node[1]], "in": lambda: [node[1], *node[2]]}.get(node[0], list)()
