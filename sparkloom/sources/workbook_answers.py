"""Workbooks that run: the sheets of many workbooks as queries, with their fields, parameters, relationships, filters and roles.

field_levels() orders the calculated fields of all workbooks at once: a field's level is one above the highest of the
fields it refers to, found by taking away, pass by pass, what refers to nothing that is left. Fields on
a cycle, or that need one, never go and have no level.

answers() then makes one plan for each join tree, however many workbooks use it: the tables are joined and read
once, one grouping keeps what all sheets of all these workbooks need (see plans.sheets), and every sheet
is a grouping of that. Definitions come to the driver (they are what plans are made of), one workbook
after another; rows of data never do. Where a workbook has security groups, each group gets the answers from what it
may see; a group without values sees nothing, and security of several columns is a problem.

What can't be run gives a row in the problems, and the other sheets run. Sheets over several data sources need
a blend and are problems. Null values in a filter's choices aren't matched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..formulas import fields
from ..formulas.syntax import Refused, children, parse_field
from ..plans.sheets import Question, Sheet
from ..storage import cut
from .workbooks import join_tree, literal

#: How a shelf aggregates a field, and the part of a date that it takes. Fixed values.
AGGREGATED = {"sum": "SUM", "avg": "AVG", "cnt": "COUNT", "ctd": "COUNTD", "min": "MIN", "max": "MAX", "med": "MEDIAN", "std": "STDEV", "var": "VAR"}
DATE_PARTS = {"yr": "YEAR", "mn": "MONTH", "dy": "DAY"}
_LITERALS = r"'[^']*'|\"[^\"]*\""
ANSWER = "workbook string, sheet string, role string, keys string, measure string, value double"
PROBLEM = "workbook string, sheet string, problem string"


class Answers(NamedTuple):
    """rows: one for each sheet, role (null where a workbook has none), key and measure; problems: what didn't run."""

    rows: DataFrame
    problems: DataFrame


def field_levels(workbooks: DataFrame) -> DataFrame:
    """workbook, source, field and level of every calculated field: 0 refers to no other; null is on a cycle or needs one."""
    own = workbooks.where("kind = 'field' AND formula IS NOT NULL")
    called = own.select("workbook", "source", F.col("name").alias("needs"), F.explode(F.array("name", "detail")).alias("word")).where("word IS NOT NULL").distinct()
    words = own.select("workbook", "source", F.col("name").alias("field"), F.explode(F.regexp_extract_all(F.regexp_replace("formula", _LITERALS, ""), F.lit(r"\[([^\]]+)\]"), 1)).alias("word")).distinct()
    left = cut(words.join(called, ["workbook", "source", "word"]).select("workbook", "source", "field", "needs").distinct())
    todo, found, level = cut(own.select("workbook", "source", F.col("name").alias("field")).distinct()), [], 0
    keys = ["workbook", "source", "field"]
    while True:  # as many passes as fields stand above each other
        free = cut(todo.join(left, keys, "left_anti"))
        if free.isEmpty():
            break
        found.append(free.withColumn("level", F.lit(level)))
        todo = cut(todo.join(free, keys, "left_anti"))
        left, level = cut(left.join(free.withColumnRenamed("field", "needs"), ["workbook", "source", "needs"], "left_anti").select(*keys, "needs")), level + 1
    return reduce(DataFrame.unionByName, [*found, todo.withColumn("level", F.lit(None).cast("int"))])


def _compiled(rows: list, scope: fields.Scope) -> tuple[dict[str, tuple], dict[str, str]]:
    """Trees of a source's calculated fields by name and caption, each parsed once, lower levels first; and reasons of those refused."""
    trees, refused = {}, {}
    for r in sorted((r for r in rows if r.kind == "field" and r.formula), key=lambda r: (r.level is None, r.level or 0, r.name)):
        try:
            if r.level is None:
                raise Refused("calculated fields refer to each other")
            tree = scope.inlined(parse_field(r.formula), trees)
            trees |= {n: tree for n in (r.name, r.detail) if n}
        except Refused as reason:
            refused |= {n: f"[{r.name}]: {reason}" for n in (r.name, r.detail) if n}
    return trees, refused


def _question(sheet: list, source: str, tree_of: Callable[[str], tuple], policy) -> Question:
    """A sheet's shelves and filters as trees."""
    dims, measures, asked, left = {}, {}, [], []
    for r in sheet:
        if r.kind == "shelf":
            if r.source != source:
                raise Refused("a sheet over several data sources")
            tree, name = tree_of(r.detail), f"{r.type or 'none'}:{r.detail}"
            if r.type in AGGREGATED:
                measures[name] = ("call", AGGREGATED[r.type], [tree])
            elif fields.has_aggregate(tree) and any(fields.is_aggregate(x) for x in _outer(tree)):
                measures[name] = tree
            else:
                dims[name] = ("call", DATE_PARTS[r.type], [tree]) if r.type in DATE_PARTS else tree
    for (field, derivation, role), own in groupby(sorted((r for r in sheet if r.kind in ("choice", "range") and r.source == source), key=lambda r: (r.detail, r.type or "", r.role)), key=lambda r: (r.detail, r.type, r.role)):
        own = list(own)
        tree = tree_of(field)
        if derivation in AGGREGATED:
            raise Refused(f"a filter on an aggregate of [{field}]")
        tree = ("call", DATE_PARTS[derivation], [tree]) if derivation in DATE_PARTS else tree
        values = [("lit", literal(r.formula)) for r in own]
        if role in ("min", "max"):
            asked += [("op", ">=" if role == "min" else "<=", tree, v) for v in values]
        else:
            left.append(("in", tree, values) if role == "member" else ("not", ("in", tree, values)))
    if not measures:
        raise Refused("a sheet without a measure")
    condition = reduce(lambda a, b: ("op", "&&", a, b), [*asked, *left]) if asked or left else None
    return Question(dims, measures, condition, policy)


def _outer(tree) -> Iterator:
    yield tree
    if tree[0] != "lod" and not fields.is_aggregate(tree):
        for child in children(tree):
            yield from _outer(child)


def answers(workbooks: DataFrame, table: Callable[[str], DataFrame]) -> Answers:
    """All sheets of all workbooks; table() gives the DataFrame of a table's name."""
    asked, problems = questions_of(workbooks, table)
    out, refused = [], []
    for sheet, questions in asked:
        given, reasons = sheet.answers(questions)
        out += [_long(df, *of, questions[of]) for of, df in given.items()]
        refused += [(*of, reason) for of, reason in reasons.items()]
    spark = workbooks.sparkSession
    return Answers(reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], ANSWER), problems.unionByName(spark.createDataFrame(refused, PROBLEM)))


def questions_of(workbooks: DataFrame, table: Callable[[str], DataFrame]) -> tuple[list[tuple[Sheet, dict[tuple[str, str], Question]]], DataFrame]:
    """For each join tree its rows as a sheet with the questions of all its worksheets, by workbook and name; and the problems met so far."""
    spark = workbooks.sparkSession
    levels = field_levels(workbooks).select("workbook", "source", F.col("field").alias("name"), "level")
    defined = workbooks.where("kind IN ('table', 'join', 'field', 'parameter', 'security', 'column', 'sheet', 'shelf', 'choice', 'range', 'problem')")
    rows = defined.join(levels.withColumn("kind", F.lit("field")), ["workbook", "source", "name", "kind"], "left").orderBy("workbook")
    trees: dict[tuple, dict] = {}  # join tree -> its workbooks' sources
    problems: list[tuple] = []
    for workbook, own in groupby(rows.toLocalIterator(), key=lambda r: r.workbook):
        own = list(own)
        problems += [(workbook, None, r.name) for r in own if r.kind == "problem"]
        sheets = {r.name: [x for x in own if x.name == r.name and x.kind in ("shelf", "choice", "range")] for r in own if r.kind == "sheet"}
        by_source: dict[str, dict] = {}
        for name, parts in sheets.items():
            shelves = sorted((x for x in parts if x.kind == "shelf"), key=lambda x: (x.role, x.position))
            if not shelves:
                problems.append((workbook, name, "an empty sheet"))
                continue
            by_source.setdefault(shelves[0].source, {})[name] = [*shelves, *(x for x in parts if x.kind != "shelf")]
        for source, asked in by_source.items():
            of = [r for r in own if r.source in (source, "Parameters")]
            joins = tuple(sorted((r.position, r.kind, r.name, r.detail, r.role) for r in of if r.kind in ("table", "join")))
            trees.setdefault(joins, {})[workbook, source] = (of, asked)
    out = []
    for sources in trees.values():
        first = next(iter(sources.values()))[0]
        try:
            base = join_tree([r for r in first if r.kind in ("table", "join")], table)
        except Refused as reason:
            problems += [(workbook, name, str(reason)) for (workbook, _), (_, asked) in sources.items() for name in asked]
            continue
        sheet, questions = Sheet(base), {}
        for (workbook, source), (of, asked) in sources.items():
            parameters = {n: literal(r.formula) for r in of if r.kind == "parameter" for n in (r.name, r.detail) if n}
            scope = fields.Scope(sheet.scope.columns, sheet.scope.types, {}, parameters, frozenset(r.role for r in of if r.kind == "security" and r.role))
            compiled, refused = _compiled([r for r in of if r.source == source], scope)

            def tree_of(name: str, scope=scope, compiled=compiled, refused=refused) -> tuple:
                if name in refused:
                    raise Refused(refused[name])
                return scope.inlined(("field", None, name), compiled)

            for name, parts in asked.items():
                try:
                    policies = _policy(spark, of, sheet)
                    questions[workbook, name] = _question(parts, source, tree_of, policies)
                except Refused as reason:
                    problems.append((workbook, name, str(reason)))
        if questions:
            out.append((sheet, questions))
    return out, spark.createDataFrame(problems, PROBLEM)


def _policy(spark, of: list, sheet: Sheet) -> tuple[str, DataFrame] | None:
    """The values of its one secured column that each group sees."""
    rules = [r for r in of if r.kind == "security" and r.detail]
    columns = {r.name for r in rules}
    if not columns:
        return None
    if len(columns) > 1:
        raise Refused("security of several columns")
    column = columns.pop()
    if column not in sheet.scope.columns:
        raise Refused(f"security of an unknown column [{column}]")
    allowed = {(r.detail, r.formula) for r in rules if r.formula is not None}
    return column, spark.createDataFrame(sorted(allowed), "_role string, _value string").withColumn("_value", F.col("_value").cast(sheet.scope.types[column]))


def _long(df: DataFrame, workbook: str, sheet: str, question: Question) -> DataFrame:
    """One row for each key and measure; keys: name=value of every dimension, in the order of the shelves."""
    keys = F.concat_ws("; ", *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("null"))) for n in question.dimensions))
    role = F.col("_role") if question.policy else F.lit(None).cast("string")
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(f"`{n}`").cast("double").alias("value")) for n in question.measures))).alias("m")
    return df.select(F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"), role.alias("role"), keys.alias("keys"), values).select("workbook", "sheet", "role", "keys", "m.measure", "m.value")
