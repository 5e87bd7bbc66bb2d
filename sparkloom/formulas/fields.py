"""Workbook fields: calculated-field formulas as Spark columns and as DAX text.

Rows and aggregates are told apart: inside an aggregate everything is row-level; around aggregates
only literals, parameters, dimensions and further functions may stand. Table calculations, unknown
functions and security groups are refused. Conventions: division by zero gives null, `+` on strings
concatenates, CONTAINS heeds case, DATEDIFF counts boundaries.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .syntax import Refused, children, parse_field, walk

#: Functions that need the order or the frame of a finished table. Fixed values.
TABLE_CALCULATIONS = ("WINDOW_", "RUNNING_", "RANK", "INDEX", "LOOKUP", "TOTAL", "FIRST", "LAST", "PREVIOUS_VALUE", "SIZE")
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "SUM": F.sum,
    "AVG": F.avg,
    "COUNT": F.count,
    "COUNTD": F.count_distinct,
    "MIN": F.min,
    "MAX": F.max,
    "MEDIAN": F.median,
    "STDEV": F.stddev_samp,
    "VAR": F.var_samp,
}
SCALARS: dict[str, Callable[..., Column]] = {
    "ZN": lambda x: F.coalesce(x, F.lit(0)),
    "IFNULL": F.coalesce,
    "ISNULL": F.isnull,
    "IIF": lambda c, t, e=None: F.when(c, t).otherwise(F.lit(None) if e is None else e),
    "CONTAINS": F.contains,
    "TRIM": F.trim,
    "UPPER": F.upper,
    "LOWER": F.lower,
    "LEN": lambda x: F.length(x).cast("bigint"),
    "LEFT": F.left,
    "RIGHT": F.right,
    "MID": lambda s, start, n=None: F.substr(s, start, n) if n is not None else F.substr(s, start),
    "REPLACE": F.replace,
    "ABS": F.abs,
    "ROUND": lambda x, n=None: F.round(x, n) if n is not None else F.round(x),
    "CEILING": lambda x: F.ceil(x).cast("bigint"),
    "FLOOR": lambda x: F.floor(x).cast("bigint"),
    "SQRT": F.sqrt,
    "EXP": F.exp,
    "LN": F.ln,
    "LOG": lambda x, base=None: F.log10(x) if base is None else F.ln(x) / F.ln(base),
    "TODAY": F.current_date,
    "NOW": F.current_timestamp,
    "YEAR": lambda x: F.year(x).cast("bigint"),
    "MONTH": lambda x: F.month(x).cast("bigint"),
    "DAY": lambda x: F.day(x).cast("bigint"),
    "MIN": F.least,
    "MAX": F.greatest,
}
ARGUMENTS = {"ZN": (1, 1), "IFNULL": (2, 2), "ISNULL": (1, 1), "IIF": (2, 3), "CONTAINS": (2, 2), "LEFT": (2, 2), "RIGHT": (2, 2), "MID": (2, 3), "REPLACE": (3, 3), "ROUND": (1, 2), "LOG": (1, 2), "TODAY": (0, 0), "NOW": (0, 0), "MIN": (2, 99), "MAX": (2, 99)}
UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


@dataclass
class Scope:
    """What names mean: columns with their types, calculated fields (formulas), parameters and security groups."""

    columns: Mapping[str, Column]
    types: Mapping[str, str] = field(default_factory=dict)
    calculated: Mapping[str, str] = field(default_factory=dict)
    parameters: Mapping[str, object] = field(default_factory=dict)
    groups: frozenset[str] = frozenset()

    def tree(self, formula: str, seen: tuple[str, ...] = ()):
        """The formula's tree with calculated fields put in place."""
        return self._inline(parse_field(formula), seen)

    def inlined(self, node, compiled: Mapping[str, tuple]):
        """A parsed tree with calculated fields put in place, of which the trees are ready."""
        return self._inline(node, (), compiled)

    def _inline(self, node, seen, compiled: Mapping[str, tuple] = {}):
        if node[0] == "field":
            source, name = node[1], node[2]
            if source == "Parameters":
                if name not in self.parameters:
                    raise Refused(f"unknown parameter {name!r}")
                return ("lit", self.parameters[name])
            if name in self.groups:
                raise Refused(f"{name!r} is a security group; it becomes a role")
            if name in self.columns:
                return ("field", None, name)
            if name in compiled:
                return compiled[name]
            if name in self.calculated:
                if name in seen:
                    raise Refused(f"calculated fields refer to each other: {' > '.join((*seen, name))}")
                return self.tree(self.calculated[name], (*seen, name))
            raise Refused(f"unknown field {name!r}")
        again = lambda x: self._inline(x, seen, compiled)
        if node[0] in ("lit", "table"):
            return node
        if node[0] == "call":
            return ("call", node[1], [again(x) for x in node[2]])
        if node[0] == "op":
            return ("op", node[1], again(node[2]), again(node[3]))
        if node[0] in ("not", "neg"):
            return (node[0], again(node[1]))
        if node[0] == "in":
            return ("in", again(node[1]), [again(x) for x in node[2]])
        if node[0] == "if":
            return ("if", [(again(c), again(v)) for c, v in node[1]], again(node[2]))
        if node[0] == "case":
            return ("case", again(node[1]), [(again(c), again(v)) for c, v in node[2]], again(node[3]))
        inner = again(node[3])
        if any(x[0] == "lod" and x[1] != "FIXED" for x in walk(inner)):
            raise Refused("a level of detail in another is FIXED")
        return ("lod", node[1], [again(d) for d in node[2]], inner)


def is_aggregate(node) -> bool:
    return node[0] == "call" and node[1] in AGGREGATES and len(node[2]) == 1


def has_aggregate(node) -> bool:
    """Whether a field of this tree is a measure."""
    return any(is_aggregate(x) or x[0] == "lod" for x in walk(node))


def outside_levels(node):
    """The nodes of a tree that stand in no level of detail."""
    yield node
    if node[0] != "lod":
        for child in children(node):
            yield from outside_levels(child)


def checked(node, scope: Scope) -> None:
    """Refuse what can't be a column, in the formula or in a level of detail inside it."""
    for x in walk(node):
        if x[0] == "lod":
            to_column(x[3], scope, lambda y: F.lit(0) if y[0] == "lod" else None)
    to_column(node, scope, lambda y: F.lit(0) if y[0] == "lod" else None)


def is_text(node, scope: Scope) -> bool:
    kind = node[0]
    if kind == "lit":
        return isinstance(node[1], str)
    if kind == "field":
        return scope.types.get(node[2]) == "string"
    if kind == "op":
        return node[1] in ("+", "&") and (is_text(node[2], scope) or is_text(node[3], scope))
    if kind == "call":
        return node[1] in ("TRIM", "UPPER", "LOWER", "LEFT", "RIGHT", "MID", "REPLACE", "STR") or node[1] in ("ZN", "IFNULL", "MIN", "MAX") and bool(node[2]) and is_text(node[2][0], scope)
    if kind == "if":
        return any(is_text(v, scope) for _, v in node[1]) or is_text(node[2], scope)
    return kind == "case" and (any(is_text(v, scope) for _, v in node[2]) or is_text(node[3], scope))


def to_column(node, scope: Scope, replaced: Callable = lambda node: None) -> Column:
    """A tree as a column; replaced() may give the column that stands for a subtree."""
    ready = replaced(node)
    if ready is not None:
        return ready
    again = lambda x: to_column(x, scope, replaced)
    kind = node[0]
    if kind == "lit":
        return F.lit(node[1])
    if kind == "field":
        return scope.columns[node[2]]
    if kind == "not":
        return ~again(node[1])
    if kind == "neg":
        return -again(node[1])
    if kind == "in":
        return again(node[1]).isin(*map(again, node[2]))
    if kind == "if":
        return _when([(again(c), again(v)) for c, v in node[1]], again(node[2]))
    if kind == "case":
        subject = again(node[1])
        return _when([(subject == again(c), again(v)) for c, v in node[2]], again(node[3]))
    if kind == "op":
        a, b = again(node[2]), again(node[3])
        match node[1]:
            case "||":
                return a | b
            case "&&":
                return a & b
            case "+" | "&" if node[1] == "&" or is_text(node, scope):
                return F.concat(a, b)
            case "/":
                return F.try_divide(a, b)
            case "%":
                return F.try_mod(a, b)
            case symbol:
                return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "+": a + b, "-": a - b, "*": a * b}[symbol]
    if kind == "call":
        return call(node, scope, again)
    raise Refused(f"{kind} can't stand here")


def _when(branches: list, otherwise: Column) -> Column:
    out = None
    for c, v in branches:
        out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(otherwise)


def call(node, scope: Scope, again: Callable) -> Column:
    name, args = node[1], node[2]
    if name.startswith(TABLE_CALCULATIONS[:3]) or name in TABLE_CALCULATIONS:
        raise Refused(f"{name} is a table calculation")
    if is_aggregate(node):
        if any(map(is_aggregate, outside_levels(args[0]))):
            raise Refused("aggregate of an aggregate")
        return AGGREGATES[name](again(args[0]))
    if name == "DATEDIFF":
        if len(args) != 3 or args[0][0] != "lit" or str(args[0][1]).lower() not in UNITS:
            raise Refused("DATEDIFF needs a unit and two dates")
        unit = str(args[0][1]).lower()
        a, b = (F.date_trunc(unit, again(x)) for x in args[1:])
        return F.timestamp_diff(unit.upper(), a, b).cast("bigint")
    if name == "STR":
        x = again(args[0])
        return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")) if not is_text(args[0], scope) else x
    if name not in SCALARS:
        raise Refused(f"{name} is not translated")
    low, high = ARGUMENTS.get(name, (1, 1))
    if not low <= len(args) <= high:
        raise Refused(f"{name} with {len(args)} arguments")
    return SCALARS[name](*map(again, args))


# --- DAX text ---

#: workbook function -> DAX function. Fixed values.
DAX_NAMES = {
    "ISNULL": "ISBLANK", "TRIM": "TRIM", "UPPER": "UPPER", "LOWER": "LOWER", "LEN": "LEN", "LEFT": "LEFT", "RIGHT": "RIGHT", "MID": "MID", "REPLACE": "SUBSTITUTE", "ABS": "ABS", "ROUND": "ROUND",
    "CEILING": "CEILING", "FLOOR": "FLOOR", "SQRT": "SQRT", "EXP": "EXP", "LN": "LN", "LOG": "LOG", "TODAY": "TODAY", "NOW": "NOW", "YEAR": "YEAR", "MONTH": "MONTH", "DAY": "DAY", "CONTAINS": "CONTAINSSTRING", "MIN": "MIN", "MAX": "MAX",
}
DAX_AGGREGATES = {"SUM": "SUM", "AVG": "AVERAGE", "COUNT": "COUNT", "COUNTD": "DISTINCTCOUNT", "MIN": "MIN", "MAX": "MAX", "MEDIAN": "MEDIAN", "STDEV": "STDEV.S", "VAR": "VAR.S"}


def to_dax(formula: str, table: str, known: frozenset[str] | None = None) -> tuple[str | None, str]:
    """(DAX, "") or (None, reason); known: the fields there are (None: any)."""
    quote = lambda name: "'" + name.replace("'", "''") + "'"

    def name_of(node) -> str:
        if node[1] == "Parameters":
            return f"SELECTEDVALUE('Parameters'[{node[2]}])"
        if known is not None and node[2] not in known:
            raise Refused(f"unknown field {node[2]!r}")
        return f"{quote(table)}[{node[2]}]"

    def show(node) -> str:
        kind = node[0]
        if kind == "lit":
            v = node[1]
            return "BLANK()" if v is None else {True: "TRUE()", False: "FALSE()"}[v] if isinstance(v, bool) else '"' + v.replace('"', '""') + '"' if isinstance(v, str) else str(v)
        if kind == "field":
            return name_of(node)
        if kind == "not":
            return f"NOT({show(node[1])})"
        if kind == "neg":
            return f"(-{show(node[1])})"
        if kind == "in":
            return f"({show(node[1])} IN {{{', '.join(map(show, node[2]))}}})"
        if kind == "if":
            out = show(node[2])
            for c, v in reversed(node[1]):
                out = f"IF({show(c)}, {show(v)}, {out})"
            return out
        if kind == "case":
            return f"SWITCH({', '.join([show(node[1]), *(show(x) for b in node[2] for x in b), show(node[3])])})"
        if kind == "op":
            return f"MOD({show(node[2])}, {show(node[3])})" if node[1] == "%" else f"({show(node[2])} {node[1]} {show(node[3])})"
        if kind == "lod":
            if any(x[0] == "lod" for x in walk(node[3])):
                raise Refused("nested level-of-detail expression")
            dims = [name_of(d) for d in node[2]]
            inner = show(node[3])
            if node[1] == "FIXED":
                return f"CALCULATE({inner}, {f'ALLEXCEPT({quote(table)}, {", ".join(dims)})' if dims else f'ALL({quote(table)})'})"
            if node[1] == "EXCLUDE":
                return f"CALCULATE({inner}, REMOVEFILTERS({', '.join(dims)}))"
            return f"SUMX({f'VALUES({dims[0]})' if len(dims) == 1 else f'SUMMARIZE({quote(table)}, {", ".join(dims)})'}, CALCULATE({inner}))"
        if kind != "call":
            raise Refused(f"{kind} can't stand here")
        name, args = node[1], node[2]
        if name.startswith(TABLE_CALCULATIONS[:3]) or name in TABLE_CALCULATIONS:
            raise Refused(f"{name} is a table calculation")
        if is_aggregate(node):
            if args[0][0] == "field":
                return f"{DAX_AGGREGATES[name]}({show(args[0])})"
            if name == "COUNTD":
                return f"COUNTROWS(DISTINCT(SELECTCOLUMNS({quote(table)}, \"v\", {show(args[0])})))"
            if name in ("STDEV", "VAR"):
                raise Refused(f"{name} over an expression")
            return f"{DAX_AGGREGATES[name]}X({quote(table)}, {show(args[0])})"
        if name == "ZN" and len(args) == 1:
            return f"COALESCE({show(args[0])}, 0)"
        if name == "IFNULL" and len(args) == 2:
            return f"COALESCE({show(args[0])}, {show(args[1])})"
        if name == "IIF" and len(args) in (2, 3):
            return f"IF({', '.join(map(show, args))}{', BLANK()' * (len(args) == 2)})"
        if name == "DATEDIFF" and len(args) == 3 and args[0][0] == "lit" and str(args[0][1]).lower() in UNITS:
            return f"DATEDIFF({show(args[1])}, {show(args[2])}, {str(args[0][1]).upper()})"
        if name == "STR" and len(args) == 1:
            return f'FORMAT({show(args[0])}, "General Number")'
        if name not in DAX_NAMES:
            raise Refused(f"{name} is not translated")
        return f"{DAX_NAMES[name]}({', '.join(map(show, args))})"

    try:
        return show(parse_field(formula)), ""
    except Refused as reason:
        return None, str(reason)
