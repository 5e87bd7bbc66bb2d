"""References, normal forms and fingerprints of measure expressions, as Spark columns.

Expressions are cut into tokens by one regular expression, so whatever stands in a string or a
comment is never taken for a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r'"[^"]*(?:""[^"]*)*"'
_COMMENT = r"--[^\n]*|//[^\n]*|/\*[\s\S]*?\*/"
_BRACKET = r"\[[^\]]*(?:\]\][^\]]*)*\]"
_TABLE = r"'[^']*(?:''[^']*)*'|[A-Za-z_][A-Za-z0-9_]*"
TOKEN = f"{_STRING}|{_COMMENT}|(?:{_TABLE})\\s*{_BRACKET}|{_BRACKET}|'[^']*(?:''[^']*)*'|[A-Za-z_][A-Za-z0-9_.]*|\\d+(?:\\.\\d+)?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: functions over arrays compute what they name from outside for every element."""
    return F.transform(F.array(value), body)[0]


def tokens(expression: Column | str) -> Column:
    """The names, references, quoted tables and numbers of an expression, in order."""
    every = F.regexp_extract_all(expression, F.lit(TOKEN), F.lit(0))
    return F.filter(every, lambda t: ~t.startswith('"') & ~t.rlike(r"^(--|//|/\*)"))


def references(expression: Column | str) -> Column:
    """array<struct<table, name>> of the bracketed references; table is null where none is written."""
    refs = F.filter(tokens(expression), lambda t: t.endswith("]"))

    def split(t: Column) -> Column:
        table = F.rtrim(F.regexp_extract(t, f"^((?:{_TABLE})?)", 1))
        name = F.replace(F.regexp_extract(t, r"\[([\s\S]*)\]$", 1), F.lit("]]"), F.lit("]"))
        return F.struct(F.nullif(unquoted(table), F.lit("")).alias("table"), name.alias("name"))

    return F.array_distinct(F.transform(refs, split))


def unquoted(name: Column) -> Column:
    return F.when(name.startswith("'"), F.replace(F.regexp_extract(name, r"^'([\s\S]*)'$", 1), F.lit("''"), F.lit("'"))).otherwise(name)


def tables(expression: Column | str) -> Column:
    """The tables that an expression names, as 'T' or before a bracket."""
    named = F.filter(tokens(expression), lambda t: t.startswith("'") | t.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\s*\["))
    return F.array_distinct(F.transform(named, lambda t: unquoted(F.rtrim(F.regexp_extract(t, f"^({_TABLE})", 1)))))


def functions(expression: Column | str) -> Column:
    """The bare names of an expression in capitals: functions, variables and keywords."""
    return F.array_distinct(F.transform(F.filter(tokens(expression), lambda t: t.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$")), F.upper))


def normalised(expression: Column | str) -> Column:
    """The expression without comments and formatting; strings, names in brackets and case stay.

    Its tokens and single signs, with a space only where two words would run into each other.
    """
    every = F.regexp_extract_all(F.coalesce(expression, F.lit("")), F.lit(f"{TOKEN}|\\S"), F.lit(0))
    kept = F.transform(F.filter(every, lambda t: ~t.rlike(r"^(--|//|/\*)")), lambda t: F.regexp_replace(t, f"^({_TABLE})\\s+(?=\\[)", "$1"))

    def joined(pieces: Column) -> Column:
        apart = lambda p, i: F.coalesce(F.get(pieces, i - 1).rlike("[\\w'\"]$"), F.lit(False)) & p.rlike("^[\\w'\"]")
        return F.array_join(F.transform(pieces, lambda p, i: F.when(apart(p, i), F.concat(F.lit(" "), p)).otherwise(p)), "")

    return let(kept, joined)


def fingerprint(expression: Column | str) -> Column:
    """The normal form in capitals, its variables numbered in order of their declaration."""
    every = F.transform(F.regexp_extract_all(normalised(expression), F.lit(f"{TOKEN}|\\s+|[\\s\\S]"), F.lit(0)), F.upper)

    def numbered(pieces: Column, variables: Column) -> Column:
        number = lambda p: F.array_position(variables, p)
        return F.array_join(F.transform(pieces, lambda p: F.when(number(p) > 0, F.concat(F.lit("_"), number(p))).otherwise(p)), "")

    def declared(pieces: Column) -> Column:
        return F.array_distinct(F.array_compact(F.transform(pieces, lambda p, i: F.when((F.get(pieces, i - 2) == "VAR") & p.rlike("^[A-Z_]"), p))))

    return let(every, lambda pieces: let(declared(pieces), lambda variables: numbered(pieces, variables)))


def fingerprint_tokens(text: Column | str) -> Column:
    """The distinct names, bracketed names and whole numbers of a fingerprint; a table and its column count apart."""
    apart = F.flatten(F.transform(tokens(text), lambda t: F.regexp_extract_all(t, F.lit(r"\[[\s\S]*\]$|[^\W\d]\w*|\d+"), F.lit(0))))
    return F.array_distinct(apart)


def named_fields(expression: Column | str) -> Column:
    """What NAMEOF names in an expression, as it is written there."""
    return let(tokens(expression), lambda every: F.array_distinct(F.filter(every, lambda t, i: (F.upper(F.get(every, i - 1)) == "NAMEOF") & t.endswith("]"))))


def sql_of(m_expression: Column | str) -> Column:
    """The SQL inside a source query: its longest string of 12 characters or more that reads as SQL, escapes decoded."""
    strings = F.transform(F.regexp_extract_all(m_expression, F.lit(r'"([^"]*(?:""[^"]*)*)"'), F.lit(1)), lambda s: decoded(F.replace(s, F.lit('""'), F.lit('"'))))
    sql = F.filter(strings, lambda s: (F.length(s) >= 12) & (s.rlike(r"(?i)^\s*(with|select)\b") | s.rlike(r"(?is)\bselect\b.*\bfrom\b|\bfrom\b.*\bselect\b")))
    longest = F.array_max(F.transform(sql, lambda s: F.struct(F.length(s).alias("n"), s.alias("sql"))))
    return F.coalesce(longest["sql"], F.lit(""))


def decoded(text: Column) -> Column:
    """Source-query escapes: #(lf), #(cr), #(tab), #(#), #(0041), #(0001F600), and several with commas between."""
    names = F.create_map(*map(F.lit, ("lf", "\n", "cr", "\r", "tab", "\t", "#", "#")))

    def character(code: Column) -> Column:
        return F.coalesce(F.element_at(names, code), F.when(code.rlike("^[0-9A-Fa-f]{4}$"), F.decode(F.unhex(code), "UTF-16BE")), F.when(code.rlike("^[0-9A-Fa-f]{8}$"), F.decode(F.unhex(code), "UTF-32")))

    def piece(p: Column) -> Column:
        codes = F.transform(F.split(F.regexp_extract(p, r"^#\(([^)]*)\)$", 1), ","), lambda c: character(F.trim(c)))
        return F.when(p.startswith("#(") & ~F.exists(codes, lambda c: c.isNull()), F.array_join(codes, "")).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"#\([^)]*\)|[^#]+|#"), F.lit(0)), piece), "")


_NAME = r"(?:[\w$#@]+|\[[^\]]+\]|\"[^\"]+\"|`[^`]+`)"
_SQL_TOKEN = rf"--[^\n]*|/\*[\s\S]*?\*/|'(?:[^']|'')*'|{_NAME}(?:\s*\.\s*{_NAME})*|[(),;]"
_CLAUSES = ("WHERE", "GROUP", "ORDER", "HAVING", "UNION", "EXCEPT", "MINUS", "INTERSECT", "LIMIT", "OFFSET", "FETCH", "WINDOW", "QUALIFY", "SET", "VALUES", "RETURNING")
_SQL_STATE = "struct<frames: array<struct<mode: string, query: boolean, name: string, recursive: boolean>>, named: array<struct<name: string, depth: int>>, tables: array<string>, last: string>"


def sql_sources(sql: Column | str) -> Column:
    """The tables that a query reads, each once: of FROM lists, comma joins, joins and nested queries; quotes and brackets dropped.

    One fold over the query's tokens with a stack of scopes, one for each open parenthesis. A scope is where a
    table's name is wanted (table), after one (after: a comma asks for the next), in a WITH clause (with: a name; cte and
    as: up to its body; body and done), or elsewhere. The name of a common table expression hides tables from where its body
    ends (from where it begins, if recursive) to the end of the scope that names it, and only if it stands without a
    schema. FROM outside of a query (EXTRACT(YEAR FROM d)), after DISTINCT, and functions in a FROM list name no table.
    """
    tokens = F.filter(F.regexp_extract_all(sql, F.lit(_SQL_TOKEN), F.lit(0)), lambda t: ~t.startswith("--") & ~t.startswith("/*") & ~t.startswith("'"))
    start = F.from_json(F.lit('{"frames": [{"mode": "start", "query": true, "name": "", "recursive": false}], "named": [], "tables": [], "last": ""}'), _SQL_STATE)
    text = lambda x: F.lit(x).cast("string")

    def step(s: Column, t: Column) -> Column:
        frames, named, tables, last = (s[c] for c in ("frames", "named", "tables", "last"))
        word, bare, depth, top = F.upper(t), F.regexp_replace(t, r'[\[\]"`\s]', ""), F.size(frames), F.element_at(frames, -1)
        mode, own = top["mode"], F.lower(F.regexp_replace(t, r'[\[\]"`\s]', ""))
        under = F.element_at(frames, F.when(F.size(frames) > 1, -2).otherwise(-1))
        frame = lambda mode, query, name, recursive: F.struct(mode.alias("mode"), query.alias("query"), name.alias("name"), recursive.alias("recursive"))
        with_top = lambda f: F.concat(F.slice(frames, 1, F.size(frames) - 1), F.array(f))
        add = lambda name, depth: F.concat(named, F.array(F.struct(name.alias("name"), depth.alias("depth"))))

        opens, closes, begins = t == "(", (t == ")") & (depth > 1), word.isin("SELECT", "DELETE")
        hidden = ~F.contains(own, F.lit(".")) & F.exists(named, lambda x: x["name"] == own)
        is_from = ((word == "FROM") & top["query"] & (last != "DISTINCT")) | word.isin("JOIN", "APPLY")
        plain = ~t.isin("(", ")", ",", ";") & ~(word.isin("WITH") & mode.isin("start", "table")) & ~begins & ~is_from & ~word.isin(*_CLAUSES)
        wanted = plain & (mode == "table") & ~word.isin("LATERAL", "ONLY", "AS", "OUTER", "CROSS")
        read = wanted & ~hidden
        # the top scope's next mode, if no parenthesis opens or closes
        next_mode = (
            F.when(t == ",", F.when(mode == "after", "table").when(mode == "done", "with").otherwise(mode)).when(t == ";", "start")
            .when((word == "WITH") & mode.isin("start", "table"), "with").when(begins, "").when(is_from, "table")
            .when((mode == "cte") & (word == "AS"), "as").when((mode == "with") & (word != "RECURSIVE"), "cte").when(mode.isin("cte", "as"), mode)
            .when(word.isin(*_CLAUSES), "").when(wanted, "after").otherwise(mode)
        )
        named_now = (mode == "with") & plain & (word != "RECURSIVE")
        changed = frame(next_mode, (top["query"] | begins), F.when(named_now, own).otherwise(top["name"]), F.when((word == "WITH") & mode.isin("start", "table"), F.lit(False)).when((mode == "with") & (word == "RECURSIVE"), F.lit(True)).otherwise(top["recursive"]))
        parent = frame(F.when(mode == "as", "body").when(mode == "table", "after").otherwise(mode), top["query"], top["name"], top["recursive"])
        inside = frame(F.when(mode == "table", "table").otherwise("start"), F.lit(False), text(""), F.lit(False))
        back = frame(F.when(under["mode"] == "body", "done").otherwise(under["mode"]), under["query"], under["name"], under["recursive"])
        left = F.filter(named, lambda x: x["depth"] < depth)
        return F.struct(
            F.when(opens, F.concat(with_top(parent), F.array(inside))).when(closes, F.concat(F.slice(frames, 1, F.greatest(depth - 2, F.lit(0))), F.array(back))).otherwise(with_top(changed)).alias("frames"),
            F.when(opens & (mode == "as") & top["recursive"], add(top["name"], depth)).when(closes & (under["mode"] == "body") & ~under["recursive"], F.concat(left, F.array(F.struct(under["name"].alias("name"), (depth - 1).alias("depth"))))).when(closes, left).when(t == ";", F.slice(named, 1, 0)).otherwise(named).alias("named"),
            F.when(opens & (last == "table"), F.slice(tables, 1, F.size(tables) - 1)).when(read, F.concat(tables, F.array(bare))).otherwise(tables).alias("tables"),
            F.when(read, "table").when(word == "DISTINCT", "DISTINCT").otherwise("").alias("last"),
        )

    return F.array_distinct(F.aggregate(tokens, start, lambda s, t: step(s, t).cast(_SQL_STATE), lambda s: s["tables"]))
