"""Naming conventions, slugs and ids, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Convention -> pattern, first match counts. Fixed values.
CONVENTIONS = {
    "snake_case": r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$",
    "PascalCase": r"^[A-Z][a-zA-Z0-9]*$",
    "camelCase": r"^[a-z][a-zA-Z0-9]*$",
    "Title Case With Spaces": r"^[A-Z][a-z0-9]*(\s[A-Za-z0-9]+)*$",
}
OTHER = "Other/mixed"


def convention(name: Column | str) -> Column:
    name, out = F.col(name) if isinstance(name, str) else name, None
    for label, pattern in CONVENTIONS.items():
        out = F.when(name.rlike(pattern), label) if out is None else out.when(name.rlike(pattern), label)
    return out.otherwise(OTHER)


#: A word starts at a capital after a small letter or digit, and at a digit after a letter; separators end it.
_ALIKE = r"(?:[0-9]+[a-z]*|[A-Z]+[a-z]*|[a-z]+)"
_MARKS = r"[^\sA-Za-z0-9_\-]+"
WORD = f"(?:{_ALIKE}|{_MARKS}{_ALIKE}?)(?:{_MARKS}{_ALIKE}?)*"
#: Convention -> how the first word and the others are written, and what stands between them.
STYLES = {"snake_case": (F.lower, F.lower, "_"), "PascalCase": (F.initcap, F.initcap, ""), "camelCase": (F.lower, F.initcap, ""), "Title Case With Spaces": (F.initcap, F.initcap, " ")}


def words(name: Column | str) -> Column:
    return F.regexp_extract_all(name, F.lit(WORD), F.lit(0))


def converted(name: Column | str, to: Column) -> Column:
    """The name in a convention; null where it has no words or the convention is none."""
    own, out = words(name), F.lit(None).cast("string")

    def spelt(first, rest, between: str) -> Column:
        return F.array_join(F.transform(own, lambda w, i: F.when(i == 0, first(w)).otherwise(rest(w))), between)

    for style, how in STYLES.items():
        out = F.when(to == style, spelt(*how)).otherwise(out)
    return F.when(F.size(own) > 0, out)


def slug(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def stable_id(*parts: Column, length: int = 8) -> Column:
    """The same id for the same parts, whatever run makes it."""
    return F.left(F.md5(F.concat_ws("::", *parts).cast("binary")), F.lit(length))


def megabytes(size: Column | str) -> Column:
    return F.round((F.col(size) if isinstance(size, str) else size) / 1048576, 2)
