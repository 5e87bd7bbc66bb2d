"""Differences between catalogs, and measures that compute nearly the same."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, qualified
from ..functions import expressions as X
from ..storage import ship
from .relational import changes


def measure_changes(base: Catalog, other: Catalog) -> DataFrame:
    """model, measure, change (expression changed, moved, added, removed), severity, and both tables and expressions.

    Formatting and comments don't count. Of measures that share a name the last table's counts; health() reports them.
    """
    last = lambda c: c.measures.groupBy("model", "measure").agg(F.max_by(F.struct(F.col("table"), F.col("expression")), F.col("table")).alias("m")).select("model", "measure", "m.table", "m.expression", X.normalised(F.col("m.expression")).alias("normal"))
    rows = changes(last(base), last(other), ["model", "measure"], ["table", "expression", "normal"])
    drifted = ~F.col("base_normal").eqNullSafe(F.col("other_normal"))
    moved = ~F.col("base_table").eqNullSafe(F.col("other_table"))
    what = F.when(F.col("change") != "changed", F.col("change")).when(drifted, "expression changed").when(moved, "moved")
    severity = F.when(what.isin("expression changed", "removed"), "High").otherwise("Medium")
    return rows.where(what.isNotNull()).select("model", "measure", what.alias("change"), severity.alias("severity"), "base_table", "other_table", "base_expression", "other_expression")


def structure_changes(base: Catalog, other: Catalog) -> DataFrame:
    """model, kind, object, change, severity: tables, columns and relationships (with direction) added or removed."""

    def objects(c: Catalog) -> DataFrame:
        tables = c.tables.select("model", F.lit("Table").alias("kind"), F.col("table").alias("object"))
        columns = c.user_columns.select("model", F.lit("Column"), qualified())
        ends = F.concat(qualified("from_table", "from_column"), F.lit(" -> "), qualified("to_table", "to_column"), F.lit(" ("), F.col("direction"), F.lit(")"))
        return tables.union(columns).union(c.relationships.select("model", F.lit("Relationship"), ends))

    # both sides in one grouping, so each catalog is read once
    sides = objects(base).withColumn("before", F.lit(1)).union(objects(other).withColumn("before", F.lit(0)))
    found = sides.groupBy("model", "kind", "object").agg(F.min("before").alias("least"), F.max("before").alias("most")).where("least = most")
    added = F.col("most") == 0
    return found.select("model", "kind", "object", F.when(added, "Added").otherwise("Removed").alias("change"), F.when(added, "Low").otherwise("Medium").alias("severity"))


def versions_of(c: Catalog, version: Column | int) -> DataFrame:
    """model, version, kind, object, content (a hash of what counts) of a catalog's objects, for history().

    version: a number, or a column of all of the catalog's relations, whose rows are then those of several versions.
    """
    told = lambda *columns: F.xxhash64(*(F.coalesce(F.col(x).cast("string") if isinstance(x, str) else x.cast("string"), F.lit("\0")) for x in columns))
    number = F.lit(version) if isinstance(version, int) else version
    rows = lambda df, kind, name, content: df.select("model", F.lit(kind).alias("kind"), name.alias("object"), content.alias("content"), number.alias("version"))
    parts = [
        rows(c.tables, "Table", F.col("table"), told("category", "expression")),
        rows(c.user_columns, "Column", qualified(), told("data_type", "column_type", X.normalised(F.col("expression")))),
        rows(c.measures, "Measure", qualified(column="measure"), told(X.normalised(F.col("expression")), "format")),
        rows(c.relationships, "Relationship", F.concat(qualified("from_table", "from_column"), F.lit(" -> "), qualified("to_table", "to_column")), told("direction", "active", "from_cardinality", "to_cardinality")),
    ]
    # objects of the same name count as one, with all that is told of them: sums of both halves of its hashes, which need no lists
    half = lambda x: F.sum(x.bitwiseAND(F.lit(0xFFFFFFFF)))
    every = reduce(DataFrame.unionByName, parts).groupBy("model", "version", "kind", "object")
    return every.agg(F.xxhash64(half(F.col("content")), half(F.shiftrightunsigned("content", 32))).alias("content"))


def history(objects: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """model, version, kind, object, change (added, changed, removed): what each version of a model does to the one before it.

    objects: model, version (an ordered number), kind, object, content, for any number of versions; a model's first one
    is where it begins. Objects are compared by content alone, each version with its neighbour, in one pass over the rows of an object,
    so n versions cost one shuffle. known: model, version of all versions, where these can be told without making the objects again.
    """
    known = (objects if known is None else known).groupBy("model").agg(F.array_sort(F.collect_set("version")).alias("versions"))  # a model's versions, not its objects
    own = Window.partitionBy("model", "kind", "object").orderBy("version")
    # in the order of objects first, which begins with the model: the join needs no other
    rows = objects.withColumns({"seen": F.lag("version").over(own), "was": F.lag("content").over(own), "again": F.lead("version").over(own)}).join(known, "model")
    place = F.array_position("versions", F.col("version")).cast("int")
    rows = rows.withColumns({"before": F.get("versions", place - 2), "next": F.get("versions", place)})
    here = F.when(F.col("before").isNull(), None).when(~F.col("seen").eqNullSafe(F.col("before")), "added").when(F.col("was") != F.col("content"), "changed")
    gone = F.when(F.col("next").isNotNull() & ~F.col("again").eqNullSafe(F.col("next")), "removed")
    found = F.explode(F.array(F.struct("version", here.alias("change")), F.struct(F.col("next").alias("version"), gone.alias("change")))).alias("c")
    return rows.select("model", "kind", "object", found).where("c.change IS NOT NULL").select("model", "c.version", "kind", "object", "c.change")


def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """How much of two texts is equal, in percent; a pair that stands in many models is compared once a batch."""
    pairs = list(zip(a, b, strict=True))
    made = {p: difflib.SequenceMatcher(None, *p).ratio() * 100 for p in set(pairs)}
    return pd.Series([made[p] for p in pairs], dtype="float64")


def near_duplicate_measures(c: Catalog, threshold: int = 85) -> DataFrame:
    """model, table_a, measure_a, table_b, measure_b, similarity, severity: pairs of measures with nearly equal logic.

    Copies (measures of one fingerprint) are paired with the first of them, at 100, and only that one is in
    other pairs; a copy is as near to those as it is.

    Pairs must share one of their rarest tokens: token sets whose Jaccard similarity reaches 0.75 of
    the threshold always do. Lengths and Jaccard similarity are tested in the JVM; only what passes
    meets the character comparison. Every measure takes part.
    """
    ship(c.measures.sparkSession)
    least, similarity = 0.75 * threshold / 100, F.pandas_udf(ratios, T.DoubleType())
    fp = F.explode(F.array(X.fingerprint("expression")))  # as an array's only item, so that the filter on it doesn't compute it again
    m = c.measures.select("model", "table", "measure", fp.alias("fp")).where(F.length("fp") >= 8).distinct().withColumn("tokens", X.fingerprint_tokens("fp"))
    # equal fingerprints are one node, so copies of a measure don't multiply the join; the first of them stands for all
    nodes = m.groupBy("model", "fp").agg(F.first("tokens").alias("tokens"), F.min(F.struct("measure", "table")).alias("first"))
    each = nodes.withColumn("token", F.explode("tokens")).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("model", "token")))
    order = F.row_number().over(Window.partitionBy("model", "fp").orderBy("df", "token"))
    prefix = each.withColumn("place", order).where(F.col("place") <= F.size("tokens") - F.ceil(F.lit(least) * F.size("tokens")) + 1)
    a, b = (prefix.select("model", "token", *(F.col(x).alias(f"{x}_{s}") for x in ("fp", "tokens", "first"))) for s in "ab")
    lengths = F.least(F.length("fp_a"), F.length("fp_b")) >= F.lit(0.8 * threshold / 100) * F.greatest(F.length("fp_a"), F.length("fp_b"))
    jaccard = F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.lit(least) * F.size(F.array_union("tokens_a", "tokens_b"))
    pairs = a.join(b, ["model", "token"]).where((F.col("fp_a") < F.col("fp_b")) & lengths & jaccard).select("model", "fp_a", "fp_b", "first_a", "first_b").distinct()
    scored = pairs.withColumn("similarity", similarity("fp_a", "fp_b")).where(F.col("similarity") >= threshold)
    name = lambda s: (F.col(f"first_{s}.table").alias(f"table_{s}"), F.col(f"first_{s}.measure").alias(f"measure_{s}"))
    near = scored.select("model", *name("a"), *name("b"), "similarity")
    copies = m.select("model", F.min(F.struct("measure", "table")).over(Window.partitionBy("model", "fp")).alias("first_a"), F.struct("measure", "table").alias("first_b"))
    equal = copies.where("first_a < first_b").select("model", *name("a"), *name("b"), F.lit(100.0).alias("similarity"))
    out = near.select("model", "table_a", "measure_a", "table_b", "measure_b", "similarity").unionByName(equal.select("model", "table_a", "measure_a", "table_b", "measure_b", "similarity"))
    first = F.struct("measure_a", "table_a") < F.struct("measure_b", "table_b")
    side = lambda n, x, y: F.when(first, F.col(x)).otherwise(F.col(y)).alias(n)
    out = out.select("model", side("table_a", "table_a", "table_b"), side("measure_a", "measure_a", "measure_b"), side("table_b", "table_b", "table_a"), side("measure_b", "measure_b", "measure_a"), F.round("similarity", 1).alias("similarity"))
    return out.withColumn("severity", F.when(F.col("similarity") >= 95, "High").otherwise("Medium"))
