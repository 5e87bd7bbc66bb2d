"""The graph of relationships: shape of the schema, bridges, subject areas, and how far roles reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..storage import cut


def links(c: Catalog) -> DataFrame:
    """model, a, b: both directions of every relationship between two tables."""
    r = c.relationships.where("from_table <> to_table").select("model", F.col("from_table").alias("a"), F.col("to_table").alias("b"))
    return r.union(r.select("model", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def facts(c: Catalog) -> DataFrame:
    """model, table of the fact tables: the many side of two relationships or more, else the tables with most."""
    degree = c.relationships.groupBy("model", F.col("from_table").alias("table")).agg(F.count(F.lit(1)).alias("n"))
    most = degree.groupBy("model").agg(F.max("n").alias("most"))
    return degree.join(most, "model").where("n >= 2 OR (most < 2 AND n = most)").select("model", "table")


def distances(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """model, table, depth from the nearest start (model, table), breadth first; one round for each step, nodes once."""
    reached = cut(starts.select("model", "table").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        edge = reached.where(F.col("depth") == depth - 1).select("model", F.col("table").alias("a"))
        new = edge.join(edges, ["model", "a"]).select("model", F.col("b").alias("table")).distinct().join(reached, ["model", "table"], "left_anti")
        new = cut(new.withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return reached
        reached = cut(reached.union(new))


def schema_shape(c: Catalog) -> DataFrame:
    """model, shape (Galaxy, Snowflake, Star or Flat), facts, dimensions, depth."""
    own = facts(c)
    dims = c.relationships.select("model", F.col("to_table").alias("table")).distinct().join(own, ["model", "table"], "left_anti")
    depth = distances(own, links(c)).groupBy("model").agg(F.max("depth").alias("depth"))
    lists = lambda df, name: df.groupBy("model").agg(F.array_sort(F.collect_set("table")).alias(name))
    rows = c.tables.select("model").distinct().join(lists(own, "facts"), "model", "left").join(lists(dims, "dimensions"), "model", "left").join(depth, "model", "left")
    size = F.coalesce(F.size("facts"), F.lit(0))
    shape = F.when(size > 1, "Galaxy").when(F.col("depth") > 1, "Snowflake").when(size > 0, "Star").otherwise("Flat")
    none = F.array().cast("array<string>")
    return rows.select("model", shape.alias("shape"), F.coalesce("facts", none).alias("facts"), F.coalesce("dimensions", none).alias("dimensions"), F.coalesce("depth", F.lit(0)).alias("depth"))


def subject_areas(c: Catalog) -> DataFrame:
    """model, fact, tables: each fact table with the tables it is joined to; tables of measures alone don't count."""
    real = c.user_columns.select("model", "table").distinct()
    own = facts(c).join(real, ["model", "table"], "left_semi")
    near = own.join(links(c).withColumnRenamed("a", "table"), ["model", "table"]).select("model", F.col("table").alias("fact"), F.col("b").alias("table"))
    every = own.select("model", F.col("table").alias("fact"), "table").union(near).join(real, ["model", "table"], "left_semi")
    return every.groupBy("model", "fact").agg(F.array_sort(F.collect_set("table")).alias("tables"))


def paths_from(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """model, start, table, depth, before: one shortest path from every start (model, start) to every table it reaches, as pointers back.

    Breadth first from all starts at once; each (start, table) is met once and keeps the table before it on the path
    whose names, read from the start, sort first among the shortest. Steps are written apart and united when read. most: the longest path.
    """
    first = starts.select("model", "start", F.col("start").alias("table"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("before"), F.lit(1).cast("long").alias("place"))
    parts = [cut(first)]
    while most is None or len(parts) <= most:
        frontier, known = parts[-1], reduce(DataFrame.unionByName, parts).select("model", "start", "table")
        step = frontier.join(edges.select("model", F.col("a").alias("table"), "b"), ["model", "table"]).groupBy("model", "start", F.col("b").alias("next")).agg(F.min(F.struct("place", F.col("table").alias("before"))).alias("best"))
        new = step.select("model", "start", F.col("next").alias("table"), F.lit(len(parts)).alias("depth"), "best.before", F.col("best.place").alias("place")).join(known, ["model", "start", "table"], "left_anti")
        order = Window.partitionBy("model", "start").orderBy("place", "table")  # of one step from one start: at most a model's tables
        parts.append(cut(new.withColumn("place", F.row_number().over(order).cast("long"))))
        if parts[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, parts).drop("place")


def graph_classes(items: DataFrame) -> DataFrame:
    """model, class: models with the same starts and the same links are of one class; models without starts are left out.

    items: model, a, b, each once: starts (b null) and links from a to b. Classes are told by the items' number and 128 bits of
    hashes, so no task holds a model's items together; they are exact up to collisions of these.
    """
    halves = [F.bit_xor(F.xxhash64(F.lit(seed), "a", F.lit(seed), F.col("b").isNull(), "b")).alias(f"h{seed}") for seed in (1, 2)]
    told = items.where("model IS NOT NULL").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b").isNull()).alias("starts"), *halves).where("starts > 0")
    return told.select("model", F.concat_ws(" ", "starts", "n", "h1", "h2").alias("class"))


def with_bridges(c: Catalog, tables: DataFrame, hops: int | None = None) -> DataFrame:
    """model, table: the given tables and those on shortest paths between them (with at most `hops` tables in between, if given).

    Of equally short paths the one counts whose names sort first, read from the end whose name does. Models with the same
    links and given tables are one class, whose paths are looked for in one of them.
    """
    none = F.lit(None).cast("string")
    # starts and links are written, as every step reads them; apart, as a task would hold both otherwise
    items = cut(tables.select("model", F.col("table").alias("a"), none.alias("b")).distinct()).union(cut(links(c)))
    classes = cut(graph_classes(items))
    first = cut(classes.groupBy("class").agg(F.min("model").alias("model")))  # written, as its size tells how to join
    one = cut(items.join(first, "model").select(F.col("class").alias("model"), "a", "b"))
    own = one.where("b IS NULL").select("model", F.col("a").alias("table"))
    paths = cut(paths_from(own.withColumnRenamed("table", "start"), one.where("b IS NOT NULL"), None if hops is None else hops + 1))
    at = paths.join(own, ["model", "table"], "left_semi").where("start < table").select("model", "start", F.col("before").alias("table"))
    found = [own]
    while True:  # back from the ends, all pairs at once: as often as the longest path has steps
        at = cut(at.where("table <> start").distinct())
        if at.isEmpty():
            break
        found.append(at.select("model", "table"))
        at = at.join(paths.select("model", "start", "table", "before"), ["model", "start", "table"]).select("model", "start", F.col("before").alias("table"))
    each = reduce(DataFrame.union, found).distinct().withColumnRenamed("model", "class")
    nameless = items.where("model IS NULL AND b IS NULL").select("model", F.col("a").alias("table"))  # joined with nothing
    return classes.join(each, "class").select("model", "table").union(nameless)


def filter_edges(c: Catalog) -> DataFrame:
    """model, a, b: filters of a reach b, from the one side to the many side, and back where a relationship filters both ways."""
    r = c.relationships.where("coalesce(active, true) AND from_table <> to_table AND from_table <> '' AND to_table <> ''")
    one_first = F.lower(F.coalesce("from_cardinality", F.lit("Many"))).startswith("one")
    one, many = F.when(one_first, F.col("from_table")).otherwise(F.col("to_table")), F.when(one_first, F.col("to_table")).otherwise(F.col("from_table"))
    down = r.select("model", one.alias("a"), many.alias("b"))
    up = r.where("direction = 'Both'").select("model", many.alias("a"), one.alias("b"))
    return down.union(up).distinct()


def role_reach(c: Catalog) -> DataFrame:
    """model, role, secured, table, filtered, severity, reason: which tables each role's filters reach.

    Not reached, but related to the secured table: High; not related: Low; a role without filters: Medium.
    """
    secured = c.roles.where("table IS NOT NULL AND table <> ''").select("model", "role", F.col("table").alias("secured")).distinct()
    edges = filter_edges(c)
    start = secured.withColumn("table", F.col("secured")).withColumn("path", F.array("secured"))
    parts = [cut(start.select("model", "role", "secured", "table", "path"))]
    while not parts[-1].isEmpty():  # each step is written once; what is known is their union
        step = parts[-1].join(edges.withColumnRenamed("a", "table"), ["model", "table"]).select("model", "role", "secured", F.col("b").alias("table"), F.concat("path", F.array("b")).alias("path"))
        known = reduce(DataFrame.unionByName, parts).select("model", "role", "secured", "table")
        parts.append(cut(step.groupBy("model", "role", "secured", "table").agg(F.min("path").alias("path")).join(known, ["model", "role", "secured", "table"], "left_anti")))
    reached = reduce(DataFrame.unionByName, parts)
    related = c.relationships.select("model", F.col("from_table").alias("secured"), F.col("to_table").alias("table"), "active").union(c.relationships.select("model", "to_table", "from_table", "active"))
    related = related.groupBy("model", "secured", "table").agg(F.max(F.coalesce("active", F.lit(True))).alias("any_active"))
    rows = secured.join(c.tables.select("model", "table").distinct(), "model").join(reached, ["model", "role", "secured", "table"], "left").join(related, ["model", "secured", "table"], "left")
    filtered = F.col("path").isNotNull()
    severity = F.when(filtered, "Info").when(F.col("any_active").isNotNull(), "High").otherwise("Low")
    reason = (
        F.when(F.size("path") == 1, "filter on this table").when(filtered, F.array_join("path", " > ")).when(F.col("any_active"), F.concat(F.lit("related to "), "secured", F.lit(", but filters don't flow that way")))
        .when(~F.col("any_active"), F.concat(F.lit("related to "), "secured", F.lit(" by an inactive relationship only"))).otherwise(F.concat(F.lit("no path from "), "secured"))
    )
    out = rows.select("model", "role", "secured", "table", filtered.alias("filtered"), severity.alias("severity"), reason.alias("reason"))
    bare = c.roles.select("model", "role").distinct().join(secured, ["model", "role"], "left_anti")
    none = F.lit(None).cast("string")
    return out.union(bare.select("model", "role", none, none, F.lit(False), F.lit("Medium"), F.lit("the role has no filters: it may read everything")))


def role_exposure(c: Catalog) -> DataFrame:
    """model, role, secured, exposed, trapped, severity: counts of tables over role_reach."""
    counts = role_reach(c).groupBy("model", "role").agg(F.count_if("filtered").alias("secured"), F.count_if(~F.col("filtered")).alias("exposed"), F.count_if(F.col("severity") == "High").alias("trapped"))
    return counts.withColumn("severity", F.when(F.col("trapped") > 0, "High").when(F.col("secured") <= 1, "Medium").otherwise("Info"))
