"""Findings about a model's health, names, folders, storage and readiness.

Each audit returns model, check, severity, object, message (and sometimes more); an audit whose
statistics a catalog lacks gives no findings for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import SEVERITIES, Catalog, finding, qualified
from ..functions import expressions as X
from ..functions import names as N
from ..storage import cut
from .references import measure_cycles

#: Functions that need a row or filter context. Fixed values.
CONTEXT_FUNCTIONS = ["CALCULATE", "RELATED", "RELATEDTABLE", "EARLIER", "EARLIEST", "FILTER", "ALL", "ALLEXCEPT", "USERELATIONSHIP"]
LARGE_KEY = 1_000_000
LARGE_TEXT_KEY = 100_000


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def health(c: Catalog) -> DataFrame:
    """Duplicate and circular measures, risky relationships, movable columns, large keys, missing descriptions, mixed formats."""
    twice = c.measures.groupBy("model", "measure").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = [twice.select("model", *finding("Duplicate measure name", "High", F.col("measure"), F.concat(F.col("n").cast("string"), F.lit(" measures share this name"))))]
    parts.append(measure_cycles(c).select("model", *finding("Circular measure reference", "High", F.array_join("measures", ", "), "these measures call each other in a circle")))
    r, ends = c.relationships, F.concat_ws(" - ", "from_table", "to_table")
    parts.append(r.where("direction = 'Both'").select("model", *finding("Bi-directional relationship", "Medium", ends, "filters in both directions can double-count")))
    parts.append(r.where("from_cardinality = 'Many' AND to_cardinality = 'Many'").select("model", *finding("Many-to-many relationship", "Medium", ends, "neither side is unique")))
    movable = c.calculated_columns.where((F.coalesce(F.length("expression"), F.lit(0)) > 0) & ~F.arrays_overlap(X.functions("expression"), F.array(*map(F.lit, CONTEXT_FUNCTIONS))))
    parts.append(movable.select("model", *finding("Calculated column could move upstream", "Low", qualified(), "its expression needs no row or filter context")))
    columns = c.user_columns
    keys = columns.join(c.key_columns, ["model", "table", "column"], "left_semi").where(F.col("cardinality") > LARGE_KEY)
    parts.append(keys.select("model", *finding("High-cardinality relationship key", "High", qualified(), F.concat(F.lit("about "), F.col("cardinality").cast("string"), F.lit(" values")))))
    blind = columns.groupBy("model").agg(F.count("cardinality").alias("n")).where("n = 0")
    parts.append(blind.select("model", *finding("High-cardinality relationship key", "Info", "(model)", "skipped: the catalog holds no cardinalities")))
    bare = lambda df: df.where(F.trim(F.coalesce("description", F.lit(""))) == "")
    for df, name in ((c.tables, F.col("table")), (columns, qualified()), (c.measures, F.col("measure"))):
        parts.append(bare(df).select("model", *finding("Missing description", "Low", name, "no description")))
    formats = c.measures.where("data_type IS NOT NULL AND trim(coalesce(format, '')) <> ''").groupBy("model", "data_type").agg(F.array_sort(F.collect_set("format")).alias("formats")).where(F.size("formats") > 1)
    parts.append(formats.select("model", *finding("Inconsistent format strings", "Low", F.col("data_type"), F.array_join("formats", ", "))))
    return union(parts)


def naming(c: Catalog) -> DataFrame:
    """Names that leave the convention of most of their group (a model's tables, a table's measures, a table's columns).

    Also table, convention and suggestion. Where several conventions are as frequent, the one whose
    first name sorts first counts as the group's.
    """
    tables = c.tables.select("model", F.lit("Table").alias("kind"), F.lit("(model)").alias("table"), F.col("table").alias("name"))
    measures = c.measures.select("model", F.lit("Measure"), "table", F.col("measure"))
    columns = c.user_columns.select("model", F.lit("Column"), "table", F.col("column"))
    named = tables.union(measures).union(columns).where("name IS NOT NULL").withColumn("convention", N.convention("name"))
    group = ["model", "kind", "table"]
    counts = named.groupBy(*group, "convention").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))
    usual = counts.groupBy(*group).agg(F.min(F.struct(-F.col("n"), "first", "convention")).alias("top"), F.sum("n").alias("names")).where("names > 1").select(*group, F.col("top.convention").alias("usual"))
    odd = named.join(usual, group).where("convention <> usual")
    suggestion = N.converted("name", F.col("usual"))
    return odd.select("model", *finding("Naming", F.when(F.col("kind") == "Measure", "Medium").otherwise("Low"), F.col("name"), F.concat(F.lit("most names here use "), "usual")), "kind", "table", "convention", F.when(suggestion != F.col("name"), suggestion).alias("suggestion"))


def folders(c: Catalog) -> DataFrame:
    """Measures outside the folders that their table uses, and visible relationship keys."""
    loose = c.measures.groupBy("model", "table").agg(F.count_if(F.coalesce("folder", F.lit("")) != "").alias("filed"), F.array_sort(F.collect_list(F.when(F.coalesce("folder", F.lit("")) == "", F.col("measure")))).alias("loose")).where((F.col("filed") > 0) & (F.size("loose") > 0))
    keys = c.user_columns.join(c.key_columns, ["model", "table", "column"], "left_semi").where(~F.coalesce("hidden", F.lit(False)))
    keys = keys.groupBy("model", "table").agg(F.array_join(F.array_sort(F.collect_set("column")), ", ").alias("names"))
    first = loose.select("model", *finding("Measure outside the folder taxonomy", "Low", F.col("table"), F.array_join("loose", ", ")))
    return first.unionByName(keys.select("model", *finding("Relationship key visible in the field list", "Medium", F.col("table"), F.col("names"))))


def folder_tree(c: Catalog) -> DataFrame:
    """model, table, folder, measures, columns: sorted names in each folder ('' is the root)."""
    items = c.measures.select("model", "table", F.coalesce("folder", F.lit("")).alias("folder"), F.col("measure"), F.lit(None).cast("string").alias("column")).union(c.user_columns.select("model", "table", F.coalesce("folder", F.lit("")), F.lit(None).cast("string"), "column"))
    return items.groupBy("model", "table", "folder").agg(F.array_sort(F.collect_set("measure")).alias("measures"), F.array_sort(F.collect_set("column")).alias("columns"))


def encoding_counts(c: Catalog) -> DataFrame:
    return c.user_columns.where("encoding IS NOT NULL").groupBy("model", "encoding").agg(F.count(F.lit(1)).alias("columns"))


def sizes(c: Catalog, kind: str = "column", k: int = 20) -> DataFrame:
    """model, table[, column], megabytes (or distinct values for kind cardinality): the k largest of each model; ties by name."""
    if kind == "table":
        df, names, size = c.tables, ["table"], "size"
    else:
        df, names, size = c.user_columns, ["table", "column"], "total_size" if kind == "column" else "cardinality"
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc(size), *names))
    top = df.where(F.col(size).isNotNull()).withColumn("place", place).where(F.col("place") <= k)
    return top.select("model", *names, N.megabytes(size).alias("megabytes") if kind != "cardinality" else F.col("cardinality").alias("distinct"))


def total_sizes(c: Catalog) -> DataFrame:
    """model, megabytes of all columns, and how much of them dictionaries and data take, where the catalog tells."""
    own = c.user_columns.groupBy("model").agg(*(F.sum(x).alias(x) for x in ("total_size", "dictionary_size", "data_size")))
    return own.where("total_size IS NOT NULL").select("model", N.megabytes("total_size").alias("megabytes"), N.megabytes("dictionary_size").alias("dictionary_megabytes"), N.megabytes("data_size").alias("data_megabytes"))


def encoding_advice(c: Catalog) -> DataFrame:
    """Columns worth another encoding, a sort order, a split or no hierarchy; also megabytes, dictionary percent and distinct estimate.

    Only columns of at least 0.5 % of the model, or 1 MB where that is less.
    """
    segments = c.segments.groupBy("model", "table", "column").agg(F.min(F.when(F.col("compression") != "", F.col("compression"))).alias("compression"), F.max("bits").alias("bits"))
    columns = c.user_columns.join(segments, ["model", "table", "column"], "left").join(c.tables.select("model", "table", "rows_count").dropDuplicates(["model", "table"]), ["model", "table"], "left")
    total = c.user_columns.groupBy("model").agg(F.sum(F.coalesce("total_size", F.lit(0))).alias("model_size"), F.count("total_size").alias("known")).where("known > 0")
    threshold = F.when(F.col("model_size") > 0, F.least(F.col("model_size") * 0.005, F.lit(1_000_000.0))).otherwise(0.0)
    rows = columns.join(total, "model").withColumn("size", F.coalesce("total_size", F.lit(0))).withColumn("threshold", threshold).where("size >= threshold")
    rows = rows.withColumn("percent", F.coalesce(F.try_divide(F.coalesce("dictionary_size", F.lit(0)) * 100.0, F.col("size")), F.lit(0.0)))
    estimate = F.when(F.col("bits").between(1, 40), F.least(F.expr("shiftleft(1L, bits)"), F.col("rows_count")))
    rows = rows.withColumn("distinct", estimate)
    big = F.when(F.col("size") > F.col("threshold") * 4, "High").otherwise("Medium")
    numeric = F.lower("data_type").isin("int64", "double", "decimal", "currency")
    flags = [
        (numeric & (F.upper("encoding") == "HASH"), F.when(F.col("percent") > 40, "High").otherwise("Medium"), "numbers stored with a dictionary"),
        ((F.upper("compression") == "NOSPLIT") & (F.col("distinct") <= 1024), big, "few distinct values, but runs aren't encoded: sort the source by this column"),
        (F.col("percent") > 60, big, "the dictionary dwarfs the data: split or round the values"),
        (F.col("hidden") & F.col("in_mdx"), F.lit("Medium"), "hidden, but a hierarchy is built for it"),
    ]
    advice = F.filter(F.array(*(F.when(test, F.struct(sev.alias("severity"), F.lit(text).alias("text"))) for test, sev, text in flags)), lambda x: x.isNotNull())
    rows = rows.withColumn("advice", advice).where(F.size("advice") > 0)
    worst = F.when(F.exists("advice", lambda x: x["severity"] == "High"), "High").otherwise("Medium")
    return rows.select("model", *finding("Encoding", worst, qualified(), F.array_join(F.transform("advice", lambda x: x["text"]), "; ")), N.megabytes("size").alias("megabytes"), F.round("percent", 1).alias("dictionary_percent"), "distinct")


def readiness(c: Catalog) -> DataFrame:
    """What keeps a model from being read straight from lake files; one Info row for models with nothing."""
    several = lambda df, name: df.groupBy("model").agg(F.array_sort(F.collect_set(name)).alias("names")).withColumn("text", F.array_join("names", ", "))
    parts = []
    kinds = c.partitions.withColumn("kind", F.lower("source_type"))
    parts.append(several(kinds.where("kind = 'calculated'"), F.col("table")).select("model", *finding("Calculated tables", "High", F.col("text"), "no expression engine at load time")))
    parts.append(several(c.columns.where("column_type = 'Calculated'"), qualified()).select("model", *finding("Calculated columns", "High", F.col("text"), "compute them in the source table")))
    parts.append(several(kinds.where("kind = 'm'"), F.col("table")).select("model", *finding("Source transforms", "Medium", F.concat(F.size("names").cast("string"), F.lit(" table(s)")), "move transforms upstream")))
    auto = c.tables.where(F.col("table").startswith("LocalDateTable_") | F.col("table").startswith("DateTableTemplate_"))
    parts.append(several(auto, F.col("table")).select("model", *finding("Auto date/time tables", "High", F.concat(F.size("names").cast("string"), F.lit(" hidden table(s)")), "one hidden date table for each date column")))
    total = c.user_columns.groupBy("model").agg((F.sum("total_size") / 1024**3).alias("gb")).where("gb > 0")
    parts.append(total.select("model", *finding("Memory", F.when(F.col("gb") > 25, "High").when(F.col("gb") > 3, "Medium").otherwise("Info"), "(model)", F.concat(F.round("gb", 2).cast("string"), F.lit(" GB of columns")))))
    parts.append(several(c.user_columns.where("hidden AND in_mdx AND total_size IS NOT NULL"), qualified()).select("model", *finding("Unneeded hierarchies", "Medium", F.concat(F.size("names").cast("string"), F.lit(" hidden column(s)")), "hierarchies that no report can browse")))
    text_keys = c.user_columns.join(c.key_columns, ["model", "table", "column"], "left_semi").where((F.col("data_type") == "String") & (F.col("cardinality") > LARGE_TEXT_KEY))
    parts.append(several(text_keys, qualified()).select("model", *finding("Text keys", "Medium", F.col("text"), "replace by integer keys")))
    parts.append(several(c.relationships.where("direction = 'Both'"), F.concat_ws(" - ", "from_table", "to_table")).select("model", *finding("Bi-directional relationships", "Medium", F.col("text"), "ambiguous and slow in any mode")))
    found = union(parts)
    clean = c.tables.select("model").distinct().join(found, "model", "left_anti")
    return found.unionByName(clean.select("model", *finding("No blockers", "Info", "(model)", "nothing found that keeps it from lake files")))


def date_tables(c: Catalog) -> DataFrame:
    """model, table, marked, key, date_columns of tables marked for time, or with a date column and a name that says so."""
    columns = c.user_columns.groupBy("model", "table").agg(F.min(F.when(F.col("is_key"), F.col("column"))).alias("key"), F.array_sort(F.collect_set(F.when(F.lower("data_type").isin("datetime", "date"), F.col("column")))).alias("date_columns"))
    marked = F.lower(F.coalesce("category", F.lit(""))) == "time"
    rows = c.tables.select("model", "table", marked.alias("marked")).join(columns, ["model", "table"], "left")
    return rows.where(F.col("marked") | (F.size("date_columns") > 0) & F.col("table").rlike("(?i)date|calendar"))


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy("model", *by).agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES))


def scorecard(sections: dict[str, DataFrame], models: DataFrame) -> DataFrame:
    """model, score, grade: 100 less what each section's worst severity and its count take, at most 100 / sections each.

    Info findings cost nothing. sections: name -> findings; models: the models to grade. Each section's counts are
    written before the next one's begin, so the driver holds one section's plan and joins at a time.
    """
    cap = 100.0 / max(len(sections), 1)
    counts = union([cut(severity_counts(f.select("model", "severity")).withColumn("section", F.lit(n))) for n, f in sections.items()])
    base = F.when(F.col("high") > 0, 0.60).when(F.col("medium") > 0, 0.35).when(F.col("low") > 0, 0.12).otherwise(0.0)
    worst = F.when(F.col("high") > 0, F.col("high")).when(F.col("medium") > 0, F.col("medium")).otherwise(F.col("low"))
    cost = F.when(base > 0, F.lit(cap) * (base + (1 - base) * F.least(F.lit(1.0), worst / 10) * 0.7)).otherwise(0.0)
    total = models.select("model").distinct().join(counts.groupBy("model").agg(F.sum(cost).alias("cost")), "model", "left")
    score = F.round(100 - F.coalesce("cost", F.lit(0.0))).cast("int")
    return total.select("model", score.alias("score")).withColumn("grade", F.when(F.col("score") >= 85, "Healthy").when(F.col("score") >= 60, "Needs attention").otherwise("At risk"))
