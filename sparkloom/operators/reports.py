"""What reports use of a model: broken bindings, columns safe to delete, field parameters, source lineage, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import expressions as X
from .references import column_uses


def broken_bindings(c: Catalog) -> DataFrame:
    """The bindings that no object of the model answers, with problem and severity High.

    A binding without a table is skipped; a measure may have moved to another table; a level may be a column.
    """
    names = [x for x in c.bindings.columns if x not in ("model", "table", "field")]
    rows = c.bindings.where("table <> ''").select("model", "table", "field", F.lit("binding").alias("what"), *names)
    parts = [(c.tables, "table", F.lit(None).cast("string")), (c.user_columns, "column", F.col("column")), (c.measures, "measure", F.col("measure")), (c.levels, "level", F.col("level"))]
    for df, what, name in parts:
        rows = rows.unionByName(df.select("model", "table", name.alias("field"), F.lit(what).alias("what")), allowMissingColumns=True)
    # what bears a binding's name is beside it in the order of tables, then in that of names: two sorts, not a join for each question
    there = lambda what, *by: F.max(F.col("what") == what).over(Window.partitionBy("model", *by))
    full = {what: F.col("field").isNotNull() & there(what, "table", "field") for what in ("column", "measure", "level")}
    rows = rows.withColumns(full).withColumn("known", there("table", "table")).where("what IN ('binding', 'measure')")
    rows = rows.withColumn("moved", F.col("field").isNotNull() & there("measure", "field")).where("what = 'binding'")
    problem = (
        F.when(~F.col("known"), "the table doesn't exist").when((F.col("kind") == "Measure") & ~F.col("moved") & ~F.col("column"), "no such measure")
        .when((F.col("kind") == "Hierarchy level") & ~F.col("level") & ~F.col("column"), "no such level").when(~F.col("kind").isin("Measure", "Hierarchy level") & ~F.col("column") & ~F.col("measure"), "no such column")
    )
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select(*c.bindings.columns, "problem").withColumn("severity", F.lit("High"))


def column_disposition(c: Catalog) -> DataFrame:
    """model, table, column, in_dax, in_report (null without a report), pages, verdict, severity.

    A field's bare name counts as use where no page names its table.
    """
    rows, dax, seen = column_uses(c), F.col("status") != "Likely unused", F.col("shown")
    verdict = (
        F.when(F.col("report").isNull(), F.when(dax, "Referenced").otherwise("Unknown without the report")).when(dax & seen, "Keep: expressions and visuals use it")
        .when(dax, "Keep: expressions use it").when(seen, "Keep: visuals use it").otherwise("Safe to delete")
    )
    severity = F.when(verdict == "Safe to delete", "Medium").when(verdict == "Unknown without the report", "Low").otherwise("Info")
    return rows.select("model", "table", "column", dax.alias("in_dax"), F.when(F.col("report"), seen).alias("in_report"), "pages", verdict.alias("verdict"), severity.alias("severity"))


def field_parameters(c: Catalog) -> DataFrame:
    """model, table, fields (what its rows name), used (null without a report), pages, severity."""
    def rows(df: DataFrame, **given) -> DataFrame:
        kinds = {"expression": "string", "marker": "boolean", "page": "string", "what": "string"}
        return df.select("model", "table", *(given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()))

    every = rows(c.tables, expression=F.coalesce("expression", F.lit("")), what=F.lit("table")).union(rows(c.columns, marker=F.coalesce("marker", F.lit(False)))).union(rows(c.bindings, page=F.col("page"), what=F.lit("binding")))
    of_table, bound = Window.partitionBy("model", "table"), F.col("what") == "binding"
    here = F.col("table").isNotNull()
    every = every.withColumns({"marked": here & F.max("marker").over(of_table), "bound": here & F.coalesce(F.max(bound).over(of_table), F.lit(False)), "pages": F.collect_set("page").over(of_table)})
    every = every.withColumn("report", F.max(F.when(bound, True)).over(Window.partitionBy("model"))).where("what = 'table'")
    found = every.where(F.col("marked") | F.array_contains(X.functions("expression"), "NAMEOF"))
    used = F.when(F.col("report"), F.col("bound"))
    return found.select("model", "table", F.array_sort(X.named_fields(F.col("expression"))).alias("fields"), used.alias("used"), F.when(F.col("bound"), F.array_sort("pages")).alias("pages"), F.when(~used, "Medium").otherwise("Info").alias("severity"))


def page_tables(c: Catalog) -> DataFrame:
    """model, page, table: the model's tables that each page's visuals use, by their columns or measures' expressions."""
    direct = c.bindings.select("model", "page", "table")
    measures = c.bindings.join(c.measures.select("model", F.col("measure").alias("field"), "expression"), ["model", "field"]).select("model", "page", F.explode(X.tables("expression")).alias("table"))
    real = c.user_columns.select("model", "table").distinct()
    return direct.union(measures).distinct().join(real, ["model", "table"], "left_semi").select("model", "page", "table")


def source_queries(c: Catalog) -> DataFrame:
    """model, table, partition, mode, sql of the partitions that hold SQL."""
    p = c.partitions.where("lower(coalesce(source_type, '')) <> 'calculated'")
    return p.select("model", "table", "partition", "mode", F.explode(F.array(X.sql_of("expression"))).alias("sql")).where("sql <> ''")


def lineage(c: Catalog) -> DataFrame:
    """model, table, source: the tables that each table's SQL reads."""
    # explode_outer, and the text as an array's only item: filters before explode would compute the fold, and the text, again
    return source_queries(c).select("model", "table", F.explode_outer(X.sql_sources("sql")).alias("source")).where("source IS NOT NULL").distinct()


def source_impact(c: Catalog) -> DataFrame:
    """model, source, tables, n: which tables a source feeds."""
    return lineage(c).groupBy("model", "source").agg(F.array_sort(F.collect_set("table")).alias("tables")).withColumn("n", F.size("tables"))


def usual_source_schema(c: Catalog) -> DataFrame:
    """model, catalog, schema: the most frequent qualification of sources; the smallest of ties."""
    parts = F.split("source", r"\.")
    n = F.size(parts)
    rows = lineage(c).select("model", F.when(n > 2, F.get(parts, n - 3)).alias("catalog"), F.when(n > 1, F.get(parts, n - 2)).alias("schema"))
    # both parts of a name are counted in one reading of the queries
    each = rows.select("model", F.explode(F.array(*(F.struct(F.lit(x).alias("part"), F.col(x).alias("name")) for x in ("catalog", "schema")))).alias("p"))
    counted = each.where("p.name IS NOT NULL").groupBy("model", "p.part", "p.name").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("model", "part").orderBy(F.desc("n"), "name"))
    best = counted.withColumn("place", place).where("place = 1")
    named = best.groupBy("model").agg(*(F.max(F.when(F.col("part") == x, F.col("name"))).alias(x) for x in ("catalog", "schema")))
    return c.tables.select("model").distinct().join(named, "model", "left").select("model", "catalog", "schema")


def cleanup_plan(c: Catalog) -> DataFrame:
    """model, kind (table or column), table, column: parameter tables that no report uses, and columns safe to delete in other tables."""
    tables = field_parameters(c).where("used = false").select("model", F.lit("table").alias("kind"), "table", F.lit(None).cast("string").alias("column"))
    columns = column_disposition(c).where("verdict = 'Safe to delete'").select("model", F.lit("column").alias("kind"), "table", "column")
    whole = F.max(F.col("kind") == "table").over(Window.partitionBy("model", "table"))
    return tables.unionByName(columns).withColumn("whole", whole).where("kind = 'table' OR NOT whole").select("model", "kind", "table", "column")


def reclaimed(c: Catalog) -> DataFrame:
    """model, bytes: what the columns of the clean-up plan, and of its tables, take."""
    columns = c.user_columns.select("model", F.lit("own").alias("kind"), "table", "column", "total_size")
    rows = columns.unionByName(cleanup_plan(c), allowMissingColumns=True)
    planned = lambda kind, *by: F.max(F.col("kind") == kind).over(Window.partitionBy("model", *by))
    rows = rows.withColumn("single", planned("column", "table", "column")).withColumn("whole", planned("table", "table"))
    gone = rows.where("kind = 'own' AND table IS NOT NULL AND (whole OR single)")
    return gone.groupBy("model").agg(F.sum(F.coalesce("total_size", F.lit(0))).alias("bytes"))


def cleaned(c: Catalog) -> Catalog:
    """The catalog without the planned tables and columns, and without relationships that touch them."""
    plan = cleanup_plan(c)
    tables = plan.where("kind = 'table'").select("model", "table")
    columns = plan.where("kind = 'column'").select("model", "table", "column")
    keep = lambda df: df.join(tables, ["model", "table"], "left_anti").select(*df.columns)
    rels = c.relationships
    for side in ("from", "to"):
        rels = rels.join(tables.withColumnRenamed("table", f"{side}_table"), ["model", f"{side}_table"], "left_anti")
        rels = rels.join(columns.toDF("model", f"{side}_table", f"{side}_column"), ["model", f"{side}_table", f"{side}_column"], "left_anti")
    return c.with_(tables=keep(c.tables), columns=keep(c.columns).join(columns, ["model", "table", "column"], "left_anti").select(*c.columns.columns), measures=keep(c.measures), partitions=keep(c.partitions), relationships=rels.select(*c.relationships.columns))
