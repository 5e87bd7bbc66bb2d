"""What expressions refer to: dependencies between measures, used and unused columns, impact of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import expressions as X
from .components import components


def expression_references(c: Catalog) -> DataFrame:
    """model, kind, home, object, table (null where unqualified), name: one row per reference of a measure or calculated column."""
    measures = c.measures.select("model", F.lit("measure").alias("kind"), F.col("table").alias("home"), F.col("measure").alias("object"), "expression")
    columns = c.calculated_columns.select("model", F.lit("calculated column").alias("kind"), F.col("table").alias("home"), F.col("column").alias("object"), "expression")
    # explode_outer, as before explode Spark tests the array in a filter and so computes it again for each test
    each = measures.union(columns).select("model", "kind", "home", "object", F.explode_outer(X.references("expression")).alias("r")).where("r IS NOT NULL")
    return each.select("model", "kind", "home", "object", "r.table", "r.name")


def measure_edges(c: Catalog) -> DataFrame:
    """model, measure, uses: calls between measures, a measure's calls of itself included."""
    names = c.measures.select("model", F.col("measure").alias("name")).distinct()
    calls = expression_references(c).where("kind = 'measure'")
    return calls.join(names, ["model", "name"], "left_semi").select("model", F.col("object").alias("measure"), F.col("name").alias("uses")).distinct()


def measure_dependencies(c: Catalog) -> DataFrame:
    """model, measure, depends_on, used_by: sorted lists of direct neighbours, for every measure."""
    edges = measure_edges(c).where("measure <> uses")
    down = edges.groupBy("model", "measure").agg(F.array_sort(F.collect_set("uses")).alias("depends_on"))
    up = edges.groupBy("model", F.col("uses").alias("measure")).agg(F.array_sort(F.collect_set("measure")).alias("used_by"))
    every = c.measures.select("model", "measure").distinct().join(down, ["model", "measure"], "left").join(up, ["model", "measure"], "left")
    none = F.array().cast("array<string>")
    return every.select("model", "measure", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("used_by", none).alias("used_by"))


def measure_cycles(c: Catalog) -> DataFrame:
    """model, measures: the sets of measures that call each other in a circle, those that call themselves included."""
    own = components(measure_edges(c).toDF("model", "a", "b"))
    return own.groupBy("model", "component").agg(F.array_sort(F.collect_set("v")).alias("measures")).select("model", "measures")


def referenced_columns(c: Catalog, qualified: bool = False) -> DataFrame:
    """model, table, column that an expression or a relationship uses.

    An unqualified name counts where one table owns it; qualified=True also lets 'T'[c] name its table.
    A name that is a measure's never counts.
    """
    measures = c.measures.select("model", F.col("measure").alias("name")).distinct()
    used = expression_references(c).select("model", "table", "name").join(measures, ["model", "name"], "left_anti").distinct()
    owners = c.user_columns.select("model", F.col("column").alias("name"), "table").distinct()
    only = owners.groupBy("model", "name").agg(F.count(F.lit(1)).alias("n"), F.first("table").alias("owner")).where("n = 1")
    found = used.join(only, ["model", "name"]).select("model", F.col("owner").alias("table"), F.col("name").alias("column"))
    if qualified:
        found = found.union(used.where("table IS NOT NULL").join(owners, ["model", "name", "table"]).select("model", "table", F.col("name").alias("column")))
    return found.union(c.key_columns).distinct()


def column_uses(c: Catalog, qualified: bool = False) -> DataFrame:
    """model, table, column, status for every column, and what reports make of it: shown (its name is bound), report (null without any), pages.

    What names a column, or may be taken for one, is grouped once by name and table; the tables of a name and the names of
    a model then follow each other in one order, so no question takes a join of its own.
    """
    none, one = F.lit(None).cast("string"), F.lit(1)

    def rows(df: DataFrame, kind: str, table, column, page=none) -> DataFrame:
        return df.select("model", table.alias("table"), column.alias("column"), F.lit(kind).alias("kind"), page.alias("page"))

    r = c.relationships
    ends = r.select("model", F.explode(F.array(*(F.struct(F.col(f"{e}_table").alias("table"), F.col(f"{e}_column").alias("column")) for e in ("from", "to")))).alias("end"))
    every = rows(c.user_columns, "own", F.col("table"), F.col("column")).union(rows(ends.where("end.table <> '' AND end.column <> ''"), "key", F.col("end.table"), F.col("end.column")))
    every = every.union(rows(expression_references(c), "named", F.col("table") if qualified else none, F.col("name"))).union(rows(c.measures, "measure", none, F.col("measure")))
    every = every.union(rows(c.bindings, "bound", F.col("table"), F.col("field"), F.col("page")))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("own", "key", "named", "measure", "bound")]
    each = every.groupBy("model", "column", "table").agg(*counts, F.array_sort(F.collect_set("page")).alias("pages"))
    own, named = F.col("own") > 0, F.col("named") > 0
    of_name, of_model = Window.partitionBy("model", "column"), Window.partitionBy("model")
    any_of = lambda test: F.max(test).over(of_name)
    each = each.withColumns({
        "owners": F.count(F.when(own, one)).over(of_name), "known_owners": F.count(F.when(own & F.col("table").isNotNull(), one)).over(of_name), "called": any_of(named) & ~any_of(F.col("measure") > 0),
        "is_key": any_of(F.col("key") > 0), "matched": any_of(own & named & F.col("table").isNotNull()), "shown": any_of(F.col("bound") > 0),
    })
    each = each.withColumn("report", F.max(F.when(F.col("bound") > 0, True)).over(of_model))
    alone = F.col("called") & (F.col("owners") == 1)
    used = (F.col("key") > 0) | alone | F.lit(qualified) & F.col("called") & named
    somewhere = F.col("is_key") | alone | F.lit(qualified) & F.col("called") & F.col("matched")
    status = F.when(used, "Referenced").when((F.col("known_owners") > 1) & somewhere, "Referenced somewhere (table ambiguous)").otherwise("Likely unused")
    each = each.where(own & F.col("table").isNotNull() & F.col("column").isNotNull()).withColumn("again", F.explode(F.array_repeat(one, F.col("own").cast("int"))))  # as often as the catalog has it
    return each.select("model", "table", "column", status.alias("status"), "shown", "report", F.when(F.col("bound") > 0, F.col("pages")).alias("pages"))


def unused_columns(c: Catalog, qualified: bool = False) -> DataFrame:
    """model, table, column, status, severity for every column."""
    rows = column_uses(c.with_(bindings=c.bindings.where("false")), qualified)
    return rows.select("model", "table", "column", "status", F.when(F.col("status") == "Likely unused", "Low").otherwise("Info").alias("severity"))


def impact_of_table(c: Catalog, table: str) -> DataFrame:
    """model, kind, object: measures, calculated columns, relationships and neighbours that a table's change reaches."""
    touches = lambda e: F.array_contains(X.tables(e), table)
    measures = c.measures.where(touches("expression")).select("model", F.lit("measure").alias("kind"), F.col("measure").alias("object"))
    columns = c.calculated_columns.where(touches("expression")).select("model", F.lit("calculated column"), F.concat("table", F.lit("["), "column", F.lit("]")))
    near = c.relationships.where((F.col("from_table") == table) | (F.col("to_table") == table))
    rels = near.select("model", F.lit("relationship"), F.concat_ws(" ", F.concat("from_table", F.lit("["), "from_column", F.lit("]")), F.lit("to"), F.concat("to_table", F.lit("["), "to_column", F.lit("]"))))
    neighbours = near.select("model", F.lit("related table"), F.when(F.col("from_table") == table, F.col("to_table")).otherwise(F.col("from_table"))).distinct()
    return measures.union(columns).union(rels).union(neighbours)


def impact_of_column(c: Catalog, table: str, column: str) -> DataFrame:
    """As impact_of_table, for references that name table and column."""
    hits = expression_references(c).where((F.col("table") == table) & (F.col("name") == column)).select("model", "kind", F.when(F.col("kind") == "measure", F.col("object")).otherwise(F.concat("home", F.lit("["), "object", F.lit("]"))).alias("object"))
    ends = c.relationships.where((F.col("from_table") == table) & (F.col("from_column") == column) | (F.col("to_table") == table) & (F.col("to_column") == column))
    return hits.distinct().union(ends.select("model", F.lit("relationship"), F.concat_ws(" ", F.concat("from_table", F.lit("["), "from_column", F.lit("]")), F.lit("to"), F.concat("to_table", F.lit("["), "to_column", F.lit("]")))))


def tables_of_measures(c: Catalog) -> DataFrame:
    """model, measure, table: the model's tables that each measure's expression names."""
    named = c.measures.select("model", "measure", F.explode(X.tables("expression")).alias("table"))
    return named.join(c.tables.select("model", "table").distinct(), ["model", "table"], "left_semi").select("model", "measure", "table").distinct()


def measure_homes(c: Catalog) -> DataFrame:
    """model, table, measure, home: of a measure in a table without columns of its own, the first real table that it names; else its table."""
    real = c.user_columns.select("model", "table").distinct()
    named = c.measures.select("model", "table", "measure", F.explode(X.tables("expression")).alias("named"))
    first = named.join(real.withColumnRenamed("table", "named"), ["model", "named"], "left_semi").groupBy("model", "table", "measure").agg(F.min("named").alias("named"))
    rows = c.measures.select("model", "table", "measure").distinct().join(real.withColumn("real", F.lit(True)), ["model", "table"], "left").join(first, ["model", "table", "measure"], "left")
    return rows.select("model", "table", "measure", F.when(F.col("real"), F.col("table")).otherwise(F.coalesce("named", "table")).alias("home"))


def search(c: Catalog, text: str) -> DataFrame:
    """model, kind, object, where: names and expressions that hold a text, whatever its case."""
    has = lambda x: F.coalesce(F.contains(F.lower(x), F.lit(text.lower())), F.lit(False))
    tables = c.tables.where(has("table")).select("model", F.lit("table").alias("kind"), F.col("table").alias("object"), F.lit("name").alias("where"))
    columns = c.user_columns.where(has("column")).select("model", F.lit("column"), F.concat("table", F.lit("["), "column", F.lit("]")), F.lit("name"))
    measures = c.measures.where(has("measure") | has("expression")).select("model", F.lit("measure"), "measure", F.when(has("measure"), "name").otherwise("expression"))
    return tables.union(columns).union(measures)


def screens(c: Catalog) -> DataFrame:
    """model, screen, order, measures: tables of measures alone, or if there are none all tables with measures; by the number that starts their name."""
    counts = c.measures.groupBy("model", "table").agg(F.count(F.lit(1)).alias("measures"))
    real = c.user_columns.select("model", "table").distinct().withColumn("real", F.lit(True))
    rows = counts.join(real, ["model", "table"], "left").withColumn("group", F.col("real").isNull())
    rows = rows.withColumn("any_group", F.max("group").over(Window.partitionBy("model"))).where("group OR NOT any_group")
    return rows.select("model", F.col("table").alias("screen"), F.expr("try_cast(nullif(regexp_extract(table, '^\\\\s*(\\\\d+)', 1), '') AS int)").alias("order"), "measures")


def page_organised(c: Catalog) -> DataFrame:
    """model, organised: whether two tables of measures alone, or more, hold at least four fifths of its measures."""
    real = c.user_columns.select("model", "table").distinct().withColumn("real", F.lit(True))
    counts = c.measures.groupBy("model", "table").agg(F.count(F.lit(1)).alias("n")).join(real, ["model", "table"], "left")
    alone = F.col("real").isNull()
    per_model = counts.groupBy("model").agg(F.count_if(alone).alias("groups"), F.sum(F.when(alone, F.col("n"))).alias("inside"), F.sum("n").alias("every"))
    return c.tables.select("model").distinct().join(per_model, "model", "left").select("model", F.coalesce((F.col("groups") >= 2) & (F.col("inside") >= 0.8 * F.col("every")), F.lit(False)).alias("organised"))


def role_tables(c: Catalog) -> DataFrame:
    """model, role, table (with the filter), named: the tables that each role's filters name."""
    return c.roles.select("model", "role", "table", F.explode(X.tables("filter")).alias("named")).distinct()
