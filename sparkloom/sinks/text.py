"""Exports as rows of (model, path, content): Spark builds every file's text and writes it in parallel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog
from ..formulas.measures import to_sql
from ..functions import names as N
from ..operators.references import measure_homes
from ..operators.reports import cleanup_plan
from ..storage import ship

#: Catalog data types (lower case) -> those of model files. Fixed values.
FILE_TYPES = {"int64": "int64", "double": "double", "string": "string", "datetime": "dateTime", "date": "dateTime", "boolean": "boolean", "decimal": "decimal", "currency": "decimal"}


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text and nulls as empty text, for CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.coalesce((F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")), F.lit("")).alias(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.option("header", True).option("escape", '"').csv(path)


def data_dictionary(c: Catalog) -> dict[str, DataFrame]:
    """The sheets of a data dictionary, one DataFrame each."""
    formulas = c.measures.select("model", F.lit("Measure").alias("type"), "table", F.col("measure").alias("name"), "expression").union(c.calculated_columns.select("model", F.lit("Calculated column"), "table", "column", "expression"))
    return {"tables": c.tables, "columns": c.user_columns, "formulas": formulas, "relationships": c.relationships, "roles": c.roles, "perspectives": c.perspectives, "sources": c.partitions}


def quoted(name: Column | str) -> Column:
    """A name in model files: in quotes unless it is an identifier."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.rlike(r"^[A-Za-z_]\w*$"), name).otherwise(F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'")))


def lines(df: DataFrame, *by: str, line: Column, order: Column) -> DataFrame:
    """by, content: each group's lines in order, as one text."""
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))


def table_files(c: Catalog) -> DataFrame:
    """model, path, content: a definition file for each table, with its columns and measures."""
    kind = F.create_map(*(F.lit(x) for pair in FILE_TYPES.items() for x in pair))[F.lower("data_type")]
    head = c.tables.select("model", "table", F.lit(0).alias("part"), F.lit("").alias("name"), F.concat(F.lit("table "), quoted("table")).alias("line"))
    columns = c.user_columns.select("model", "table", F.lit(2), F.col("column"), F.concat(F.lit("\n\tcolumn "), quoted("column"), F.lit("\n\t\tdataType: "), F.coalesce(kind, F.lit("string")), F.lit("\n\t\tsourceColumn: "), F.col("column")))
    measures = c.measures.select("model", "table", F.lit(1), F.col("measure"), F.concat(F.lit("\n\tmeasure "), quoted("measure"), F.lit(" = "), F.col("expression")))
    rows = head.union(columns).union(measures)
    out = lines(rows, "model", "table", line=F.col("line"), order=F.struct("part", "name"))
    return out.select("model", F.concat(F.lit("definition/tables/"), F.regexp_replace("table", r'[\\/:*?"<>|]', "_"), F.lit(".tmdl")).alias("path"), "content")


def role_files(roles: DataFrame) -> DataFrame:
    """model, path, content from model, role, table, column, allowed (values): one file for each role."""
    values = F.array_join(F.transform("allowed", lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))), ", ")
    rows = roles.select("model", "role", "table", F.concat(F.lit("\ttablePermission "), quoted("table"), F.lit(" = "), F.lit("'"), F.col("table"), F.lit("'["), F.col("column"), F.lit("] IN {"), values, F.lit("}")).alias("line"))
    head = rows.select("model", "role", F.lit("").alias("table"), F.concat(F.lit("role "), quoted("role"), F.lit("\n\tmodelPermission: read\n")).alias("line")).distinct()
    out = lines(head.union(rows), "model", "role", line=F.col("line"), order=F.col("table"))
    return out.select("model", F.concat(F.lit("definition/roles/"), N.slug("role"), F.lit(".tmdl")).alias("path"), "content")


def cleanup_script(c: Catalog) -> DataFrame:
    """model, path, content: a script that deletes what the clean-up plan names, columns first."""
    show = lambda x: F.concat(F.lit('"'), F.replace(F.replace(F.col(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.when(F.col("kind") == "column", F.concat(F.lit("Model.Tables["), show("table"), F.lit("].Columns["), show("column"), F.lit("].Delete();"))).otherwise(F.concat(F.lit("Model.Tables["), show("table"), F.lit("].Delete();")))
    out = lines(cleanup_plan(c), "model", line=line, order=F.struct("kind", "table", "column"))
    return out.select("model", F.lit("cleanup.csx").alias("path"), "content")


def cleanup_notes(c: Catalog) -> DataFrame:
    """model, path, content: the clean-up plan as comments of model files, tables first, then columns by table."""
    path = F.concat(F.lit("definition/tables/"), F.col("table"), F.lit(".tmdl"))
    line = F.when(F.col("kind") == "table", F.concat(F.lit("// delete "), path)).otherwise(F.concat(F.lit("// in "), path, F.lit(": delete column "), quoted("column")))
    out = lines(cleanup_plan(c), "model", line=line, order=F.struct(F.col("kind") == "column", "table", "column"))
    return out.select("model", F.lit("cleanup.tmdl").alias("path"), "content")


def diagram(c: Catalog) -> DataFrame:
    """model, path, content: the relationships as a DOT graph; two-way filters have two heads, inactive ones are dashed."""
    name = lambda x: F.concat(F.lit('"'), F.replace(F.col(x), F.lit('"'), F.lit('\\"')), F.lit('"'))
    edge = F.concat(F.lit("  "), name("to_table"), F.lit(" -> "), name("from_table"), F.lit(" [label=\""), F.left("to_cardinality", F.lit(1)), F.lit(":"), F.left("from_cardinality", F.lit(1)), F.lit('"'), F.when(F.col("direction") == "Both", ", dir=both").otherwise(""), F.when(~F.col("active"), ", style=dashed").otherwise(""), F.lit("];"))
    out = lines(c.relationships, "model", line=edge, order=F.struct("from_table", "to_table", "name"))
    return out.select("model", F.lit("model.dot").alias("path"), F.concat(F.lit("digraph model {\n"), "content", F.lit("\n}")).alias("content"))


def datasets(c: Catalog, catalog: str, schema: str) -> DataFrame:
    """model, id, name, source, columns, measures: a dashboard's data set for each table.

    The measures' text is compiled in batches on the executors, one small formula at a time.
    """
    @F.pandas_udf(T.StructType([T.StructField("sql", T.StringType()), T.StructField("reason", T.StringType())]))
    def compiled(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([to_sql(t or "") for t in text], columns=["sql", "reason"])

    ship(c.measures.sparkSession)
    own = c.measures.join(measure_homes(c), ["model", "table", "measure"]).withColumn("m", compiled("expression"))
    measures = own.groupBy("model", F.col("home").alias("table")).agg(F.array_sort(F.collect_list(F.when(F.col("m.sql").isNotNull(), F.struct(F.col("measure").alias("name"), F.col("m.sql").alias("expression"))))).alias("measures"), F.array_sort(F.collect_list(F.when(F.col("m.sql").isNull(), F.struct("measure", F.col("m.reason").alias("reason"))))).alias("refused"))
    columns = c.user_columns.groupBy("model", "table").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    source = F.concat_ws(".", F.lit(catalog), F.lit(schema), N.slug("table"))
    rows = columns.join(measures, ["model", "table"], "left")
    count = F.array(F.struct(F.lit("count").alias("name"), F.lit("COUNT(*)").alias("expression")))
    return rows.select("model", N.stable_id(F.col("model"), F.col("table")).alias("id"), F.col("table").alias("name"), source.alias("source"), "columns", F.concat(count, F.coalesce("measures", F.array().cast("array<struct<name:string,expression:string>>"))).alias("measures"), "refused")


def dashboard_json(c: Catalog, catalog: str, schema: str) -> DataFrame:
    """model, path, content: data sets and joins of a dashboard, as JSON."""
    sets = datasets(c, catalog, schema).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("id", "name", "source", "columns", "measures"))).alias("datasets"))
    on = F.concat(F.lit("`"), "from_table", F.lit("`.`"), "from_column", F.lit("` = `"), "to_table", F.lit("`.`"), "to_column", F.lit("`"))
    kind = F.when((F.col("from_cardinality") == "Many") & (F.col("to_cardinality") == "One"), "MANY_TO_ONE").when((F.col("from_cardinality") == "One") & (F.col("to_cardinality") == "Many"), "ONE_TO_MANY").otherwise("ONE_TO_ONE")
    joins = c.relationships.groupBy("model").agg(F.array_sort(F.collect_list(F.struct(on.alias("on"), kind.alias("cardinality")))).alias("joins"))
    rows = sets.join(joins, "model", "left")
    return rows.select("model", F.lit("dashboard.json").alias("path"), F.to_json(F.struct("datasets", "joins")).alias("content"))
