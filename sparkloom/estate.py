"""An estate of semantic models, one for each customer, as portable SQL over the driver's tables.

The same texts give the relations to Spark (estate()) and, as common table expressions (PREFIX), to an
SQL engine that checks the analyses. Which tables, columns, measures, relationships, roles and report
bindings a model has follows from its customer's key; flaws are spread over the models on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .storage import parts_for


def values(name: str, columns: str, rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS {name}({columns})"


SELECTOR = "{(\"Sales\", NAMEOF('Sales'[Total Sales]), 0), (\"Quantity\", NAMEOF('Sales'[Total Quantity]), 1)}"
# An object with (every, rest) is in the models whose key leaves that rest.
TABLES = [
    ("Date", 1, 0, "Time", "dim", 1461, ""), ("Product", 1, 0, "", "dim", 5200, ""), ("Customer", 1, 0, "", "dim", 84_000, ""), ("Store", 2, 0, "", "dim", 300, ""), ("Country", 4, 1, "", "dim", 90, ""),
    ("Sales", 1, 0, "", "fact", 3_200_000, ""), ("Returns", 3, 0, "", "fact", 40_000, ""), ("Metrics", 4, 0, "", "none", 0, ""), ("Param", 5, 0, "", "calculated", 3, SELECTOR),
]
_KEY, _INT, _TEXT = ("Int64", "Data", True), ("Int64", "Data", False), ("String", "Data", False)
COLUMNS = [
    ("Date", "DateKey", *_KEY, 1, 0, ""), ("Date", "Date", "DateTime", "Data", False, 1, 0, ""), ("Date", "Year", *_INT, 1, 0, ""), ("Date", "Month", *_TEXT, 1, 0, ""),
    ("Product", "ProductKey", *_KEY, 1, 0, ""), ("Product", "Product Name", *_TEXT, 1, 0, ""), ("Product", "Category", *_TEXT, 1, 0, ""), ("Product", "Old Code", *_TEXT, 7, 0, ""),
    ("Customer", "CustomerKey", *_KEY, 1, 0, ""), ("Customer", "Name", *_TEXT, 1, 0, ""), ("Customer", "Region", *_TEXT, 1, 0, ""), ("Customer", "internal_notes", *_TEXT, 2, 1, ""), ("Customer", "CountryKey", *_INT, 4, 1, ""),
    ("Store", "StoreKey", "String", "Data", True, 1, 0, ""), ("Store", "City", *_TEXT, 1, 0, ""), ("Store", "Name", *_TEXT, 1, 0, ""),
    ("Country", "CountryKey", *_KEY, 1, 0, ""), ("Country", "Country", *_TEXT, 1, 0, ""),
    ("Sales", "DateKey", *_INT, 1, 0, ""), ("Sales", "ProductKey", *_INT, 1, 0, ""), ("Sales", "CustomerKey", *_INT, 1, 0, ""), ("Sales", "StoreKey", *_TEXT, 2, 0, ""), ("Sales", "Quantity", *_INT, 1, 0, ""), ("Sales", "UnitPrice", "Double", "Data", False, 1, 0, ""),
    ("Sales", "Line Total", "Double", "Calculated", False, 1, 0, "Sales[Quantity] * Sales[UnitPrice]"), ("Sales", "RowNumber-2662979B", "Int64", "RowNumber", False, 1, 0, ""),
    ("Returns", "DateKey", *_INT, 1, 0, ""), ("Returns", "ProductKey", *_INT, 1, 0, ""), ("Returns", "Amount", "Double", "Data", False, 1, 0, ""),
    ("Param", "Param", "String", "CalculatedTableColumn", False, 1, 0, ""), ("Param", "Fields", "String", "CalculatedTableColumn", False, 1, 0, ""), ("Param", "Ord", "Int64", "CalculatedTableColumn", False, 1, 0, ""),
]
MEASURES = [
    ("Sales", "Total Sales", 1, 0, "Double", "#,0", "Sales", "SUMX(Sales, Sales[Quantity] * Sales[UnitPrice])"), ("Sales", "Total Quantity", 1, 0, "Int64", "0", "Sales", "SUM(Sales[Quantity]) -- not [Growth]"),
    ("Sales", "Sales YTD", 1, 0, "Double", "#,0.00", "Time", "TOTALYTD([Total Sales], 'Date'[Date])"), ("Sales", "total_orders", 1, 0, "Int64", "0", "", "COUNTROWS(Sales)"),
    ("Sales", "Growth", 2, 1, "Double", "0.0%", "Time", 'DIVIDE([Sales YTD], [Total Quantity], "[Self]")'), ("Sales", "Copy", 10, 0, "Double", "", "", "SUMX( Sales , Sales[Quantity]*Sales[UnitPrice] )"),
    ("Sales", "Loop A", 8, 0, "Int64", "", "", "[Loop B] + 1"), ("Sales", "Loop B", 8, 0, "Int64", "", "", "[Loop C]"), ("Sales", "Loop C", 8, 0, "Int64", "", "", "SUM(Sales[Quantity]) + [Loop A]"), ("Sales", "Caller", 8, 0, "Int64", "", "", "[Loop A]"),
    ("Sales", "Self", 9, 0, "Int64", "", "", "[Self] * 2"), ("Returns", "Total Returns", 1, 0, "Double", "#,0", "", "SUM(Returns[Amount])"), ("Returns", "Total Quantity", 2, 0, "Double", "#,0", "", "SUM( Returns[Amount] )"),
    ("Metrics", "Region Sales", 1, 0, "Double", "#,0", "", 'CALCULATE([Total Sales], Customer[Region] = "West")'), ("Metrics", "Units", 1, 0, "Int64", "0", "", 'CALCULATE(DISTINCTCOUNT(Sales[ProductKey]), Customer[Region] = "West")'),
]
RELATIONSHIPS = [("r1", "Sales", "DateKey", "Date", "DateKey"), ("r2", "Sales", "ProductKey", "Product", "ProductKey"), ("r3", "Sales", "CustomerKey", "Customer", "CustomerKey"), ("r4", "Sales", "StoreKey", "Store", "StoreKey"), ("r5", "Returns", "DateKey", "Date", "DateKey"), ("r6", "Returns", "ProductKey", "Product", "ProductKey"), ("r7", "Customer", "CountryKey", "Country", "CountryKey")]
ROLES = [("Regional", "Customer", 'Customer[Region] = "West"', 1, 0), ("Rep", "Sales", "Sales[Quantity] > 0", 2, 0), ("Stores", "Store", 'Store[City] = "Rome"', 2, 0), ("Open", None, None, 10, 0)]
BINDINGS = [
    ("Overview", "v1", "bar", "Column", "Customer", "Region", 2, 0), ("Overview", "v1", "bar", "Measure", "Sales", "Total Sales", 2, 0), ("Overview", "v2", "card", "Measure", "Sales", "Revenue", 4, 0),
    ("Detail", "v3", "table", "Column", "Stores", "City", 6, 0), ("Detail", "v3", "table", "Column", "", "Category", 6, 0), ("Detail", "v4", "slicer", "Column", "Param", "Param", 20, 0), ("Detail", "v5", "card", "Measure", "Metrics", "Region Sales", 8, 0),
]

_IN = "mod(k, x.every) = x.rest"
#: Relation -> its SQL; each may name those before it.
SQL = {
    "base": "SELECT CAST(c_custkey AS BIGINT) AS k, concat('m', CAST(c_custkey AS STRING)) AS model FROM {customer}",
    "tabs": f"SELECT k, model, x.tbl, x.rows_of + k AS rows_count, CASE WHEN mod(k + length(x.tbl), 3) = 0 THEN '' ELSE concat('About ', x.tbl) END AS description, x.expression, x.category, mod(k * 7919 + length(x.tbl) * 104729, 5000000) AS size, x.source FROM base JOIN {values('x', 'tbl, every, rest, category, source, rows_of, expression', TABLES)} ON {_IN}",
    "cols": (
        "SELECT k, model, tbl, x.col, x.column_type, x.data_type, mod(k + length(x.col), 5) = 0 AS hidden, mod(k, 3) <> 0 AS in_mdx, CASE WHEN mod(k + length(x.col), 4) = 0 THEN NULL ELSE 'x' END AS description, '' AS folder, "
        "CASE WHEN mod(k + length(x.col), 11) = 0 OR x.data_type = 'String' THEN 'HASH' ELSE 'VALUE' END AS encoding, mod(k * 61357 + length(x.col) * 77171 + length(tbl) * 31, 3000000) AS total_size, mod(k * 13159 + length(x.col) * 99713, 1000000) AS dictionary_size, "
        f"CASE WHEN mod(k, 5) = 3 THEN NULL ELSE mod(k * 9973 + length(x.col) * 70001, 2000000) END AS cardinality, x.expression, tbl = 'Param' AND x.col = 'Fields' AS marker, x.is_key FROM (SELECT k, model, tbl FROM tabs) t JOIN {values('x', 'owner, col, data_type, column_type, is_key, every, rest, expression', COLUMNS)} ON tbl = x.owner AND {_IN}"
    ),
    "meas": f"SELECT k, model, tbl, x.mea, x.expression, x.data_type, x.format, CASE WHEN mod(k + length(x.mea), 3) = 1 THEN ' ' ELSE 'x' END AS description, x.folder FROM (SELECT k, model, tbl FROM tabs) t JOIN {values('x', 'owner, mea, every, rest, data_type, format, folder, expression', MEASURES)} ON tbl = x.owner AND {_IN}",
    "rels": (
        "SELECT f.k, f.model, x.name, x.from_table, x.from_column, x.to_table, x.to_column, 'Many' AS from_cardinality, CASE WHEN x.name = 'r6' AND mod(f.k, 9) = 0 THEN 'Many' ELSE 'One' END AS to_cardinality, "
        "CASE WHEN x.name = 'r3' AND mod(f.k, 3) = 1 OR x.name = 'r5' AND mod(f.k, 4) = 0 THEN 'Both' ELSE 'Single' END AS direction, NOT (x.name = 'r4' AND mod(f.k, 6) = 2) AS active "
        f"FROM cols f JOIN {values('x', 'name, from_table, from_column, to_table, to_column', RELATIONSHIPS)} ON f.tbl = x.from_table AND f.col = x.from_column JOIN cols t ON t.model = f.model AND t.tbl = x.to_table AND t.col = x.to_column"
    ),
    "rols": f"SELECT k, model, x.role, x.tbl, x.filter FROM base JOIN {values('x', 'role, tbl, filter, every, rest', ROLES)} ON {_IN}",
    "parts": (
        "SELECT k, model, tbl, tbl AS part, 'import' AS mode, CASE WHEN source = 'calculated' THEN 'calculated' ELSE 'm' END AS source_type, CASE WHEN source = 'calculated' THEN expression ELSE "
        "concat('let q = \"SELECT * FROM ', CASE mod(k, 3) WHEN 0 THEN '' WHEN 1 THEN 'dbo.' ELSE 'lake.sales.' END, source, '_', lower(tbl), '\" in q') END AS expression FROM tabs WHERE source <> 'none'"
    ),
    "segs": "SELECT k, model, tbl, col, CASE WHEN mod(k + length(col), 3) = 0 THEN 'NOSPLIT' ELSE 'RLE' END AS compression, CAST(mod(k + length(col) * 3, 30) AS INT) AS bits FROM cols",
    "binds": f"SELECT k, model, x.page, x.visual, x.visual_type, x.kind, x.tbl, x.field FROM base JOIN {values('x', 'page, visual, visual_type, kind, tbl, field, every, rest', BINDINGS)} ON {_IN}",
}
#: What the measures' and calculated columns' expressions refer to: table, object, named table, name.
REFERENCES = [
    ("Sales", "Total Sales", "Sales", "Quantity"), ("Sales", "Total Sales", "Sales", "UnitPrice"), ("Sales", "Total Quantity", "Sales", "Quantity"), ("Sales", "Sales YTD", None, "Total Sales"), ("Sales", "Sales YTD", "Date", "Date"),
    ("Sales", "Growth", None, "Sales YTD"), ("Sales", "Growth", None, "Total Quantity"), ("Sales", "Copy", "Sales", "Quantity"), ("Sales", "Copy", "Sales", "UnitPrice"), ("Sales", "Loop A", None, "Loop B"), ("Sales", "Loop B", None, "Loop C"),
    ("Sales", "Loop C", "Sales", "Quantity"), ("Sales", "Loop C", None, "Loop A"), ("Sales", "Caller", None, "Loop A"), ("Sales", "Self", None, "Self"), ("Returns", "Total Returns", "Returns", "Amount"), ("Returns", "Total Quantity", "Returns", "Amount"),
    ("Metrics", "Region Sales", None, "Total Sales"), ("Metrics", "Region Sales", "Customer", "Region"), ("Metrics", "Units", "Sales", "ProductKey"), ("Metrics", "Units", "Customer", "Region"), ("Sales", "Line Total", "Sales", "Quantity"), ("Sales", "Line Total", "Sales", "UnitPrice"),
]
#: For checking: what the relations imply, named by the analyses' SQL.
DERIVED = {
    "objs": "SELECT model, 'measure' AS kind, tbl AS home, mea AS obj FROM meas UNION ALL SELECT model, 'calculated column', tbl, col FROM cols WHERE column_type IN ('Calculated', 'CalculatedTableColumn')",
    "refs": f"SELECT o.model, o.kind, o.home, o.obj, x.named, x.name FROM objs o JOIN {values('x', 'owner, obj, named, name', REFERENCES)} ON o.home = x.owner AND o.obj = x.obj",
    "own": "SELECT * FROM cols WHERE column_type <> 'RowNumber'",
    "keys": "SELECT DISTINCT model, from_table AS tbl, from_column AS col FROM rels UNION SELECT model, to_table, to_column FROM rels",
    "edges": "SELECT DISTINCT r.model, r.obj AS mea, r.name AS uses FROM refs r JOIN meas m ON m.model = r.model AND m.mea = r.name WHERE r.kind = 'measure'",
    "reach": "SELECT model, mea AS a, uses AS b FROM edges UNION SELECT r.model, r.a, e.uses FROM reach r JOIN edges e ON e.model = r.model AND e.mea = r.b",
    "used": "SELECT DISTINCT r.model, o.tbl, o.col FROM refs r JOIN (SELECT model, col, min(tbl) AS tbl FROM own GROUP BY model, col HAVING count(*) = 1) o ON o.model = r.model AND o.col = r.name WHERE NOT EXISTS (SELECT 1 FROM meas m WHERE m.model = r.model AND m.mea = r.name) UNION SELECT model, tbl, col FROM keys",
    "links": "SELECT DISTINCT model, from_table AS a, to_table AS b FROM rels UNION SELECT model, to_table, from_table FROM rels",
    "degree": "SELECT model, from_table AS tbl, count(*) AS n FROM rels GROUP BY model, from_table",
    "facts": "SELECT model, tbl FROM degree WHERE n >= 2",
    "flows": "SELECT model, to_table AS a, from_table AS b FROM rels WHERE active UNION SELECT model, from_table, to_table FROM rels WHERE active AND direction = 'Both'",
    "secured": "SELECT DISTINCT model, role, tbl AS secured FROM rols WHERE tbl IS NOT NULL",
    "flooded": "SELECT model, role, secured, secured AS tbl FROM secured UNION SELECT f.model, f.role, f.secured, e.b FROM flooded f JOIN flows e ON e.model = f.model AND e.a = f.tbl",
}
PREFIX = "WITH RECURSIVE " + ", ".join(f"{n} AS ({sql})" for n, sql in (SQL | DERIVED).items()).replace("{customer}", "customer") + " "
_RENAMED = {"tbl": "table", "col": "column", "mea": "measure", "part": "partition"}
_RELATIONS = {"tables": "tabs", "columns": "cols", "measures": "meas", "relationships": "rels", "partitions": "parts", "roles": "rols", "segments": "segs", "bindings": "binds"}


#: Models of one partition of the estate: their rows are what a task holds of a relation.
MODELS_A_PART = 4000


def relation(spark: SparkSession, sf_dir: str, name: str, parts: int) -> DataFrame:
    before = list(SQL)[: list(SQL).index(name) + 1]
    texts = {n: SQL[n] for n in before} | {"base": f"SELECT /*+ REPARTITION({parts}, model) */ * FROM ({SQL['base']})"}
    text = "WITH " + ", ".join(f"{n} AS ({texts[n]})" for n in before) + f" SELECT * FROM {name}"
    df = spark.sql(text.replace("{customer}", f"parquet.`{sf_dir}/customer.parquet`"))
    return df.withColumnsRenamed({k: v for k, v in _RENAMED.items() if k in df.columns}).drop("k", "source")


def estate(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of all models, every relation dealt out by model alike, into as many parts as the number of models asks for.

    A file of customers may be a single part, whose rows make some thirty times as many; and as all relations are dealt
    alike, what joins or groups by model needs no other shuffle.
    """
    parts = parts_for(spark, spark.read.parquet(f"{sf_dir}/customer.parquet").count(), MODELS_A_PART)  # from the file's footers
    return Catalog.empty(spark, **{n: relation(spark, sf_dir, sql, parts) for n, sql in _RELATIONS.items()})


def archive_parts(c: Catalog) -> DataFrame:
    """model, part, text, problem: the models as archives hold them, in JSON."""

    def listed(df: DataFrame, name: str, *columns) -> DataFrame:
        return df.groupBy("model").agg(F.collect_list(F.struct(*columns)).alias(name))

    as_ = lambda old, new: F.col(old).alias(new)
    tables = c.tables.select("model", "table", "category").join(c.columns.groupBy("model", "table").agg(F.collect_list(F.struct(as_("column", "name"), as_("data_type", "dataType"), as_("is_key", "isKey"))).alias("columns")), ["model", "table"], "left")
    tables = listed(tables, "tables", as_("table", "name"), as_("category", "dataCategory"), F.col("columns"))
    both = F.when(F.col("direction") == "Both", "bothDirections").otherwise("oneDirection")
    rels = listed(c.relationships, "relationships", F.col("name"), as_("from_table", "fromTable"), as_("from_column", "fromColumn"), as_("to_table", "toTable"), as_("to_column", "toColumn"), both.alias("crossFilteringBehavior"), as_("active", "isActive"))
    bim = tables.join(rels, "model", "left").select("model", F.lit("Model.bim").alias("part"), F.to_json(F.struct(F.struct("tables", "relationships").alias("model"))).alias("text"))
    counted = listed(c.tables, "Tables", as_("table", "TableName"), as_("rows_count", "RowsCount"), as_("description", "Description"))
    columns = listed(c.columns, "Columns", as_("table", "TableName"), as_("column", "ColumnName"), as_("column_type", "ColumnType"), as_("data_type", "DataType"))
    measures = listed(c.measures, "Measures", as_("table", "TableName"), as_("measure", "MeasureName"), as_("expression", "MeasureExpression"))
    view = counted.join(columns, "model", "left").join(measures, "model", "left").select("model", F.lit("DaxVpaView.json").alias("part"), F.to_json(F.struct("Tables", "Columns", "Measures")).alias("text"))
    named = c.tables.select("model").distinct().select("model", F.lit("DaxModel.json").alias("part"), F.to_json(F.struct(as_("model", "ModelName"))).alias("text"))
    return bim.union(view).union(named).withColumn("problem", F.lit(None).cast("string"))
