"""A small retail model with deliberate flaws, as archive parts: a fixture of the tests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from sparkloom.catalog import Catalog
from sparkloom.sources.archives import from_parts

# Names, row counts, expressions and flaws of the model that results are compared with.
MODEL = "Sample Retail Model"
#: table -> (rows, {column: type}); the first column of a dimension is its key.
TABLES = {
    "Date": (1461, {"DateKey": "int64", "Date": "dateTime", "Year": "int64", "Month": "string"}),
    "Product": (5200, {"ProductKey": "int64", "Product Name": "string", "Category": "string"}),
    "Customer": (84000, {"CustomerKey": "int64", "Customer Name": "string", "Region": "string", "internal_notes": "string"}),
    "Sales": (3_200_000, {"DateKey": "int64", "ProductKey": "int64", "CustomerKey": "int64", "Quantity": "int64", "Unit Price": "double"}),
    "Metric Selector": (100, {"Metric Selector": "string", "Metric Fields": "string", "Metric Order": "int64"}),
}
#: measure -> (expression, folder), all in Sales.
MEASURES = {
    "Total Sales": ("SUMX(Sales, Sales[Quantity] * Sales[Unit Price])", "Sales"),
    "Total Quantity": ("SUM(Sales[Quantity])", "Sales"),
    "Sales YTD": ("TOTALYTD([Total Sales], 'Date'[Date])", "Time Intelligence"),
    "total_orders": ("COUNTROWS(Sales)", ""),
}
SELECTOR = "{\n  (\"Sales\", NAMEOF('Sales'[Total Sales]), 0),\n  (\"Quantity\", NAMEOF('Sales'[Total Quantity]), 1)\n}"
ROLES = {"Regional Manager": ("Customer", 'Customer[Region] = "West"'), "Sales Rep (misconfigured)": ("Sales", "Sales[Quantity] > 0")}


def archive_texts() -> dict[str, str]:
    """The JSON members of the model's archive."""
    tables = []
    for name, (_, columns) in TABLES.items():
        source = {"type": "calculated", "expression": SELECTOR} if name == "Metric Selector" else {"type": "m", "expression": f'let\n  q = "SELECT * FROM {"fact" if name == "Sales" else "dim"}_{name.lower()}"\nin\n  q'}
        own = []
        for i, (column, kind) in enumerate(columns.items()):
            c = {"name": column, "dataType": kind}
            if i == 0 and name in ("Date", "Product", "Customer"):
                c["isKey"] = True
            if name == "Metric Selector":
                c["type"] = "calculatedTableColumn"
            if column == "Metric Fields":
                c["extendedProperties"] = [{"type": "json", "name": "ParameterMetadata", "value": {"version": 3}}]
            own.append(c)
        table = {"name": name, "columns": own, "measures": [{"name": m, "expression": e} for m, (e, _) in MEASURES.items()] if name == "Sales" else [], "partitions": [{"name": name, "mode": "import", "source": source}]}
        if name == "Date":
            table["dataCategory"] = "Time"
        tables.append(table)
    relationships = [
        {"name": f"r{i}", "fromTable": "Sales", "fromColumn": f"{t}Key", "toTable": t, "toColumn": f"{t}Key", "crossFilteringBehavior": "both" if t == "Customer" else "singleDirection", "isActive": True, "fromCardinality": "many", "toCardinality": "one"}
        for i, t in enumerate(("Date", "Product", "Customer"), 1)
    ]
    roles = [{"name": r, "tablePermissions": [{"name": t, "filterExpression": e}]} for r, (t, e) in ROLES.items()]
    stats = {
        "Tables": [{"TableName": t, "RowsCount": n, "Description": "", "TableExpression": SELECTOR if t == "Metric Selector" else ""} for t, (n, _) in TABLES.items()],
        "Columns": [
            {"TableName": t, "ColumnName": c, "ColumnType": "Data", "DataType": kind.capitalize(), "IsHidden": False, "DisplayFolder": "", "Description": "", "IsAvailableInMDX": True, "IsRowNumber": False, "Encoding": "VALUE" if kind == "int64" else "HASH"}
            for t, (_, columns) in TABLES.items()
            for c, kind in columns.items()
        ],
        "Measures": [{"TableName": "Sales", "MeasureName": m, "MeasureExpression": e, "FormatString": "", "Description": "", "DisplayFolder": f} for m, (e, f) in MEASURES.items()],
        "Relationships": [],
    }
    return {"Model.bim": json.dumps({"model": {"tables": tables, "relationships": relationships, "roles": roles}}), "DaxVpaView.json": json.dumps(stats), "DaxModel.json": json.dumps({"ModelName": MODEL})}


def archive_parts(spark: SparkSession) -> DataFrame:
    """model, part, text, problem, as the archive reader gives them."""
    return spark.createDataFrame([(MODEL, p, t, None) for p, t in archive_texts().items()], "model string, part string, text string, problem string")


def sample(spark: SparkSession) -> Catalog:
    return from_parts(archive_parts(spark))[0]


def with_report(spark: SparkSession) -> Catalog:
    """The sample with a small report: two sound bindings, a renamed measure, a dropped table and a bare name."""
    rows = [("Overview", "v1", "bar", "Column", "Customer", "Region"), ("Overview", "v1", "bar", "Measure", "Sales", "Total Sales"), ("Overview", "v2", "card", "Measure", "Sales", "Revenue"), ("Detail", "v3", "table", "Column", "Stores", "City"), ("Detail", "v3", "table", "Column", "", "Category")]
    bindings = spark.createDataFrame([(MODEL, *r) for r in rows], "model string, page string, visual string, visual_type string, kind string, table string, field string")
    return sample(spark).with_(bindings=bindings)
