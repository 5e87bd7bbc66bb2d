"""The relational catalog of semantic models: one DataFrame for each kind of object.

Every relation has a `model` column, so each analysis covers one model or an estate of any number of
models in the same Spark job; nothing is ever joined or counted across models.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut

SCHEMAS = {
    "tables": "model string, table string, rows_count bigint, description string, expression string, category string, size bigint",
    "columns": "model string, table string, column string, column_type string, data_type string, hidden boolean, in_mdx boolean, description string, folder string, encoding string, total_size bigint, data_size bigint, dictionary_size bigint, cardinality bigint, expression string, marker boolean, is_key boolean",
    "measures": "model string, table string, measure string, expression string, data_type string, format string, description string, folder string",
    "relationships": "model string, name string, from_table string, from_column string, to_table string, to_column string, from_cardinality string, to_cardinality string, direction string, active boolean",
    "partitions": "model string, table string, partition string, mode string, source_type string, expression string",
    "roles": "model string, role string, table string, filter string",
    "perspectives": "model string, perspective string, table string, kind string, object string",
    "segments": "model string, table string, column string, compression string, bits int",
    "levels": "model string, table string, hierarchy string, level string",
    "pages": "model string, page string, ordinal int, hidden boolean",
    "bindings": "model string, page string, visual string, visual_type string, kind string, table string, field string",
}
SEVERITIES = ("High", "Medium", "Low", "Info")


@dataclass(frozen=True)
class Catalog:
    tables: DataFrame
    columns: DataFrame
    measures: DataFrame
    relationships: DataFrame
    partitions: DataFrame
    roles: DataFrame
    perspectives: DataFrame
    segments: DataFrame
    levels: DataFrame
    pages: DataFrame
    bindings: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, **given: DataFrame) -> Catalog:
        """The given relations, the others empty; columns that a relation lacks are null."""
        parts = {}
        for n, schema in SCHEMAS.items():
            # known to be empty when planned, so that nothing runs for it
            none = spark.sql(f"SELECT {', '.join('CAST(NULL AS {1}) AS `{0}`'.format(*c.split()) for c in schema.split(', '))} WHERE false")
            parts[n] = none
            if n in given:  # in the given rows' partitions, of the kinds that a union has
                df, kinds = given[n], none.unionByName(given[n], allowMissingColumns=True).schema
                parts[n] = df.select(*((F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kinds[c].dataType).alias(c) for c in none.columns))
        return cls(**parts)

    def stored(self) -> Catalog:
        """The catalog with every relation written once, so that analyses don't parse archives again."""
        return Catalog(**{f.name: cut(getattr(self, f.name)) for f in fields(self)})

    def with_(self, **given: DataFrame) -> Catalog:
        return replace(self, **given)

    @property
    def user_columns(self) -> DataFrame:
        """Columns without the storage engine's row numbers."""
        row_number = (F.lower(F.coalesce("column_type", F.lit(""))) == "rownumber") | F.coalesce(F.col("column").rlike("^RowNumber-[0-9A-Fa-f-]+$"), F.lit(False))
        return self.columns.where(~row_number)

    @property
    def calculated_columns(self) -> DataFrame:
        return self.columns.where(F.col("column_type").isin("Calculated", "CalculatedTableColumn"))

    @property
    def key_columns(self) -> DataFrame:
        """model, table, column of every relationship's ends."""
        r = self.relationships
        ends = r.select("model", F.col("from_table").alias("table"), F.col("from_column").alias("column")).union(r.select("model", "to_table", "to_column"))
        return ends.where("table <> '' AND column <> ''").distinct()


def ranked(severity: str = "severity"):
    """Sort key of severities, the gravest first, unknown ones last."""
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity))
    return F.when(order > 0, order).otherwise(9)


def finding(check: str, severity, object_, message):
    """Columns of a finding, besides model."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return [F.lit(check).alias("check"), as_col(severity).alias("severity"), as_col(object_).alias("object"), as_col(message).alias("message")]


def qualified(table: str = "table", column: str = "column"):
    return F.concat(F.col(table), F.lit("["), F.col(column), F.lit("]"))
