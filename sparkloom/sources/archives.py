"""Model and report archives into a catalog: zip files read by Spark, their JSON parsed by Spark.

Python only unzips, one member at a time; sections are parsed with explicit schemas in
the JVM. Archives that can't be read give a row in `problems` instead of failing the job.
"""

from __future__ import annotations

import io
import lzma
import zipfile
import zlib
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import SCHEMAS, Catalog
from ..storage import cut, opened, ship

MODEL_PARTS = ("Model.bim", "DaxVpaView.json", "DaxModel.json")
BIM = """struct<model: struct<tables: array<struct<name: string, dataCategory: string, isHidden: boolean,
  columns: array<struct<name: string, dataType: string, type: string, isKey: boolean, isHidden: boolean, extendedProperties: array<struct<name: string>>>>,
  measures: array<struct<name: string, expression: string>>,
  hierarchies: array<struct<name: string, levels: array<struct<name: string>>>>,
  partitions: array<struct<name: string, mode: string, source: struct<type: string, expression: string>>>>>,
  relationships: array<struct<name: string, fromTable: string, fromColumn: string, toTable: string, toColumn: string, fromCardinality: string, toCardinality: string, crossFilteringBehavior: string, isActive: boolean>>,
  roles: array<struct<name: string, tablePermissions: array<struct<name: string, filterExpression: string>>>>,
  perspectives: array<struct<name: string, perspectiveTables: array<struct<name: string, perspectiveColumns: array<struct<name: string>>, perspectiveMeasures: array<struct<name: string>>>>>>>>"""
VPA = """struct<
  Tables: array<struct<TableName: string, Name: string, RowsCount: bigint, Description: string, TableExpression: string, TotalSize: bigint, TableSize: bigint, DataSize: bigint, DictionarySize: bigint, ColumnSize: bigint>>,
  Columns: array<struct<TableName: string, ColumnName: string, ColumnType: string, ColumnExpression: string, DataType: string, IsHidden: boolean, IsRowNumber: boolean, IsAvailableInMDX: boolean, IsKey: boolean, DisplayFolder: string, Description: string, Encoding: string, ColumnEncoding: string, TotalSize: bigint, DataSize: bigint, DictionarySize: bigint, Cardinality: bigint, ColumnCardinality: bigint>>,
  Measures: array<struct<TableName: string, MeasureName: string, MeasureExpression: string, DataType: string, FormatString: string, Description: string, DisplayFolder: string>>,
  Relationships: array<struct<RelationshipName: string, FromCardinalityType: string, ToCardinalityType: string, CrossFilteringBehavior: string, IsActive: boolean>>,
  ColumnsSegments: array<struct<TableName: string, ColumnName: string, CompressionType: string, BitsCount: int>>>"""


#: What zipfile raises for archives that it can't read: damage, encryption, unknown packing, ends too early.
UNREADABLE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, RuntimeError, EOFError, OSError, ValueError)


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the files under a path, without their content; empty ones too, which Spark's scans leave out."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    place = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    names = spark.createDataFrame([(x,) for x in files.inputFiles()], "name string").select(place(F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B")))).alias("name"))  # what the file index holds on the driver as well
    return names.join(files, F.col("name") == place(F.col("path")), "left").select(F.coalesce("path", "name").alias("path"), F.coalesce("length", F.lit(0).cast("long")).alias("length"))


def parts_of(files: DataFrame, parts: tuple[str, ...] = MODEL_PARTS) -> DataFrame:
    """path, part, text, problem: the wanted members of zip files (path, length, and content if they are rows, not files), as UTF-8 without a mark.

    A task opens one archive at a time and reads its directory and these members alone, by their places, so an archive may
    be larger than memory; a member may not.
    """

    def member(z: zipfile.ZipFile, path: str, part: str, names: dict[str, str]) -> tuple:
        if part not in names:
            return path, part, None, f"{part} is missing"
        try:
            return path, part, z.read(names[part]).decode("utf-8-sig", "ignore"), None
        except UNREADABLE as why:
            locked = isinstance(why, RuntimeError) and not isinstance(why, NotImplementedError)
            return path, part, None, f"{part} is encrypted" if locked else f"{part} can't be unpacked"

    def read(path: str, length: int | None, content: pa.Scalar | None) -> list[tuple]:
        if not length:
            return [(path, None, None, "empty file")]
        try:
            with ExitStack() as held:
                if content is None:
                    files, place = opened(path)
                    raw = held.enter_context(files.open_input_file(place))
                else:
                    raw = io.BytesIO(content.as_py())
                z = held.enter_context(zipfile.ZipFile(raw))
                names = {n.rsplit("/", 1)[-1]: n for n in z.namelist()}
                return [member(z, path, part, names) for part in parts]
        except UNREADABLE:
            return [(path, None, None, "not a zip file")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["path", "part", "text", "problem"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            contents = batch.column("content") if packed else [None] * batch.num_rows
            for path, length, content in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), contents, strict=True):
                own = read(path, length, content)
                rows, held = rows + own, held + sum(len(text or "") for _, _, text, _ in own)
                if held > 1 << 20 or len(rows) > 1000:  # a batch for many small archives
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    ship(files.sparkSession)
    packed = "content" in files.columns
    return files.select("path", "length", *["content"] * packed).mapInArrow(run, "path string, part string, text string, problem string")


def read_models(spark: SparkSession, path: str) -> tuple[Catalog, DataFrame]:
    """The catalog of all model archives under a path (model: the file's path), and problems (model, problem).

    Spark lists the files without reading them; tasks open them by their URIs.
    """
    return models_of(listed_files(spark, path))


def models_of(archives: DataFrame) -> tuple[Catalog, DataFrame]:
    """The same of archives as parts_of() takes them. All relations are read from the parsed texts, which are written once."""
    return from_parts(parts_of(archives).withColumnRenamed("path", "model"), once=True)


def from_parts(parts: DataFrame, once: bool = False) -> tuple[Catalog, DataFrame]:
    """model, part, text, problem -> catalog and problems. Models with a problem give no rows. once: write what is parsed, for all relations to read."""
    one = parts.groupBy("model").agg(*(F.max(F.when(F.col("part") == p, F.col("text"))).alias(n) for p, n in zip(MODEL_PARTS, ("bim", "vpa", "dax"), strict=True)), F.array_sort(F.collect_set("problem")).alias("problems"))
    one = one.withColumns({"b": F.from_json("bim", BIM), "v": F.from_json("vpa", VPA)})
    bad = F.when(F.size("problems") > 0, F.array_join("problems", "; ")).when(~F.coalesce(F.trim("bim").startswith("{"), F.lit(False)) | F.col("b.model").isNull(), "Model.bim isn't a JSON object").when(~F.coalesce(F.trim("vpa").startswith("{"), F.lit(False)), "DaxVpaView.json isn't a JSON object")
    one = one.withColumn("problem", bad).select("model", "problem", "b", "v")
    one = cut(one) if once else one
    good = one.where("problem IS NULL")
    return _catalog(good.select("model", F.col("b.model").alias("b"), "v")), one.where("problem IS NOT NULL").select("model", "problem")


def _each(df: DataFrame, array: str, name: str) -> DataFrame:
    return df.select("*", F.explode(array).alias(name))


def _beside(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join of two relations of all models, neither of which is gathered on the driver.

    Rows exploded from a stored file are planned by a share of the file's size, which may let them be broadcast however many they are.
    """
    return df.join(other.hint("merge"), keys, how)


def _lines(text):
    """An expression that is a list of lines as one text."""
    return F.when(text.startswith("["), F.array_join(F.from_json(text, "array<string>"), "\n")).otherwise(text)


def _catalog(m: DataFrame) -> Catalog:
    spark = m.sparkSession
    bt = _each(m, "b.tables", "t").where("t.name IS NOT NULL")
    vt = _each(m, "v.Tables", "t").select("model", F.coalesce("t.TableName", "t.Name").alias("table"), F.col("t.RowsCount").alias("rows_count"), F.col("t.Description").alias("description"), F.nullif("t.TableExpression", F.lit("")).alias("expression"), F.coalesce("t.TotalSize", "t.TableSize", "t.DataSize", "t.DictionarySize", "t.ColumnSize").alias("size"))
    partitions = _each(bt, "t.partitions", "p").select("model", F.col("t.name").alias("table"), F.col("p.name").alias("partition"), F.col("p.mode").alias("mode"), F.col("p.source.type").alias("source_type"), _lines(F.col("p.source.expression")).alias("expression"))
    calculated = partitions.where("lower(source_type) = 'calculated'").groupBy("model", "table").agg(F.min("expression").alias("formula"))
    tables = _beside(bt.select("model", F.col("t.name").alias("table"), F.col("t.dataCategory").alias("category")), vt, ["model", "table"], "full_outer")
    tables = _beside(tables, calculated, ["model", "table"], "left").withColumn("expression", F.coalesce("expression", "formula"))
    marks = _each(bt, "t.columns", "c").select("model", F.col("t.name").alias("table"), F.col("c.name").alias("column"), F.exists("c.extendedProperties", lambda x: x["name"] == "ParameterMetadata").alias("marker"), F.coalesce("c.isKey", F.lit(False)).alias("key"), F.lower("c.type").alias("tom_type"))
    vc = _each(m, "v.Columns", "c").where("NOT coalesce(c.IsRowNumber, false)").select("model", "c.*")
    own = vc.select(
        "model", F.col("TableName").alias("table"), F.col("ColumnName").alias("column"), F.col("ColumnType").alias("column_type"), F.col("DataType").alias("data_type"), F.col("IsHidden").alias("hidden"), F.col("IsAvailableInMDX").alias("in_mdx"), F.col("Description").alias("description"), F.col("DisplayFolder").alias("folder"),
        F.coalesce("Encoding", "ColumnEncoding").alias("encoding"), F.col("TotalSize").alias("total_size"), F.col("DataSize").alias("data_size"), F.col("DictionarySize").alias("dictionary_size"), F.coalesce("Cardinality", "ColumnCardinality").alias("cardinality"), F.col("ColumnExpression").alias("expression"), F.col("IsKey").alias("is_key"),
    )
    columns = _beside(own, marks, ["model", "table", "column"], "left").withColumn("is_key", F.coalesce("is_key", "key"))
    measures = _each(m, "v.Measures", "x").select("model", F.col("x.TableName").alias("table"), F.col("x.MeasureName").alias("measure"), F.col("x.MeasureExpression").alias("expression"), F.col("x.DataType").alias("data_type"), F.col("x.FormatString").alias("format"), F.col("x.Description").alias("description"), F.col("x.DisplayFolder").alias("folder")).where("measure IS NOT NULL")
    relationships = _relationships(m)
    roles = m.select("model", F.explode("b.roles").alias("r")).select("model", F.col("r.name").alias("role"), F.explode_outer("r.tablePermissions").alias("p")).select("model", "role", F.col("p.name").alias("table"), F.col("p.filterExpression").alias("filter"))
    pt = m.select("model", F.explode("b.perspectives").alias("p")).select("model", F.col("p.name").alias("perspective"), F.explode("p.perspectiveTables").alias("t"))
    items = F.concat(F.transform(F.coalesce("t.perspectiveColumns", F.array()), lambda x: F.struct(F.lit("Column").alias("kind"), x["name"].alias("object"))), F.transform(F.coalesce("t.perspectiveMeasures", F.array()), lambda x: F.struct(F.lit("Measure").alias("kind"), x["name"].alias("object"))))
    whole = F.array(F.struct(F.lit("Table").alias("kind"), F.lit(None).cast("string").alias("object")))
    perspectives = pt.select("model", "perspective", F.col("t.name").alias("table"), F.explode(F.when(F.size(items) > 0, items).otherwise(whole)).alias("i")).select("model", "perspective", "table", "i.kind", "i.object")
    segments = _each(m, "v.ColumnsSegments", "s").select("model", F.col("s.TableName").alias("table"), F.col("s.ColumnName").alias("column"), F.col("s.CompressionType").alias("compression"), F.col("s.BitsCount").alias("bits"))
    levels = _each(_each(bt, "t.hierarchies", "h"), "h.levels", "l").select("model", F.col("t.name").alias("table"), F.col("h.name").alias("hierarchy"), F.col("l.name").alias("level"))
    keep = lambda name, df: df.select(*(c.split()[0] for c in SCHEMAS[name].split(", ")))
    given = {"tables": tables, "columns": columns, "measures": measures, "relationships": relationships, "partitions": partitions, "roles": roles, "perspectives": perspectives, "segments": segments, "levels": levels}
    return Catalog.empty(spark, **{n: keep(n, df) for n, df in given.items()})


def _relationships(m: DataFrame) -> DataFrame:
    """The model's relationships; statistics of the same name fill what the model leaves out."""
    r = _each(m, "b.relationships", "r").select("model", "r.*").where("coalesce(fromTable, '') <> '' AND coalesce(toTable, '') <> ''")
    s = _each(m, "v.Relationships", "s").select("model", F.col("s.RelationshipName").alias("name"), F.col("s.FromCardinalityType").alias("from_stat"), F.col("s.ToCardinalityType").alias("to_stat"), F.col("s.CrossFilteringBehavior").alias("direction_stat"), F.col("s.IsActive").alias("active_stat")).dropDuplicates(["model", "name"])
    j = _beside(r, s, ["model", "name"], "left")
    both = F.lower(F.coalesce("direction_stat", "crossFilteringBehavior", F.lit(""))).startswith("both")
    return j.select(
        "model", "name", F.col("fromTable").alias("from_table"), F.col("fromColumn").alias("from_column"), F.col("toTable").alias("to_table"), F.col("toColumn").alias("to_column"),
        F.initcap(F.coalesce("from_stat", "fromCardinality", F.lit("Many"))).alias("from_cardinality"), F.initcap(F.coalesce("to_stat", "toCardinality", F.lit("One"))).alias("to_cardinality"),
        F.when(both, "Both").otherwise("Single").alias("direction"), F.coalesce("active_stat", "isActive", F.lit(True)).alias("active"),
    )
