"""Report archives into pages and field bindings.

Each archive is one row of Spark's binary reader; Python unzips it and walks the visuals' JSON, which
nests without bound, for column, measure and hierarchy references. A reference's alias is looked up in
the nearest enclosing list of sources; an alias that isn't there gives an empty table.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, ship
from .archives import UNREADABLE

KINDS = {"Column": "Column", "Measure": "Measure", "HierarchyLevel": "Hierarchy level"}


def loaded(value):
    """JSON inside a string, as far as it is JSON."""
    if isinstance(value, str) and value[:1] in ("{", "["):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def field_references(node, aliases: dict[str, str] | None = None) -> Iterator[tuple[str, str, str]]:
    """(kind, table, field) of every reference in a visual's definition."""
    todo = [(node, aliases or {})]
    while todo:
        node, aliases = todo.pop()
        node = loaded(node)
        if isinstance(node, list):
            todo += [(x, aliases) for x in node]
        elif isinstance(node, dict):
            if isinstance(sources := loaded(node.get("From")), list):
                aliases = aliases | {s["Name"]: s["Entity"] for s in sources if isinstance(s, dict) and s.get("Name") and s.get("Entity")}
            for name, kind in KINDS.items():
                ref = node.get(name)
                if isinstance(ref, dict):
                    field = ref.get("Level") if name == "HierarchyLevel" else ref.get("Property")
                    source = _source(ref.get("Expression"))
                    if field:
                        yield kind, source.get("Entity") or aliases.get(source.get("Source", ""), ""), field
            todo += [(x, aliases) for x in node.values()]


def _source(node) -> dict:
    """The SourceRef inside an expression, through a hierarchy if there is one."""
    while isinstance(node, dict):
        if isinstance(node.get("SourceRef"), dict):
            return node["SourceRef"]
        node = node.get("Expression") or node.get("Hierarchy")
    return {}


def read_archive(raw: bytes) -> tuple[list[tuple], list[tuple]]:
    """(pages: name, ordinal, hidden), (bindings: page, visual, type, kind, table, field)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        if "Report/Layout" in names:
            return _classic(z.read("Report/Layout"))
        return _folders(z, names)


def _text(raw: bytes) -> str:
    for encoding in ("utf-16-le", "utf-8-sig"):
        try:
            text = raw.decode(encoding).lstrip("﻿")
            if text.lstrip().startswith("{"):
                return text
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "ignore")


def _classic(raw: bytes) -> tuple[list, list]:
    pages, bindings = [], []
    for i, section in enumerate(json.loads(_text(raw)).get("sections") or []):
        page = section.get("displayName") or section.get("name") or ""
        config = loaded(section.get("config"))
        pages.append((page, int(section.get("ordinal") or i), isinstance(config, dict) and config.get("visibility") == 1))
        bindings += [(page, "(page)", "filter", *r) for r in dict.fromkeys(field_references(section.get("filters")))]
        for n, visual in enumerate(section.get("visualContainers") or []):
            config = loaded(visual.get("config"))
            config = config if isinstance(config, dict) else {}
            kind = (config.get("singleVisual") or {}).get("visualType") or ""
            bindings += [(page, config.get("name") or str(n), kind, *r) for r in dict.fromkeys(field_references([config, visual.get("filters")]))]
    return pages, bindings


def _folders(z: zipfile.ZipFile, names: list[str]) -> tuple[list, list]:
    own = {n: json.loads(_text(z.read(n))) for n in names if "/definition/pages/" in f"/{n}" and n.endswith(".json")}
    order = next((x.get("pageOrder") or [] for n, x in own.items() if n.endswith("/pages.json")), [])
    found = {n.rsplit("/", 2)[-2]: x for n, x in own.items() if n.endswith("/page.json")}
    ids = [p for p in order if p in found] + sorted(set(found) - set(order))
    title = {p: found[p].get("displayName") or found[p].get("name") or p for p in ids}
    pages = [(title[p], i, bool(found[p].get("visibility"))) for i, p in enumerate(ids)]
    bindings = []
    for n, visual in own.items():
        parts = n.split("/")
        if parts[-1] == "visual.json" and parts[-4] in title:
            bindings += [(title[parts[-4]], visual.get("name") or parts[-2], (visual.get("visual") or {}).get("visualType") or "", *r) for r in dict.fromkeys(field_references(visual))]
    return pages, bindings


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pages, bindings (as in the catalog; model is the file's path) and problems of all report archives under a path."""
    return reports_of(spark.read.format("binaryFile").load(path))


def reports_of(archives: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of archives given as rows of path and content, each of which is unpacked once."""

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    pages, bindings = read_archive(raw.as_py() or b"")
                    problem = None if pages else "no report definition"
                except (KeyError, *UNREADABLE) as e:
                    pages, bindings, problem = [], [], str(e) or type(e).__name__
                rows += [(name, "page", p, None, None, None, None, None, o, h) for p, o, h in pages] + [(name, "binding", *b, None, None) for b in bindings] + ([(name, "problem", problem, *[None] * 7)] if problem else [])
                if len(rows) >= 1000:  # a batch for many small reports
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:8]), pa.array(columns[8], pa.int32()), pa.array(columns[9], pa.bool_())], schema)

    schema = ["model", "row", "page", "visual", "visual_type", "kind", "table", "field", "ordinal", "hidden"]
    ship(archives.sparkSession)
    rows = cut(archives.select("path", "content").mapInArrow(run, ", ".join(f"{c} string" for c in schema[:8]) + ", ordinal int, hidden boolean"))
    return (
        rows.where("row = 'page'").select("model", "page", "ordinal", "hidden"),
        rows.where("row = 'binding'").select("model", "page", "visual", "visual_type", "kind", "table", "field").distinct(),
        rows.where("row = 'problem'").select("model", F.col("page").alias("problem")),
    )
