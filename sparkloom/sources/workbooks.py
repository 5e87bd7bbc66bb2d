"""Workbooks (zipped or plain XML) into tables of data sources, fields, parameters, security groups and sheets.

Spark reads the files, Python parses one workbook at a time into flat rows. datasource() then turns
the rows of one data source into a runnable Sheet: its join tree becomes Spark joins, its calculated
fields and parameters become the sheet's scope. workbook_answers runs the sheets of many workbooks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formulas.syntax import Refused
from ..plans.sheets import Sheet
from .archives import UNREADABLE

COLUMNS = ["workbook", "kind", "source", "name", "detail", "role", "type", "formula", "position"]
REFERENCE = re.compile(r"\[([^\]]*)\]\.\[([^\]]*)\]")


def bare(name: str | None) -> str:
    return (name or "").strip().removeprefix("[").removesuffix("]")


def field_of(reference: str) -> tuple[str, str] | None:
    """[source].[derivation:field:kind] -> (source, field)."""
    m = REFERENCE.search(reference or "")
    if not m:
        return None
    parts = m[2].split(":")
    return m[1], parts[1] if len(parts) == 3 else m[2]


def rows_of(root: ET.Element) -> Iterator[tuple]:
    """(kind, source, name, detail, role, type, formula, position) rows of a workbook."""
    seen: set[str] = set()
    for ds in root.findall("./datasources/datasource"):
        source = ds.get("name") or ""
        if source in seen:
            continue
        seen.add(source)
        if source == "Parameters":
            for c in ds.findall("column"):
                yield "parameter", source, bare(c.get("name")), c.get("caption"), c.get("param-domain-type"), c.get("datatype"), c.get("value"), None
                names = {a.get("key"): a.get("value") for a in c.iterfind("aliases/alias")}
                for i, m in enumerate(c.iterfind("members/member")):
                    yield "member", source, bare(c.get("name")), m.get("alias") or names.get(m.get("value")), None, None, m.get("value"), i
            continue
        connection = ds.find("connection")
        yield "source", source, ds.get("caption") or source, None if connection is None else connection.get("class"), None, None, None, None
        top = None if connection is None else connection.find("relation")
        if top is not None:
            yield from _relation(source, top, [0])
        for record in ds.iter("metadata-record"):
            if record.get("class") == "column":
                yield "column", source, bare(record.findtext("local-name")), bare(record.findtext("parent-name")), None, record.findtext("local-type"), record.findtext("remote-name"), None
        for c in ds.findall("column"):
            calculation = c.find("calculation")
            formula = calculation.get("formula") if calculation is not None and calculation.get("class") == "tableau" else None
            yield "field", source, bare(c.get("name")), c.get("caption"), c.get("role"), c.get("datatype"), formula, None
        for g in ds.iter("group"):
            yield from _memberships(source, bare(g.get("name")), g)
    for r in root.iter("datasource-relationship"):
        for i, m in enumerate(r.iterfind("column-mapping/map")):
            ends = [(field_of(m.get(x) or "") or (None, bare(m.get(x))))[1] for x in ("key", "value")]
            derivation, _, kind = key if len(key := bare((m.get("key") or "").rpartition("].")[2]).split(":")) == 3 else (None, None, None)
            yield "relationship", r.get("source"), ends[0], r.get("target"), derivation, kind, ends[1], i
    for sheet in root.iter("worksheet"):
        name, mark = sheet.get("name"), sheet.find("./table/panes/pane/mark")
        yield "sheet", None, name, None if mark is None else mark.get("class"), None, None, None, None
        for shelf in ("rows", "cols"):
            for i, m in enumerate(REFERENCE.finditer(sheet.findtext(f"./table/{shelf}") or "")):
                ref = field_of(m[0])
                yield "shelf", ref[0], name, ref[1], shelf, m[2].split(":")[0] if m[2].count(":") == 2 else None, None, i
        for i, e in enumerate(sheet.iterfind("./table/panes/pane/encodings/*")):
            if ref := field_of(e.get("column") or ""):
                yield "encoding", ref[0], name, ref[1], e.tag, None, None, i
        for f in sheet.findall("./table/view/filter"):
            if ref := field_of(f.get("column") or ""):
                yield "filter", ref[0], name, ref[1], f.get("class"), None, None, None
                yield from _chosen(ref, name, f)


def _chosen(ref: tuple[str, str], sheet: str, f: ET.Element) -> Iterator[tuple]:
    """A filter's chosen values (role except: the values it leaves out) and bounds; type: the derivation that they are of."""
    parts = bare((f.get("column") or "").rpartition("].")[2]).split(":")
    derivation = parts[0] if len(parts) == 3 else None
    out = "except" if any(g.get("function") == "except" for g in f.iter("groupfilter")) else "member"
    for i, g in enumerate(g for g in f.iter("groupfilter") if g.get("function") == "member"):
        yield "choice", ref[0], sheet, ref[1], out, derivation, g.get("member"), i
    for end in ("min", "max"):
        if (value := f.findtext(end)) is not None:
            yield "range", ref[0], sheet, ref[1], end, derivation, value.strip(), None


def _memberships(source: str, name: str, group: ET.Element) -> Iterator[tuple]:
    """Security rows: the values that members of a directory group may see; one without a value where they may see none."""
    todo = group.findall("groupfilter")
    while todo:
        node = todo.pop()
        member = re.search(r"ISMEMBEROF\('([^']*)'\)", node.get("expression") or "")
        if not member:
            todo += node.findall("groupfilter")
            continue
        role = re.sub(r"\\([.\\])", r"\1", member[1])
        for leaf in node.iter("groupfilter"):
            if leaf.get("function") == "member":
                yield "security", source, bare(leaf.get("level")), role, name, None, re.sub(r'^"(.*)"$', r"\1", leaf.get("member") or "", flags=re.S), None
            elif leaf.get("function") == "empty-level":
                yield "security", source, bare(leaf.get("member")), role, name, None, None, None


def _relation(source: str, node: ET.Element, at: list[int]) -> Iterator[tuple]:
    """Leaves and joins in the order in which they are joined, the left side first."""
    kind = node.get("type")
    if kind == "join":
        sides = node.findall("relation")
        for side in sides:
            yield from _relation(source, side, at)
        keys = [bare_pair(e.get("op")) for e in node.iter("expression") if (e.get("op") or "").startswith("[")]
        yield "join", source, node.get("join") or "inner", " = ".join(keys[:2]), None, None, None, at[0]
    else:
        yield "table", source, node.get("name"), node.get("table"), kind, None, node.text if kind == "text" else None, at[0]
    at[0] += 1


def bare_pair(op: str) -> str:
    return op.replace("].[", "\t").strip("[]")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all workbooks under a path; kind problem for those that can't be read."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_py() or b""
                try:
                    if raw[:2] == b"PK":
                        with zipfile.ZipFile(io.BytesIO(raw)) as z:
                            raw = z.read(next(n for n in z.namelist() if n.endswith(".twb")))
                    rows = [(path, *r) for r in rows_of(ET.fromstring(raw))]
                except StopIteration:
                    rows = [(path, "problem", None, "no workbook inside", *[None] * 5)]
                except (ET.ParseError, *UNREADABLE) as e:
                    rows = [(path, "problem", None, str(e) or type(e).__name__, *[None] * 5)]
                columns = list(zip(*rows, strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:8]), pa.array(columns[8], pa.int32())], COLUMNS)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{c} string" for c in COLUMNS[:8]) + ", position int")


def literal(text: str | None):
    """A value as workbooks write it: quoted text, a date between hashes, a number, or text."""
    text = (text or "").strip()
    if text[:1] in ("'", '"', "#"):
        return text[1:-1]
    return float(text) if re.fullmatch(r"-?\d+\.\d+", text) else int(text) if re.fullmatch(r"-?\d+", text) else text


def join_tree(rows: list, table: Callable[[str], DataFrame]) -> DataFrame:
    """The joined rows of a data source, from its table and join rows; table() gives the DataFrame of a table's name.

    Custom SQL and join conditions other than one equality are refused. A column that both sides of a
    join have keeps its name on the left and gets the right table's name, in brackets, on the right.
    """
    stack: list[tuple[DataFrame, dict[str, str]]] = []
    for r in sorted(rows, key=lambda r: r.position):
        if r.kind == "table":
            if r.role != "table":
                raise Refused(f"{r.role} relation {r.name!r} is not a table")
            stack.append((table(bare(r.detail or r.name).split("].[")[-1]), {}))
            stack[-1][1][r.name] = r.name
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        sides = [x.split("\t")[-1] for x in (r.detail or "").split(" = ")]
        if len(sides) != 2 or not all(sides):
            raise Refused("a join needs one equality of two columns")
        x, y = sides if sides[0] in left.columns else sides[::-1]
        if x not in left.columns or y not in right.columns:
            raise Refused(f"no columns to join by {r.detail!r}")
        twice = {c: f"{c} ({next(iter(b))})" for c in right.columns if c in left.columns}
        right, y = right.withColumnsRenamed(twice), twice.get(y, y)
        how = {"inner": "inner", "left": "left", "right": "right", "full": "full_outer"}[r.name]
        stack.append((left.join(right, left[x] == right[y], how), a | b))
    if len(stack) != 1:
        raise Refused("the data source has no single join tree")
    return stack[0][0]


def datasource(workbooks: DataFrame, workbook: str, source: str, table: Callable[[str], DataFrame]) -> Sheet:
    """A data source as a runnable sheet (see join_tree); only the rows that define it come to the driver."""
    rows = workbooks.where((F.col("workbook") == workbook) & F.col("source").isin(source, "Parameters") & F.col("kind").isin("table", "join", "field", "parameter", "security")).collect()
    fields = [r for r in rows if r.kind == "field" and r.source == source and r.formula]
    parameters = {n: literal(r.formula) for r in rows if r.kind == "parameter" for n in (r.name, r.detail) if n}
    calculated = {n: r.formula for r in fields for n in (r.name, r.detail) if n}
    return Sheet(join_tree([r for r in rows if r.kind in ("table", "join")], table), calculated, parameters, frozenset(r.role for r in rows if r.kind == "security" and r.role))


def security_roles(workbooks: DataFrame) -> DataFrame:
    """workbook, role (a directory group), table (null where no source tells), column, allowed: the values that each group's members may see.

    Groups are united over all data sources of a workbook.
    """
    tables = workbooks.where("kind = 'column'").groupBy("workbook", "source", "name").agg(F.min("detail").alias("table"))
    own = workbooks.where("kind = 'security'").join(tables, ["workbook", "source", "name"], "left")
    return own.groupBy("workbook", F.col("detail").alias("role"), "table", F.col("name").alias("column")).agg(F.array_sort(F.collect_set("formula")).alias("allowed"))


def relationship_keys(workbooks: DataFrame) -> DataFrame:
    """workbook, source, target, key, target_key, ambiguous: one pair of columns for each two data sources that are related.

    A column without a derivation (none), and a nominal one (nk), is preferred; of equals the first counts.
    """
    score = (F.coalesce("role", F.lit("")) == "none").cast("int") + (F.coalesce("type", F.lit("")) == "nk").cast("int")
    rows = workbooks.where("kind = 'relationship'").withColumn("pair", F.struct((-score).alias("s"), "position", F.col("name").alias("key"), F.col("formula").alias("target_key")))
    best = rows.groupBy("workbook", "source", F.col("detail").alias("target")).agg(F.min("pair").alias("best"), (F.count_distinct("name", "formula") > 1).alias("ambiguous"))
    return best.select("workbook", "source", "target", "best.key", "best.target_key", "ambiguous")
