"""Workbooks that run, on small tables."""

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.workbook_answers import answers, field_levels
from sparkloom.sources.workbooks import rows_of

from xml.etree import ElementTree as ET

COLUMNS = "workbook string, kind string, source string, name string, detail string, role string, type string, formula string, position int"


def book(fields: str = "", sheets: str = "", relation: str = '<relation type="table" name="t" table="[dbo].[t]"/>', group: str = "") -> str:
    return f'<workbook><datasources><datasource name="s"><connection class="lake">{relation}</connection>{fields}{group}</datasource></datasources><worksheets>{sheets}</worksheets></workbook>'


def field(name: str, formula: str, caption: str = "") -> str:
    return f'<column name="[{name}]" {f"caption={chr(34)}{caption}{chr(34)}" if caption else ""} role="measure"><calculation class="tableau" formula="{formula}"/></column>'


def sheet(name: str, rows: str, cols: str = "", filters: str = "") -> str:
    return f'<worksheet name="{name}"><table><view>{filters}</view><rows>{rows}</rows><cols>{cols}</cols></table></worksheet>'


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), ("b", 4.0, "x"), (None, 8.0, "x")], "g string, v double, h string")


def run(spark, t, *books: str):
    rows = [(f"w{i}", *r) for i, text in enumerate(books) for r in rows_of(ET.fromstring(text))]
    found = answers(spark.createDataFrame(rows, COLUMNS), lambda name: {"t": t}[name])
    return sorted((tuple(r) for r in found.rows.collect()), key=str), sorted((tuple(r) for r in found.problems.collect()), key=str)


def test_levels_of_fields(spark):
    rows = [("w", *r) for r in rows_of(ET.fromstring(book(field("A", "[v]", "first") + field("B", "[first] + [C]") + field("C", "[A] * 2") + field("D", "[E]") + field("E", "[D] + '[A]'") + field("F", "[D]") + field("G", "'[B]'") + field("H", "[H]"))))]
    df = spark.createDataFrame(rows, COLUMNS)
    assert {r.field: r.level for r in field_levels(df).collect()} == {"A": 0, "C": 1, "B": 2, "D": None, "E": None, "F": None, "G": 0, "H": None}
    assert field_levels(df.where("false")).collect() == []


def test_sheets_filters_and_problems(spark, t):
    good = book(
        field("N", "[v] * 10") + field("S", "SUM([N]) / SUM({FIXED [g] : SUM([v])})") + field("X", "RUNNING_SUM([v])"),
        sheet("one", "[s].[sum:N:qk]", "[s].[none:g:nk]")
        + sheet("two", "[s].[usr:S:qk] [s].[ctd:h:qk] [s].[med:v:qk]", "", '<filter class="categorical" column="[s].[none:h:nk]"><groupfilter function="union"><groupfilter function="member" member="&quot;x&quot;"/></groupfilter></filter><filter class="quantitative" column="[s].[none:v:qk]"><max>5</max></filter>')
        + sheet("bad", "[s].[sum:X:qk]") + sheet("blend", "[s].[sum:v:qk] [z].[sum:v:qk]") + sheet("dims", "[s].[none:g:nk]") + sheet("none", ""),
    )
    rows, problems = run(spark, t, good, book(sheets=sheet("one", "[s].[max:v:qk]")), book(sheets=sheet("q", "[s].[sum:v:qk]"), relation='<relation type="text" name="q">SELECT 1</relation>'))
    assert rows == sorted([
        ("w0", "one", None, "none:g=a", "sum:N", 30.0), ("w0", "one", None, "none:g=b", "sum:N", 40.0), ("w0", "one", None, "none:g=null", "sum:N", 80.0),
        ("w0", "two", None, "", "usr:S", 50.0 / 7.0), ("w0", "two", None, "", "ctd:h", 1.0), ("w0", "two", None, "", "med:v", 2.5), ("w1", "one", None, "", "max:v", 8.0),
    ], key=str)
    assert [(w, s) for w, s, _ in problems] == [("w0", "bad"), ("w0", "blend"), ("w0", "dims"), ("w0", "none"), ("w2", "q")]


def test_groups_see_their_own_levels(spark, t):
    group = """<group name="[R]"><groupfilter function="union"><groupfilter expression="ISMEMBEROF('xs')" function="filter"><groupfilter function="member" level="[h]" member="&quot;x&quot;"/></groupfilter>
    <groupfilter expression="ISMEMBEROF('all')" function="filter"><groupfilter function="member" level="[h]" member="&quot;x&quot;"/><groupfilter function="member" level="[h]" member="&quot;y&quot;"/></groupfilter><groupfilter expression="ISMEMBEROF('no')" function="filter"><groupfilter function="empty-level" member="[h]"/></groupfilter></groupfilter></group>"""
    rows, problems = run(spark, t, book(field("W", "{FIXED : SUM([v])}"), sheet("s", "[s].[max:W:qk] [s].[sum:v:qk]", "[s].[none:g:nk]"), group=group))
    assert problems == []
    assert {(r[2], r[3], r[4]): r[5] for r in rows} == {
        ("xs", "none:g=a", "max:W"): 13.0, ("xs", "none:g=b", "max:W"): 13.0, ("xs", "none:g=null", "max:W"): 13.0, ("xs", "none:g=a", "sum:v"): 1.0, ("xs", "none:g=b", "sum:v"): 4.0, ("xs", "none:g=null", "sum:v"): 8.0,
        ("all", "none:g=a", "max:W"): 15.0, ("all", "none:g=b", "max:W"): 15.0, ("all", "none:g=null", "max:W"): 15.0, ("all", "none:g=a", "sum:v"): 3.0, ("all", "none:g=b", "sum:v"): 4.0, ("all", "none:g=null", "sum:v"): 8.0,
    }


def test_all_sheets_read_the_tables_once(spark, t, tmp_path):
    t.write.parquet(f"{tmp_path}/t")
    rows = [("w", *r) for r in rows_of(ET.fromstring(book(field("W", "{FIXED [h] : SUM([v])}"), sheet("a", "[s].[sum:W:qk]", "[s].[none:g:nk]") + sheet("b", "[s].[avg:v:qk]", "[s].[none:h:nk]"))))]
    made = answers(spark.createDataFrame(rows, COLUMNS), lambda name: spark.read.parquet(f"{tmp_path}/t")).rows
    assert f"{tmp_path}/t" not in made._jdf.queryExecution().toString() and len(made.collect()) == 5
