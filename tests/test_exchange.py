import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.formulas.syntax import Refused
from sample_model import sample, with_report
from sparkloom.sinks import text
from sparkloom.sources import reports, workbooks
from sparkloom.streaming.measures import windowed

SAMPLE = "Sample Retail Model"


def archive(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def column(entity, name, kind="Column"):
    return {kind: {"Expression": {"SourceRef": entity}, "Property": name}}


def test_classic_and_folder_reports(spark, tmp_path):
    query = {"From": [{"Name": "s", "Entity": "Sales"}], "Select": [column({"Source": "s"}, "Total", "Measure"), {"inner": {"From": [{"Name": "s", "Entity": "Other"}], "x": column({"Source": "s"}, "City")}}, column({"Source": "q"}, "Lost")]}
    level = {"HierarchyLevel": {"Expression": {"Hierarchy": {"Expression": {"SourceRef": {"Entity": "Date"}}, "Hierarchy": "H"}}, "Level": "Year"}}
    visual = {"config": json.dumps({"name": "v1", "singleVisual": {"visualType": "bar", "prototypeQuery": query, "more": json.dumps([level])}})}
    layout = {"sections": [{"displayName": "One", "ordinal": 3, "config": json.dumps({"visibility": 1}), "visualContainers": [visual], "filters": json.dumps([column({"Entity": "Sales"}, "Year")])}]}
    (tmp_path / "classic.pbix").write_bytes(archive({"Report/Layout": json.dumps(layout).encode("utf-16-le")}))
    base = "X.Report/definition/pages"
    folder = {f"{base}/pages.json": json.dumps({"pageOrder": ["b", "a"]}), f"{base}/a/page.json": json.dumps({"displayName": "A"}), f"{base}/b/page.json": json.dumps({"displayName": "B", "visibility": "HiddenInViewMode"}), f"{base}/b/visuals/v/visual.json": json.dumps({"name": "v", "visual": {"visualType": "card", "query": column({"Entity": "Sales"}, "Total", "Measure")}})}
    (tmp_path / "folder.pbix").write_bytes(archive(folder))
    (tmp_path / "bad.pbix").write_bytes(b"no")
    pages, bindings, problems = reports.read_reports(spark, str(tmp_path))
    short = lambda r: r.model.rsplit("/", 1)[-1].split(".")[0]
    assert {(short(r), r.page, r.ordinal, r.hidden) for r in pages.collect()} == {("classic", "One", 3, True), ("folder", "B", 0, True), ("folder", "A", 1, False)}
    got = {(short(r), r.page, r.visual, r.kind, r.table, r.field) for r in bindings.collect()}
    assert got == {
        ("classic", "One", "v1", "Measure", "Sales", "Total"), ("classic", "One", "v1", "Column", "Other", "City"), ("classic", "One", "v1", "Column", "", "Lost"), ("classic", "One", "v1", "Hierarchy level", "Date", "Year"),
        ("classic", "One", "(page)", "Column", "Sales", "Year"), ("folder", "B", "v", "Measure", "Sales", "Total"),
    }
    assert [short(r) for r in problems.collect()] == ["bad"]


WORKBOOK = """<workbook><datasources>
<datasource name='Parameters'><column name='[P]' caption='Rate' param-domain-type='range' datatype='real' value='2.0'/></datasource>
<datasource name='ds1' caption='Shop'><connection class='postgres'>
 <relation type='join' join='left'><clause><expression op='='><expression op='[orders].[cust]'/><expression op='[people].[id]'/></expression></clause>
  <relation type='table' name='orders' table='[public].[orders]'/><relation type='table' name='people' table='[public].[people]'/></relation></connection>
 <column name='[Calc1]' caption='Gross' role='measure' datatype='real'><calculation class='tableau' formula='SUM([amount] * [Parameters].[P])'/></column>
 <group name='[grp]'><groupfilter function='intersection'><groupfilter expression="ISMEMBEROF('west-team')" function='filter'><groupfilter function='union'><groupfilter function='member' level='[region]' member='"West"'/><groupfilter function='member' level='[region]' member='"North"'/></groupfilter></groupfilter></groupfilter></group>
</datasource>
<datasource name='ds2'><connection class='x'><relation type='text' name='Custom'>SELECT 1</relation></connection></datasource>
</datasources><worksheets><worksheet name='S1'><table><panes><pane><mark class='Bar'/></pane></panes><rows>[ds1].[sum:Calc1:qk]</rows><cols>[ds1].[none:region:nk]</cols><view><filter class='categorical' column='[ds1].[none:region:nk]'/></view></table></worksheet></worksheets></workbook>"""


def test_workbooks_run(spark, tmp_path):
    (tmp_path / "a.twbx").write_bytes(archive({"a.twb": WORKBOOK}))
    (tmp_path / "b.twb").write_bytes(b"<broken")
    rows = workbooks.read_workbooks(spark, str(tmp_path)).cache()
    assert rows.where("kind = 'problem'").count() == 1
    book = rows.where("kind = 'source'").first().workbook
    shelves = {(r.role, r.detail, r.type) for r in rows.where("kind = 'shelf'").collect()}
    assert shelves == {("rows", "Calc1", "sum"), ("cols", "region", "none")}
    tables = {"orders": spark.createDataFrame([(1, 10.0), (2, 5.0), (9, 1.0)], "cust int, amount double"), "people": spark.createDataFrame([(1, "West"), (2, "East")], "id int, region string")}
    sheet = workbooks.datasource(rows, book, "ds1", tables.__getitem__)
    got = {(r.region, r.g) for r in sheet.query({"region": "[region]"}, {"g": "[Gross]"}).collect()}
    assert got == {("West", 20.0), ("East", 10.0), (None, 2.0)}
    with pytest.raises(Refused):
        workbooks.datasource(rows, book, "ds2", tables.__getitem__)
    roles = workbooks.security_roles(rows)
    assert [(r.role, r.column, r.allowed) for r in roles.collect()] == [("west-team", "region", ["North", "West"])]
    files = text.role_files(roles.select(F.col("workbook").alias("model"), "role", F.lit("people").alias("table"), "column", "allowed")).collect()
    assert len(files) == 1 and '\'people\'[region] IN {"North", "West"}' in files[0].content and files[0].path == "definition/roles/west_team.tmdl"


def test_equal_column_names_of_a_join_keep_apart(spark, tmp_path):
    (tmp_path / "a.twbx").write_bytes(archive({"a.twb": WORKBOOK}))
    rows = workbooks.read_workbooks(spark, str(tmp_path))
    book = rows.where("kind = 'source'").first().workbook
    tables = {"orders": spark.createDataFrame([(1, 10.0, "o")], "cust int, amount double, region string"), "people": spark.createDataFrame([(1, "West")], "id int, region string")}
    sheet = workbooks.datasource(rows, book, "ds1", tables.__getitem__)
    got = sheet.query({"own": "[region]", "other": "[region (people)]"}, {"g": "[Gross]"}).collect()
    assert [(r.own, r.other, r.g) for r in got] == [("o", "West", 20.0)]


def test_groups_without_values_and_nested_groups():
    from xml.etree import ElementTree as ET

    group = ET.fromstring("""<group name='[g]'><groupfilter function='union'><groupfilter expression='false' function='filter'><groupfilter expression="ISMEMBEROF('a\\.b')"><groupfilter function='member' level='[r]' member='"x"'/></groupfilter></groupfilter>
    <groupfilter expression="ISMEMBEROF('none')"><groupfilter function='empty-level' member='[r]'/></groupfilter></groupfilter></group>""")
    assert sorted(r[2:4] + r[6:7] for r in workbooks._memberships("s", "g", group)) == [("r", "a.b", "x"), ("r", "none", None)]


def test_field_references_of_workbooks():
    assert workbooks.field_of("[ds].[none:Region:nk]") == ("ds", "Region") and workbooks.field_of("[ds].[Region]") == ("ds", "Region") and workbooks.field_of("Region") is None


def test_texts(spark, tmp_path):
    c = with_report(spark)
    files = {r.path: r.content for r in text.table_files(c).collect()}
    assert "measure 'Total Quantity' = SUM(Sales[Quantity])" in files["definition/tables/Sales.tmdl"] and "dataType: dateTime" in files["definition/tables/Date.tmdl"]
    script = text.cleanup_script(c).first().content.split("\n")
    assert script[-1] == 'Model.Tables["Metric Selector"].Delete();' and 'Model.Tables["Date"].Columns["Year"].Delete();' in script
    assert '"Customer" -> "Sales" [label="O:M", dir=both];' in text.diagram(c).first().content
    sets = {r.name: r for r in text.datasets(c, "main", "gold").collect()}
    assert sets["Sales"].source == "main.gold.sales" and {m.expression for m in sets["Sales"].measures} == {"COUNT(*)", "SUM(`Quantity`)"} and {m.measure for m in sets["Sales"].refused} == {"Total Sales", "Sales YTD"}
    spec = json.loads(text.dashboard_json(c, "main", "gold").first().content)
    assert len(spec["datasets"]) == 5 and {j["cardinality"] for j in spec["joins"]} == {"MANY_TO_ONE"}
    assert text.dashboard_json(c, "main", "gold").first() == text.dashboard_json(c, "main", "gold").first()
    nested = spark.createDataFrame([(1, ["a", 'b"'], None)], "i int, xs array<string>, n string")
    text.write_csv(nested, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").first()
    assert json.loads(back.xs) == ["a", 'b"'] and back.n is None
    assert set(text.data_dictionary(sample(spark))) == {"tables", "columns", "formulas", "relationships", "roles", "perspectives", "sources"}


def test_windows_are_equal_on_tables_and_streams(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:04:00", "a", 2.0), ("2024-01-01 00:11:00", "b", 5.0), ("2024-01-01 00:12:00", "a", 7.0)]
    df = spark.createDataFrame(rows, "at string, kind string, value double").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    wanted = {"m": "SUM(events[value])", "b": 'CALCULATE(COUNTROWS(events), events[kind] = "b")'}
    table = sorted(map(tuple, windowed(df, "at", "10 minutes", wanted).collect()))
    stream = windowed(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "at", "10 minutes", wanted)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == table and [r[2:] for r in table] == [(3.0, 0), (12.0, 1)]
    with pytest.raises(Refused):
        windowed(df, "at", "10 minutes", {"m": "SUM(events[nope])"})


def test_distinct_counts_are_exact_on_streams(spark, tmp_path):
    df = spark.range(12_000).select(F.timestamp_seconds(F.col("id") % 1200).alias("at"), F.concat(F.lit("k"), F.col("id") % 2).alias("kind"), F.when(F.col("id") % 7 > 0, F.col("id") % 4001).alias("value"))
    odd = spark.sql("SELECT timestamp_seconds(0) AS at, 'odd' AS kind, CAST(NULL AS bigint) AS value")
    df = df.union(odd).withColumn("real", F.when(F.col("value") % 3 == 0, F.lit(-0.0)).when(F.col("value") % 3 == 1, F.lit(0.0)).otherwise(F.lit(float("nan"))))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    wanted = {"n": "DISTINCTCOUNTNOBLANK(events[value])", "b": "DISTINCTCOUNT(events[value])", "r": "DISTINCTCOUNTNOBLANK(events[real])", "f": 'CALCULATE(DISTINCTCOUNTNOBLANK(events[value]), events[kind] = "k1")', "s": "SUM(events[value])"}
    table = sorted(map(tuple, windowed(df, "at", "10 minutes", wanted, ["kind"]).collect()))
    stream = windowed(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "at", "10 minutes", wanted, ["kind"], late="1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("distinct").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("distinct").collect())) == table and max(r[3] for r in table) > 2000
