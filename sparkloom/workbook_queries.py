"""Registered queries that run workbooks: one for each nation, made from the tables, over the orders' star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.workbook_answers import answers, field_levels, questions_of
from .sources.workbooks import read_workbooks
from .storage import stored_zips

QUERIES, ORACLE_SQL = {}, {}


def registered(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


#: {n} is the nation's name, {k} its key, {s} a segment of customers that goes with the key.
WORKBOOK = """<workbook><datasources>
<datasource name="Parameters"><column name="[Parameter 1]" caption="Rate" param-domain-type="range" datatype="real" value="1.{k}"/></datasource>
<datasource name="lake.1" caption="Sales"><connection class="lake">
<relation type="join" join="inner"><clause><expression op="="><expression op="[customer].[c_nationkey]"/><expression op="[nation].[n_nationkey]"/></expression></clause>
<relation type="join" join="inner"><clause><expression op="="><expression op="[orders].[o_custkey]"/><expression op="[customer].[c_custkey]"/></expression></clause><relation type="table" name="orders" table="[dbo].[orders]"/><relation type="table" name="customer" table="[dbo].[customer]"/></relation>
<relation type="table" name="nation" table="[dbo].[nation]"/></relation></connection>
<column name="[Calc 3]" caption="Share" role="measure" datatype="real"><calculation class="tableau" formula="SUM([Calc 1]) / MAX([Calc 2])"/></column>
<column name="[Calc 1]" caption="Net" role="measure" datatype="real"><calculation class="tableau" formula="[o_totalprice] * [Parameters].[Parameter 1]"/></column>
<column name="[Calc 2]" caption="All of segment" role="measure" datatype="real"><calculation class="tableau" formula="{{FIXED [c_mktsegment] : SUM([Net])}}"/></column>
<column name="[Calc 4]" caption="Loop" datatype="real"><calculation class="tableau" formula="[Calc 5] + 1"/></column>
<column name="[Calc 5]" caption="Back" datatype="real"><calculation class="tableau" formula="[Loop] - 'not [Calc 1]'"/></column>
<column name="[Calc 6]" caption="Size" datatype="string"><calculation class="tableau" formula="IF [o_totalprice] &gt; 100000 * {k} THEN 'big' ELSE 'small' END"/></column>
<group name="[RLS]"><groupfilter function="union"><groupfilter expression="ISMEMBEROF('team\\.{n}')" function="filter"><groupfilter function="member" level="[c_mktsegment]" member="&quot;{s}&quot;"/><groupfilter function="member" level="[c_mktsegment]" member="&quot;BUILDING&quot;"/></groupfilter><groupfilter expression="ISMEMBEROF('nobody')" function="filter"><groupfilter function="empty-level" member="[c_mktsegment]"/></groupfilter></groupfilter></group>
</datasource></datasources><worksheets>
<worksheet name="Sales {n}"><table><view><filter class="categorical" column="[lake.1].[none:n_name:nk]"><groupfilter function="member" level="[none:n_name:nk]" member="&quot;{n}&quot;"/></filter><filter class="quantitative" column="[lake.1].[none:o_totalprice:qk]" included-values="in-range"><min>1000</min><max>250000.5</max></filter></view>
<panes><pane><mark class="Bar"/></pane></panes><rows>([lake.1].[sum:Calc 1:qk] + [lake.1].[usr:Calc 3:qk])</rows><cols>[lake.1].[none:c_mktsegment:nk]</cols></table></worksheet>
<worksheet name="Years {n}"><table><view><filter class="categorical" column="[lake.1].[none:o_orderstatus:nk]"><groupfilter function="except"><groupfilter function="level-members" level="[none:o_orderstatus:nk]"/><groupfilter function="member" level="[none:o_orderstatus:nk]" member="&quot;P&quot;"/></groupfilter></filter></view>
<panes><pane><mark class="Line"/></pane></panes><rows>[lake.1].[cnt:o_orderkey:qk] [lake.1].[ctd:o_custkey:qk]</rows><cols>[lake.1].[yr:o_orderdate:ok] [lake.1].[none:Calc 6:nk]</cols></table></worksheet>
<worksheet name="Broken {n}"><table><view/><panes><pane><mark class="Text"/></pane></panes><rows>[lake.1].[sum:Calc 4:qk]</rows><cols/></table></worksheet>
</worksheets></workbook>"""
_SEGMENTS = ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def nation_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("s", F.element_at(F.array(*map(F.lit, _SEGMENTS)), (F.col("n_nationkey") % 4 + 1).cast("int")))
    text = F.lit(WORKBOOK.replace("{{", "{").replace("}}", "}"))
    for mark, column in (("{n}", "n_name"), ("{k}", "n_nationkey"), ("{s}", "s")):
        text = F.replace(text, F.lit(mark), F.col(column).cast("string"))
    rows = nation.select(F.concat(F.lit("w"), F.col("n_nationkey").cast("string")).alias("model"), F.lit("book.twb").alias("member"), text.alias("text"))
    return read_workbooks(spark, stored_zips(rows, "running", "twbx")).withColumn("workbook", F.regexp_extract("workbook", r"([^/]+)\.twbx$", 1))


_BOOKS = f"""WITH books AS (SELECT 'w' || n_nationkey AS workbook, n_name AS n, n_nationkey AS k, CAST('1.' || n_nationkey AS DOUBLE) AS rate, list_value({', '.join(f"'{s}'" for s in _SEGMENTS)})[CAST(n_nationkey % 4 + 1 AS INT)] AS s FROM nation)"""


@registered(f"""{_BOOKS} SELECT workbook, 'lake.1' AS source, field, CAST(level AS INT) AS level FROM books CROSS JOIN (VALUES ('Calc 1', 0), ('Calc 2', 1), ('Calc 3', 2), ('Calc 4', NULL), ('Calc 5', NULL), ('Calc 6', 0)) AS f(field, level)""")
def wb_field_levels(spark, d):
    return field_levels(nation_workbooks(spark, d))


@registered(f"""{_BOOKS}, seen AS (SELECT b.*, o.*, c_mktsegment, n_name FROM books b, orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', b.s)),
fixed AS (SELECT *, sum(o_totalprice * rate) OVER (PARTITION BY workbook, c_mktsegment) AS whole FROM seen),
sales AS (SELECT workbook, n, c_mktsegment, sum(o_totalprice * rate) AS net, sum(o_totalprice * rate) / max(whole) AS share FROM fixed WHERE n_name = n AND o_totalprice BETWEEN 1000 AND 250000.5 GROUP BY 1, 2, 3),
years AS (SELECT workbook, n, year(o_orderdate) AS y, CASE WHEN o_totalprice > 100000 * k THEN 'big' ELSE 'small' END AS size, count(o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers FROM seen WHERE o_orderstatus <> 'P' GROUP BY ALL)
SELECT workbook, sheet, 'team.' || n AS role, keys, measure, round(value, 6) AS value FROM (
SELECT workbook, n, 'Sales ' || n AS sheet, 'none:c_mktsegment=' || c_mktsegment AS keys, 'sum:Calc 1' AS measure, net AS value FROM sales UNION ALL SELECT workbook, n, 'Sales ' || n, 'none:c_mktsegment=' || c_mktsegment, 'usr:Calc 3', share FROM sales
UNION ALL SELECT workbook, n, 'Years ' || n, 'yr:o_orderdate=' || y || '; none:Calc 6=' || size, 'cnt:o_orderkey', orders FROM years UNION ALL SELECT workbook, n, 'Years ' || n, 'yr:o_orderdate=' || y || '; none:Calc 6=' || size, 'ctd:o_custkey', customers FROM years)""")
def wb_sheets(spark, d):
    rows = answers(nation_workbooks(spark, d), lambda t: spark.read.parquet(f"{d}/{t}.parquet")).rows
    return rows.withColumn("value", F.round("value", 6))


@registered(f"{_BOOKS} SELECT workbook, 'Broken ' || n AS sheet, '[Calc 4]: calculated fields refer to each other' AS problem FROM books")
def wb_problems(spark, d):
    return questions_of(nation_workbooks(spark, d), lambda t: spark.read.parquet(f"{d}/{t}.parquet"))[1]
