"""Registered queries of the semantic engine over the star model of the test tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import profile, relational
from .plans.associative import Associations
from .plans.sheets import Sheet
from .plans.star import Relationship, StarModel
from .storage import shuffles_for

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
RELATIONSHIPS = [
    Relationship("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Relationship("lineitem", "l_partkey", "part", "p_partkey"),
    Relationship("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Relationship("orders", "o_custkey", "customer", "c_custkey", both=True),
    Relationship("customer", "c_nationkey", "nation", "n_nationkey"),
    Relationship("nation", "n_regionkey", "region", "r_regionkey"),
    Relationship("supplier", "s_nationkey", "nation", "n_nationkey", active=False),
]
ROLES = {
    "Asia": {"region": 'region[r_name] = "ASIA"'},
    "Segments": {"customer": 'customer[c_mktsegment] IN {"BUILDING", "MACHINERY"}'},
    "Urgent": {"orders": 'orders[o_orderpriority] = "1-URGENT"'},
}
MEASURES = {
    "Building sales": 'COALESCE(CALCULATE(SUM(lineitem[l_extendedprice]), customer[c_mktsegment] = "BUILDING"), 0)',
    "Lines": "COUNTROWS(lineitem)",
    "Orders": "COUNTROWS(orders)",
}

#: Rows of a sheet for each partition of its shuffles, as a grouping may leave nearly as many.
ROWS_A_PART = 1_000_000

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def star(spark: SparkSession, sf_dir: str) -> StarModel:
    return StarModel({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}, RELATIONSHIPS, MEASURES, ROLES)


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def sheet(model: StarModel, *tables: str, **kw) -> Sheet:
    """The first table's rows, with those of further tables that it has paths to, under their own names."""
    rows = model.tables[tables[0]]
    shuffles_for(rows.sparkSession, rows.count(), ROWS_A_PART)  # from the file's footers
    refs = {(t, c) for t in tables for c in model.tables[t].columns}
    rows = model.frame(tables[0], refs)
    return Sheet(rows.select(*(F.col(f"`{t}.{c}`").alias(c) for t, c in sorted(refs))), **kw)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# --- measures ---

STAR = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@registered("SELECT l_returnflag, count(*) AS m FROM lineitem GROUP BY 1")
def dax_countrows(spark, d):
    return star(spark, d).query({"l_returnflag": ("lineitem", "l_returnflag")}, {"m": "Lines"})


@registered("SELECT l_linestatus, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS mn, max(l_quantity) AS mx, count(l_quantity) AS c FROM lineitem GROUP BY 1")
def dax_sum_avg_min_max_count(spark, d):
    names = {"s": "SUM", "a": "AVERAGE", "mn": "MIN", "mx": "MAX", "c": "COUNT"}
    return rounded(star(spark, d).query({"l_linestatus": ("lineitem", "l_linestatus")}, {n: f"{f}(lineitem[l_quantity])" for n, f in names.items()}), s=2, a=6)


@registered("SELECT o_orderpriority, count(DISTINCT o_custkey) AS m, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def dax_distinctcount(spark, d):
    return star(spark, d).query({"o_orderpriority": ("orders", "o_orderpriority")}, {"m": "DISTINCTCOUNT(orders[o_custkey])", "n": "DISTINCTCOUNTNOBLANK(orders[o_custkey])"})


@registered("SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS m FROM orders GROUP BY 1")
def dax_calculate_eq(spark, d):
    return rounded(star(spark, d).query({"o_orderpriority": ("orders", "o_orderpriority")}, {"m": 'CALCULATE(SUM(orders[o_totalprice]), orders[o_orderstatus] = "F")'}), m=2)


@registered("SELECT o_orderpriority, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS m FROM orders GROUP BY 1")
def dax_calculate_ne_keepfilters(spark, d):
    return star(spark, d).query({"o_orderpriority": ("orders", "o_orderpriority")}, {"m": 'CALCULATE(COUNTROWS(orders), KEEPFILTERS(orders[o_orderstatus] <> "F"))'})


@registered("SELECT l_returnflag, count(DISTINCT CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'N' THEN l_suppkey END) AS m FROM lineitem GROUP BY 1")
def dax_calculate_multi_distinct(spark, d):
    return star(spark, d).query({"l_returnflag": ("lineitem", "l_returnflag")}, {"m": 'CALCULATE(DISTINCTCOUNT(lineitem[l_suppkey]), lineitem[l_linestatus] = "O", lineitem[l_returnflag] <> "N")'})


@registered("SELECT c_mktsegment, coalesce(sum(CASE WHEN c_name = 'nobody' THEN c_acctbal END), 0) AS m FROM customer GROUP BY 1")
def dax_coalesce_default(spark, d):
    return star(spark, d).query({"c_mktsegment": ("customer", "c_mktsegment")}, {"m": 'COALESCE(CALCULATE(SUM(customer[c_acctbal]), customer[c_name] = "nobody"), 0)'})


@registered(f"SELECT r_name, coalesce(round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN l_extendedprice END), 2), 0) AS m {STAR} GROUP BY 1")
def dax_cross_table_filter(spark, d):
    return rounded(star(spark, d).query({"r_name": ("region", "r_name")}, {"m": "Building sales"}), m=2)


@registered("SELECT c_mktsegment, o.n AS orders, l.n AS lines FROM (SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o FULL JOIN (SELECT c_mktsegment, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1) l USING (c_mktsegment)")
def dax_two_facts(spark, d):
    return star(spark, d).query({"c_mktsegment": ("customer", "c_mktsegment")}, {"orders": "Orders", "lines": "Lines"})


# --- widgets and relationships ---


@registered("SELECT count(*) AS m FROM events")
def widget_counter(spark, d):
    return star(spark, d).query({}, {"m": "COUNTROWS(events)"})


@registered("SELECT event_type, user_id, count(*) AS c, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def widget_table(spark, d):
    return rounded(star(spark, d).query({"event_type": ("events", "event_type"), "user_id": ("events", "user_id")}, {"c": "COUNTROWS(events)", "v": "SUM(events[value])"}), v=4)


@registered("SELECT event_type, CAST(count_if(value > 50) AS BIGINT) AS associated FROM events GROUP BY 1")
def widget_filter_select(spark, d):
    return star(spark, d).filter_values(("events", "event_type"), "events[value] > 50")


#: Customers of two segments, by role, who live in a region and have ordered a small part; what each field's values have left.
_SEEN = """WITH c AS (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
asian AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE'))), small AS (SELECT p_partkey FROM part WHERE p_size <= 5),
with_small AS (SELECT o_orderkey, o_custkey FROM o WHERE o_totalprice > 50000 AND o_orderkey IN (SELECT l_orderkey FROM l WHERE l_partkey IN (SELECT p_partkey FROM small)))"""


@registered(f"""{_SEEN}
SELECT 'customer[c_mktsegment]' AS field, c_mktsegment AS value, count(*) AS n_rows, CAST(count_if(c_nationkey IN (SELECT * FROM asian) AND c_custkey IN (SELECT o_custkey FROM with_small)) AS BIGINT) AS n_possible FROM c GROUP BY 2
UNION ALL SELECT 'region[r_name]', r_name, count(*), CAST(count_if(r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c WHERE c_custkey IN (SELECT o_custkey FROM with_small)))) AS BIGINT) FROM region GROUP BY 2
UNION ALL SELECT 'part[p_size]', CAST(p_size AS VARCHAR), count(*), CAST(count_if(p_partkey IN (SELECT l_partkey FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM o WHERE o_totalprice > 50000 AND o_custkey IN (SELECT c_custkey FROM c WHERE c_nationkey IN (SELECT * FROM asian))))) AS BIGINT) FROM part GROUP BY 2
UNION ALL SELECT 'lineitem[l_returnflag]', l_returnflag, count(*), CAST(count_if(l_partkey IN (SELECT * FROM small) AND l_orderkey IN (SELECT o_orderkey FROM o WHERE o_totalprice > 50000 AND o_custkey IN (SELECT c_custkey FROM c WHERE c_nationkey IN (SELECT * FROM asian)))) AS BIGINT) FROM l GROUP BY 2""")
def widget_filter_related(spark, d):
    chosen = {("region", "r_name"): ["ASIA", "EUROPE"], ("part", "p_size"): "part[p_size] <= 5", ("orders", "o_totalprice"): "orders[o_totalprice] > 50000"}
    return Associations(star(spark, d), chosen, role="Segments").all_values([("customer", "c_mktsegment"), ("region", "r_name"), ("part", "p_size"), ("lineitem", "l_returnflag")])


@registered(f"SELECT r_name, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev {STAR} GROUP BY 1, 2")
def rel_star_join(spark, d):
    s = sheet(star(spark, d), "lineitem", "orders", "customer", "nation", "region", calculated={"net": "[l_extendedprice] * (1 - [l_discount])"})
    return rounded(s.query({"r_name": "[r_name]", "l_returnflag": "[l_returnflag]"}, {"rev": "SUM([net])"}), rev=2)


@registered("SELECT count(*) AS c FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def rel_bidirectional(spark, d):
    return star(spark, d).query({}, {"c": "COUNTROWS(customer)"}, role="Urgent")


@registered("SELECT o_orderpriority, count(*) AS c FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') GROUP BY 1")
def rls_dimension_role(spark, d):
    return star(spark, d).query({"o_orderpriority": ("orders", "o_orderpriority")}, {"c": "Orders"}, role="Asia")


@registered("SELECT o_orderstatus, count(*) AS c FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) GROUP BY 1")
def rls_membership_in(spark, d):
    return star(spark, d).query({"o_orderstatus": ("orders", "o_orderstatus")}, {"c": "Orders"}, role="Segments")


# --- workbook fields ---


@registered("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS BIGINT) AS n, left(p_name, 3) AS lf, right(p_name, 2) AS rt, substr(p_name, 2, 3) AS md, replace(p_name, 'a', '-') AS rp, trim(p_type) AS t FROM part")
def tab_string_funcs(spark, d):
    return sheet(star(spark, d), "part").rows_with(
        {"p_partkey": "[p_partkey]", "u": "UPPER([p_name])", "l": "LOWER([p_brand])", "n": "LEN([p_name])", "lf": "LEFT([p_name], 3)", "rt": "RIGHT([p_name], 2)", "md": "MID([p_name], 2, 3)", "rp": "REPLACE([p_name], 'a', '-')", "t": "TRIM([p_type])"}
    )


@registered("SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, round(l_extendedprice, 1) AS r, CAST(ceil(l_tax * 100) AS BIGINT) AS c, CAST(floor(l_tax * 100) AS BIGINT) AS f, round(sqrt(l_quantity), 8) AS s, round(ln(l_quantity), 8) AS n, round(exp(l_tax), 8) AS e, round(log10(l_quantity), 8) AS g FROM lineitem")
def tab_math_funcs(spark, d):
    wanted = {"l_orderkey": "[l_orderkey]", "l_linenumber": "[l_linenumber]", "a": "ABS([l_discount] - 0.05)", "r": "ROUND([l_extendedprice], 1)", "c": "CEILING([l_tax] * 100)", "f": "FLOOR([l_tax] * 100)"}
    wanted |= {"s": "ROUND(SQRT([l_quantity]), 8)", "n": "ROUND(LN([l_quantity]), 8)", "e": "ROUND(EXP([l_tax]), 8)", "g": "ROUND(LOG([l_quantity]), 8)"}
    return sheet(star(spark, d), "lineitem").rows_with(wanted)


@registered("SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, count(*) AS c FROM orders GROUP BY 1, 2, 3")
def tab_date_parts(spark, d):
    return sheet(star(spark, d), "orders").query({"y": "YEAR([o_orderdate])", "m": "MONTH([o_orderdate])", "d": "DAY([o_orderdate])"}, {"c": "COUNT([o_orderkey])"})


@registered("SELECT l_orderkey, l_linenumber, date_diff('month', o_orderdate, l_shipdate) AS mm, date_diff('day', o_orderdate, l_shipdate) AS dd FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def tab_datediff(spark, d):
    return sheet(star(spark, d), "lineitem", "orders").rows_with({"l_orderkey": "[l_orderkey]", "l_linenumber": "[l_linenumber]", "mm": "DATEDIFF('month', [o_orderdate], [l_shipdate])", "dd": "DATEDIFF('day', [o_orderdate], [l_shipdate])"})


@registered("SELECT CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'mid' ELSE 'neg' END AS b, count(*) AS c FROM customer GROUP BY 1")
def tab_if_elseif(spark, d):
    return sheet(star(spark, d), "customer").query({"b": "IF [c_acctbal] > 5000 THEN 'high' ELSEIF [c_acctbal] > 0 THEN 'mid' ELSE 'neg' END"}, {"c": "COUNT([c_custkey])"})


@registered("SELECT CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE 'Other' END AS s, count(*) AS c FROM orders GROUP BY 1")
def tab_case(spark, d):
    return sheet(star(spark, d), "orders").query({"s": "CASE [o_orderstatus] WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE 'Other' END"}, {"c": "COUNT([o_orderkey])"})


@registered("SELECT l_returnflag, sum(coalesce(CASE WHEN l_linestatus = 'O' THEN l_quantity END, 0)) AS z, count(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS c FROM lineitem GROUP BY 1")
def tab_iif_zn_ifnull(spark, d):
    s = sheet(star(spark, d), "lineitem", calculated={"open": "IIF([l_linestatus] = 'O', [l_quantity])"})
    return s.query({"l_returnflag": "[l_returnflag]"}, {"z": "SUM(ZN([open]))", "c": "COUNT([open])"})


@registered("SELECT CAST(l_linenumber AS STRING) AS k, sum(coalesce(CASE WHEN l_linestatus = 'O' THEN l_quantity END, 1)) AS filled, count(CASE WHEN l_linestatus <> 'O' THEN 1 END) AS missing, count(CASE WHEN l_shipdate < now() THEN 1 END) AS past FROM lineitem GROUP BY 1")
def tab_null_funcs(spark, d):
    s = sheet(star(spark, d), "lineitem", calculated={"open": "IIF([l_linestatus] = 'O', [l_quantity])", "gone": "IIF([l_shipdate] < NOW() AND [l_shipdate] <= TODAY(), 1)"})
    return s.query({"k": "STR([l_linenumber])"}, {"filled": "SUM(IFNULL([open], 1))", "missing": "COUNT(IIF(ISNULL([open]), 1))", "past": "COUNT([gone])"})


@registered("SELECT p_brand, count(*) AS c FROM part WHERE contains(p_name, 'a') AND p_size IN (1, 2, 3, 4, 5) GROUP BY 1")
def tab_contains_in(spark, d):
    return sheet(star(spark, d), "part").query({"p_brand": "[p_brand]"}, {"c": "COUNT([p_partkey])"}, where="CONTAINS([p_name], 'a') AND [p_size] IN (1, 2, 3, 4, 5)")


@registered("SELECT l_linenumber % 3 AS k, count(*) AS c FROM lineitem WHERE NOT (l_quantity < 10 OR l_discount = 0) AND -l_tax <= 0 GROUP BY 1")
def tab_bool_arith_mod(spark, d):
    return sheet(star(spark, d), "lineitem").query({"k": "[l_linenumber] % 3"}, {"c": "COUNT([l_orderkey])"}, where="NOT ([l_quantity] < 10 OR [l_discount] = 0) AND -[l_tax] <= 0")


@registered("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS q FROM lineitem")
def tab_div_zero(spark, d):
    return sheet(star(spark, d), "lineitem").rows_with({"l_orderkey": "[l_orderkey]", "l_linenumber": "[l_linenumber]", "q": "[l_extendedprice] / [l_discount]"})


@registered("SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 2) AS s, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS d FROM lineitem GROUP BY 1")
def tab_agg_over_if(spark, d):
    return rounded(sheet(star(spark, d), "lineitem").query({"l_linestatus": "[l_linestatus]"}, {"s": "SUM(IF [l_returnflag] = 'R' THEN [l_extendedprice] END)", "d": "COUNTD(IF [l_returnflag] = 'R' THEN [l_partkey] END)"}), s=2)


@registered("SELECT l_returnflag, median(l_quantity) AS md, round(stddev_samp(l_quantity), 8) AS sd, round(var_samp(l_quantity), 8) AS vr FROM lineitem GROUP BY 1")
def tab_stats(spark, d):
    return rounded(sheet(star(spark, d), "lineitem").query({"l_returnflag": "[l_returnflag]"}, {"md": "MEDIAN([l_quantity])", "sd": "STDEV([l_quantity])", "vr": "VAR([l_quantity])"}), sd=8, vr=8)


@registered("SELECT c_custkey, greatest(c_acctbal, 0.0::DOUBLE, 100.0::DOUBLE) AS g, least(c_acctbal, 0.0::DOUBLE) AS l FROM customer")
def tab_nary_minmax(spark, d):
    return sheet(star(spark, d), "customer").rows_with({"c_custkey": "[c_custkey]", "g": "MAX([c_acctbal], 0.0, 100.0)", "l": "MIN([c_acctbal], 0.0)"})


@registered("SELECT CASE WHEN o_totalprice > 100000 THEN 'big ' || o_orderpriority ELSE o_orderstatus || '!' END AS k, count(*) AS c FROM orders GROUP BY 1")
def tab_concat_parameter(spark, d):
    s = sheet(star(spark, d), "orders", parameters={"Limit": 100000})
    return s.query({"k": "IF [o_totalprice] > [Parameters].[Limit] THEN 'big ' + [o_orderpriority] ELSE [o_orderstatus] + '!' END"}, {"c": "COUNT([o_orderkey])"})


@registered("SELECT o_orderpriority, round(avg(f), 6) AS m FROM (SELECT o_orderpriority, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS f FROM orders) GROUP BY 1")
def tab_lod_fixed(spark, d):
    return rounded(sheet(star(spark, d), "orders").query({"o_orderpriority": "[o_orderpriority]"}, {"m": "AVG({FIXED [o_custkey]: SUM([o_totalprice])})"}), m=6)


@registered("SELECT o_orderpriority, round(sum(o_totalprice) / max(t), 10) AS m FROM orders, (SELECT sum(o_totalprice) AS t FROM orders) GROUP BY 1")
def tab_lod_fixed_all(spark, d):
    return rounded(sheet(star(spark, d), "orders").query({"o_orderpriority": "[o_orderpriority]"}, {"m": "SUM([o_totalprice]) / {FIXED : SUM([o_totalprice])}"}), m=10)


@registered("SELECT a.l_returnflag, a.l_linestatus, a.q, b.q AS ex FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1) b USING (l_returnflag)")
def tab_lod_exclude(spark, d):
    return sheet(star(spark, d), "lineitem").query({"l_returnflag": "[l_returnflag]", "l_linestatus": "[l_linestatus]"}, {"q": "SUM([l_quantity])", "ex": "{EXCLUDE [l_linestatus]: SUM([l_quantity])}"})


@registered("SELECT o_orderpriority, round(sum(m), 4) AS v, round(max(m), 6) AS mx FROM (SELECT o_orderpriority, o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1")
def tab_lod_include(spark, d):
    s = sheet(star(spark, d), "orders")
    return rounded(s.query({"o_orderpriority": "[o_orderpriority]"}, {"v": "{INCLUDE [o_custkey]: AVG([o_totalprice])}", "mx": "MAX({INCLUDE [o_custkey]: AVG([o_totalprice])})"}), v=4, mx=6)


@registered("""WITH r AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS s, avg(l_extendedprice) OVER (PARTITION BY l_returnflag, ship_year) AS f, median(l_quantity) OVER (PARTITION BY ship_year) AS md FROM (SELECT *, extract('year' FROM l_shipdate) AS ship_year FROM lineitem)),
n AS (SELECT *, avg(s) OVER (PARTITION BY l_linestatus) AS nested FROM r), o AS (SELECT * FROM n WHERE l_quantity > 10),
i AS (SELECT l_returnflag, l_linestatus, max(a) AS inc FROM (SELECT l_returnflag, l_linestatus, l_suppkey, avg(l_extendedprice) AS a FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2),
e AS (SELECT l_returnflag, sum(l_quantity) AS ex FROM o GROUP BY 1)
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, round(stddev_samp(l_extendedprice), 4) AS sd, count(DISTINCT l_partkey) AS parts, round(avg(f), 4) AS f, round(sum(CASE WHEN l_extendedprice > f THEN 1 ELSE 0 END)) AS above, round(max(nested), 4) AS nested, round(sum(md), 2) AS md, any_value(ex) AS ex, round(any_value(inc), 4) AS inc
FROM o JOIN i USING (l_returnflag, l_linestatus) JOIN e USING (l_returnflag) GROUP BY 1, 2""")
def tab_lod_lattice(spark, d):
    s = sheet(star(spark, d), "lineitem", calculated={"year": "YEAR([l_shipdate])", "mean of year": "{FIXED [l_returnflag], [year]: AVG([l_extendedprice])}", "of supplier": "{FIXED [l_suppkey]: SUM([l_quantity])}"})
    wanted = {"q": "SUM([l_quantity])", "sd": "STDEV([l_extendedprice])", "parts": "COUNTD([l_partkey])", "f": "AVG([mean of year])", "above": "SUM(IF [l_extendedprice] > [mean of year] THEN 1 ELSE 0 END)", "nested": "{FIXED [l_linestatus]: AVG([of supplier])}"}
    wanted |= {"md": "SUM({FIXED [year]: MEDIAN([l_quantity])})", "ex": "{EXCLUDE [l_linestatus]: SUM([l_quantity])}", "inc": "MAX({INCLUDE [l_suppkey]: AVG([l_extendedprice])})"}
    out = s.query({"l_returnflag": "[l_returnflag]", "l_linestatus": "[l_linestatus]"}, wanted, where="[l_quantity] > 10")
    return rounded(out, sd=4, f=4, nested=4, md=2, inc=4)


@registered("SELECT o_orderpriority, c_mktsegment, median(o_totalprice) AS md, median(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS filled, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def tab_median(spark, d):
    return sheet(star(spark, d), "orders", "customer").query({"o_orderpriority": "[o_orderpriority]", "c_mktsegment": "[c_mktsegment]"}, {"md": "MEDIAN([o_totalprice])", "filled": "MEDIAN(IF [o_orderstatus] = 'F' THEN [o_totalprice] END)", "c": "COUNT([o_orderkey])"})


@registered("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 8) AS unit_rev FROM lineitem GROUP BY 1")
def tab_nested_calc(spark, d):
    s = sheet(star(spark, d), "lineitem", calculated={"unit": "SUM([net]) / SUM([l_quantity])", "net": "[l_extendedprice] * [share]", "share": "1 - [l_discount]"})
    return rounded(s.query({"l_returnflag": "[l_returnflag]"}, {"unit_rev": "[unit]"}), unit_rev=8)


# --- catalog and relational operators ---


@registered("SELECT l_suppkey AS k, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY c DESC, k LIMIT 20")
def cat_cardinality_top20(spark, d):
    return profile.top_values(star(spark, d).tables["lineitem"], "l_suppkey", 20).toDF("k", "c")


@registered("SELECT 'orders' AS t, 'o_custkey' AS c, count(DISTINCT o_custkey) AS d, count(*) AS n, count(*) - count(o_custkey) AS nulls FROM orders UNION ALL SELECT 'orders', 'o_orderstatus', count(DISTINCT o_orderstatus), count(*), count(*) - count(o_orderstatus) FROM orders UNION ALL SELECT 'nation', 'n_name', count(DISTINCT n_name), count(*), count(*) - count(n_name) FROM nation")
def cat_profile(spark, d):
    tables = star(spark, d).tables
    return profile.columns({"orders": tables["orders"].select("o_custkey", "o_orderstatus"), "nation": tables["nation"].select("n_name")})


@registered("SELECT o_orderpriority AS m FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_orderpriority LIMIT 1")
def cat_mode(spark, d):
    return profile.most_frequent(star(spark, d).tables["orders"], "o_orderpriority").toDF("m")


@registered("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)an') OR regexp_matches(p_type, '(?i)an')")
def cat_search_ci(spark, d):
    return relational.search(star(spark, d).tables["part"], "an", ["p_name", "p_type"]).select("p_partkey")


@registered("SELECT p_partkey FROM (SELECT p_partkey, count(*) OVER (PARTITION BY lower(trim(p_name)), p_brand, p_size) AS n FROM part) WHERE n > 1")
def cat_dups(spark, d):
    return relational.repeated(star(spark, d).tables["part"], [F.lower(F.trim("p_name")), F.col("p_brand"), F.col("p_size")]).select("p_partkey")


@registered("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS ch FROM (SELECT o_orderstatus AS k, count(*) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) a FULL JOIN (SELECT o_orderstatus AS k, count(*) AS v FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice > 50000 GROUP BY 1) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def model_diff(spark, d):
    orders = star(spark, d).tables["orders"]
    side = lambda df: df.groupBy(F.col("o_orderstatus").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return relational.changes(side(orders.where("o_orderstatus <> 'F'")), side(orders.where("o_orderstatus <> 'O' AND o_totalprice > 50000")), ["k"], ["v"]).select("k", F.col("change").alias("ch"))


@registered("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10")
def struct_except(spark, d):
    tables = star(spark, d).tables
    return tables["customer"].select(F.col("c_nationkey").alias("k")).subtract(tables["supplier"].where("s_nationkey < 10").select("s_nationkey"))


@registered("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS v FROM nation GROUP BY 1")
def list_agg(spark, d):
    return relational.listed(star(spark, d).tables["nation"], ["n_regionkey"], "n_name").toDF("n_regionkey", "v")


@registered("SELECT p_partkey FROM part ANTI JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) ON p_partkey = l_partkey")
def unused_keys_anti(spark, d):
    tables = star(spark, d).tables
    return relational.unreferenced(tables["part"].select("p_partkey"), tables["lineitem"].where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])
