import io
import zipfile

from pyspark.sql import functions as F

import sample_model as samples
from sparkloom.catalog import Catalog
from sparkloom.functions import expressions as X
from sparkloom.functions import names as N
from sparkloom.operators import audits, comparison, model_graph, references, reports
from sparkloom.sources.archives import read_models


def archive(texts: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in texts.items():
            z.writestr(name, text)
    return out.getvalue()


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "e string").select(column).first()[0]


def test_archives_are_read_and_bad_ones_reported(spark, tmp_path):
    texts = samples.archive_texts()
    (tmp_path / "good.vpax").write_bytes(archive({**texts, "Model.bim": "﻿" + texts["Model.bim"]}))
    (tmp_path / "short.vpax").write_bytes(archive({"Model.bim": "{}"}))
    (tmp_path / "list.vpax").write_bytes(archive({**texts, "Model.bim": "[1]"}))
    (tmp_path / "text.vpax").write_bytes(b"hello")
    catalog, problems = read_models(spark, str(tmp_path))
    bad = {r.model.rsplit("/", 1)[-1]: r.problem for r in problems.collect()}
    assert set(bad) == {"short.vpax", "list.vpax", "text.vpax"} and "missing" in bad["short.vpax"] and "zip" in bad["text.vpax"]
    assert catalog.columns.count() == 19 and catalog.measures.count() == 4 and catalog.relationships.count() == 3
    assert {r.marker for r in catalog.columns.where("column = 'Metric Fields'").collect()} == {True}
    assert model_graph.schema_shape(catalog).first().shape == "Star"


def test_tokens_skip_strings_and_comments(spark):
    text = "VAR x = \"[No]\" -- [Neither]\nRETURN SUM('My ''T'[A]]b]) /* [Nor] */ + [M] + Sales [C] // 'U'[v]"
    refs = [(r.table, r.name) for r in one(spark, text, X.references("e"))]
    assert refs == [("My 'T", "A]b"), (None, "M"), ("Sales", "C")]
    assert one(spark, text, X.tables("e")) == ["My 'T", "Sales"]


def test_normal_forms(spark):
    assert one(spark, 'SUMX( Sales ,\n  Sales[a] * 2 ) -- x\n & "North  West"', X.normalised("e")) == 'SUMX(Sales,Sales[a]*2)&"North  West"'
    a, b = (one(spark, f"VAR {v} = SUM(T[a]) RETURN {v} + 1", X.fingerprint("e")) for v in ("s", "total"))
    assert a == b and "_1+1" in a
    assert one(spark, None, X.normalised("e")) == ""
    assert one(spark, "VAR  x=1 /* y */RETURN x+'My T' [A  b] & \"a\"\"b\" -- end", X.normalised("e")) == "VAR x=1 RETURN x+'My T'[A  b]&\"a\"\"b\""


def test_names(spark):
    cases = {"total_orders": "snake_case", "TotalOrders": "PascalCase", "totalOrders": "camelCase", "Total orders": "Title Case With Spaces", "total-Orders x": "Other/mixed"}
    for name, want in cases.items():
        assert one(spark, name, N.convention("e")) == want
    for to, want in {"snake_case": "sale_amt_2", "PascalCase": "SaleAmt2", "camelCase": "saleAmt2", "Title Case With Spaces": "Sale Amt 2"}.items():
        assert one(spark, "sale-Amt2", N.converted("e", F.lit(to))) == want
    assert one(spark, "Net Sales (USD)", N.slug("e")) == "net_sales_usd"
    assert one(spark, "a", N.stable_id(F.col("e"), F.lit("b"))) == one(spark, "a", N.stable_id(F.col("e"), F.lit("b")))


def test_sql_sources(spark):
    sql = "WITH c AS (SELECT * FROM raw.t1), d AS (SELECT 1) SELECT 'from x.y' FROM c JOIN [dbo].[Orders] o ON 1=1 -- from no.where\n LEFT JOIN \"s\".\"u\" ON EXISTS (SELECT 1 FROM `a`.b.c2)"
    assert one(spark, sql, X.sql_sources("e")) == ["raw.t1", "dbo.Orders", "s.u", "a.b.c2"]
    assert one(spark, 'let q = "SELECT a#(lf)FROM t -- ""x""" in q', X.sql_of("e")) == 'SELECT a\nFROM t -- "x"'
    assert one(spark, 'let q = "no statement here" in q', X.sql_of("e")) == ""


def test_models_of_an_estate_stay_apart(spark):
    rows = [("m1", "T", "A", "[B]"), ("m2", "T", "B", "[A]"), ("m2", "T", "A", "1")]
    c = Catalog.empty(spark, measures=spark.createDataFrame(rows, "model string, table string, measure string, expression string"))
    assert [tuple(r) for r in references.measure_edges(c).collect()] == [("m2", "B", "A")]
    assert references.measure_cycles(c).count() == 0


def test_empty_catalogs_give_no_findings(spark):
    c = Catalog.empty(spark)
    for df in (audits.health(c), audits.naming(c), audits.readiness(c), audits.encoding_advice(c), model_graph.role_reach(c), reports.cleanup_plan(c), references.unused_columns(c), reports.lineage(c)):
        assert df.count() == 0


def test_encoding_advice(spark):
    columns = [("m", "T", "a", "Int64", "HASH", 10_000_000, 5_000_000, False, True), ("m", "T", "b", "String", "HASH", 8_000_000, 7_000_000, True, True), ("m", "T", "c", "String", "HASH", 10, 10, False, True), ("m", "T", "d", "String", "VALUE", 6_000_000, 0, False, False)]
    c = Catalog.empty(
        spark,
        columns=spark.createDataFrame(columns, "model string, table string, column string, data_type string, encoding string, total_size bigint, dictionary_size bigint, hidden boolean, in_mdx boolean"),
        segments=spark.createDataFrame([("m", "T", "d", "NOSPLIT", 3), ("m", "T", "d", None, 8)], "model string, table string, column string, compression string, bits int"),
        tables=spark.createDataFrame([("m", "T", 100)], "model string, table string, rows_count bigint"),
    )
    got = {r.object: (r.severity, r.distinct) for r in audits.encoding_advice(c).collect()}
    assert got == {"T[a]": ("High", None), "T[b]": ("High", None), "T[d]": ("High", 100)}


def test_cleaned_catalog(spark):
    from sample_model import with_report

    c = with_report(spark)
    after = reports.cleaned(c)
    assert "Metric Selector" not in {r.table for r in after.tables.collect()}
    assert ("Customer", "internal_notes") not in {(r.table, r.column) for r in after.columns.collect()}
    assert after.relationships.count() == 3


def test_source_escapes(spark):
    for text, want in (("a#(0041)#(lf,0001F600)b", "aA\n\U0001F600b"), ("#(zz)#(#)(lf)#", "#(zz)#(lf)#"), ("#(cr, lf)#(tab)", "\r\n\t"), ("", "")):
        assert one(spark, text, X.decoded(F.col("e"))) == want


def test_words_of_names(spark):
    for name, want in (("HTTPServer2Go", "HTTPServer,2,Go"), ("2ndPlace abc123def_x", "2nd,Place,abc,123def,x"), ("ÄrgerLevel-9 é", "Ärger,Level,9,é"), ("__", "")):
        assert ",".join(one(spark, name, N.words("e"))) == want


def test_copies_are_paired_with_the_first_only(spark):
    rows = [("A", "SUM(T[amount]) - SUM(T[cost])"), ("B", "SUM( T[amount] ) - SUM(T[cost])"), ("C", "sum(T[amount]) - SUM(T[cost]) -- same"), ("D", "SUM(T[amount]) - SUM(T[cost]) + 0")]
    m = spark.createDataFrame([("m", "T", n, e) for n, e in rows], "model string, table string, measure string, expression string")
    got = {(r.measure_a, r.measure_b) for r in comparison.near_duplicate_measures(Catalog.empty(spark, measures=m)).collect()}
    assert got == {("A", "B"), ("A", "C"), ("A", "D")}


def test_self_diff_is_empty(spark):
    from sample_model import sample
    from sparkloom.operators import comparison

    c = sample(spark)
    assert comparison.measure_changes(c, c).count() == 0 and comparison.structure_changes(c, c).count() == 0


QUERY_SHAPES = {
    "SELECT * FROM a, b AS x, c y WHERE 1 = 1": "a b c",
    "SELECT a.x, (SELECT max(v) FROM d) FROM a LEFT JOIN b ON a.k = b.k, c": "d a b c",
    "WITH t AS (SELECT * FROM a), u AS (SELECT * FROM t JOIN b USING (k, l)) SELECT * FROM u, t": "a b",
    "WITH t AS (SELECT * FROM t) SELECT * FROM t": "t",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t) SELECT * FROM t JOIN z ON true": "z",
    "SELECT * FROM (WITH t AS (SELECT * FROM a) SELECT * FROM t) q JOIN t ON q.x = t.x": "a t",
    "WITH t AS (SELECT 1) SELECT * FROM s.t, [dbo].[t], \"x y\".`z`": "s.t dbo.t xy.z",
    "SELECT EXTRACT(YEAR FROM d), trim(both FROM x) FROM a WHERE x IS DISTINCT FROM y": "a",
    "SELECT * FROM (a JOIN (b JOIN c ON 1 = 1) ON 2 = 2) WHERE EXISTS (SELECT 1 FROM e WHERE e.k = a.k)": "a b c e",
    "SELECT * FROM unnest(xs), generate_series(1, 2) g, LATERAL (SELECT * FROM f) z, h": "f h",
    "SELECT 'x FROM no', \"from\" FROM a -- FROM no\n JOIN b /* , no */ ON 1 = 1 UNION SELECT * FROM c ORDER BY 1, 2": "a b c",
    "WITH t AS (SELECT * FROM a) SELECT * FROM t; SELECT * FROM t": "a t",
    "SELECT * FROM a WITH (NOLOCK), b": "a b",
    "": "", "SELECT 1": "", "FROM a SELECT x": "a",
}


def test_tables_of_queries_with_scopes(spark):
    df = spark.createDataFrame([(q,) for q in QUERY_SHAPES], "e string").withColumn("t", F.array_join(X.sql_sources("e"), " "))
    assert {r.e: r.t for r in df.collect()} == QUERY_SHAPES
