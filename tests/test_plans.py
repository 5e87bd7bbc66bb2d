import pytest
from pyspark.sql import functions as F

from sparkloom.formulas.syntax import Refused
from sparkloom.plans.sheets import Sheet
from sparkloom.plans.star import Relationship, StarModel


@pytest.fixture(scope="module")
def model(spark):
    sales = spark.createDataFrame([(1, 1, 10.0, "a"), (2, 1, 20.0, "b"), (3, None, 5.0, "a"), (4, 9, 7.0, None)], "id int, cust int, amount double, tag string")
    customers = spark.createDataFrame([(1, "West", 1), (2, "East", 2)], "cust int, region string, nation int")
    returns = spark.createDataFrame([(1, 1, 1.0), (2, 2, 2.0)], "id int, cust int, lost double")
    nations = spark.createDataFrame([(1, "N1"), (2, "N2")], "nation int, name string")
    rels = [Relationship("sales", "cust", "customers", "cust"), Relationship("returns", "cust", "customers", "cust", both=True), Relationship("customers", "nation", "nations", "nation")]
    return StarModel({"sales": sales, "customers": customers, "returns": returns, "nations": nations}, rels, roles={"west": {"customers": 'customers[region] = "West"'}, "lossy": {"returns": "returns[lost] > 1"}, "n1": {"nations": 'nations[name] = "N1"'}})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_facts_survive_missing_dimensions(model):
    assert rows(model.query({"region": ("customers", "region")}, {"m": "SUM(sales[amount])"})) == [("West", 30.0), (None, 12.0)]


def test_two_facts_join_on_nulls_too(model):
    got = rows(model.query({"region": ("customers", "region")}, {"m": "SUM(sales[amount])", "l": "SUM(returns[lost])"}))
    assert got == [("East", None, 2.0), ("West", 30.0, 1.0), (None, 12.0, None)]


def test_only_needed_tables_are_read(model):
    plan = model.query({"tag": ("sales", "tag")}, {"m": "COUNTROWS(sales)"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_roles_restrict_what_they_reach(model):
    assert rows(model.query({}, {"m": "COUNTROWS(sales)"}, role="west")) == [(2,)]
    assert rows(model.query({}, {"m": "COUNTROWS(customers)"}, role="lossy")) == [(1,)]  # back over a relationship that filters both ways
    assert rows(model.query({}, {"m": "COUNTROWS(sales)"}, role="n1")) == [(2,)]  # two steps
    assert rows(model.query({}, {"m": "COUNTROWS(nations)"}, role="west")) == [(2,)]  # many to one: not reached


def test_refusals(model):
    for dims, measures in (({"t": ("sales", "tag")}, {"m": "COUNTROWS(customers)"}), ({"t": (None, "nope")}, {"m": "COUNTROWS(sales)"}), ({}, {"m": "SUM(sales[nope])"}), ({"t": (None, "cust")}, {"m": "COUNTROWS(nations)"})):
        with pytest.raises(Refused):
            model.query(dims, measures)


def test_ambiguous_paths_are_refused(spark):
    t = lambda *c: spark.createDataFrame([tuple([1] * len(c))], ", ".join(f"{x} int" for x in c))
    m = StarModel({"f": t("a", "b"), "x": t("a", "n"), "y": t("b", "n"), "z": t("n", "v")}, [Relationship("f", "a", "x", "a"), Relationship("f", "b", "y", "b"), Relationship("x", "n", "z", "n"), Relationship("y", "n", "z", "n")])
    with pytest.raises(Refused, match="2 paths"):
        m.query({"v": ("z", "v")}, {"m": "COUNTROWS(f)"})


def test_blank_counts_once_if_asked(model):
    assert rows(model.query({}, {"m": "DISTINCTCOUNT(sales[tag])"})) == [(2,)]
    assert rows(model.query({}, {"m": "DISTINCTCOUNT(sales[tag])"}, count_blank=True)) == [(3,)]


@pytest.fixture(scope="module")
def sheet(spark):
    data = [("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 5.0), (None, "x", 7.0), ("b", "x", None)]
    return Sheet(spark.createDataFrame(data, "g string, h string, v double"), calculated={"double": "[v] * 2"}, parameters={"P": 4})


def test_levels_of_detail(sheet):
    assert rows(sheet.query({"g": "[g]"}, {"m": "SUM([v])", "all": "{FIXED : SUM([v])}"})) == [("a", 4.0, 16.0), ("b", 5.0, 16.0), (None, 7.0, 16.0)]
    assert rows(sheet.query({"g": "[g]"}, {"m": "MAX({FIXED [h]: SUM([v])})"})) == [("a", 13.0), ("b", 13.0), (None, 13.0)]
    assert rows(sheet.query({"g": "[g]", "h": "[h]"}, {"e": "{EXCLUDE [h]: SUM([v])}"})) == [("a", "x", 4.0), ("a", "y", 4.0), ("b", "x", 5.0), (None, "x", 7.0)]
    assert rows(sheet.query({"g": "[g]"}, {"i": "{INCLUDE [h]: MAX([v])}"})) == [("a", 4.0), ("b", 5.0), (None, 7.0)]
    # ordinary filters don't reach FIXED
    assert rows(sheet.query({"g": "[g]"}, {"m": "MAX({FIXED : SUM([v])})"}, where="[g] = 'a'")) == [("a", 16.0)]


def test_fixed_equals_group_and_join(sheet):
    base = sheet.rows
    want = base.groupBy("g").agg(F.sum("v").alias("s"))
    got = sheet.rows_with({"g": "[g]", "s": "{FIXED [g]: SUM([v])}"}).distinct()
    assert rows(got) == rows(want)


def test_rows_and_refusals(sheet):
    assert rows(sheet.rows_with({"d": "[double]", "q": "[v] / ([v] - 1)", "p": "[v] > [Parameters].[P]", "s": "[g] + '-' + [h]"}, where="[g] = 'a'")) == [(2.0, None, False, "a-x"), (6.0, 1.5, False, "a-y")]
    for bad in ({"m": "[v]"}, {"m": "SUM(SUM([v]))"}, {"m": "{FIXED [h]: SUM([v])}"}):
        with pytest.raises(Refused):
            sheet.query({"g": "[g]"}, bad)


# --- associative filters ---


def test_selections_reach_up_and_down(model):
    from sparkloom.plans.associative import Associations

    a = Associations(model, {("nations", "name"): ["N1"], ("sales", "tag"): ["a", None]})
    assert rows(a.values(("customers", "region"))) == [("East", 1, 0), ("West", 1, 1)]
    assert rows(a.values(("returns", "id"))) == [(1, 1, 1), (2, 1, 0)]
    assert rows(a.values(("sales", "tag"))) == [("a", 2, 1), ("b", 1, 1), (None, 1, 0)]  # its own selection doesn't bear on it
    assert rows(a.values(("nations", "name"))) == [("N1", 1, 1), ("N2", 1, 0)]
    assert rows(Associations(model, {("sales", "id"): "sales[amount] > 6"}).values(("sales", "tag"))) == [("a", 2, 1), ("b", 1, 1), (None, 1, 1)]
    assert rows(Associations(model, {}).values(("sales", "tag"))) == [("a", 2, 2), ("b", 1, 1), (None, 1, 1)]


def test_roles_hide_rows_of_associations(model):
    from sparkloom.plans.associative import Associations

    west = Associations(model, {("customers", "region"): ["East", "West"]}, role="west")
    assert rows(west.values(("sales", "tag"))) == [("a", 1, 1), ("b", 1, 1)]
    assert rows(west.all_values([("customers", "region"), ("returns", "id")])) == [("customers[region]", "West", 1, 1), ("returns[id]", "1", 1, 1)]
    assert rows(Associations(model, {("sales", "tag"): ["a"]}, role="n1").values(("customers", "region"))) == [("West", 1, 1)]


def test_rows_of_associations_never_multiply(model):
    from sparkloom.plans.associative import Associations

    plan = Associations(model, {("sales", "tag"): ["a"], ("returns", "lost"): "returns[lost] > 0"}).values(("nations", "name"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner" not in plan and "Cross" not in plan and plan.count("LeftSemi") == 2


def test_two_ways_to_a_selection_are_refused(model):
    from sparkloom.plans.associative import Associations

    twice = StarModel(model.tables, [*model.relationships, Relationship("sales", "id", "nations", "nation")])
    with pytest.raises(Refused, match="2 paths"):
        Associations(twice, {("nations", "name"): ["N1"]}).values(("customers", "region"))
    with pytest.raises(Refused, match="unknown"):
        Associations(model, {("nations", "nothing"): ["N1"]})


# --- medians and levels of detail ---


@pytest.mark.parametrize("few", [0, 100])
def test_exact_medians(spark, monkeypatch, few):
    import random
    from statistics import median

    from sparkloom.plans import selection

    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.choice([1e-300, -1e300, 0.0, -0.0, 2.5, -2.5, 1e17, rng.gauss(0, 1), rng.gauss(0, 1e-9), None])) for _ in range(900)]
    data += [("one", 7.0), ("none", None), ("two", 1.0), ("two", 2.0), ("same", 3.0), ("same", 3.0), ("even", 1.0), ("even", 1.0), ("even", 5.0), ("even", 9.0)]
    df = spark.createDataFrame(data, "g string, v double")
    groups = {}
    for g, v in data:
        groups.setdefault(g, []).append(v)
    want = {g: median(own) if (own := [v for v in vs if v is not None]) else None for g, vs in groups.items()}
    assert {r.g: r.m for r in selection.medians(df, ["g"], F.col("v"), "m").collect()} == want
    every = [v for _, v in data if v is not None]
    assert [tuple(r) for r in selection.medians(df, [], F.col("v"), "m").collect()] == [(median(every),)]
    weighted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    assert {r.g: r.m for r in selection.medians(weighted, ["g"], F.col("v"), "m", F.col("w")).collect()} == want


def test_no_task_holds_a_groups_values(spark):
    """Half of all rows in one group: what each pass reads is dealt by value, not by group."""
    from sparkloom.plans import selection

    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 97).cast("string")).alias("g"), F.hash("id").cast("double").alias("v"))
    selection.FEW, before = 0, selection.FEW
    try:
        got = {r.g: r.m for r in selection.medians(df, ["g"], F.col("v"), "m").collect()}
    finally:
        selection.FEW = before
    assert got == {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}


def test_levels_share_one_grouping(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "x", 3.0, 1), ("a", "y", 5.0, 2), ("b", "x", 7.0, 2), ("b", None, None, 3), (None, "y", 11.0, 3)], "g string, h string, v double, k int")
    s = Sheet(df, {"of k": "{FIXED [k]: SUM([v])}", "big": "{FIXED [k]: SUM([v])} > 8"})
    made = s.query({"g": "[g]"}, {"n": "{FIXED [g]: AVG({FIXED [g], [h]: SUM([v])})}", "all": "{FIXED : COUNT([v])}", "md": "MEDIAN([v])", "vr": "VAR([v])", "d": "COUNTD([h])"})
    assert "LogicalRDD" not in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and "LocalRelation" not in plan  # the rows themselves
    assert rows(made) == [("a", 13 / 3, 5, 3.0, 4.0, 2), ("b", 7.0, 5, 7.0, None, 1), (None, 11.0, 5, 11.0, None, 1)]
    got = {r.big: (r.s, r.f) for r in s.query({"big": "[big]"}, {"s": "SUM([v])", "f": "SUM([of k])"}).collect()}
    assert got == {False: (4.0, 8.0), True: (23.0, 46.0)}
    assert rows(s.query({"g": "[g]"}, {"s": "SUM([v])"}, where="[of k] > 4 AND [v] > 4")) == [("a", 5.0), ("b", 7.0), (None, 11.0)]
    assert rows(s.rows_with({"k": "[k]", "share": "[v] / [of k]"}, where="[v] > 6")) == [(2, 7.0 / 12.0), (3, 1.0)]
    assert rows(s.query({"g": "[g]"}, {"m": "MEDIAN({INCLUDE [h]: SUM([v])})", "e": "{EXCLUDE [g]: MEDIAN([v])}"})) == [("a", 4.5, 5.0), ("b", 7.0, 5.0), (None, 11.0, 5.0)]
    with pytest.raises(Refused, match="FIXED"):
        s.query({"g": "[g]"}, {"n": "{FIXED [g]: AVG({INCLUDE [h]: SUM([v])})}"})
    with pytest.raises(Refused, match="aggregate"):
        s.query({"g": "[g]"}, {"n": "{FIXED [g]: [v]}"})
