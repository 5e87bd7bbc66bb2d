import pytest

from sparkloom.formulas.fields import Scope, has_aggregate, to_dax
from sparkloom.formulas.measures import to_sql
from sparkloom.formulas.syntax import Refused, parse_field, parse_measure

SQL = {
    "SUM('T'[a])": "SUM(`a`)",
    "AVERAGE(T[a])": "AVG(`a`)",
    "DISTINCTCOUNTNOBLANK([a])": "COUNT(DISTINCT `a`)",
    'CALCULATE(DISTINCTCOUNT(O[k]), O[s] = "F", KEEPFILTERS(O[p] <> "x\'y"))': "COUNT(DISTINCT CASE WHEN `s` = 'F' AND `p` <> 'x''y' THEN `k` END)",
    'COALESCE(CALCULATE(COUNTROWS(O), O[s] = "F"), 0)': "COALESCE(COUNT(CASE WHEN `s` = 'F' THEN 1 END), 0)",
    "COUNTROWS('My Table') // all": "COUNT(*)",
    'CALCULATE(SUM(O[a]), O[s] = "say ""hi"" -- no comment")': "SUM(CASE WHEN `s` = 'say \"hi\" -- no comment' THEN `a` END)",
}
REFUSED = ["COUNTROWS(FILTER(O, O[q] > 1))", "CALCULATE(SUM(O[a]), O[q] > 1)", "SUM(O[a]) / SUM(O[b])", "[M1] + [M2]", "TOTALYTD([Total], 'Date'[Date])", "SUMX(S, S[a] * S[b])", "", "-- nothing", "SUM(O[a]", "COALESCE(SUM(O[a]), [b])"]
DAX = {
    "[A] - [B] - [C]": "(('T'[A] - 'T'[B]) - 'T'[C])",
    "ZN(SUM([S]))/[N]": "(COALESCE(SUM('T'[S]), 0) / 'T'[N])",
    "SUM(IF [R]='West' THEN [S] END)": "SUMX('T', IF(('T'[R] = \"West\"), 'T'[S], BLANK()))",
    "CASE [R] WHEN 'E' THEN 1 ELSE 0 END": "SWITCH('T'[R], \"E\", 1, 0)",
    "[R] IN ('E','W')": "('T'[R] IN {\"E\", \"W\"})",
    "IIF([S] > 0, 'y', 'n')": "IF(('T'[S] > 0), \"y\", \"n\")",
    "MAX([A],[B])": "MAX('T'[A], 'T'[B])",
    "{FIXED [C]: SUM([S])}": "CALCULATE(SUM('T'[S]), ALLEXCEPT('T', 'T'[C]))",
    "{FIXED : SUM([S])}": "CALCULATE(SUM('T'[S]), ALL('T'))",
    "{EXCLUDE [C]: SUM([S])}": "CALCULATE(SUM('T'[S]), REMOVEFILTERS('T'[C]))",
    "{INCLUDE [A],[B]: AVG([S])}": "SUMX(SUMMARIZE('T', 'T'[A], 'T'[B]), CALCULATE(AVERAGE('T'[S])))",
    "NOT [a] = [b]": "NOT(('T'[a] = 'T'[b]))",
    "IF [a] > 1 THEN 2 END + 1": "(IF(('T'[a] > 1), 2, BLANK()) + 1)",
    "[Parameters].[P] * 2": "(SELECTEDVALUE('Parameters'[P]) * 2)",
}


@pytest.mark.parametrize(("text", "sql"), SQL.items())
def test_measure_sql(text, sql):
    assert to_sql(text) == (sql, "")


@pytest.mark.parametrize("text", REFUSED)
def test_refused_measures(text):
    sql, reason = to_sql(text)
    assert sql is None and reason


@pytest.mark.parametrize(("text", "dax"), DAX.items())
def test_field_dax(text, dax):
    assert to_dax(text, "T") == (dax, "")


@pytest.mark.parametrize("text", ["RUNNING_SUM(SUM([S]))", "STARTSWITH([S], 'a')", "{FIXED [a]: SUM({FIXED [b]: MAX([c])})}", "{INCLUDE : SUM([S])}", "{SUM([S])}", "IF [a] THEN 1", "RANK(SUM([S]))"])
def test_refused_fields(text):
    dax, reason = to_dax(text, "T")
    assert dax is None and reason


def test_unknown_field_is_refused():
    assert to_dax("[Nope] + 1", "T", frozenset({"S"}))[0] is None


def test_precedence():
    assert parse_field("a < b") if False else parse_field("1 + 2 * 3 = 7 AND NOT 1 = 2 OR TRUE")[1] == "||"
    assert parse_measure("T[a]") == ("field", "T", "a")


def test_calculated_fields_are_inlined_and_cycles_refused():
    scope = Scope({"x": None}, calculated={"a": "[b] + 1", "b": "[x] * 2", "c": "[d]", "d": "[c]"}, groups=frozenset({"g"}))
    assert scope.tree("[a]") == ("op", "+", ("op", "*", ("field", None, "x"), ("lit", 2)), ("lit", 1))
    for bad in ("[c]", "[g]", "[Parameters].[p]"):
        with pytest.raises(Refused):
            scope.tree(bad)
    assert has_aggregate(scope.tree("SUM([a])")) and not has_aggregate(scope.tree("[a]"))
