"""Formulas over one row, tables of accepted and refused ones."""

from datetime import date, datetime

import pytest

from lattiq.errors import UnsupportedCalc
from lattiq.operators.model import Model
from lattiq.plans.graph import coverage, infer_row_level, layers, lineage
from lattiq.plans.nodes import Binary, Lit
from lattiq.plans.parser import parse
from lattiq.plans.view import measure_level, with_calcs

ACCEPTED = [
    ("1 + 2 * 3", 7),
    ("-2 ^ 2", 4.0),
    ("2 ^ 3 ^ 2", 512.0),
    ("7 / 2", 3.5),
    ("1 / 0", None),
    ("DIV(-7, 2)", -3),
    ("DIV(7, 0)", None),
    ("MOD(-7, 3)", 2),
    ("7 % -3", -2),
    ("MOD(7, 0)", None),
    ("ROUND(-2.5)", -3.0),
    ("ROUND(1.256, 2)", 1.26),
    ("CEILING(-1.5)", -1),
    ("FLOOR(-1.5)", -2),
    ("INT(-7.9)", -7),
    ("LOG(1000)", 3.0),
    ("ROUND(LOG(8, 2), 6)", 3.0),
    ("ATAN2(0, 0)", 0.0),
    ("SIGN(-3)", -1),
    ("MIN(3, 5) + MAX(2.5, 1)", 5.5),
    ("MIN(3, NULL)", None),
    ("LEN('abc')", 3),
    ("MID('abcd', 2)", "bcd"),
    ("MID('abcd', 2, 2)", "bc"),
    ("REPLACE('a.b', '.', '-')", "a-b"),
    ("CONTAINS('abc', 'B')", False),
    ("FIND('abc', 'z')", 0),
    ("FIND('abcb', 'b', 3)", 4),
    ("FINDNTH('abcb', 'b', 2)", 4),
    ("FINDNTH('abcb', 'b', 3)", 0),
    ("PROPER('hELLO wORLD-x')", "Hello World-X"),
    ("CHAR(65) + CHAR(955)", "Aλ"),
    ("ASCII('A')", 65),
    ("SPACE(2) + 'x'", "  x"),
    ("'a' + NULL", None),
    ("'it''s' + \" \"\"q\"\"\"", "it's \"q\""),
    ("SPLIT('a-b-c', '-', -1)", "c"),
    ("REGEXP_EXTRACT('a12', '([0-9]+)')", "12"),
    ("IF FALSE THEN 1 END", None),
    ("IF NULL THEN 1 ELSE 2 END", 2),
    ("CASE 'a' WHEN 'A' THEN 1 ELSE 0 END", 0),
    ("IIF(NULL = 1, 1, 2, 3)", 3),
    ("TRUE AND NULL", None),
    ("TRUE OR NULL", True),
    ("NOT FALSE AND FALSE", False),
    ("'a' IN ('A', 'b')", False),
    ("ISNULL(NULL)", True),
    ("ZN(NULL + 1)", 0),
    ("IFNULL(NULL, 5)", 5),
    ("'a' = 'A'", False),
    ("2 >= 1.5 // a comment", True),
    ("1 /* one */ + 1", 2),
    ("#2024-01-02#", date(2024, 1, 2)),
    ("#January 2, 2024#", date(2024, 1, 2)),
    ("#2024-03-01# - #2024-02-01#", 29),
    ("#2024-02-28# + 2", date(2024, 3, 1)),
    ("WEEK(#2024-01-07#)", 2),
    ("WEEK(#2023-01-01#)", 1),
    ("ISOWEEK(#2024-12-30#)", 1),
    ("ISOYEAR(#2024-12-30#)", 2025),
    ("ISOWEEKDAY(#2024-01-07#)", 7),
    ("DATEPART('weekday', #2024-01-07#)", 1),
    ("DATENAME('month', #2024-01-07#)", "January"),
    ("DATENAME('weekday', #2024-01-31#)", "Wednesday"),
    ("DATEDIFF('month', #2024-01-31#, #2024-02-01#)", 1),
    ("DATEDIFF('year', #2023-12-31#, #2024-01-01#)", 1),
    ("DATEDIFF('week', #2024-01-06#, #2024-01-07#)", 1),
    ("DATEDIFF('week', #2024-01-07#, #2024-01-06#)", -1),
    ("DATEDIFF('hour', #2024-01-31 10:20:30#, #2024-02-01 00:00:01#)", 14),
    ("DATEADD('month', 1, #2024-01-31 10:20:30#)", datetime(2024, 2, 29, 10, 20, 30)),
    ("DATETRUNC('month', #2024-01-31 10:20:30#)", datetime(2024, 1, 1)),
    ("DATETRUNC('week', #2024-01-10#)", datetime(2024, 1, 7)),
    ("MAKEDATE(2024, 2, 29)", date(2024, 2, 29)),
    ("MAKEDATETIME(#2024-01-02#, #2024-05-06 03:04:05#)", datetime(2024, 1, 2, 3, 4, 5)),
    ("DATEPARSE('yyyy/MM/dd', '2024/01/02')", datetime(2024, 1, 2)),
    ("ISDATE('2024-13-01')", False),
    ("YEAR(TODAY())", 2024),
    ("[Parameters].[P] + 1", 4),
    ("[n] + [Number of Records]", 6),
]
REFUSED = [
    ("[nowhere]", "field"),
    ("[n] + 'x'", "type"),
    ("IF TRUE THEN 1 ELSE 'x' END", "type"),
    ("IF 1 THEN 2 END", "type"),
    ("SUM([n]) + [n]", "grain"),
    ("SUM(SUM([n]))", "grain"),
    ("SUM([s])", "type"),
    ("LEFT([n], 2)", "type"),
    ("DATEDIFF('fortnight', [d], [d])", "function"),
    ("DATEPART([s], [d])", "function"),
    ("SCRIPT_REAL('x', SUM([n]))", "function"),
    ("RAWSQL_INT('1')", "function"),
    ("NOSUCH(1)", "function"),
    ("LEN()", "function"),
    ("#01-02-2000#", "syntax"),
    ("'a\\b'", "syntax"),
    ("1 +", "syntax"),
    ("(1", "syntax"),
    ("IF TRUE THEN 1", "syntax"),
    ("{FIXED [n] : [n]}", "lod"),
    ("{INCLUDE : SUM([n])}", "lod"),
    ("{INCLUDE [s] : AVG({FIXED [s] : SUM([n])})}", "lod"),
    ("COUNTD({FIXED [s] : SUM([n])})", "lod"),
    ("RUNNING_SUM([n])", "grain"),
    ("TOTAL(RUNNING_SUM(SUM([n])))", "table calc"),
    ("WINDOW_SUM(SUM([n]), -1)", "table calc"),
    ("WINDOW_SUM(SUM([n]), 'x', 1, 2)", "table calc"),
    ("[Parameters].[Q]", "parameter"),
    ("[loop]", "cycle"),
    ("[arr]", "type"),
    ("[other].[n]", "field"),
]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(5, "x", date(2024, 1, 31), [1])], "n int, s string, d date, arr array<int>")
    return Model.single(df, calcs={"loop": "[back] + 1", "back": "[loop]"}, params={"P": 3}, anchor=datetime(2024, 5, 6, 7, 8, 9))


@pytest.fixture(scope="module")
def row(model):
    # All formulas in one plan: a job each would take most of the time.
    return with_calcs(model, {f"c{i}": f for i, (f, _) in enumerate(ACCEPTED)}).first()


@pytest.mark.parametrize("i", range(len(ACCEPTED)), ids=[f for f, _ in ACCEPTED])
def test_value(row, i):
    got, want = row[f"c{i}"], ACCEPTED[i][1]
    assert type(got) is type(want) and (got == want or isinstance(want, float) and abs(got - want) < 1e-9)


@pytest.mark.parametrize("formula,category", REFUSED, ids=[f for f, _ in REFUSED])
def test_refused(model, formula, category):
    with pytest.raises(UnsupportedCalc) as e:
        measure_level(model, formula)
    assert e.value.category == category


def test_signs_and_powers():
    assert parse("-2 ^ 2") == Binary("^", Lit(-2, "int"), Lit(2, "int"))
    assert parse("a(1)" if False else "1 - -1") == Binary("-", Lit(1, "int"), Lit(-1, "int"))


def test_ambiguous_captions_fail_closed(spark):
    from lattiq.operators.model import Table

    df = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(UnsupportedCalc):
        measure_level(Model([Table("a", df), Table("b", df)]), "[k]")
    assert measure_level(Model([Table("a", df), Table("b", df)]), "[a].[k]") == "row"


def test_graph(spark):
    calcs = {"a": "[n] + 1", "b": "SUM([a])", "c": "[b] / [d]", "d": "[c]", "e": "[Parameters].[P]"}
    assert layers(calcs) == ([["a", "e"], ["b"]], ["c", "d"])
    assert lineage(calcs)["c"].calcs == ("b", "d") and lineage(calcs)["e"].params == ("P",)
    model = Model.single(spark.createDataFrame([(1,)], "n int"), calcs=calcs, params={"P": 1})
    assert coverage(model) == {"a": "row", "b": "agg", "c": "refused: cycle", "d": "refused: cycle", "e": "const"}
    assert infer_row_level(model)["a"] and not infer_row_level(model)["b"]
