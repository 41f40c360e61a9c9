"""Model objects, comparison, similarity and sources over small tables."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.errors import UnsupportedCalc
from lattiq.operators import derived, layout, reconcile, relational
from lattiq.operators import similarity as sim
from lattiq.operators.components import connected_components
from lattiq.operators.idioms import argmax_members
from lattiq.operators.model import Model, key_confidence, key_like
from lattiq.operators.profile import auto_grain, profile
from lattiq.sources.readers import Connection, decide, jdbc_options, match_headers, read_csv, read_sql, sql_parameters, table_name
from lattiq.sources.writers import enriched, extract_to_csv, materialise, write_csv


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_profile_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (3, None)], "x int, s string")
    got = {r["column"]: r for r in profile(df).collect()}
    assert got["x"]["null_count"] == 1 and got["x"]["avg"] == 2.0 and got["s"]["cardinality"] == 1 and got["s"]["null_rate"] == 0.3333
    assert {r["column"]: r["null_rate"] for r in profile(df.limit(0)).collect()} == {"x": None, "s": None}
    assert auto_grain(spark.createDataFrame([(1, i % 3, i) for i in range(100)], "one int, few int, many int")) == ["few"]


def test_groups_with_many_members_join(spark):
    df = spark.createDataFrame([(str(i),) for i in range(400)] + [(None,)], "k string")
    groups = {"low": [str(i) for i in range(150)], "high": [str(i) for i in range(100, 300)]}
    joined, chained = derived.with_group(df, "k", groups, "g"), df.withColumn("g", derived.group_column(F.col("k"), groups))
    assert rows(joined) == rows(chained)


def test_parameter_ranges(spark):
    assert derived.parameter_range(0, None, 5, 10) == (0.0, 100.0, 5.0, 10.0)
    assert derived.parameter_range(0, 1e9, 1, 0)[1] == 9999.0
    assert [r[0] for r in derived.parameter_series(spark, 1, 3, 1, 9).collect()] == [1.0, 2.0, 3.0, 9.0]
    assert derived.parameter_series(spark, 0, 1, 0.1, 0.3).count() == 11


def test_calendar_of_nothing(spark):
    assert derived.calendar_of(spark.createDataFrame([], "d date"), "d").count() == 0
    days = derived.calendar(spark, date(2024, 3, 1), date(2024, 3, 2))
    assert days.count() == 366 and days.filter("`Week of Month` > 6").count() == 0
    assert derived.primary_date({"a": "date", "b": "datetime"}) is None and derived.primary_date({"a": "date", "b": "text"}) == "a"


def test_row_filter_fails_closed(spark):
    df = spark.createDataFrame([("u",), ("v",)], "who string")
    assert rows(derived.row_filter(df, "[who] = USERNAME()", "u")) == [("u",)]
    for formula in ("TRUE", "[who] <> USERNAME()", "[x] = USERNAME()", "((", "[who] = USERNAME() OR TRUE"):
        assert derived.row_filter(df, formula, "u").count() == 0


def test_argmax_keeps_ties(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "g string, m string")
    assert rows(argmax_members(df, ["g"], "m", F.count(F.lit(1)))) == sorted([("a", "x", 1), ("a", "y", 1), (None, "z", 1)], key=repr)


def test_keys():
    assert key_like("customers", "Customer_ID") and key_like("x", "pk") and not key_like("orders", "customer_id")
    assert [key_confidence("int", "n"), key_confidence("text", "user_id"), key_confidence("text", "s"), key_confidence("date", "d")] == ["high", "high", "low", "medium"]


@pytest.mark.parametrize("a,b,want", [((1, 5), (1, 5), "equal"), ((2, 4), (1, 5), "subset"), ((1, 5), (2, 4), "superset"), ((1, 3), (2, 5), "partial"), ((1, 2), (3, 4), "disjoint"), ((None, 2), (3, 4), "unknown"), ((5, 1), (1, 5), "equal")])
def test_ranges(spark, a, b, want):
    lit = lambda v: F.lit(v).cast("double")
    assert spark.range(1).select(reconcile.range_relationship(*map(lit, (*a, *b)))).first()[0] == want


def test_scalars_compare(spark):
    one = lambda a, b, **k: spark.range(1).select(reconcile.compare_scalars(F.lit(a).cast("double"), F.lit(b).cast("double"), **k)).first()[0]
    assert [one(None, None), one(None, 0.0), one(None, 0.0, blank_is_zero=False), one(1.0, 1.0 + 1e-12), one(1.0, 1.0 + 1e-12, exact=True), one(1.0, 2.0)] == ["verified", "verified", "mismatch", "verified", "mismatch", "mismatch"]


def test_verdicts_of_tables(spark):
    a = spark.createDataFrame([(date(2024, 1, i), float(i)) for i in range(1, 20)], "d date, v double")
    windows, probes = reconcile.plan_probes(a, a, measures=["v"])
    assert windows == ["d"]
    check = lambda x, y, w: tuple(reconcile.verdict_of(reconcile.verify_tables(x, y, w, probes)).first())[:2]
    recent, other = a.filter("d > '2024-01-10'"), a.withColumn("v", F.col("v") * 3)
    assert check(recent, a, windows) == ("verified", "subset")
    assert check(a, other, windows) == ("mismatch", "equal")
    assert check(a, a.withColumn("d", F.col("d") + 100), windows)[0] == "mismatch"
    assert check(recent, a, []) == ("compatible", "subset")
    assert check(a.limit(0), a, windows)[0] == "compatible"  # no rows are within any rows


def test_ranked_candidates(spark):
    m = Model.single(spark.createDataFrame([("a", 1.0, 2.0), ("b", 5.0, 6.0)], "g string, x double, y double"))
    assert [g for _, g in reconcile.rank_candidates(m, "SUM([x])", ["SUM([y])", "AVG([x]) * COUNT([x])", "nonsense("])] == ["high", "medium", "low"]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 360)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.range(400).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long"))
    assert dict(tuple(r) for r in got.collect()) == {i: find(i) for i in range(400)}


def inventory(spark, assets):
    return spark.createDataFrame(assets, sim.INVENTORY)


def test_matching(spark):
    def asset(i, name, cols, table):
        return (i, name, [(c, t) for c, t in cols], [("sqlserver", "db", table)] if table else [], [])

    sales = [("Net Bookings", "REAL"), ("Order ID", "INTEGER"), ("Region", "STRING")]
    left = inventory(spark, [asset("l1", "Sales Orders", sales, "fact_sales"), asset("l2", "HR data", [("Salary", "REAL")], None), asset("l3", "Sales Order", sales, "fact_sales")])
    right = inventory(spark, [asset("r1", "sales-orders", [(c, {"REAL": "double", "INTEGER": "int64", "STRING": "string"}[t]) for c, t in sales], "fact_sales"), asset("r2", "Weather", [("Rain", "double")], None)])
    got = {(r["left_id"], r["right_id"]): r for r in sim.compare_inventories(left, right).collect()}
    assert got["l1", "r1"]["score"] == 1.0 and got["l1", "r1"]["tier"] == "Exact" and got["l1", "r1"]["rank"] == 1
    assert got["l3", "r1"]["name_score"] == round(0.9 * 2 * 10 / 21, 4)
    assert got["l2", "r2"]["source_score"] is None and got["l2", "r2"]["bucket"] == "rebuild"
    c = sim.compare_inventories(left, right)
    assert {(r["left_id"], r["right_id"]) for r in sim.assign_one_to_one(c).collect()} >= {("l1", "r1")}
    assert {r["left_id"]: r["contested"] for r in sim.contested(c).collect()} == {"l1": True, "l3": True}
    assert [r["id"] for r in sim.unmatched(right, c).collect()] == ["r2"]
    assert {r["left_id"]: r["review"] for r in sim.review(c).collect()} == {"l1": None, "l2": "likely_rebuild", "l3": None}
    levels = {r["left_id"]: (r["confidence"], r["mutual"]) for r in sim.confidence(c).collect()}
    assert levels["l1"] == ("Medium", True) and levels["l3"] == ("Medium", False) and levels["l2"][0] == "High"


def test_assignment_equals_the_greedy_order(spark):
    rng = random.Random(3)
    pairs = [(f"l{a}", f"r{b}", rng.randrange(1, 6) / 5) for a in range(12) for b in range(9) if rng.random() < 0.5]
    left, right, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    got = sim.assign_one_to_one(spark.createDataFrame(pairs, "left_id string, right_id string, score double"))
    assert {(r[0], r[1]) for r in got.collect()} == want


def test_clusters(spark):
    f = lambda *c: [(x, "STRING") for x in c]
    inv = inventory(spark, [("a", "x", f("p1", "p2", "p3"), [], []), ("b", "y", f("P2", "p1", "p-3"), [], []), ("c", "z", f("p1", "p2", "p3", "p4", "p5"), [], []), ("d", "w", f("q"), [], []), ("e", None, [], [], [])])
    got = {r["id"]: (r["cluster"], r["size"]) for r in sim.cluster(inv, 0.7).collect()}
    assert got == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1), "e": ("e", 1)}


def test_names_and_scores(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(sim.name_tokens(F.lit("The Data Source"))) == ["the", "data", "source"]
    assert one(sim.name_tokens(F.lit("Sales (Final) v2"))) == ["sales"]
    assert [one(sim.connector(F.lit(x))) for x in ("Microsoft SQL Server", "azure_sqldb", "excel-direct", "Odd One", None)] == ["sqlserver", "sqlserver", "excel", "oddone", "other"]
    assert one(sim.logic_parity(F.array(F.lit("A b")), F.array(F.lit("ab"), F.lit("c")))) == "likely"
    assert one(sim.importance_score(F.lit(8), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("boolean"))) == 0.5
    assert one(sim.importance_level(F.lit(None).cast("double"))) == "Unknown"
    assert one(sim.migration_priority(F.lit("rebuild"), sim.usage_priority(F.lit(0)))) == "P4"


def test_images_and_layouts(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (12, 16), dtype=np.uint8)
    assert layout.structural_similarity(a, a) == pytest.approx(1.0)
    df = spark.createDataFrame([(a.tobytes(), a.tobytes(), 16), (a.tobytes(), a[:4].tobytes(), 16), (None, a.tobytes(), 16)], "a binary, b binary, w int")
    got = [r[0] for r in df.select(layout.ssim("a", "b", "w")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1:] == [None, None]


def test_sets_and_blends(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (None,)], "k int")
    assert rows(relational.in_set(a, "k", b)) == [(2,)]
    assert rows(relational.in_set(a, "k", b, exclude=True)) == rows(spark.createDataFrame([(1,), (None,)], "k int"))
    assert rows(relational.combine_sets(a, b, "EXCEPT")) == [(1,)]
    with pytest.raises(UnsupportedCalc):
        relational.combine_sets(a, b, "XOR")


# -- sources --------------------------------------------------------------------


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("﻿item name,QTY,When,ok\na,1,2024-01-02,true\nb\nc,x,2024-01-03,false,surplus\n", encoding="utf-8")
    df = read_csv(spark, str(tmp_path / "in.csv"), {"Item Name": "string", "Qty": "integer", "When": "date", "ok": "boolean"})
    assert rows(df) == sorted([("a", 1, date(2024, 1, 2), True), ("b", None, None, None), ("c", None, date(2024, 1, 3), False)], key=repr)
    write_csv(df, str(tmp_path / "out"))
    assert rows(read_csv(spark, str(tmp_path / "out"), {"Item Name": "string", "Qty": "integer", "When": "date", "ok": "boolean"})) == rows(df)
    df.write.parquet(str(tmp_path / "p"))
    extract_to_csv(spark, str(tmp_path / "p"), str(tmp_path / "x"), 2)
    assert spark.read.csv(str(tmp_path / "x"), header=True).count() == 2


def test_headers():
    assert match_headers(["A", "Person"], ["A", "Regional Manager"]) == {"A": "A", "Person": "Regional Manager"}
    assert match_headers(["order id"], ["Order_ID", "x"]) == {"order id": "Order_ID"}
    assert match_headers(["p", "q"], ["x"]) == {}


def test_sql_and_names(spark):
    assert table_name("[cat].[a]]b].[t x]") == ("cat", "a]b", "t x") and table_name("plain") == ("plain",)
    with pytest.raises(UnsupportedCalc):
        table_name("a.b.c.d")
    text = "SELECT * FROM {t} WHERE k <<= <[Parameters].[Most]>"
    assert sql_parameters(text) == ["Most"]
    assert rows(read_sql(spark, text, {"Most": 1}, {"t": spark.range(3).withColumnRenamed("id", "k")})) == [(0,), (1,)]
    with pytest.raises(UnsupportedCalc):
        read_sql(spark, text, {}, {})


def test_connectors():
    pg = Connection("postgres", {"server": "h:5432", "database": "d"}, table="[s].[t]")
    assert decide(pg).score == 95 and jdbc_options(pg)["dbtable"] == "s.t" and jdbc_options(pg)["url"] == "jdbc:postgresql://h:5432/d"
    assert decide(Connection("postgres", query="SELECT 1", extract=True)).score == 80
    assert [decide(Connection(k)).format for k in ("csv", "bigquery", "genericodbc", "trino", "msolap", "saas")] == ["csv", "jdbc", None, "jdbc", None, None]
    with pytest.raises(UnsupportedCalc):
        jdbc_options(Connection("snowflake", {"server": "x", "database": "d"}, table="t"))


def test_addresses_to_complete():
    for kind, options, missing in (("bigquery", {}, ["project", "oauth_type"]), ("teradata", {"server": "h"}, ["database"]), ("genericodbc", {"dsn": "x"}, ["url"])):
        c = Connection(kind, options, table="t")
        assert decide(c).format == "jdbc" and [f"give {n}" for n in missing] == [x for x in decide(c).follow_ups if x.startswith("give")]
        with pytest.raises(UnsupportedCalc, match=missing[0]):
            jdbc_options(c)
        whole = Connection(kind, options | {n: "v" for n in missing}, table="t")
        assert not [x for x in decide(whole).follow_ups if x.startswith("give")] and jdbc_options(whole)["url"]
    assert jdbc_options(Connection("genericodbc", {"url": "jdbc:a:b", "driver_class": "c.D"}, table="t")) == {"url": "jdbc:a:b", "driver": "c.D", "fetchsize": "10000", "dbtable": "t"}


def test_cells_of_several_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"two\nlines, ""quoted"""\n2,x\n')
    got = read_csv(spark, str(tmp_path / "a.csv"), {"k": "integer", "v": "string"}, multi_line=True)
    assert rows(got) == [(1, 'two\nlines, "quoted"'), (2, "x")]


def test_candidates_are_those_of_all_pairs(spark):
    """Against a loop over every pair of names: alike ones, equal ones and those that share a word."""
    import difflib
    import random

    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
    tokens = [name() for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {tuple(r) for r in sim.names_alike(df, df).collect()}
    want = {(a, b) for a in tokens for b in tokens if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= sim.FUZZY_FLOOR}
    assert want <= got and len(got) < len(set(tokens)) ** 2
    sides = [spark.createDataFrame([(f"{s}{i:02}", t, None, None, None) for i, t in enumerate(tokens[k::2])], sim.INVENTORY) for k, s in enumerate("lr")]
    found = {(r["left_id"], r["rank"]): (r["right_id"], r["score"]) for r in sim.compare_inventories(*sides).collect()}
    for i, a in enumerate(tokens[::2]):
        ratio = [difflib.SequenceMatcher(None, a, b).ratio() for b in tokens[1::2]]
        score = [(1.0 if a == b else 0.9 * r if r >= 0.6 else 0.0, -j) for j, (b, r) in enumerate(zip(tokens[1::2], ratio))]
        assert [found[f"l{i:02}", n + 1][0] for n in range(4)] == [f"r{-j:02}" for _, j in sorted(score, reverse=True)[:4]]


def test_sharing_loses_no_pair(spark):
    import random

    rng = random.Random(5)
    sets = {f"s{i:02}": sorted({"id", *(f"c{rng.randrange(12)}" for _ in range(rng.randrange(0, 8)))}) for i in range(40)}
    df = spark.createDataFrame(list(sets.items()), "id string, keys array<string>")
    for least in (0.0, 0.3, 0.75, 1.0):
        got = {tuple(r) for r in sim.sharing(df, least).collect()}
        assert {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= max(least, 1e-9)} <= got


def test_materialised_tables(spark, tmp_path):
    m = Model.single(spark.createDataFrame([(1,), (None,)], "n int"), "t")
    out = enriched(m, {"twice": "[n] * 2", "bad": "SUM([n])", "worse": "[x]"})
    assert out.written == ("twice",) and set(out.refused) == {"bad", "worse"} and out.df.columns == ["n", "twice"]
    spark.sql("DROP TABLE IF EXISTS lattiq_test_enriched")
    materialise(m, {"twice": "[n] * 2"}, "lattiq_test_enriched")
    assert rows(spark.table("lattiq_test_enriched")) == sorted([(1, 2), (None, None)], key=repr)
    spark.sql("DROP TABLE lattiq_test_enriched")


def test_excel(spark, tmp_path):
    import zipfile

    from lattiq.sources.excel import read_excel

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Item</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr(
            "xl/worksheets/s2.xml",
            f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Qty</t></is></c><c r="D1" t="str"><v>When</v></c></row>'
            '<row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>3</v></c><c r="D2"><v>45292.5</v></c></row><row/><row><c r="C4" t="str"><v>x</v></c></row></sheetData></worksheet>',
        )
    got = read_excel(spark, str(tmp_path), {"item": "string", "Qty": "integer", "When": "date"}, "Two")
    assert rows(got) == sorted([("ab", 3, date(2024, 1, 1)), (None, None, None)], key=repr)
