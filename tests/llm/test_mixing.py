"""Pfair mixing: SQL at small size, lag bounds, weights, odd rows."""

import math
from collections import Counter
from fractions import Fraction

import pytest
from oracle import connect, expected, found

from lattiq.llm import mixing
from lattiq.llm.mixing import in_mixture_order, mix
from lattiq.llm.queries import ORACLE_SQL, QUERIES


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert found(QUERIES["op2_mixing"](spark, sf)) == expected(connect(sf), ORACLE_SQL["op2_mixing"])


@pytest.mark.parametrize("weights", [None, {"a": 0.7, "b": 0.2, "c": 0.1}])
def test_never_a_block_away_from_its_share(spark, scratch, weights):
    sizes = {"a": 900, "b": 300, "c": 40}
    docs = spark.createDataFrame([(1000 * k + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, source string")
    rows = mix(docs, scratch, weights, block=4, slots=50).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows))) and len({r["doc_id"] for r in rows}) == len(rows)
    blocks = list(dict.fromkeys((r["frame"], r["slot"], r["source"]) for r in rows))
    first = [b for b in blocks if b[0] == 0]
    quota = Counter(b[2] for b in first)
    if weights:
        assert quota == {"a": 35, "b": 10, "c": 5}
    seen: Counter = Counter()
    for t, b in enumerate(first, 1):
        seen[b[2]] += 1
        assert all(abs(seen[s] - t * q / len(first)) < 1 for s, q in quota.items())


def test_odd_documents(spark, scratch, odd_docs):
    got = mix(odd_docs, scratch).collect()
    assert len(got) == odd_docs.count() and sorted(r["position"] for r in got) == list(range(len(got)))
    assert mix(odd_docs.limit(0), scratch.__class__(spark, "empty")).count() == 0
    ordered = in_mixture_order(odd_docs, scratch.__class__(spark, "order"))
    assert ordered.columns == odd_docs.columns and sorted(map(str, ordered.collect())) == sorted(map(str, odd_docs.collect()))


def test_too_many_sources_are_refused(spark, scratch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS source")
    with pytest.raises(ValueError):
        mix(docs, scratch, slots=100)


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.1985, "d": 0.0015}])
def test_exact_mixing_keeps_to_the_weights_over_many_frames(spark, scratch, weights):
    """Against earliest deadlines worked slot by slot, and the share of each source from fractions, run-outs included."""
    sizes = {"a": 1500, "b": 907, "c": 600, "d": 14}
    docs = spark.createDataFrame([(10_000 * i + j, s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)], "doc_id long, source string")
    rows = mix(docs, scratch, weights, block=1, slots=100, exact=True).orderBy("position").collect()
    assert [r["position"] for r in rows] == [100 * r["frame"] + r["slot"] for r in rows] == list(range(sum(sizes.values())))
    got = [r["source"] for r in rows]
    w = {s: Fraction(weights[s]).limit_denominator(10_000) if weights else Fraction(n**0.5) for s, n in sizes.items()}
    corners = sorted(n / w[s] for s, n in sizes.items())

    def used(v):
        return sum(min(Fraction(n), v * w[s]) for s, n in sizes.items())

    due = {(s, j): (math.floor(round(used(j / w[s]), 6)), math.ceil(round(used((j + 1) / w[s]), 6))) for s, n in sizes.items() for j in range(n)}
    nth, want = Counter(), []
    for t in range(len(rows)):
        s = min((s for s, n in sizes.items() if nth[s] < n and due[s, nth[s]][0] <= t), key=lambda s: (due[s, nth[s]][1], s))
        nth[s] += 1
        want.append(s)
    assert got == want
    seen = Counter()
    for t, s in enumerate(got, 1):
        seen[s] += 1
        lo = max([c for c in corners if used(c) <= t], default=Fraction(0))
        rate = sum(w[x] for x in sizes if sizes[x] / w[x] > lo)
        v = lo + (t - used(lo)) / rate if rate else lo
        assert all(abs(seen[x] - min(Fraction(n), v * w[x])) < 1 + Fraction(1, 10**5) for x, n in sizes.items())
    assert mix(docs.limit(0), scratch.__class__(spark, "exact-empty"), exact=True).count() == 0


def test_any_number_of_sources(spark, tmp_path, scratch, monkeypatch):
    """The query takes 3000 sources, and the large path agrees with the small one and with SQL."""
    many = spark.range(9000).selectExpr("id AS doc_id", "cast(id % 3000 AS string) AS source", "cast(null AS string) AS text")
    many.union(spark.range(9000, 9400).selectExpr("id", "'0'", "null")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(QUERIES["op2_mixing"](spark, str(tmp_path)).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(9400)) and len({r["doc_id"] for r in rows}) == 9400
    assert len({(r["frame"], r["slot"]) for r in rows}) == len({(r["source"], r["block"]) for r in rows})

    sizes = {"a": 900, "b": 300, "c": 40, "d": 3}
    docs = spark.createDataFrame([(1000 * i + j, s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)], "doc_id long, source string")
    few = {tuple(r) for r in mix(docs, scratch, block=2, slots=50).collect()}
    monkeypatch.setattr(mixing, "MAX_PATTERN", 0)
    assert {tuple(r) for r in mix(docs, scratch.__class__(spark, "large"), block=2, slots=50, any_number=True).collect()} == few
    for sf in ("sf0.001", "sf0.1"):
        assert found(QUERIES["op2_mixing"](spark, f"/root/testdata/{sf}")) == expected(connect(f"/root/testdata/{sf}"), ORACLE_SQL["op2_mixing"])


def test_columns_with_our_names_stay(spark, scratch, odd_docs):
    docs = odd_docs.selectExpr("*", "1 AS key", "2 AS of", "3 AS at", "4 AS _position", "5 AS _id", "6 AS Position")
    got = in_mixture_order(docs, scratch)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert in_mixture_order(docs.limit(0), scratch.__class__(spark, "none")).count() == 0
