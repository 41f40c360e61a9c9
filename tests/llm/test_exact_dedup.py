"""Exact copies: SQL, filters that merge without loss, collisions, odd rows."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, expected, found

from pyspark.sql import functions as F

from lattiq.llm import exact_dedup as ed
from lattiq.llm.queries import ORACLE_SQL, QUERIES


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert found(QUERIES["op8_exact_dedup"](spark, sf)) == expected(connect(sf), ORACLE_SQL["op8_exact_dedup"])


def test_filters_merge_without_loss(spark):
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 3000)] * 2 + [7] * 500 + [-1, 1 << 62]
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(7)
    counts = {x: fps.count(x) for x in set(fps)}
    for blocks in (1, 16):
        got = ed.merge_filters(ed.build_filters(df, blocks), 1).collect()
        assert {r["fp"]: r["n"] for r in got} == counts and len(got) == len(counts)
    assert {r["fp"] for r in ed.merge_filters(ed.build_filters(df, 4)).collect()} == {x for x, n in counts.items() if n > 1}


def test_equal_fingerprints_of_other_texts_stay_apart(spark, scratch, monkeypatch):
    monkeypatch.setattr(ed, "fingerprint", lambda sha: F.lit(1).cast("long") + F.length(sha) * 0)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (4, "c")], "doc_id long, text string")
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in ed.exact_dedup(docs, scratch).collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_odd_documents(spark, scratch, odd_docs):
    rows = [tuple(r) for r in ed.exact_dedup(odd_docs, scratch).collect()]
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:4])
    assert by[1] == [(1, 2, True)] * 2
    assert by[5] == [(5, 2, True)] and by[4] == [(5, 2, False)]
    assert by[7] == [(7, 4, True)] and by[2] == [(7, 4, False)] and by[3] == [(7, 4, False)]
    assert ed.exact_dedup(odd_docs.limit(0), scratch.__class__(spark, "none")).count() == 0


def test_drop_copies(spark, scratch, odd_docs):
    kept = ed.drop_copies(odd_docs.filter("doc_id IS NOT NULL"), scratch)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 6, 7, 8]


@given(st.dictionaries(st.one_of(st.integers(0, 1 << 12), st.integers(0, (1 << 64) - 1)), st.one_of(st.integers(1, 4), st.integers(1, 1 << 60)), max_size=200), st.sampled_from([64, 63, 50, 20]))
@settings(max_examples=120, deadline=None)
def test_a_filter_keeps_what_it_was_given(held, bits):
    held = {k & ((1 << bits) - 1): n for k, n in held.items()}
    keys = sorted(held)
    f = ed.QuotientFilter.load(ed.QuotientFilter.of(np.array(keys, np.uint64), np.array([held[k] for k in keys], np.int64), bits).dump())
    got = f.items()
    assert got[0].tolist() == keys and got[1].tolist() == [held[k] for k in keys]


@given(st.lists(st.lists(st.integers(0, 300), max_size=60), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_filters_of_any_size_merge(parts):
    def of(xs):
        keys, counts = np.unique(np.array(xs, np.uint64) * np.uint64(977), return_counts=True)
        return ed.QuotientFilter.of(keys, counts, 40)

    keys, counts = np.unique(np.array([x for p in parts for x in p], np.uint64) * np.uint64(977), return_counts=True)
    got = ed.QuotientFilter.merged([of(p) for p in parts]).items()
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == counts.tolist()


def test_bits_of_a_filter():
    """Quotients are not stored: about the remainder and three bits for a fingerprint met once, at the load there is."""
    for n in (60_000, 100_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 48, n, dtype=np.uint64))
        f = ed.QuotientFilter.of(keys, np.ones(len(keys), np.int64), 48)
        slots = max(f.n, 1 << f.q)
        assert (1 << f.q) >= len(keys) and f.n < 1.05 * (1 << f.q)
        assert 8 * len(f.dump()) <= slots * (48 - f.q + 3) + 200
        hot = ed.QuotientFilter.of(keys, np.where(keys == keys[5], 10**6, 1), 48)
        assert len(hot.dump()) <= len(f.dump()) + 8


def test_texts_that_are_single_are_not_routed(spark):
    docs = spark.range(20_000).select(F.xxhash64("id").alias("fp"), "id")
    many = docs.filter("id < 50").select("fp")
    got = ed._may_be_among(docs, many)
    assert got.columns == docs.columns and got.count() < 200 and got.filter("id < 50").count() == 50
    assert ed._may_be_among(docs, many.limit(0)).count() == 0


def test_columns_with_our_names_stay(spark, scratch, odd_docs):
    docs = odd_docs.withColumn("sha", F.lit("mine")).withColumn("KEY", F.lit("mine")).withColumn("_sha", F.lit("mine")).withColumn("of", F.lit("mine"))
    kept = ed.drop_copies(docs, scratch)
    assert kept.columns == docs.columns and kept.filter("sha <> 'mine' OR KEY <> 'mine' OR _sha <> 'mine' OR of <> 'mine'").count() == 0
    assert ed.drop_copies(docs.limit(0), scratch.__class__(spark, "none")).count() == 0
