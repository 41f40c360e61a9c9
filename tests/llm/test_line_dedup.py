"""Repeated lines: SQL, a brute-force suffix comparison, odd rows."""

import random

import pytest
from oracle import connect, expected, found

from lattiq.llm.line_dedup import drop_repeated_lines, maximal_runs, suffix_array, suffix_ranks
from lattiq.llm.queries import ORACLE_SQL, QUERIES


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert found(QUERIES["op10_line_dedup"](spark, sf)) == expected(connect(sf), ORACLE_SQL["op10_line_dedup"])


def brute(rows, min_lines, min_words):
    """Lines that are in a run with an earlier copy, by comparing every pair of places."""
    places = [(d, i, line) for d, t in sorted(rows) for i, line in enumerate(t.split("\n"))]
    texts = {d: t.split("\n") for d, t in rows}
    gone = {d: set() for d in texts}
    for b, (d, i, _) in enumerate(places):
        for c, k, _ in places[:b]:
            n = 0
            while i + n < len(texts[d]) and k + n < len(texts[c]) and texts[d][i + n] == texts[c][k + n]:
                n += 1
            if n >= min_lines:
                gone[d].update(range(i, i + n))
            for m in range(n):
                if len(texts[d][i + m].split()) >= min_words:
                    gone[d].add(i + m)
    return {d: "\n".join(x for i, x in enumerate(t) if i not in gone[d]) for d, t in texts.items()}


@pytest.mark.parametrize("min_lines,min_words", [(2, 50), (4, 3), (1, 50), (3, 50)])
def test_against_all_pairs(spark, scratch, min_lines, min_words):
    rng = random.Random(min_lines)
    rows = [(d, "\n".join(rng.choice(["a", "b", "c", "dd ee ff", "g " * 60]) for _ in range(rng.randrange(1, 14)))) for d in range(18)]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), scratch, min_lines, min_words).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute(rows, min_lines, min_words)
    assert all(r["n_lines"] - r["n_deleted"] == (0 if r["n_lines"] == r["n_deleted"] else r["text"].count("\n") + 1) for r in got)


def test_odd_documents(spark, scratch, odd_docs):
    got = drop_repeated_lines(odd_docs, scratch).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_lines"], r["n_deleted"], r["text"]))
    assert by[3] == [(0, 0, None)] and by[2] == [(1, 0, "")] and len(by[1]) == 2 and by[1][0] == by[1][1]
    assert drop_repeated_lines(odd_docs.limit(0), scratch.__class__(spark, "none")).count() == 0


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def texts_of(seed, n_docs=16, longest=24):
    rng = random.Random(seed)
    docs = [[rng.choice("aabbccdefgh") for _ in range(rng.randrange(1, longest))] for _ in range(n_docs)]
    return [*docs, docs[0], docs[1][2:] + ["only"], ["a"] * 13, ["x", *docs[2]]]


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_array_and_lcps(spark, scratch, seed):
    docs = texts_of(seed)
    df = spark.createDataFrame([(d, "\n".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    rows = sorted(suffix_array(suffix_ranks(df.repartition(5), scratch), scratch).collect(), key=lambda r: (r["part"], r["at"]))
    found = [tuple(docs[r["doc"]][r["line"] :]) for r in rows]
    lines = [x for t in docs for x in t]
    assert sorted(found) == sorted(tuple(t[i:]) for t in docs for i in range(len(t)) if lines.count(t[i]) > 1)
    assert [r["lcp"] for r in rows] == [0, *(common(a, b) for a, b in zip(found, found[1:]))]
    # Suffixes that share lines are next to each other: an LCP is at least any that spans it.
    for i in range(len(found)):
        for j in range(i + 1, len(found)):
            assert common(found[i], found[j]) == min(r["lcp"] for r in rows[i + 1 : j + 1])


@pytest.mark.parametrize("seed,min_lines", [(4, 1), (5, 2), (6, 3)])
def test_maximal_runs(spark, scratch, seed, min_lines):
    docs = texts_of(seed)
    df = spark.createDataFrame([(d, "\n".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    places = [(d, i) for d, t in enumerate(docs) for i in range(len(t))]
    longest = {(d, i): max(common(docs[d][i:], docs[e][j:]) for e, j in places if (e, j) != (d, i)) for d, i in places}
    want = {(d, i, i + n) for (d, i), n in longest.items() if n >= min_lines and (i == 0 or longest[d, i - 1] < n + 1)}
    assert {(r["doc_id"], r["line"], r["end"]) for r in maximal_runs(df, scratch, min_lines).collect()} == want


def test_runs_of_three_documents(spark, scratch):
    """a b and b c are repeated, a b c is not: two maximal runs, one stretch that goes."""
    df = spark.createDataFrame([(1, "a\nb\nx"), (2, "y\nb\nc"), (3, "a\nb\nc")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["line"], r["end"]) for r in maximal_runs(df, scratch).collect()) == [(1, 0, 2), (2, 1, 3), (3, 0, 2), (3, 1, 3)]
    got = {r["doc_id"]: (r["n_deleted"], r["n_runs"]) for r in drop_repeated_lines(df, scratch.__class__(spark, "three")).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (3, 1)}


@pytest.mark.parametrize("min_lines", [2, 3])
def test_stretches(spark, scratch, min_lines):
    """n_runs counts the stretches of a brute-force cover."""
    docs = texts_of(7)
    df = spark.createDataFrame([(d, "\n".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    whole = sorted(map(tuple, drop_repeated_lines(df, scratch, min_lines).collect()))
    seen, want = set(), {}
    for d, t in enumerate(docs):
        reach, stretches = -1, 0
        for i in range(len(t) - min_lines + 1):
            window = tuple(t[i : i + min_lines])
            if window in seen:
                stretches += i >= reach
                reach = i + min_lines
            seen.add(window)
        want[d] = stretches
    assert {r[0]: r[3] for r in whole} == want
