"""Near duplicates against all pairs, and sketches against exact similarities."""

import random
import re

import numpy as np
import pytest
from oracle import connect, expected, found
from pyspark.sql import functions as F

from lattiq.llm import near_dedup as nd
from lattiq.llm.queries import ORACLE_SQL, QUERIES


def word_shingles(text):
    """A set of tuples of words, by the contract alone: nothing of the module under test, no hashes."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = tuple(re.findall(r"[^\x20\x09-\x0D]+", low))
    return {ws[i : i + 5] for i in range(len(ws) - 4)} if len(ws) >= 5 else {ws} if ws else set()


def brute(rows, percent):
    """Components by comparing every pair of documents that share a shingle."""
    sets = [word_shingles(t) for _, t in rows]
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        near: dict[int, int] = {}
        for h in s:
            for j in where.setdefault(h, []):
                near[j] = near.get(j, 0) + 1
            where[h].append(i)
        for j, both in near.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(ids[i]), find(ids[j])))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def words(rng, n):
    return [f"w{rng.randrange(2000)}" for _ in range(n)]


def altered(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
    return ws


@pytest.mark.parametrize("percent", [80, 85])
def test_a_dense_group_and_chains(spark, scratch, percent):
    rng = random.Random(percent)
    base = words(rng, 150)
    texts = [" ".join(altered(rng, base, rng.randrange(0, 9))) for _ in range(700)]  # around the threshold of one another
    chain = words(rng, 200)
    for _ in range(30):  # each near the one before, ends far apart
        chain = altered(rng, chain, 2)
        texts.append(" ".join(chain))
    texts += [" ".join(words(rng, rng.randrange(1, 60))) for _ in range(300)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), scratch, percent).collect()
    want = brute(rows, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_documents(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_dedup(docs, scratch, 85).collect()}
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 85)


def test_odd_documents(spark, scratch, odd_docs):
    got = nd.near_dedup(odd_docs, scratch)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert len(rows) == odd_docs.count()
    by = {r[0]: r for r in rows}
    assert by[2][1:] == (0, 2, True) and by[3][1:] == (0, 3, True) and by[5][2] == 4 and not by[5][3] and by[7][1] == 0
    assert by[None][2:] == (None, True)
    kept = nd.drop_near_copies(odd_docs, scratch.__class__(spark, "kept"))
    assert kept.columns == odd_docs.columns and kept.filter("doc_id = 5").count() == 0 and kept.filter("doc_id IS NULL").count() == 2
    assert nd.near_dedup(odd_docs.limit(0), scratch.__class__(spark, "none")).count() == 0


def test_words_and_case():
    assert len(nd.shingles("A b\x0bc\td E")) == 1 and (nd.shingles("A b\x0bc\td E") == nd.shingles("a B c d e")).all()
    assert len(nd.shingles("a b")) == 1 and len(nd.shingles(" \n ")) == 0
    assert not (nd.shingles("É a") == nd.shingles("é a")).all()  # only A-Z change
    assert len(nd.shingles("a\u00a0b c d e f")) == 1  # a no-break space is no blank


def test_estimates():
    rng = np.random.default_rng(4)
    for n, share in ((150, 0.8), (3000, 0.8), (3000, 0.5), (40, 0.9)):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            k = round(n * (1 - share) / (1 + share))
            a, b = (np.unique(np.r_[both[k:], rng.integers(0, 1 << 62, k, dtype=np.uint64)]) for _ in range(2))
            exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = nd.fine_sketch(a), nd.fine_sketch(b)
            errors.append(nd.estimate(x, y) - exact)
            assert exact < 0.8 or nd.may_reach(x, np.array(len(a)), y, np.array(len(b)), 80)
        assert abs(np.mean(errors)) < 0.02
    assert (nd.registers(np.array([5], np.uint64)) == nd.registers(np.array([5], np.uint64))).all()


def one_bucket(monkeypatch):
    """Puts all nodes in the same bucket of band 0, as frames that all pages share do."""
    keys = nd.band_keys

    def same(regs):
        found = keys(regs).copy()
        found[0] = 7
        return found

    monkeypatch.setattr(nd, "band_keys", same)


def test_a_bucket_of_unlike_nodes_gives_few_rows(spark, scratch, monkeypatch):
    """20 000 nodes that share a bucket and half of their text: rows grow with the nodes, not with their square."""
    rng = random.Random(9)
    frame = words(rng, 30)
    docs = spark.createDataFrame([(i, " ".join([*frame, *(f"u{i}x{j}" for j in range(30))])) for i in range(20_000)], "doc_id long, text string")
    sketched = nd.sketch(docs).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "fine", "regs", "packed")
    nodes = scratch.cut(sketched, "nodes")
    labelled = nodes.select(F.lit(7).cast("long").alias("key"), "node", F.col("node").alias("comp"))
    sent = []
    of = nd._cross_pairs
    monkeypatch.setattr(nd, "_cross_pairs", lambda rows, percent: sent.append(rows) or of(rows, percent))
    assert nd.late_pairs(labelled, nodes, 80, scratch).count() == 0
    assert sum(rows.agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0] for rows in sent) < 20_000


@pytest.mark.parametrize("block", [3, 1000])
def test_large_open_buckets_lose_no_link(spark, scratch, monkeypatch, block):
    """Frames with little of their own, near and far from one another, against all pairs; by rare shingles and blocks alone."""
    one_bucket(monkeypatch)
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(11)
    frame, texts = words(rng, 60), []
    for i in range(120):
        own = [f"o{i // 3}x{j}" for j in range(rng.choice([4, 12, 20, 40]))]
        texts.append(" ".join(frame + altered(rng, own, rng.randrange(0, 3))))
    texts += [" ".join(words(rng, 40)) for _ in range(40)] + texts[:5] + ["", "a b", "A  b"]
    rows = list(enumerate(texts))
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), scratch, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 80)


def test_columns_with_our_names_stay(spark, scratch, odd_docs):
    docs = odd_docs.withColumn("gone", F.lit(1)).withColumn("_gone", F.lit(2))
    kept = nd.drop_near_copies(docs, scratch)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5").count() == 0 and kept.filter("gone <> 1 OR _gone <> 2").count() == 0
    assert nd.drop_near_copies(docs.limit(0), scratch.__class__(spark, "none")).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert found(QUERIES["op4_near_dedup"](spark, sf)) == expected(connect(sf), ORACLE_SQL["op4_near_dedup"])
