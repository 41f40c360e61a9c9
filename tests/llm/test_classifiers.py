"""Language and quality: held-out accuracy, the factorisation identity, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm import langid, quality
from lattiq.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (ranks[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_language_id"](spark, SF).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").toPandas()
    assert len(got) > 500 and (got["lang_pred"] == got["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_binding_keeps_order():
    space = langid.Space()
    codes = lambda s: ord(s[0]) << 42 | ord(s[1]) << 21 | ord(s[2])
    a, b = space.gram(codes("abc")), space.gram(codes("cba"))
    assert abs(a @ b) / langid.DIM < 0.2 and a @ a == langid.DIM


def test_odd_texts_have_a_language(spark, odd_docs):
    got = {r["doc_id"]: r for r in langid.identify(odd_docs, langid.learn_profiles(odd_docs)).collect()}
    assert len(got) == 9 and got[3]["lang_pred"] == got[2]["lang_pred"] == got[7]["lang_pred"] == "und"
    none = langid.learn_profiles(odd_docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd_docs, none).collect()} == {"und"}
    assert langid.identify(odd_docs.limit(0), none).count() == 0


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op9_quality"](spark, SF).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").toPandas()
    assert len(got) > 200
    assert auc(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.9
    assert (got["predicted"] == got["quality"]).mean() > 0.85


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(3)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    idx, val = np.array([1, 5, 9, 30]), rng.normal(size=4)
    pairs = sum(fm.factors[idx[i]] @ fm.factors[idx[j]] * val[i] * val[j] for i in range(4) for j in range(i))
    assert fm.margin(idx, val) == pytest.approx(0.3 + fm.weights[idx] @ val + pairs)


def test_odd_texts_have_a_score(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (None, 1), (6, None), (99, 0)], "doc_id long, quality int")
    model = quality.fit_quality(odd_docs, labels)
    got = quality.score_quality(odd_docs, model)
    assert got.count() == odd_docs.count() and got.filter(~F.col("score").between(0, 1)).count() == 0
    kept = quality.keep_good(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    empty = quality.fit_quality(odd_docs.limit(0), labels.limit(0))
    assert quality.score_quality(odd_docs, empty).filter("score <> 0.5").count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs, turned)
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()


@pytest.mark.parametrize("text", ["½", "²", "① Ⅷ", "12 345", "\u0301", "!?", "  \n", "\u200d"])
def test_no_letter_is_no_language(spark, odd_docs, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r) for r in langid.identify(docs, langid.learn_profiles(odd_docs)).collect()] == [(1, "und", 0.0)]


def test_words_keep_their_marks():
    tell = lambda t: {"".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))) for g in langid.trigrams(t)[0].tolist()}
    assert tell("कि") == {" कि", "कि "} and tell("A-b 7c") == {" a ", "a b", " b ", "b c", " c "}
    assert tell("é") == tell("É") and tell("\u0301a") == {" a "}


def test_ties_go_to_the_first_language():
    v = np.ones((2, langid.DIM))
    assert langid.Profiles(["de", "en"], v).predict("abc") == ("de", 0.5)
    assert langid.Profiles(["xx"], v[:1]).predict("abc") == ("xx", 1.0)


def test_metadata_is_scored():
    """A label that only the metadata tell."""
    rows = [quality.features("same words", (10 if i % 2 else 100_000,)) for i in range(200)]
    fm = quality.FactorisationMachine.fit(rows, np.arange(200) % 2)
    assert fm.score(*quality.features("same words", (12,))) > 0.9 and fm.score(*quality.features("same words", (90_000,))) < 0.1
    for x in (None, float("nan"), -5, 2**70, 0, 0.5):
        idx, val = quality.features("", (x, x))
        assert idx.max() < quality.SIZE and len(idx) == len(val) and 0 <= fm.score(idx, val) <= 1


def test_rows_that_share_an_id_are_one_to_learn_from(spark):
    docs = spark.createDataFrame([(i, f"word{i % 5} text", i) for i in range(40)] * 2, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once, twice = quality.fit_quality(docs.distinct(), labels), quality.fit_quality(docs, labels.union(labels))
    assert once.bias == twice.bias and (once.weights == twice.weights).all()
