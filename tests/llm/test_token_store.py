"""Shards: Elias-Fano against arrays, ids against the tokenizers library, random access."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattiq.llm.token_store import ChunkTokenizer, EliasFano, Shard, read_tokens, write_tokens


@given(st.lists(st.integers(0, 1 << 40), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    ef = EliasFano.load(EliasFano.of(np.array(values, np.uint64)).dump())
    assert ef.slice(0, ef.n).tolist() == values
    for i in range(0, len(values), 37):
        assert ef.select(i) == values[i]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000)).astype(np.uint64)
    assert 8 * len(EliasFano.of(ends).dump()) / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 1.5


def brute(rows, path):
    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_equal_the_library(spark, scratch, word_bpe, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = [tuple(r) for r in read_tokens(write_tokens(docs, scratch, word_bpe)).orderBy("doc_id").collect()]
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    assert got == brute(rows, word_bpe)


def test_odd_documents(spark, scratch, word_bpe, odd_docs):
    got = sorted((tuple(r) for r in read_tokens(write_tokens(odd_docs, scratch, word_bpe)).collect()), key=lambda r: r[1])
    rows = sorted((tuple(r) for r in odd_docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert got == brute(rows, word_bpe)


def test_empty_table_and_ids(spark, scratch, word_bpe, odd_docs):
    assert read_tokens(write_tokens(odd_docs.limit(0), scratch, word_bpe)).count() == 0


def test_random_access(spark, scratch, word_bpe):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(600)], "doc_id long, text string").coalesce(1)
    manifest = write_tokens(docs, scratch, word_bpe)
    for part in manifest.collect():
        shard = Shard(part["path"])
        whole = list(shard.documents(0, part["n_docs"]))
        for at in range(0, part["n_docs"], 97):
            (key, start, ids), want = next(shard.documents(at, at + 1)), whole[at]
            assert (key, start, ids.tolist()) == (want[0], want[1], want[2].tolist())
        shard.close()


SIGNS = [*"aéİıßΣσς.,'’sSt \n\t12٣½²①Ⅷ\x1c\x1d\x1e\x1f\x85\xa0　̣́̇̀िा्क<|>_-ª·ºµKÅΩ각ͅ\xad‍", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", ". ", ", ", "İ. ", "H̱, ", "a. ", "'S, "]


@pytest.fixture(scope="module")
def both(word_bpe):
    tok = Tokenizer.from_file(word_bpe)
    tok.no_truncation(), tok.no_padding()
    return ChunkTokenizer(word_bpe, 2), tok


@given(texts=st.lists(st.one_of(st.lists(st.sampled_from(SIGNS), max_size=14).map("".join), st.text(max_size=30)), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_any_text(both, texts):
    ours, tok = both
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids, ends = ours.encode_batch(pa.array([*texts, None], pa.string()))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [*(tok.encode(t, add_special_tokens=False).ids for t in texts), []]


@pytest.mark.parametrize("text", ["İ. Melih", "Prof. İ. Ortaylı", "a\x1f, b", "a\x1c. b\x1d, c\x1e, d", "½, x", "é, x é. ", ".. , a., b,. c", ", a", "A̱. B"])
def test_stops_and_marks(both, text):
    ours, tok = both
    assert ours.encode_batch(pa.array([text]))[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_vocabularies_that_keep_white_space_are_refused(byte_bpe):
    with pytest.raises(ValueError):
        ChunkTokenizer(byte_bpe, 2)


def test_reading_is_dealt_by_the_bytes_of_shards(spark, tmp_path, monkeypatch):
    """Pieces of 40 large shards, which are a few rows, go to as many tasks as their ids ask for."""
    rows = [(0, i, f"{tmp_path}/{i}", 1 << 20, 1 << 25) for i in range(40)]
    manifest = spark.createDataFrame(rows, "part int, seq int, path string, n_docs long, n_tokens long")
    assert read_tokens(manifest).rdd.getNumPartitions() >= 40
