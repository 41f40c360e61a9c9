"""Ids and decoded texts against the tokenizers library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattiq.llm import bpe
from lattiq.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tok.no_truncation(), tok.no_padding()
    return tok


@pytest.fixture(scope="module")
def ours():
    return bpe.load(tokenizer_path("byte_bpe_50k.json"))


def same(ours, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == want
    assert ours.decode(want) == library.decode(want, skip_special_tokens=False)


@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdeinrst 'l\n\t .,!?0123é", max_size=80)))
@settings(max_examples=400, deadline=None)
def test_any_text(ours, library, text):
    same(ours, library, text.encode("utf-8", "replace").decode())


@pytest.mark.parametrize("text", ["", " ", "   x", "a  b   c", "it's we'll I'M don't'", "\x1c\x1d\x85 x　y", "<|endoftext|>a<|endoftext|>", "a" * 5000, "ab" * 3000, "́é", "12345 678١", "\U0001f600\U0001f469‍\U0001f4bb", "supercalifragilisticexpialidocious" * 20])
def test_edges(ours, library, text):
    same(ours, library, text)


def test_speculation_fails_somewhere(ours):
    """The exact way is taken, so the tests above cover both."""
    before = ours.exact
    ours.encode_words([f"{a}{b}{c}ingtheoress" for a in "xzqjk" for b in "aeiou" for c in "mnprst"])
    assert ours.exact > before


def check(got, rows, library):
    assert len(got) == len(rows)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(text or "")
    for r in got:
        answers = []
        for t in texts[r["doc_id"]]:
            ids = library.encode(t, add_special_tokens=False).ids
            answers.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in answers


def test_documents(spark, library):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op7_bpe"](spark, sf).collect(), rows, library)


def test_odd_documents(spark, library, odd_docs, byte_bpe):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = bpe.encode_decode(odd_docs, byte_bpe, keep_ids=True)
    check(got.collect(), rows, library)
    assert got.filter("size(ids) <> n_tokens").count() == 0
    assert bpe.encode_decode(odd_docs.limit(0), byte_bpe).count() == 0
