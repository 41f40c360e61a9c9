"""Media: round trips through files, features, order and captions."""

import hashlib
import zlib

from pyspark.sql import functions as F

from lattiq.llm.interleave import UNIT, assemble, describe, describe_media, page, pages_of, parse_sequences, resolve, samples, sequence, store_texts, wave
from lattiq.llm.queries import QUERIES


def test_wave_round_trip():
    for payload in (b"\0" * 64, bytes(range(256)), b"\xff" * 128):
        media = wave(payload)
        assert samples(media) == payload and len(media) == 44 + len(payload)
    junk = wave(b"ab" * 32)
    assert samples(junk[:12] + b"LIST\x03\0\0\0abc\0" + junk[12:]) == b"ab" * 32


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_interleaved_media"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (rows[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(wave(payload)), hashlib.sha256(wave(payload)).hexdigest(), describe(payload))


def test_order_and_captions():
    page = '<p>one<img src="media:sha256:aa" alt="alt"></p><figure><img src="media:sha256:bb"><img src="http://x/y.png"><figcaption>Two <b>pics</b></figcaption></figure><script>no</script><p>three</p>'
    got = sequence(page)
    assert [x["position"] for x in got] == list(range(5))
    assert [(x["kind"], x["digest"], x["caption"]) for x in got] == [("text", None, None), ("media", "aa", "alt"), ("media", "bb", "Two pics"), ("media", None, "Two pics"), ("text", None, None)]
    assert [x["text"] for x in got if x["kind"] == "text"] == ["one", "three"]
    assert sequence("") == [] and sequence("<p>unclosed <b>tags")[0]["text"] == "unclosed tags"


def test_odd_documents(spark, scratch, odd_docs):
    store = store_texts(odd_docs, scratch)
    found = resolve(parse_sequences(pages_of(odd_docs), "doc_id", "page"), "doc_id", scratch.cut(describe_media(store), "media"))
    assert found.count() == odd_docs.count() and found.filter(F.col("media_sha256").isNull()).count() == 0
    assert describe_media(store).filter("payload_bytes % 64 <> 0").count() == 0
    empty = odd_docs.limit(0)
    store = store_texts(empty, scratch.__class__(spark, "none"))
    assert describe_media(store).count() == 0 and parse_sequences(pages_of(empty), "doc_id", "page").count() == 0


def test_unresolved_references_stay(spark):
    pages = spark.createDataFrame([(1, '<img src="media:sha256:no">'), (2, None)], "page_id long, html string")
    media = spark.createDataFrame([("yes", 1)], "digest string, media_bytes long")
    assert [(r["page_id"], r["media_bytes"]) for r in resolve(parse_sequences(pages), "page_id", media).collect()] == [(1, None)]


def blocks(text):
    """A text's lines as a browser shows them: runs of blanks are one, empty lines are none."""
    return [x for x in (" ".join(line.split()) for line in text.replace("\r", "\n").split("\n")) if x]


def test_whole_texts_are_parsed_in_order(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_interleaved_media"](spark, sf).collect():
        want = [" ".join(line.split()) for line in rows[r["doc_id"]].split("\n")]
        assert r["n_items"] == 1 + sum(map(bool, want)) and r["position"] == bool(want[0]) and r["caption"] == f"document {r['doc_id']}"
        assert r["texts_sha256"] == hashlib.sha256("\n".join(filter(None, want)).encode()).hexdigest()


def test_a_text_with_tags_is_text():
    text = '<b>bold</b> & <img src="x"> &amp;\n</p><script>x</script>\n' + "long " * 50_000
    got = [x["text"] for x in sequence(page(1, text)[1]) if x["kind"] == "text"]
    assert got == blocks(text)


def test_sequences_put_together_again(spark, scratch):
    """Several media a page: texts, positions and captions stay with them, payloads agree with what was stored."""
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "doc_id long, text string")
    store = store_texts(docs, scratch)
    digest = {r["doc_id"]: r["digest"] for r in store.collect()}
    ref = lambda i: f'<img src="media:sha256:{digest[i]}" alt="alt {i}">'
    pages = [(10, f"<p>a{ref(1)}b</p>{ref(2)}<p>c</p>{ref(1)}", "x"), (11, '<p>none</p><img src="media:sha256:gone">', "y"), (12, None, None), (13, ref(3), "z"), (13, ref(3), "z"), (None, ref(2), "n")]
    sequences = parse_sequences(spark.createDataFrame(pages, "page_id long, html string, row string"), carry=("row",))
    media = scratch.cut(describe_media(store), "media")
    got = assemble(sequences, media)
    assert got.columns == ["page_id", "sequence", "row"] and got.count() == 6
    want = {i: hashlib.sha256(t.encode().ljust(UNIT, b"\0")).hexdigest() for i, t in ((1, "one"), (2, "two"), (3, "three"))}
    tell = lambda r: [(x["position"], x["text"] if x["kind"] == "text" else x["caption"], x["media"] and x["media"]["payload_sha256"]) for x in r["sequence"]]
    by = {(r["page_id"], r["row"]): tell(r) for r in got.collect()}
    assert by[10, "x"] == [(0, "a", None), (1, "alt 1", want[1]), (2, "b", None), (3, "alt 2", want[2]), (4, "c", None), (5, "alt 1", want[1])]
    assert by[11, "y"] == [(0, "none", None), (1, None, None)] and by[12, None] == [] and by[13, "z"] == [(0, "alt 3", want[3])] and by[None, "n"] == [(0, "alt 2", want[2])]
