"""Interleaved document sequences: ordered text and media, with media kept apart by digest.

HTML parsing yields, for each document, an ordered array of structs that are
either text or a reference to media by digest; captions and positions stay
with their reference.  A join by digest resolves references against a store
of media, in which media are 8-bit mono samples in RIFF/WAVE form, and
``assemble`` puts what it finds back into the sequences, in place.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, check_columns, fresh, map_arrow, slices

UNIT = 64
RATE = 8000
SCHEME = "media:sha256:"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_BLOCKS = frozenset("p div section article h1 h2 h3 h4 h5 h6 li ul ol table tr td th blockquote pre figure figcaption header footer nav main aside br hr body html".split())
_SILENT = frozenset(("script", "style", "template", "noscript", "title"))


class _Sequence(HTMLParser):
    """Text blocks and media references in the order of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("img", "audio", "video", "source", "embed"):
            attrs = dict(attrs)
            src = attrs.get("src") or ""
            if tag == "source" and not src:
                return
            self.flush()
            digest = src.removeprefix(SCHEME) if src.startswith(SCHEME) else None
            self.items.append({"kind": "media", "text": src or None, "digest": digest, "caption": attrs.get("alt") or None})
            if self.figure is not None:
                self.figure.append(len(self.items) - 1)
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_startendtag(self, tag, attrs):
        if tag not in _SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            if self.figure:
                for i in self.figure:
                    self.items[i]["caption"] = caption or self.items[i]["caption"]
            elif caption:
                self.text.append(caption)
                self.flush()
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(page: str) -> list[dict]:
    parser = _Sequence()
    parser.feed(page)
    parser.close()
    parser.flush()
    return [{"position": i} | x for i, x in enumerate(parser.items)]


def parse_sequences(pages: DataFrame, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, ``sequence`` and the columns in ``carry`` for each row; a null or empty page has an empty sequence.

    A figcaption goes to all media of its figure, whether it comes before or
    after them; else an alt text is the caption.  ``digest`` is null for
    references elsewhere, whose address is in ``text``.
    """
    kinds = "".join(f", c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate((key, *carry)))

    def run(batches):
        for batch, texts in slices(batches, "html"):
            found = pa.array([sequence(t) for t in texts], pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])))
            yield pa.RecordBatch.from_arrays([found, *batch.columns[1:]], ["sequence", *(f"c{i}" for i in range(len(batch.columns) - 1))])

    found = map_arrow(pages.select(F.col(html).alias("html"), *(F.col(c).alias(f"c{i}") for i, c in enumerate((key, *carry)))), run, f"sequence {SEQUENCE}{kinds}")
    return found.select(F.col("c0").alias(key), "sequence", *(F.col(f"c{i + 1}").alias(c) for i, c in enumerate(carry)))


def wave(payload: bytes) -> bytes:
    """8-bit mono samples as a RIFF/WAVE file."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", (36 + n) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of a RIFF/WAVE file, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at = 12
    while at + 8 <= len(media):
        (n,) = struct.unpack_from("<I", media, at + 4)
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def describe(payload: bytes) -> str:
    """Features of 8-bit samples in whole numbers: level, energy, crossings, flux, distinct levels, four band shares."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    d = np.diff(x)
    hist = np.bincount(x + 128, minlength=256)
    bands = (hist.reshape(4, 64).sum(1) * 1000 // n).tolist()
    crossings = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    return f"mean={int(x.sum()) * 1000 // n};energy={int((x * x).sum()) // n};crossings={crossings * 1000 // n};flux={int(np.abs(d).sum()) * 1000 // n};levels={int((hist > 0).sum())};bands={'/'.join(map(str, bands))}"


def stored(text: str | None) -> tuple[int, bytes]:
    """A text's bytes in UTF-8 (null: none), and these as media: with bytes 0 appended up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), wave(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"))


def store_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Stores each text (null: empty) as media.  Returns the table written: doc_id, digest, media."""

    def run(batches):
        for batch, texts in slices(batches, "text"):
            media = [stored(t)[1] for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "digest": pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), "media": pa.array(media, pa.binary())})

    return scratch.cut(map_arrow(check_columns(docs, "doc_id", "text"), run, "doc_id long, digest string, media binary"), "store")


def page(doc_id: int | None, text: str) -> tuple[int, str]:
    """A text's bytes, and the page that has all its lines as paragraphs and, after the first, a figure of its stored form."""
    n, media = stored(text)
    first, *others = (f"<p>{htmllib.escape(x)}</p>" for x in text.split("\n"))
    figure = f'<figure><audio src="{SCHEME}{hashlib.sha256(media).hexdigest()}"></audio><figcaption>document {doc_id}</figcaption></figure>'
    return n, "".join(("<article>", first, figure, *others, "</article>"))


def pages_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, page of each row: the whole text around the figure of its media."""

    def run(batches):
        for batch, texts in slices(batches, "text"):
            made = [page(i, t) for i, t in zip(batch.column(0).to_pylist(), texts)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([n for n, _ in made], pa.int64()), "page": pa.array([p for _, p in made], pa.string())})

    return map_arrow(check_columns(docs, "doc_id", "text"), run, "doc_id long, n_bytes long, page string")


def describe_media(store: DataFrame) -> DataFrame:
    """Reads stored media back: digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; one row a digest.

    Media whose digest is not theirs raise an error; rows that repeat a digest
    are one, and an empty store gives none.
    """

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                media = media.as_py()
                payload = samples(media)
                got = hashlib.sha256(media).hexdigest()
                if got != digest:
                    raise ValueError(f"media of {digest} have another digest")
                for k, v in zip(out, (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), got, describe(payload))):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out)

    found = map_arrow(check_columns(store, "digest", "media"), run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    # All rows of a digest are alike.
    return found.groupBy("digest").agg(*[F.max(c).alias(c) for c in found.columns[1:]])


def resolve(sequences: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """Joins references with described media by digest: key, position, caption, the columns beside the sequence and the media's.

    References keep their order and captions; those with no media in the
    store have nulls.  ``media`` should be a written table: both sides then
    have exchanges of their own, and a digest with very many references is
    split between tasks.
    """
    others = [c for c in sequences.columns if c not in (key, "sequence")]
    refs = sequences.select(key, *others, F.explode("sequence").alias("x")).filter("x.kind = 'media'").select(key, *others, F.col("x.position").alias("position"), F.col("x.caption").alias("caption"), F.col("x.digest").alias("digest"))
    return refs.join(media, "digest", "left")


def assemble(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """``sequences``, all rows and columns, each item of ``sequence`` with ``media``: its described media, or null.

    Items keep position, text and caption.  Rows alike in every column are
    one in the join, and each gets its media.
    """
    row, at, known = fresh(sequences, "row", "at", "known")
    digests = sequences.withColumn(row, F.sha2(F.to_json(F.struct(*sequences.columns)).cast("binary"), 256))
    refs = digests.select(row, F.explode("sequence").alias("x")).filter("x.digest IS NOT NULL").select(row, F.col("x.position").alias("position"), F.col("x.digest").alias("digest")).distinct()
    found = refs.join(media.select("digest", F.struct(*[c for c in media.columns if c != "digest"]).alias("media")), "digest")
    found = found.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("position", "media"))).alias(known)).withColumnRenamed(row, at)
    items = F.transform("sequence", lambda x: x.withField("media", F.try_element_at(F.col(known), x["position"])))
    whole = digests.join(found, digests[row] == found[at], "left")
    return whole.select(*(items.alias(c) if c == "sequence" else whole[c] for c in sequences.columns))
