"""Token ids in binary shards with Elias-Fano document boundaries.

A shard is a concatenated array of ids (little-endian, two bytes each while
the vocabulary allows) followed by two Elias-Fano sequences, the documents'
ends and their doc_ids, and a footer.  An Elias-Fano sequence of n values
below u takes about 2 + log2(u / n) bits a value: each value's low bits are
packed, the rest are unary in a bit vector, and the places of every 256th one
bit let ``select`` start near its target, so offsets need no 64-bit table.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, check_columns, dealt, map_arrow, parts

MAGIC = b"LQT1"
#: A writer begins another shard beyond so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 25, 1 << 20
#: Documents that a reading task takes from a shard at a time.
READ_DOCS = 1 << 14
SAMPLE = 256
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 4 << 20
#: Chunks in each of the two generations that a worker remembers.
CACHE_WORDS = 600_000


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little") if low_bits else np.zeros(0, np.uint8)
        ones = (v >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].copy())

    def slice(self, first: int, last: int) -> np.ndarray:
        """Values first up to last, without reading the others."""
        if first >= last:
            return np.zeros(0, np.uint64)
        s, e = first // SAMPLE, -(-last // SAMPLE)
        begin = int(self.samples[s])
        end = int(self.samples[e]) if e < len(self.samples) else 8 * len(self.high)
        at = begin // 8
        bits = np.unpackbits(self.high[at : -(-end // 8)], bitorder="little")
        ones = np.flatnonzero(bits[begin - 8 * at :])[first - s * SAMPLE : last - s * SAMPLE] + begin
        out = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            a, b = first * self.low_bits, last * self.low_bits
            low = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a]
            out |= low.reshape(-1, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def dump(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", raw)
        at = struct.calcsize("<QBQQ")
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u8", -(-n // SAMPLE), at + a + b))


class ShardWriter:
    """Streams ids to a file; only the boundaries stay in memory until it ends."""

    def __init__(self, path: str, width: int):
        fs, p = pyarrow.fs.FileSystem.from_uri(path)
        self.path, self.width, self.out = path, width, fs.open_output_stream(p)
        self.ends: list[int] = []
        self.ids: list[int] = []
        self.nulls = self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.total += len(ids) // self.width
        self.out.write(ids)
        self.ends.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> tuple[str, int, int]:
        ends = EliasFano.of(np.array(self.ends, np.uint64)).dump()
        base = self.ids[0] if self.ids else 0
        keys = EliasFano.of(np.array([i - base for i in self.ids], np.uint64)).dump()
        foot = json.dumps({"docs": len(self.ends), "tokens": self.total, "width": self.width, "ends": len(ends), "keys": len(keys), "nulls": self.nulls, "base": base}).encode()
        self.out.write(ends + keys + foot + struct.pack("<I", len(foot)) + MAGIC)
        self.out.close()
        return self.path, len(self.ends), self.total


class Shard:
    """Random access to a shard: reads its end, then only the ids asked for."""

    def __init__(self, path: str):
        fs, p = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(p)
        size = self.file.size()
        tail = self.file.read_at(8, size - 8)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        (n,) = struct.unpack("<I", tail[:4])
        self.meta = m = json.loads(self.file.read_at(n, size - 8 - n))
        at = m["tokens"] * m["width"]
        self.ends = EliasFano.load(self.file.read_at(m["ends"], at))
        self.keys = EliasFano.load(self.file.read_at(m["keys"], at + m["ends"]))

    def documents(self, first: int, last: int):
        """(doc_id, start in the shard, ids) of documents first up to last."""
        m, width = self.meta, self.meta["width"]
        ends = self.ends.slice(first, last).astype(np.int64)
        begin = self.ends.select(first - 1) if first else 0
        ids = np.frombuffer(self.file.read_at((int(ends[-1]) - begin) * width, begin * width), f"<u{width}") if len(ends) else np.zeros(0)
        nulls = max(0, min(m["nulls"], last) - first)
        keys = [None] * nulls + [int(k) + m["base"] for k in self.keys.slice(max(0, first - m["nulls"]), max(0, last - m["nulls"])).tolist()]
        start = begin
        for key, end in zip(keys, ends.tolist()):
            yield key, start, ids[start - begin : end - begin]
            start = end

    def close(self) -> None:
        self.file.close()


class ChunkTokenizer:
    """The tokenizers library on whole texts, asked once for each distinct chunk.

    A text is cut into chunks only where the library itself cuts:

    - at blanks and line feeds.  They compose with nothing, stop marks from
      being reordered, are dropped by the split, and no added token has one;
    - before a stop or comma that a blank follows, if the sign before it is
      one that the library, asked for each of LETTERS, makes one piece that
      ends there.  A text with any other sign in such a place is cut at
      blanks alone.

    A-Z are written small first where that is what the library would do
    anyway.  So a text's ids are those of its chunks in order, for vocabularies whose
    split drops white space; others are refused.
    """

    #: Signs that may stand before a stop or comma where a text is cut.
    LETTERS = [chr(i) for i in range(0x21, 0x250)]

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        pieces = lambda t: [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(t) if self.tok.normalizer else t)]
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if pieces("a b\nc") != ["a", "b", "c"] or any(set(t) & set(" \n.,") for t in added):
            raise ValueError(f"{path} does not drop white space")
        self.kind = f"<u{width}"
        ends_piece = lambda c: all(pieces(x + c + s) == [*pieces(x + c), s] for x in ("", "a", "1", "\u00b7") for s in ".,")
        self.closed = [c for c in self.LETTERS if c.isalnum() and ends_piece(c)]
        # A blank, stop or comma elsewhere: there the sign before may be one piece with it.
        self.open = "(?:^|[^" + "".join(self.closed) + "])[.,] "
        # A-Z may become a-z before the library does that, but where a mark may compose or an added token be made.
        self.lower = pieces("AZ") == ["az"] and all("<" in t for t in added)
        self.keeps_case = "[^\\x00-\\x{24F}]|<"
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        if self.lower:
            texts = pc.if_else(pc.match_substring_regex(texts, self.keeps_case), texts, pc.ascii_lower(texts))
        cut = texts
        for s in ".,":
            cut = pc.replace_substring(cut, s + " ", f" {s} ")
        return pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, self.open), texts, cut), " ")

    def _encode(self, chunks: list[str]):
        """(chunk, ids) of chunks; plain words go many at a time, told apart by their tokens' word ends."""
        words = [c for c in chunks if c.isalpha() and max(c) < "\u0100"]
        rest = list(set(chunks).difference(words))
        lines = [words[i : i + 256] for i in range(0, len(words), 256)]
        for line, e in zip(lines, self.tok.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            raw, ends = ids.tobytes(), (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(ends) != len(line):  # never for vocabularies with word ends
                rest += line
                continue
            yield from zip(line, (raw[x:y] for x, y in zip([0, *ends.tolist()], ends.tolist())))
        for c, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)):
            yield c, np.array(e.ids, self.kind).tobytes()

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's end."""
        cut = self._chunks(texts)
        chunks = cut.flatten().dictionary_encode()
        distinct, known, older, long = chunks.dictionary.to_pylist(), self.known, self.older, {}
        if len(known) > CACHE_WORDS:
            older, known = self.older, self.known = known, {}
        fresh = []
        for c in distinct:
            if c not in known:
                if c in older:
                    known[c] = older[c]
                else:
                    fresh.append(c)
        for c, ids in self._encode(fresh):
            (known if len(c) <= 64 else long)[c] = ids
        found = [known[c] if c in known else long[c] for c in distinct]
        pool = np.frombuffer(b"".join(found), self.kind)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // np.dtype(self.kind).itemsize
        lengths = np.diff(ends, prepend=0)
        at = chunks.indices.to_numpy(zero_copy_only=False)
        each = lengths[at]
        upto = np.r_[0, np.cumsum(each)]
        ids = pool[np.repeat((ends - lengths)[at] - upto[:-1], each) + np.arange(upto[-1])]
        return ids, upto[cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()]


@lru_cache(maxsize=2)
def _tokenizer(path: str, width: int) -> ChunkTokenizer:
    return ChunkTokenizer(path, width)


def write_tokens(docs: DataFrame, scratch: Scratch, vocabulary: str, end_id: int = 1, width: int = 2) -> DataFrame:
    """Encodes texts and writes shards in ascending doc_id order.

    ``docs`` needs doc_id and text; a null text counts as empty, every
    document gets ``end_id`` at its end, null doc_ids come first and rows of
    one doc_id follow each other by text.  An empty table gives no shard.
    Returns the manifest: part, seq, path, n_docs, n_tokens.  A task that is
    run again writes under another name, and only names in the manifest count.
    """
    folder = scratch.path("shards")
    fs, p = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(p, recursive=True)

    def run(batches):
        tok, part, seq, shard = _tokenizer(vocabulary, width), TaskContext.get().partitionId(), 0, None
        end = np.array([end_id], f"<u{width}").tobytes()
        done = []
        for batch in parts(batches, "text", ENCODE_BYTES):
            ids, ends = tok.encode_batch(batch.column(1))
            start = 0
            for doc_id, to in zip(batch.column(0).to_pylist(), ends.tolist()):
                if shard is None:
                    shard = ShardWriter(f"{folder}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.ids", width)
                shard.add(doc_id, ids[start:to].tobytes() + end)
                start = to
                if shard.total >= SHARD_IDS or len(shard.ends) >= SHARD_DOCS:
                    done.append((part, seq, *shard.close()))
                    shard, seq = None, seq + 1
        if shard is not None:
            done.append((part, seq, *shard.close()))
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "path", "n_docs", "n_tokens"), d)) for d in done], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    docs = check_columns(docs, "doc_id", "text")
    # Rows of one (or no) doc_id are dealt by how their texts begin, and sorted by whole texts.
    first = F.col("doc_id").asc_nulls_first()
    docs = docs.repartitionByRange(first, F.substring("text", 1, 32)).sortWithinPartitions(first, "text")
    return scratch.cut(map_arrow(docs, run, "part int, seq int, path string, n_docs long, n_tokens long"), "manifest")


def read_tokens(manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Reads shards back: doc_id, start, n_tokens, ids_crc32, with ``keep_ids`` also ids.

    ``start`` counts the ids of all documents before it.  The manifest has a
    row for each shard; a shard is read in parts of READ_DOCS documents, which
    are dealt to tasks by the bytes of all shards.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    pieces = manifest.select("path", "n_docs", F.coalesce(before, F.lit(0)).alias("base"))
    pieces = pieces.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(READ_DOCS).cast("long"))))
    n_parts, n_ids = manifest.agg(F.sum(F.ceil(F.col("n_docs") / READ_DOCS)), F.sum("n_tokens")).first()
    pieces = dealt(pieces, n_parts or 0, 4 * (n_ids or 0))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if keep_ids else {})
                for key, start, ids in shard.documents(row["first"], min(row["n_docs"], row["first"] + READ_DOCS)):
                    out["doc_id"].append(key)
                    out["start"].append(row["base"] + start)
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    if keep_ids:
                        out["ids"].append(ids.tolist())
                shard.close()
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids))

    return map_arrow(pieces, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)
