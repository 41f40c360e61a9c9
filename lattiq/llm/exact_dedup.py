"""Exact dedup with counting quotient filters.

A filter keeps a sorted multiset of numbers of a given width.  A number's high
bits, its quotient, are not stored: they say at which slot its run begins.  A
run has the remainders of one quotient in order, each followed by the digits
of its count less one, which take no slot for numbers met once.  Three bits a
slot tell which quotients have a run, where runs end, and which slots are
digits.  Two filters merge without loss by walking their sorted remainders and
adding counts, into more slots where they need them.

Each partition builds filters of its documents' 64-bit fingerprints, one for
each block of the highest bits; a block's filters are merged in one task.
Only fingerprints with a count above one are routed on: there the bytes of the
normalised texts are compared.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, check_columns, fresh, map_arrow

#: Fingerprints a merged block should hold about; more rows make more blocks, never larger ones.
BLOCK_ROWS = 1 << 16
#: Share of its slots that a new filter fills at most.
LOAD = 0.95
#: Bits of the fixed-size map that keeps most texts that are single from being shuffled, as a power of two.
MAP_BITS = 24
_BLANK = {i: None for i in (0x20, *range(0x09, 0x0E))}


class QuotientFilter:
    """A counting quotient filter of numbers of ``bits`` bits, ``q`` of them a quotient."""

    HEAD = "<BBQQ"

    def __init__(self, bits: int, q: int, n: int, occupied: np.ndarray, run_ends: np.ndarray, digits: np.ndarray, slots: np.ndarray):
        self.bits, self.q, self.n = bits, q, n
        self.occupied, self.run_ends, self.digits, self.slots = occupied, run_ends, digits, slots

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """From sorted distinct ``keys`` and how often each was met."""
        keys, extra = np.asarray(keys, np.uint64), np.asarray(counts, np.int64).astype(np.uint64) - np.uint64(1)
        # Counts may need more slots at shorter remainders, so the size is found from the shortest there can be.
        need = len(keys) + int(sum((extra >> np.uint64(8 * i)).astype(bool).sum() for i in range(8)))
        q = min(max(0, int(np.ceil(np.log2(max(1, need) / LOAD)))), bits - 8)
        r = bits - q
        quotient, remainder = (keys >> np.uint64(r) if r < 64 else np.zeros(len(keys), np.uint64)).astype(np.int64), keys & cls._mask(r)
        n_digits = sum(((extra >> np.uint64(i)) != 0).astype(np.int64) for i in range(0, 64, r))
        width = 1 + n_digits
        before = np.cumsum(width) - width
        # A run begins at its quotient's slot, or where the run before it ends.
        at = (np.maximum.accumulate(quotient - before) + before) if len(keys) else before
        n = int(at[-1] + width[-1]) if len(keys) else 0
        slots, digits, run_ends, occupied = np.zeros(n, np.uint64), np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros(1 << q, np.uint8)
        slots[at] = remainder
        for k in range(int(n_digits.max(initial=0))):
            has = n_digits > k
            slots[at[has] + 1 + k] = (extra[has] >> np.uint64(r * k)) & cls._mask(r)
            digits[at[has] + 1 + k] = 1
        last = np.r_[quotient[1:] != quotient[:-1], True] if len(keys) else np.zeros(0, bool)
        run_ends[(at + width - 1)[last]] = 1
        occupied[quotient] = 1
        table = np.empty((n, r), np.uint8)
        for i in range(r):
            table[:, i] = (slots >> np.uint64(i)) & np.uint64(1)
        packed = np.packbits(table, bitorder="little")
        return cls(bits, q, n, *(np.packbits(x, bitorder="little") for x in (occupied, run_ends, digits)), packed)

    @staticmethod
    def _mask(r: int) -> np.uint64:
        return np.uint64((1 << r) - 1)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in order, and their counts."""
        r, n = self.bits - self.q, self.n
        bits = lambda x, size: np.unpackbits(x, count=size, bitorder="little")
        quotients, ends = np.flatnonzero(bits(self.occupied, 1 << self.q)), np.flatnonzero(bits(self.run_ends, n))
        starts = np.maximum(quotients, np.r_[0, ends[:-1] + 1]) if len(ends) else ends
        length = ends - starts + 1
        used = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        table, value = bits(self.slots, n * r).reshape(n, r), np.zeros(n, np.uint64)
        for i in range(r):
            value |= table[:, i].astype(np.uint64) << np.uint64(i)
        value = value[used]
        digit = bits(self.digits, n)[used].astype(bool)
        first = np.flatnonzero(~digit)
        keys = (np.repeat(quotients, length)[first].astype(np.uint64) << np.uint64(r) if r < 64 else np.uint64(0)) | value[first]
        counts, of = np.ones(len(first), np.uint64), np.cumsum(~digit) - 1
        place = np.flatnonzero(digit)
        np.add.at(counts, of[place], value[place] << (np.uint64(r) * (place - first[of[place]] - 1).astype(np.uint64)))
        return keys, counts.astype(np.int64)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        keys, counts = merge_sorted([f.items() for f in filters])
        return cls.of(keys, counts, filters[0].bits)

    def dump(self) -> bytes:
        return struct.pack(self.HEAD, self.bits, self.q, self.n, len(self.slots)) + b"".join(x.tobytes() for x in (self.occupied, self.run_ends, self.digits, self.slots))

    @classmethod
    def load(cls, raw: bytes) -> QuotientFilter:
        bits, q, n, size = struct.unpack_from(cls.HEAD, raw)
        at, out = struct.calcsize(cls.HEAD), []
        for length in (-(-(1 << q) // 8), -(-n // 8), -(-n // 8), size):
            out.append(np.frombuffer(raw, np.uint8, length, at))
            at += length
        return cls(bits, q, n, *out)


def merge_sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted array of distinct keys from several, with the sums of their counts; a stable sort merges runs that are sorted."""
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def normalised(text: Column) -> Column:
    """The text (null: empty) without ``[\\x20\\x09-\\x0D]``."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def build_filters(fps: DataFrame, blocks: int) -> DataFrame:
    """Counting quotient filters of each partition of ``fps`` (column fp, long): block int, filter binary.

    ``blocks`` is a power of two; a fingerprint's highest bits are its block,
    and the filter of a block has the other bits.
    """
    bits = 64 - (blocks.bit_length() - 1)

    def run(batches):
        held, late, n = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            late.append(np.sort(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            n += len(late[-1])
            if n > 1 << 20:
                held, late, n = merge_sorted([held, *[(x, np.ones(len(x), np.int64)) for x in late]]), [], 0
        keys, counts = merge_sorted([held, *[(x, np.ones(len(x), np.int64)) for x in late]])
        if not len(keys):
            return
        block = (keys >> np.uint64(bits)).astype(np.int64) if bits < 64 else np.zeros(len(keys), np.int64)
        low = keys & QuotientFilter._mask(bits)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        made = [QuotientFilter.of(low[a:b], counts[a:b], bits).dump() for a, b in zip(starts, np.r_[starts[1:], len(keys)])]
        yield pa.RecordBatch.from_pydict({"block": pa.array(block[starts], pa.int32()), "filter": pa.array(made, pa.binary())})

    return map_arrow(check_columns(fps, "fp"), run, "block int, filter binary")


def merge_filters(filters: DataFrame, at_least: int = 2) -> DataFrame:
    """Merges the filters of each block: fp, n for counts of ``at_least`` or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = QuotientFilter.merged([QuotientFilter.load(raw) for raw in pdf["filter"]])
        keys, counts = merged.items()
        if merged.bits < 64:
            keys = keys | np.uint64(int(pdf["block"].iloc[0]) << merged.bits)
        keep = counts >= at_least
        return pd.DataFrame({"fp": keys[keep].view(np.int64), "n": counts[keep]})

    return filters.groupBy("block").applyInPandas(run, "fp long, n long")


def _may_be_among(docs: DataFrame, fps: DataFrame) -> DataFrame:
    """Rows of ``docs`` but for most whose fp is not in ``fps``: a map of 2^MAP_BITS bits by the fingerprints' first bits.

    The map is words of 64 bits, at most 2^(MAP_BITS - 6) rows whatever the
    tables' size, so it may be sent to every task.  With more fingerprints
    than bits it lets most rows through, which the join that follows drops.
    """
    top = lambda fp, n: F.shiftrightunsigned(fp, 64 - n)
    words = fps.groupBy(top(F.col("fp"), MAP_BITS - 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (top(F.col("fp"), MAP_BITS) % 64).cast("int"))).alias("_bits"))
    docs = docs.join(F.broadcast(words), top(F.col("fp"), MAP_BITS - 6) == F.col("_word"))
    return docs.filter(F.getbit("_bits", (top(F.col("fp"), MAP_BITS) % 64).cast("int")) == 1).drop("_word", "_bits")


def _compare_bytes(docs: DataFrame) -> DataFrame:
    """Byte verification of rows that come sorted by fp.

    Each row's normalised text is compared, byte for byte, with the texts met
    so far under its fingerprint in this task; the class is the SHA-256 of
    the text that it equals, so it is the same in every task.
    """

    def run(batches):
        now, seen = None, {}
        for batch in batches:
            classes, texts = [], batch.column(batch.schema.get_field_index("text")).to_pylist()
            for fp, text in zip(batch.column(0).to_pylist(), texts):
                raw = (text or "").translate(_BLANK).encode("utf-8", "surrogatepass")
                if fp != now:
                    now, seen = fp, {}
                if raw not in seen:  # a dict compares the bytes themselves
                    seen[raw] = hashlib.sha256(raw).hexdigest()
                classes.append(seen[raw])
            yield pa.RecordBatch.from_pydict({"fp": batch.column(0), "doc_id": batch.column(1), "n_points": batch.column(2), "text_sha256": pa.array(classes, pa.string())})

    return map_arrow(docs, run, "fp long, doc_id long, n_points long, text_sha256 string")


def exact_dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Groups texts that are identical after deleting ``[\\x20\\x09-\\x0D]``.

    ``docs`` needs doc_id and text; a null text counts as empty and all empty
    texts are one group.  Of a group the row with most code points in its
    original text stays, then that with the smallest doc_id (null ids last);
    rows alike in both are repeated rows, of which all have kept true.
    Returns a row for each row: doc_id, keep_id, group_size, kept,
    text_sha256.  An empty table gives none.
    """
    docs = check_columns(docs, "doc_id", "text")
    norm = F.encode(normalised(F.col("text")), "UTF-8")
    slim = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_points"), F.sha2(norm, 256).alias("text_sha256"))
    slim = scratch.cut(slim.withColumn("fp", fingerprint(F.col("text_sha256"))), "slim")
    blocks = 1 << max(0, -(-slim.count() // BLOCK_ROWS) - 1).bit_length()
    many = scratch.cut(merge_filters(build_filters(slim, blocks)), "many")
    single = slim.join(many, "fp", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    routed = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_points"), fingerprint(F.sha2(norm, 256)).alias("fp"), "text")
    routed = _may_be_among(routed, many).join(many.select("fp").hint("merge"), "fp").select("fp", "doc_id", "n_points", "text")
    checked = scratch.cut(_compare_bytes(routed), "checked")
    groups = scratch.cut(
        checked.groupBy("fp", "text_sha256").agg(
            F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("order"))).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        ),
        "groups",
    )
    member = checked.join(groups, ["fp", "text_sha256"])
    keep_id = -F.col("best.order")
    kept = (F.col("n_points") == F.col("best.n_points")) & F.col("doc_id").eqNullSafe(keep_id)
    return single.unionByName(member.select("doc_id", keep_id.alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256"))


def fingerprint(sha256: Column) -> Column:
    """The first 64 bits of a digest in hexadecimal, as a signed number."""
    high, low = F.conv(F.substring(sha256, 1, 8), 16, 10).cast("long"), F.conv(F.substring(sha256, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def drop_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs``, all columns, without the rows that exact_dedup doesn't keep; one of fully repeated rows stays.

    Null and empty texts are one group of copies; rows without doc_id are
    members like others and go first.  Of rows that repeat doc_id and
    normalised text any one stays.  Columns of any name are left alone, and an
    empty table gives none.
    """
    found = scratch.cut(exact_dedup(docs, scratch), "found")
    digest = F.sha2(F.encode(normalised(docs["text"]), "UTF-8"), 256)
    key, sha, of = fresh(docs, "key", "sha", "of")
    keys = lambda df, name: scratch.cut(df.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).distinct(), name)
    is_in = lambda k: docs["doc_id"].eqNullSafe(k[key]) & (digest == k[sha])
    gone = keys(found.filter(~F.col("kept")), "gone")
    again = keys(found.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    out = docs.join(gone, is_in(gone), "left_anti")
    if again.isEmpty():
        return out
    once = docs.join(again, is_in(again), "left_semi").withColumn(of, digest).dropDuplicates(["doc_id", of])
    return out.join(again, is_in(again), "left_anti").unionByName(once.select(*docs.columns))
