"""Near-duplicate detection with HyperMinHash sketches.

A document's set of word shingles is sketched twice, each bucket keeping the
least of its hash values as a count of leading zeros and some bits after its
first one.  K buckets with a hash of their own (6 and 10 bits) make bands of
four registers, one 64-bit key each; documents with a key in common are
candidates.  One hash that deals the set to FINE buckets (4 and 4 bits)
estimates the Jaccard similarity: the share of equal buckets, corrected for
buckets that agree by chance.  A set that is not much larger than FINE is
nearly told in full by it, so few pairs below the threshold get through, and
what could still reach it is verified on full sets.

No group of candidates is ever expanded into pairs to be linked.  Documents
with the same set are one node.  In each bucket the node that shares most
buckets is the hub, all others are compared with it, and confirmed links make
components.  What is left are pairs of different components that share a
bucket.  Open buckets, where there are any, of up to BLOCK nodes compare their
nodes' sketches and give only pairs that may be similar.  Of larger ones, say
of pages that share a frame but not what is in it, the nodes go by the rarest
shingles of their sets instead: of similar sets, the share of each that may
differ and one shingle more always have one in common, by any one order of
shingles.  Sets whose own shingles are that many have no partner and give no
rows; the others meet in the buckets of those shingles.  Should such a bucket
again have more than BLOCK nodes, it is cut into blocks, and only nodes
outside its largest component are sent to the others.

Joins of sides that grow with the data are merge joins at every size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch, check_columns, fresh, map_arrow, slices

WORDS = 5
K, ROWS = 128, 4
FINE = 512
#: Nodes in a block of a bucket: so many are compared in pairs by their sketches, a constant for each node.
BLOCK = 2048
#: Chance that fine buckets of disjoint sets agree: equal zero counts (a third) times equal mantissas.
CHANCE = 1 / 48
#: Standard errors below the threshold at which an estimate rules a pair out.
MARGIN = 6
#: Words whose hashes a worker remembers.
CACHE_WORDS = 150_000

_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BANDS = _RNG.integers(0, 1 << 63, K // ROWS, dtype=np.uint64)
_BASE, _MIX, _DEAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: str | bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; see near_dedup for what those are."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()  # both for ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(w) - size + 1
    h = w[:n].copy()
    for i in range(1, size):
        h *= _BASE
        h += w[i : n + i]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _leading_zeros(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of leading zeros up to ``most``, and the values shifted left by those."""
    zeros, x = np.zeros(len(x), np.uint64), x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        short = (x >> np.uint64(64 - step)) == 0
        zeros[short] += np.uint64(step)
        x[short] <<= np.uint64(step)
    return np.minimum(zeros, np.uint64(most)), x


def registers(items: np.ndarray) -> np.ndarray:
    """The K registers of a non-empty set."""
    low = np.full(K, np.iinfo(np.uint64).max)
    for at in range(0, len(items), 1024):
        np.minimum(low, np.multiply.outer(_FACTORS, items[at : at + 1024]).min(1), out=low)
    zeros, x = _leading_zeros(low, 63)
    return ((zeros << np.uint64(10)) | ((x >> np.uint64(53)) & np.uint64(1023))).astype(np.uint16)


def fine_sketch(items: np.ndarray) -> np.ndarray:
    """A byte for each of FINE buckets, 0 for an empty one, else 16 (1 + zeros) + mantissa."""
    h = items * _DEAL
    h ^= h >> np.uint64(29)
    bucket, value = h >> np.uint64(55), h << np.uint64(9)
    order = np.lexsort((value, bucket))
    bucket, value = bucket[order], value[order]
    first = np.r_[True, bucket[1:] != bucket[:-1]] if len(bucket) else np.zeros(0, bool)
    zeros, x = _leading_zeros(value[first], 14)
    out = np.zeros(FINE, np.uint8)
    out[bucket[first].astype(np.int64)] = ((zeros + np.uint64(1)) << np.uint64(4)) | ((x >> np.uint64(59)) & np.uint64(15))
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key for each band; equal for equal registers, and told apart by band."""
    packed = np.ascontiguousarray(regs).view(np.uint64)
    h = (packed ^ _BANDS) * _MIX
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of fine sketches (last axis), corrected for agreement by chance."""
    union = np.maximum(((a | b) != 0).sum(-1), 1)
    return np.maximum(0.0, (((a == b) & (a != 0)).sum(-1) / union - CHANCE) / (1 - CHANCE))


def may_reach(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether similarities could be ``percent`` or more, by fine sketches and set sizes.

    Of N shingles in a union, those that stand for its U buckets are drawn
    without replacement, so the count of equal buckets varies by
    U t (1 - t) (N - U) / (N - 1), and by chance agreement beside that.
    """
    t = percent / 100
    equal, union = ((a == b) & (a != 0)).sum(-1), ((a | b) != 0).sum(-1)
    whole = np.maximum((n_a + n_b) / (1 + t), union)
    spread = np.sqrt(union * t * (1 - t) * (whole - union) / np.maximum(whole - 1, 1) + union * (1 - t) * CHANCE)
    close = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return close & (equal >= union * (t + (1 - t) * CHANCE) - MARGIN * spread - 1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |a & b| >= percent |a | b|, on full sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set, null for the empty set), regs, fine, packed (the text, compressed) of each row."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch, texts in slices(batches, "text"):
            n, ids, regs, fine, packed = [], [], [], [], []
            for t in texts:
                s = shingles(t)
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
                fine.append(fine_sketch(s).tobytes() if len(s) else None)
                packed.append(squeeze.compress(t.encode("utf-8", "surrogatepass")) if len(s) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_shingles": pa.array(n, pa.int64()), "set_id": pa.array(ids, pa.binary()), "regs": pa.array(regs, pa.binary()), "fine": pa.array(fine, pa.binary()), "packed": pa.array(packed, pa.binary())})

    return map_arrow(check_columns(docs, "doc_id", "text"), run, "doc_id long, n_shingles long, set_id binary, regs binary, fine binary, packed binary")


def _bucket_rows(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = np.concatenate([band_keys(np.frombuffer(r.as_py(), np.uint16)) for r in batch.column(1)])
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "node": pa.array(np.repeat(batch.column(0).to_numpy(), K // ROWS))})

    return map_arrow(nodes.select("node", "regs"), run, "key long, node long")


def _merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def _may_be_similar(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and sketches do not rule them out."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}"))
    both = _merged(_merged(pairs, of("a"), "a"), of("b"), "b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(-1, FINE) for i in (4, 5))
                n_a, n_b = (part.column(i).to_numpy() for i in (2, 3))
                yield part.select([0, 1]).filter(pa.array(may_reach(x, n_a, y, n_b, percent)))

    return map_arrow(both.select("a", "b", "n_a", "n_b", "fine_a", "fine_b"), run, "a long, b long")


def _confirmed(pairs: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (a, b) that are similar on the full sets of their texts."""
    members = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = scratch.cut(_merged(nodes.select("node", "packed"), members, "node", "left_semi"), f"{name}-texts")

    def run(batches):
        unpack, now, held = zstandard.ZstdDecompressor().decompress, None, None
        for batch in batches:
            good = []
            for a, b, b_id in zip(batch.column(1), batch.column(3), batch.column(2).to_pylist()):
                if b_id != now:
                    now, held = b_id, shingles(unpack(b.as_py()))
                good.append(similar(shingles(unpack(a.as_py())), held, percent))
            yield batch.select([0, 2]).filter(pa.array(good, pa.bool_()))

    both = _merged(pairs, texts.select(F.col("node").alias("a"), F.col("packed").alias("at")), "a")
    both = _merged(both, texts.select(F.col("node").alias("b"), F.col("packed").alias("bt")), "b")
    found = scratch.cut(map_arrow(both.select("a", "at", "b", "bt"), run, "a long, b long"), name)
    scratch.drop(f"{name}-texts")
    return found


def _cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that share a bucket and may be similar by their sketches.

    rows: key, node, comp, main (the bucket's largest component), n, fine,
    regs, chunks.  All nodes stay in their own block of a bucket, those of
    other components than the main one are sent to its other blocks as well.
    Where a bucket is that of a band, pairs that share an earlier band are
    left to that one: its bucket is open too and compared as well, or has no
    other nodes, and then its hub has been compared.
    """
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    visits = F.when(F.col("comp") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    rows = rows.withColumn("own", own).withColumn("block", F.explode(visits))
    rows = rows.select("key", "block", (F.col("own") == F.col("block")).alias("home"), (F.col("comp") == F.col("main")).alias("main"), "node", "comp", "n", "fine", "regs")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block")

    def pairs_of(key, home, main, node, comp, n, fine, regs):
        x = np.frombuffer(b"".join(fine), np.uint8).reshape(len(node), FINE)
        bands = np.frombuffer(b"".join(regs), np.uint64).reshape(len(node), K // ROWS)
        band = np.flatnonzero(band_keys(np.frombuffer(regs[0], np.uint16)) == key)
        earlier = bands[:, : band[0] if len(band) else 0]
        here = np.flatnonzero(home)
        for p in np.flatnonzero(~main).tolist():
            # Of two visitors of each other the lesser one asks; who is of the main component never does.
            q = here[(comp[here] != comp[p]) & (main[here] | (node[p] < node[here]))]
            q = q[100 * np.minimum(n[q], n[p]) >= percent * np.maximum(n[q], n[p])]
            if len(q):
                q = q[may_reach(x[q], n[q], x[p], n[p], percent)]
                for r in q[(earlier[q] != earlier[p]).all(1)].tolist():
                    yield (node[p], node[r]) if node[p] < node[r] else (node[r], node[p])

    def run(batches):
        now, held, fine, regs, seen = None, [[], [], [], [], []], [], [], set()

        def close():
            if now is not None and len(fine) > 1:
                seen.update(pairs_of(now[0], *map(np.array, held), fine, regs))

        def give():
            out = sorted(seen)
            seen.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array([int(p[0]) for p in out], pa.int64()), "b": pa.array([int(p[1]) for p in out], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, *others = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(7))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if (at := (key[s], block[s])) != now:
                    close()
                    now, held, fine, regs = at, [[], [], [], [], []], [], []
                for h, part in zip(held, others):
                    h.extend(part[s:e].tolist())
                fine.extend(batch.column(7).slice(s, e - s).to_pylist())
                regs.extend(batch.column(8).slice(s, e - s).to_pylist())
            if len(seen) > 50_000:
                yield give()
        close()
        yield give()

    return map_arrow(rows, run, "a long, b long")


def _shingle_rows(nodes: DataFrame) -> DataFrame:
    """node, n, shingle of each shingle of the nodes' sets."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for node, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = shingles(unpack(packed.as_py())).view(np.int64)
                for at in range(0, len(found), 1 << 16):
                    part = found[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"node": np.full(len(part), node), "n": np.full(len(part), n), "shingle": part})

    return map_arrow(nodes.select("node", "n", "packed"), run, "node long, n long, shingle long")


def rare_buckets(nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """key, node: each node under those of its rarest shingles that a similar set must share one of, if others have them.

    Sets of n shingles that are similar share percent / 100 of n or more, so
    of the others and one more, the rarest first, they share at least one.
    """
    rows = scratch.cut(_shingle_rows(nodes), "rare-rows")
    often = scratch.cut(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "rare-counts")
    shared = _merged(rows, often, "shingle").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("all"))
    # Those met once come first in the order and make no bucket.
    take = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("all"))
    return shared.filter(take > 0).select("node", F.explode(F.slice("all", F.lit(1), take.cast("int"))).alias("x")).select(F.col("x.shingle").alias("key"), "node")


def _open_buckets(labelled: DataFrame, at_least: int, scratch: Scratch, name: str) -> DataFrame:
    """key, size, main (the largest component) of buckets of ``at_least`` nodes of two components or more."""
    sizes = scratch.cut(labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("nodes")), name)
    found = sizes.groupBy("key").agg(F.sum("nodes").alias("size"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("nodes", "comp")).alias("most"))
    return found.filter(f"comps > 1 AND size >= {at_least}").select("key", "size", F.col("most.comp").alias("main"))


def late_pairs(labelled: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs that hubs left open and that may be similar by sizes and sketches; labelled: key, node, comp of the buckets' nodes."""
    slim = nodes.select("node", "n", "fine", "regs")
    found = lambda buckets, rows: _cross_pairs(_merged(_merged(rows, buckets, "key"), slim, "node").select("key", "node", "comp", "main", "n", "fine", "regs", "chunks"), percent)
    # In a bucket of two the one pair there is was compared with its hub.
    buckets = scratch.cut(_open_buckets(labelled, 3, scratch, "sizes-1"), "open")
    pairs = found(buckets.filter(F.col("size") <= BLOCK).select("key", "main", F.lit(1).cast("long").alias("chunks")), labelled)
    large = buckets.filter(F.col("size") > BLOCK)
    if large.isEmpty():
        return pairs
    members = scratch.cut(_merged(labelled, large.select("key"), "key").select("node", "comp").distinct(), "large")
    rare = scratch.cut(_merged(rare_buckets(_merged(nodes, members.select("node"), "node", "left_semi"), percent, scratch), members, "node").select("key", "node", "comp"), "rare")
    buckets = _open_buckets(rare, 2, scratch, "sizes-2").select("key", "main", F.ceil(F.col("size") / BLOCK).cast("long").alias("chunks"))
    return pairs.union(found(scratch.cut(buckets, "open-rare"), rare))


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp (the least node of its component) for the nodes of links (a, b).

    Alternates large and small stars, whose number of rounds grows with the
    logarithm of a component's size, and cuts the lineage in each round.  The
    least neighbours are tables of their own, so both sides of the joins have
    an exchange and adaptive execution can split the edges of a hub.
    """
    edges = scratch.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    state, turn = None, 0
    sums = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")), f"{name}-m{turn}")
        # Large star: each larger neighbour goes to the least one.
        large = _merged(both.filter("v > u"), least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = scratch.cut(large, f"{name}-l{turn}")
        # Small star: smaller neighbours and the node itself go to the least one.
        least = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"), f"{name}-n{turn}")
        small = _merged(large, least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        turn += 1
        small = scratch.cut(small, f"{name}-{turn}")
        scratch.drop(*(f"{name}-{kind}{turn - 1}" for kind in ("l", "m", "n", "")))
        edges, before, state = small, state, sums(small)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_dedup(docs: DataFrame, scratch: Scratch, percent: int = 80) -> DataFrame:
    """Links documents whose shingle sets have 100 |a & b| >= percent |a | b|.

    Texts are lower-cased in A-Z and cut into words ``[^\\x20\\x09-\\x0D]+``; a
    set has the distinct shingles of five words, with fewer words the whole
    sequence as one.  Documents without words (null or empty texts) and rows
    without doc_id are linked with nothing; rows of one doc_id are one node.

    Returns a row for each row: doc_id, n_shingles, component_id (the
    smallest doc_id that links reach, its own included), kept (whether that
    is its doc_id).  Every candidate is compared: with 32 bands of 4
    registers a pair at 0.85 fails to be one with a chance of 6e-11, at 0.8
    of 5e-8, and the estimate rules one out six standard errors below.
    """
    sketched = scratch.cut(sketch(docs), "sketch")
    nodes = sketched.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("fine").alias("fine"), F.first("packed").alias("packed"))
    nodes = scratch.cut(nodes, "nodes")

    rows = scratch.cut(_bucket_rows(nodes), "rows")
    sizes = scratch.cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    buckets = scratch.cut(_merged(rows, sizes, "key"), "buckets")
    scratch.drop("rows", "sizes")
    degree = buckets.groupBy("node").agg(F.sum("size").alias("degree"))
    hubs = _merged(buckets, degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("order"))).alias("best")).select("key", (-F.col("best.order")).alias("hub"))
    stars = _merged(buckets, hubs, "key").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = scratch.cut(stars, "stars")
    tried = scratch.cut(_may_be_similar(stars, nodes, percent), "tried")
    links = _confirmed(tried, nodes, percent, scratch, "links")
    comps = scratch.cut(components(links, scratch, "cc"), "comps")

    labelled = _merged(buckets.select("key", "node"), comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    labelled = scratch.cut(labelled, "labelled")
    scratch.drop("buckets", "tried")
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = scratch.cut(_merged(late_pairs(labelled, nodes, percent, scratch).distinct(), done, ["a", "b"], "left_anti"), "crossing")
    scratch.drop("labelled", "stars", "open", "large", "rare", "rare-rows", "rare-counts", "sizes-1", "sizes-2")
    late = _confirmed(crossing, nodes, percent, scratch, "late")
    by_set = _merged(nodes.select("set_id", "node"), comps, "node", "left").select("set_id", F.coalesce("comp", "node").alias("component_id"))
    if not late.isEmpty():  # then components grow together
        of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
        ends = _merged(_merged(late, of("a"), "a", "left"), of("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
        grown = scratch.cut(components(ends, scratch, "all"), "grown")
        by_set = _merged(by_set, grown, F.col("component_id") == F.col("node"), "left").select("set_id", F.coalesce("comp", "component_id").alias("component_id"))
    by_set = scratch.cut(by_set, "by_set")
    scratch.drop("nodes", "crossing", "comps", "links", "late")
    # Rows without a set are linked with nothing, and join nothing.
    slim = sketched.select("doc_id", "n_shingles", "set_id")
    found = _merged(slim.filter("set_id IS NOT NULL"), by_set, "set_id", "left").select("doc_id", "n_shingles", "component_id")
    found = found.union(slim.filter("set_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, scratch: Scratch, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one document (the smallest doc_id) of each component.

    Documents without words and rows without doc_id stay, as they are linked
    with nothing; rows that repeat a doc_id are one document and stay or go
    together.  Columns of any name are left alone, and an empty table gives none.
    """
    (key,) = fresh(docs, "gone")
    gone = scratch.cut(near_dedup(docs, scratch, percent).filter("NOT kept").select(F.col("doc_id").alias(key)), "gone")
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")
