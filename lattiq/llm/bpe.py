"""Byte-level BPE that speculates and verifies, and its decoder.

A word (a piece of the vocabulary's split pattern) is first cut greedily into
the longest tokens.  A cut into tokens that each encode to themselves is the
result of merging exactly when each adjacent pair is *compatible*: when the
pair's joined bytes encode to that very pair.  The pairs of all new words of a
slice are checked together as one array against a table of verdicts; only
words with an incompatible pair are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lattiq.llm.common import check_columns, map_arrow, slices

#: Words in each of the two generations that a worker remembers, so memory is bounded.
CACHE_WORDS = 180_000
CACHE_PAIRS = 300_000
#: Longer words are not remembered.
CACHE_CHARS = 64

# \s of the split pattern: White_Space, which unlike Python's has no U+001C to U+001F.
_S = r"\p{White_Space}"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|{_S}+(?![^{_S}])|{_S}+"


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_chars()
        as_bytes = lambda s: bytes(back[c] for c in s)
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ids = vocab
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.merge = {}
        for rank, (a, b) in enumerate(merges):
            a, b = as_bytes(a), as_bytes(b)
            self.merge[(vocab[a], vocab[b])] = (rank, vocab[a + b])
        # Pair of ids to rank and merged id, each packed into one number.
        self.step = {a << 20 | b: rank << 20 | to for (a, b), (rank, to) in self.merge.items()}
        self.none = len(merges) << 20
        self.longest = max(map(len, vocab))
        self.pattern = regex.compile(SPLIT)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pair_ok: dict[int, bool] = {}
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        # Only tokens that encode to themselves may be proposed.
        self.proposed = {b: i for b, i in vocab.items() if len(b) == 1 or self._merged(b) == [i]}
        # Every beginning of a proposed token; -1 where it is none itself.
        self.begins = {b[:k]: -1 for b in self.proposed for k in range(1, len(b))} | self.proposed
        self.exact = 0  # words merged step by step so far

    def _merged(self, word: bytes) -> list[int]:
        """The ids after merging pair by pair, lowest rank first, leftmost first."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(ids) > 48:
            return self._merged_long(ids)
        get, none = self.step.get, self.none
        steps = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while steps and (best := min(steps)) < none:
            i = steps.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del steps[i]
            if i:
                steps[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(steps):
                steps[i] = get(ids[i] << 20 | ids[i + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links: n log n for words of any length."""
        n, get = len(ids), self.merge.get
        after, before, live = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i] if live[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = to, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return [t for t, ok in zip(ids, live) if ok]

    def _propose(self, word: bytes) -> list[int]:
        """Greedy longest match: goes on while some token begins so."""
        out, i, n, get = [], 0, len(word), self.begins.get
        while i < n:
            j = i + 1
            while j <= n and (t := get(word[i:j])) is not None:
                if t >= 0:
                    last, end = t, j
                j += 1
            out.append(last)
            i = end
        return out

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        codes, where = np.unique(pairs, return_inverse=True)
        if len(self.pair_ok) > CACHE_PAIRS:
            self.pair_ok.clear()
        verdicts = np.empty(len(codes), bool)
        for k, code in enumerate(codes.tolist()):
            ok = self.pair_ok.get(code)
            if ok is None:
                a, b = code >> 32, code & 0xFFFFFFFF
                ok = self.pair_ok[code] = self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            verdicts[k] = ok
        return verdicts[where]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        cut = [self._propose(b) for b in raw]
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter(chain.from_iterable(cut), np.int64, int(lengths.sum()))
        if len(flat) > 1:
            word = np.repeat(np.arange(len(cut)), lengths)
            inside = word[1:] == word[:-1]
            bad = ~self._compatible((flat[:-1][inside] << 32) | flat[1:][inside])
            for w in np.unique(word[1:][inside][bad]).tolist():
                cut[w] = self._merged(raw[w])
                self.exact += 1
        return cut

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.pattern.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def _entry(self, word: str, ids: list[int]) -> str | tuple[str, str]:
        """Decimal ids joined by commas; with the decoded text only where that is not the word itself."""
        ids = [self.added[word]] if word in self.added else ids
        joined, decoded = ",".join(map(str, ids)), self.decode(ids)
        return joined if decoded == word else (joined, decoded)

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its decimal ids joined by commas, and what they decode to.

        A piece's ids and their decoding are worked out once while a worker
        remembers the piece.  No piece cuts a character, so a text's decoding
        is that of its pieces in order.
        """
        cut = [self.pieces(t) for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        known, older, extra = self.words, self.older, {}
        fresh = []
        for w in set().union(*cut) - known.keys():
            if w in older:
                known[w] = older[w]
            else:
                fresh.append(w)
        for w, ids in zip(fresh, self.encode_words(fresh)):
            entry = self._entry(w, ids)
            if isinstance(entry, str) and len(w) <= CACHE_CHARS:
                known[w] = entry
            else:  # long pieces, and those that decode to something else
                extra[w] = entry
        if not extra:
            return [(",".join(map(known.__getitem__, ws)), "".join(ws)) for ws in cut]
        out = []
        for ws in cut:
            found = [known[w] if w in known else extra[w] for w in ws]
            out.append((",".join(e if isinstance(e, str) else e[0] for e in found), "".join(w if isinstance(e, str) else e[1] for w, e in zip(ws, found))))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.encode_batch([text])[0][0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_decode(docs: DataFrame, vocabulary: str, keep_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encodes each text and decodes the ids again.

    ``docs`` needs doc_id and text; a null text counts as empty, and empty
    texts have no ids.  Rows stay as they are dealt: no shuffle, repeated and
    null doc_ids included.  Returns doc_id, n_tokens, ids_sha256 (of decimal
    ids joined by commas), decoded_sha256, and with ``keep_ids`` also ids and
    decoded, then the columns named in ``carry`` as they are.  ``vocabulary``
    is a path that every executor can read.
    """
    docs = check_columns(docs, "doc_id", "text", *carry)
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    more = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches):
        bpe = load(vocabulary)
        for batch, texts in slices(batches, "text"):
            n, ids_sha, text_sha, ids_all, texts_all = [], [], [], [], []
            for ids, decoded in bpe.encode_batch(texts):
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    ids_all.append(list(map(int, ids.split(","))) if ids else [])
                    texts_all.append(decoded)
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if keep_ids:
                out |= {"ids": pa.array(ids_all, pa.list_(pa.int32())), "decoded": pa.array(texts_all, pa.string())}
            out |= {c: batch.column(batch.schema.get_field_index(c)) for c in carry}
            yield pa.RecordBatch.from_pydict(out)

    return map_arrow(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more + kept)
