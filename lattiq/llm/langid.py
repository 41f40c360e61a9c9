"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a hash of the letter.
A trigram's vector binds its letters' vectors, each permuted (rotated) by its
place; a document's vector bundles (adds) its trigrams'; a language's prototype
bundles its documents'.  Documents are compared with the prototypes, from
which their common part is taken, by cosine.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import check_columns, held_out, map_arrow, slices

DIM = 1024
#: Trigrams' vectors that a worker remembers (4 kB each); it then forgets them all.
CACHE_GRAMS = 12_000
#: How far apart cosines set scores: a score is the softmax of SHARPNESS times the cosines, so 0.1 between two of them is 0.69 to 0.31.
SHARPNESS = 8
# Words are letters with the marks on them; a mark without a letter before it is none.
_NOT_WORD = regex.compile(r"[^\p{L}\p{M}]+|(?<![\p{L}\p{M}])\p{M}+")
_NOT_ASCII_WORD = re.compile(r"[^a-z]+")


class Space:
    """The vectors of letters and trigrams."""

    def __init__(self):
        self.letters: dict[str, np.ndarray] = {}
        self.at: dict[str, int] = {}
        self.table = np.empty((1024, DIM), np.float32)

    def letter(self, c: str) -> np.ndarray:
        v = self.letters.get(c)
        if v is None:
            if len(self.letters) > 20_000:
                self.letters.clear()
            seed = int.from_bytes(hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest()[:8], "little")
            v = self.letters[c] = np.random.default_rng(seed).integers(0, 2, DIM).astype(np.float32) * 2 - 1
        return v

    def gram(self, g: int) -> np.ndarray:
        a, b, c = chr(g >> 42), chr(g >> 21 & 0x1FFFFF), chr(g & 0x1FFFFF)
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, each weighted by the root of its count."""
        if len(self.at) > CACHE_GRAMS:
            self.at.clear()
            self.table = np.empty((1024, DIM), np.float32)
        out, weights = np.zeros(DIM, np.float32), np.sqrt(counts.astype(np.float32))
        grams, at = grams.tolist(), self.at
        for start in range(0, len(grams), 4096):
            rows = []
            for g in grams[start : start + 4096]:
                i = at.get(g)
                if i is None:
                    i = at[g] = len(at)
                    if i >= len(self.table):
                        self.table = np.concatenate([self.table, np.empty_like(self.table)])
                    self.table[i] = self.gram(g)
                rows.append(i)
            out += weights[start : start + 4096] @ self.table[rows]
        return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams, 21 bits a letter, and their counts.

    Words are letters (``\\p{L}``) and the marks on them (``\\p{M}``), lower-cased
    and set apart by one blank.
    """
    low = text.lower()
    t = (_NOT_ASCII_WORD if low.isascii() else _NOT_WORD).sub(" ", low).strip()
    if not t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)


_SPACE: list[Space] = []


def _space() -> Space:
    if not _SPACE:
        _SPACE.append(Space())
    return _SPACE[0]


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.sqrt((v * v).sum()))
    return v / n if n else v


class Profiles:
    def __init__(self, langs: list[str], vectors: np.ndarray):
        self.langs, self.vectors = langs, vectors
        # What all languages share tells nothing apart.
        self.common = vectors.mean(0) if len(langs) > 1 else np.zeros(DIM)
        self.own = np.stack([unit(v - self.common) for v in vectors]).astype(np.float32) if langs else np.zeros((0, DIM), np.float32)

    def predict(self, text: str) -> tuple[str, float]:
        grams, counts = trigrams(text)
        if not len(grams) or not self.langs:
            return "und", 0.0
        doc = unit(_space().bundle(grams, counts))
        cosines = self.own @ unit(doc - self.common.astype(np.float32))
        e = np.exp(SHARPNESS * (cosines - cosines.max()))
        best = int(np.argmax(cosines))
        return self.langs[best], float(e[best] / e.sum())


def learn_profiles(docs: DataFrame, learn: Column | None = None) -> Profiles:
    """Bundles the vectors of all documents with a lang for which ``learn`` holds.

    By default those that are not held out.  Each task adds up its documents
    and gives one vector for each lang, so what the driver gets is DIM numbers
    for each lang.  Null or letterless texts add nothing.
    """
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    rows = check_columns(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & learn).select("lang", "text")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch, texts in slices(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                grams, counts = trigrams(text)
                if len(grams):
                    sums.setdefault(lang, np.zeros(DIM))
                    sums[lang] += unit(_space().bundle(grams, counts))
        for lang, v in sums.items():
            # Whole millionths: sums of them don't depend on the order of tasks.
            yield pa.RecordBatch.from_pydict({"lang": [lang], "v": pa.array([np.rint(v * 1e6).astype(np.int64)], pa.list_(pa.int64()))})

    parts = map_arrow(rows, run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    return Profiles([r["lang"] for r in found], np.array([unit(np.array([p["x"] for p in r["v"]], np.float64)) for r in found]).reshape(-1, DIM))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of each row; ``und`` and 0 where a text is null or has no letter.

    Ties go to the first lang in alphabetical order.  With no profile (no row
    to learn from) every row is ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast((profiles.langs, profiles.vectors))

    def run(batches):
        known = Profiles(*sent.value)
        for batch, texts in slices(batches, "text"):
            got = [known.predict(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())})

    return map_arrow(check_columns(docs, "doc_id", "text"), run, "doc_id long, lang_pred string, score double")
