"""Quality classifier: a factorisation machine over hashed words and structure.

A document becomes a sparse vector x: hashed words weighted by the logarithm
of their counts and scaled to length one, structure statistics, and one
indicator for the bin of each statistic and of each column of metadata (one
more for a null).  The machine scores

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

whose pair term is half of sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], so
a score takes time linear in the non-zeros.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import check_columns, held_out, map_arrow, slices

WORD_BITS = 15
BINS = 16
STATS = ("log_words", "mean_word", "upper", "letters", "digits", "blanks", "symbols", "bangs", "distinct", "top_word", "line_words", "repeated_lines", "odd_ends", "lone_symbols", "repeated_pairs", "stop_share")
#: Upper ends of the statistics' ranges, for bins and scale.
RANGES = np.array([10.0, 12, 1, 1, 0.3, 0.4, 0.4, 0.3, 1, 0.5, 60, 1, 1, 0.5, 1, 1])
#: Columns of metadata that a model can take, and the bins of each: its value's power of two, 0 for none, the last for a null.
MAX_META, META_BINS = 4, 34
META = (1 << WORD_BITS) + len(STATS) * (BINS + 1)
SIZE = META + MAX_META * META_BINS
RANK = 8
#: Labelled rows, chosen by a hash of doc_id, that a model is fitted on at most.
TRAIN_ROWS = 6000
_BUCKETS: dict[str, int] = {}


def _bucket(word: str) -> int:
    if len(_BUCKETS) > 200_000:
        _BUCKETS.clear()
    b = _BUCKETS.get(word)
    if b is None:
        b = _BUCKETS[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
    return b


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    n, m = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    upper = sum(map(str.isupper, words)) / m
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    letters = int(hist[65:91].sum() + hist[97:123].sum() + hist[192:].sum())
    digits, blanks = int(hist[48:58].sum()), int(hist[32] + hist[9:14].sum())
    points = int(hist[44] + hist[46])
    symbols = int(hist[33:127].sum()) - int(hist[65:91].sum() + hist[97:123].sum()) - digits - points
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(words)),
        len(text) / m,
        upper,
        letters / n,
        digits / n,
        blanks / n,
        symbols / n,
        int(hist[33]) / n,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        m / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(not w[-1].isalpha() for w in words) / m,
        sum(len(w) == 1 and not w.isalnum() for w in words) / m,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        sum(c for _, c in counts.most_common(10)) / m,
    ]


def features(text: str, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's vector; never empty, also for an empty text.

    ``metadata`` are numbers (negative ones count as 0) or None.
    """
    words = text.split()
    counts = Counter(words)
    idx = np.fromiter(map(_bucket, counts), np.int64, len(counts))
    val = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(val):
        val /= np.sqrt(val @ val)
    scaled = np.clip(np.array(statistics(text, words, counts)) / RANGES, 0, 1)
    base = (1 << WORD_BITS) + np.arange(len(STATS)) * (BINS + 1)
    bins = np.minimum((scaled * BINS).astype(np.int64), BINS - 1)
    meta = np.array([META + i * META_BINS + (META_BINS - 1 if x is None or x != x else int(max(0, min(x, 2.0**32 - 1))).bit_length()) for i, x in enumerate(metadata)], np.int64)
    return np.concatenate([idx, base, base + 1 + bins, meta]), np.concatenate([val, scaled, np.full(len(STATS) + len(meta), 0.5)])


def _vectors(batch: pa.RecordBatch, texts: list[str], metadata: tuple[str, ...]):
    columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in metadata]
    return (features(t, m) for t, *m in zip(texts, *columns))


class FactorisationMachine:
    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray, metadata: tuple[str, ...] = ()):
        self.bias, self.weights, self.factors, self.metadata = bias, weights, factors, metadata

    @classmethod
    def constant(cls, share: float) -> FactorisationMachine:
        return cls(float(np.log(share / (1 - share))), np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32))

    def margin(self, idx: np.ndarray, val: np.ndarray) -> float:
        v = self.factors[idx]
        sums = val @ v
        return float(self.bias + self.weights[idx] @ val + 0.5 * (sums @ sums - (val * val) @ (v * v).sum(1)))

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(idx, val), -30, 30))))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.08, seed: int = 7) -> FactorisationMachine:
        """Adagrad over shuffled rows, both labels weighing alike."""
        y = np.asarray(labels, np.float64)
        if not len(y) or y.min() == y.max():
            return cls.constant((y.sum() + 1) / (len(y) + 2))
        rng = np.random.default_rng(seed)
        w, v = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK))
        gw, gv, b, gb = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3), 0.0, 1e-3
        # Between the classes' shares and equal shares: rare labels count without moving the 0.5 mark far.
        weight = np.where(y == 1, np.sqrt(0.5 / y.mean()), np.sqrt(0.5 / (1 - y.mean())))
        for _ in range(epochs):
            for r in rng.permutation(len(y)).tolist():
                idx, val = rows[r]
                vi = v[idx]
                sums = val @ vi
                z = b + w[idx] @ val + 0.5 * (sums @ sums - (val * val) @ (vi * vi).sum(1))
                g = weight[r] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[r])
                dw, dv = g * val + 1e-6 * w[idx], g * (val[:, None] * sums - (val * val)[:, None] * vi) + 1e-5 * vi
                gb += g * g
                gw[idx] += dw * dw
                gv[idx] += dv * dv
                b -= rate * g / np.sqrt(gb)
                w[idx] -= rate * dw / np.sqrt(gw[idx])
                v[idx] -= rate * dv / np.sqrt(gv[idx])
        return cls(float(b), w.astype(np.float32), v.astype(np.float32))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS, learn: Column | None = None, metadata: tuple[str, ...] = ("n_chars",)) -> FactorisationMachine:
    """Fits on up to ``max_rows`` labelled documents (bounded and documented), whole texts each.

    The documents are those whose doc_id has the smallest crc32, so the choice
    does not depend on the order of the table.  Only rows where ``learn``
    holds are taken; by default those that are not held out.  Null labels and
    labels without a document are passed over; of rows that share a doc_id the
    least counts.  With no row, or one label alone, the model is that label's
    smoothed share.  ``metadata`` are columns of numbers, at most MAX_META.
    """
    if len(metadata) > MAX_META:
        raise ValueError(f"more than {MAX_META} columns of metadata")
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    labelled = check_columns(labels, "doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    labelled = labelled.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    chosen = labelled.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_rows)
    # At most max_rows ids: of a proven size, so they may be sent to every task.
    rows = check_columns(docs, "doc_id", "text", *metadata).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", "text", *metadata)).alias("row")).select("doc_id", "row.*")

    def run(batches):
        for batch, texts in slices(batches, "text"):
            got = list(_vectors(batch, texts, metadata))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(1), "idx": pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())), "val": pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))})

    found = map_arrow(rows, run, "doc_id long, y int, idx array<int>, val array<float>").toArrow()
    order = np.argsort(found["doc_id"].to_numpy()) if found.num_rows else []
    idx, val, y = found["idx"].combine_chunks(), found["val"].combine_chunks(), found["y"].to_numpy()
    model = FactorisationMachine.fit([(np.asarray(idx[int(i)].values, np.int64), np.asarray(val[int(i)].values, np.float64)) for i in order], np.array([y[i] for i in order]))
    model.metadata = tuple(metadata)
    return model


def score_quality(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, score of each row; null and empty texts are scored by their statistics and metadata.

    The model is of fixed size (SIZE times RANK + 1 floats) and sent to the
    tasks once each.  An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors, model.metadata))

    def run(batches):
        fm = FactorisationMachine(*sent.value)
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array([fm.score(*x) for x in _vectors(batch, texts, fm.metadata)], pa.float64())})

    return map_arrow(check_columns(docs, "doc_id", "text", *model.metadata), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: FactorisationMachine, at_least: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rows that score below ``at_least``.

    Each row is scored by itself: null and empty texts by their statistics and
    metadata, repeated rows alike, rows without doc_id like others.  Columns
    of any name are left alone, and an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors, model.metadata))
    check_columns(docs, "text", *model.metadata)

    def run(batches):
        fm = FactorisationMachine(*sent.value)
        for batch, texts in slices(batches, "text"):
            yield batch.filter(pa.array([fm.score(*x) >= at_least for x in _vectors(batch, texts, fm.metadata)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
