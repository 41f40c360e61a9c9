"""Comparing layouts and images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lattiq.operators.similarity import assign_one_to_one, jaccard

#: Fixed weights of the parts of a visual's score.
PARTS = {"type": 0.30, "fields": 0.40, "roles": 0.20, "position": 0.10}
FULL_IOU, ZERO_IOU = 0.80, 0.20


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two rectangles (structs x, y, w, h); null without an area."""
    side = lambda p, n: F.greatest(F.lit(0.0), F.least(a[p] + a[n], b[p] + b[n]) - F.greatest(a[p], b[p]))
    inter = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union)


def position_score(overlap: Column) -> Column:
    """1 from FULL_IOU on, 0 up to ZERO_IOU, linear between."""
    return F.when(overlap.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (overlap - ZERO_IOU) / (FULL_IOU - ZERO_IOU))))


def fidelity(type_score: Column, fields_a: Column, fields_b: Column, roles: Column, position: Column) -> Column:
    """Weighted score of two visuals; a missing position gives its weight to the rest."""
    fields = jaccard(fields_a, fields_b, empty=1.0)
    base = PARTS["type"] * type_score + PARTS["fields"] * fields + PARTS["roles"] * roles
    rest = PARTS["type"] + PARTS["fields"] + PARTS["roles"]
    return F.round(F.when(position.isNull(), base / rest).otherwise((base + PARTS["position"] * position) / (rest + PARTS["position"])), 4)


def pair_visuals(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs visuals (id, fields, box) one to one, by 0.7 of the fields' and 0.3 of the position's likeness.

    All visuals of two reports are compared; a report has tens of them.
    """
    pairs = left.select(F.struct("id", "fields", "box").alias("a")).crossJoin(right.select(F.struct("id", "fields", "box").alias("b")))
    fields = jaccard(F.col("a.fields"), F.col("b.fields"), empty=1.0)
    place = position_score(iou(F.col("a.box"), F.col("b.box")))
    likeness = F.when(place.isNull(), fields).otherwise(0.7 * fields + 0.3 * place)
    return assign_one_to_one(pairs.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.round(likeness, 4).alias("score"))).drop("tier")


def _means(x: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, (k, k)).mean((2, 3))


def structural_similarity(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two grey images of one shape over square windows."""
    a, b = a.astype(float), b.astype(float)
    k = min(window, *a.shape)
    if k < 1:
        return 0.0
    mean_a, mean_b = _means(a, k), _means(b, k)
    cross, squares = mean_a * mean_b, mean_a**2 + mean_b**2
    light, contrast = (0.01 * 255) ** 2, (0.03 * 255) ** 2  # the measure's usual constants
    covariance = _means(a * b, k) - cross
    spread = _means(a * a + b * b, k) - squares
    return float(np.mean((2 * cross + light) / (squares + light) * (2 * covariance + contrast) / (spread + contrast)))


@F.pandas_udf(DoubleType())
def ssim(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.Series:
    """Structural similarity of grey images as bytes, row by row, of ``width`` columns; null where shapes differ."""

    def one(x, y, w):
        if x is None or y is None or len(x) != len(y) or not w or len(x) % int(w):
            return None
        shape = (-1, int(w))
        return structural_similarity(np.frombuffer(x, np.uint8).reshape(shape), np.frombuffer(y, np.uint8).reshape(shape))

    return pd.Series([one(*r) for r in zip(a, b, width)], dtype="float64")
