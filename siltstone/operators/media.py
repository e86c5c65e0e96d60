"""Measures of sound and images. Pixels and samples are arrays, so they stay expressions where they can."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def speech_ratio(samples: Column, threshold: float) -> Column:
    return F.size(F.filter(samples, lambda x: F.abs(x) > threshold)) / F.greatest(F.size(samples), F.lit(1))


def loudness(samples: Column) -> Column:
    """Root of the mean square."""
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.greatest(F.size(samples), F.lit(1)))


def average_hash(pixels: Column) -> Column:
    """64 bits of an 8 x 8 picture, row by row: whether a pixel is beyond the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(pixels)
    return F.array_join(F.transform(pixels, lambda x: F.when(x.cast("double") > mean, "1").otherwise("0")), "")


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


_FEATURES = StructType([StructField(n, DoubleType()) for n in ("edge_density", "variance", "uniformity", "text_density", "chrome")])


@F.pandas_udf(_FEATURES)
def image_features(pixels: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Of grey pixels in 0..1: share of strong gradients, variance, share near the mean, text density and borders."""
    out = []
    for p, w in zip(pixels, width, strict=True):
        x = np.asarray(p, float).reshape(-1, int(w))
        gx, gy = np.abs(np.diff(x, axis=1)), np.abs(np.diff(x, axis=0))
        edge = float(((gx[: len(gy), :] > 0.1) | (gy[:, : gx.shape[1]] > 0.1)).mean()) if min(x.shape) > 1 else 0.0
        sides = sum(float(s.std()) < 0.02 for s in (x[0], x[-1], x[:, 0], x[:, -1]))
        out.append((edge, float(x.var()), float((np.abs(x - x.mean()) < 0.1).mean()), min(5 * edge, 1.0), float(sides >= 2)))
    return pd.DataFrame(out, columns=[f.name for f in _FEATURES])


def screenshot_class(f: Column) -> Column:
    return F.when(f["chrome"] > 0, "application").when(f["text_density"] > 0.5, "document").when(f["uniformity"] > 0.8, "dialog").otherwise("photo")


def ocr_gate(f: Column) -> Column:
    """Whether a second pass pays: rate = 2 * edge density up to 1, not below 0.05."""
    rate = F.when(f["edge_density"] > 0.1, F.least(2 * f["edge_density"], F.lit(1.0))).otherwise(f["edge_density"])
    return rate >= 0.05
