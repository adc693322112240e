"""Pixel arithmetic on gray pages held as arrays (page_id, w, h, px row-major), and decisions on crops and scans.

A page's pixels stay in its row: they are read as a matrix from the Arrow batch, so nothing is exploded
or shuffled.  Pages without pixels, or with another number than w times h, give no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TUNING, Tuning

#: Side of the picture in which edges are looked for, and the largest width in which a gutter is.
CROP_GRID, GUTTER_WIDTH = 200, 600


def _pages(pages: DataFrame, find: Callable[[np.ndarray], tuple | None], schema: str) -> DataFrame:
    """(page_id, found values) of the pages for which find(pixels as rows) gives some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            ids, wide, high, px = batch.columns
            starts, values = px.offsets.to_numpy(), px.values.to_numpy(zero_copy_only=False)
            rows = []
            for i, (w, h) in enumerate(zip(wide.to_pylist(), high.to_pylist())):
                a = values[starts[i] : starts[i + 1]]
                if w and h and len(a) == w * h and (found := find(a.reshape(h, w))) is not None:
                    rows.append((ids[i].as_py(), *found))
            kinds = kinds or [ids.type, *(pa.float64() if "double" in x else pa.int64() for x in schema.split(", "))]
            names = ["page_id", *(x.split()[0] for x in schema.split(", "))]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names)

    source = pages.select("page_id", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.col("px").cast("array<smallint>").alias("px"))
    return source.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, {schema}")


def _resampled(a: np.ndarray, size: int) -> np.ndarray:
    """Rows brought to a number: whole-numbered means of stretches of rows, or rows repeated."""
    n = len(a)
    if size > n:
        return a[np.arange(size) * n // size]
    edges = np.arange(size) * n // size
    sums = np.add.reduceat(a.astype(np.int64), edges, axis=0)
    return sums // np.diff(np.concatenate((edges, [n]))).reshape(-1, *[1] * (a.ndim - 1))


def gutter_of(a: np.ndarray, vertical: bool = True) -> int:
    """The place of the least smoothed ink between 45 and 55 percent of the width (or height)."""
    a = a if vertical else a.T
    high, wide = a.shape
    scale = min(1.0, GUTTER_WIDTH / wide)
    a = _resampled(_resampled(a, max(1, int(high * scale))).T, max(1, int(wide * scale)))
    n = len(a)
    ink = np.concatenate(([0], np.cumsum((255 - a.astype(np.int64)).sum(axis=1))))
    around = max(2, n // 80)
    at = np.arange(n)
    low, high = np.maximum(at - around, 0), np.minimum(at + around + 1, n)
    smooth = (ink[high] - ink[low]) // (high - low)
    low, high = int(n * 0.45), min(int(n * 0.55), n - 1)
    return math.floor((low + int(smooth[low : high + 1].argmin())) / scale + 0.5)


def ink_gutter(pages: DataFrame, vertical: bool = True) -> DataFrame:
    """(page_id, gutter): the column (or row) with the least smoothed ink near the middle.

    Pages wider than 600 are scaled down.  Ink is the sum of 255 - v; the moving average spans
    max(2, n / 80) places either side, cut at the edges, in whole numbers; the first least place wins.
    """
    return _pages(pages, lambda a: (gutter_of(a, vertical),), "gutter bigint")


def box_of(a: np.ndarray, tuning: Tuning = TUNING) -> tuple[float, float, float, float] | None:
    """left, right, top and bottom of the bright sheet."""
    n, out = CROP_GRID, []
    bright = _resampled(_resampled(a, n).T, n) > int(tuning.crop_brightness * 255)
    for size, lines in ((a.shape[1], bright), (a.shape[0], bright.T)):
        white = lines.sum(axis=1) > int(n * 0.75)
        three = np.flatnonzero(white[:-2] & white[1:-1] & white[2:])
        first = int(three[0]) if len(three) and three[0] < n - 3 else 0
        last = int(three[-1]) + 2 if len(three) else n - 1
        if last - first <= n // 5:
            return None
        pad = size * tuning.crop_padding
        out += [max(first / n * size - pad, 0.0), min(last / n * size + pad, float(size))]
    return tuple(out)


def crop_box(pages: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """(page_id, left, right, top, bottom) of the bright sheet; no row if it is too small.

    Pages are brought to 200 by 200.  A pixel is bright above brightness of 255; a row or column is white
    if over three quarters of it is bright; the box goes from the first of three white lines in a row to
    the last of three, or from the page's edge without such lines, must be over a fifth of the page
    either way, and is padded and clamped.
    """
    return _pages(pages, lambda a: box_of(a, tuning), "left double, right double, top double, bottom double")


def crop_decision(width: Column, height: Column, crop_width: Column, crop_height: Column, tuning: Tuning = TUNING) -> Column:
    """Why a crop is rejected, or `accepted`."""
    cut_w, cut_h = 1 - crop_width / width, 1 - crop_height / height
    aspect = F.abs((crop_width / crop_height) / (width / height) - 1)
    return (
        F.when((cut_w < tuning.crop_min_reduction) & (cut_h < tuning.crop_min_reduction), "too little")
        .when((cut_w > tuning.crop_max_width_cut) | (cut_h > tuning.crop_max_height_cut), "too much")
        .when(aspect > tuning.crop_max_aspect_change, "aspect")
        .otherwise("accepted")
    )


def upscale_factor(base: Column, score: Column, tuning: Tuning = TUNING) -> Column:
    """At least the weak-scan factor for scores below the limit; a missing score leaves the base."""
    return F.when(score < tuning.weak_scan, F.greatest(base, F.lit(tuning.weak_scan_upscale))).otherwise(base)


def top_labels(labels: DataFrame, k: int = 10) -> DataFrame:
    """The k most confident (label, confidence) of each page, with their rank from 1."""
    w = Window.partitionBy("page_id").orderBy(F.desc("confidence"), "label")
    return labels.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: What the labels of pictures contain.
PHOTO_WORDS = ("photo", "illustration", "drawing", "painting", "portrait", "art", "poster")


def is_photographic(label: Column, confidence: Column, words=PHOTO_WORDS, least: float = 0.35) -> Column:
    """Whether the top label is confident enough and holds one of the words."""
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(label), w))
    return (confidence >= F.lit(least).cast("float")) & hit
