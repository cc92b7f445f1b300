"""Planes as arrays: differences, edges, and the job that turns planes into frame metrics.

A plane is an array of samples row by row, with a width. Pixel work runs on whole
Arrow batches of planes of one size; neighbours in time come from blocks with
halo rows, so that a clip may have any number of planes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import block_window, in_blocks, numbered, own_rows

#: Planes of one block.
BLOCK = 1024


def prewitt(planes: np.ndarray) -> np.ndarray:
    """Gradient of each plane (count, height, width) by the two 3 x 3 Prewitt kernels; beyond an edge the plane is mirrored."""
    pad = [(0, 0), *[(1, 1) if n > 1 else (0, 0) for n in planes.shape[1:]]]
    wide = np.pad(planes, pad, mode="reflect")
    wide = np.pad(wide, [(0, 0), *[(0, 0) if n > 1 else (1, 1) for n in planes.shape[1:]]], mode="edge")
    rows = wide[:, :-2] + wide[:, 1:-1] + wide[:, 2:]
    cols = wide[:, :, :-2] + wide[:, :, 1:-1] + wide[:, :, 2:]
    return np.hypot(rows[:, :, 2:] - rows[:, :, :-2], cols[:, 2:] - cols[:, :-2])


def difference_average(now: np.ndarray, before: np.ndarray, width: int, edges: bool, bits: int | None = None) -> np.ndarray:
    """Mean absolute difference of planes (count, samples), or mean gradient of their difference.

    With ``bits`` samples are codes of that depth: the difference is cut to the
    codes around the middle, the gradient to the largest code, and means are
    shares of the largest code.
    """
    diff, top = before - now, 1.0
    if bits:
        top, half = float((1 << bits) - 1), float(1 << (bits - 1))
        if edges:
            diff = np.clip(diff + half, 0.0, top)
    if edges:
        out = prewitt(diff.reshape(len(diff), -1, width)).reshape(len(diff), -1)
        out = np.minimum(out, top) if bits else out
    else:
        out = np.abs(diff)
    return out.mean(axis=1) / top


def _average_of(width: int, edges: bool, bits: int | None) -> object:
    @F.pandas_udf("double")
    def average(now: pd.Series, before: pd.Series) -> pd.Series:
        out = np.full(len(now), np.nan)
        sizes = np.array([len(a) if a is not None and b is not None and len(a) == len(b) and len(a) % width == 0 else 0 for a, b in zip(now, before)])
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            a, b = (np.stack(s.to_numpy()[at]).astype(np.float64) for s in (now, before))
            out[at] = difference_average(a, b, width, edges, bits)
        return pd.Series(out)

    return average


def difference(now: Column, before: Column, width: int, edges: bool, bits: int | None = None) -> Column:
    """``difference_average`` of two plane columns; null without both, or if their sizes do not fit."""
    got = _average_of(width, edges, bits)(now, before)
    return F.when(~F.isnan(got), got)


def collect_metrics(planes: DataFrame, plane: str, width: int, clip: str, order: str, step: int = 1, edges: bool = False, bits: int | None = None) -> DataFrame:
    """``clip``, ``frame``, ``brightness`` and ``motion`` of every ``step``-th plane of each clip.

    Brightness is the plane's mean, motion the difference to the plane sampled
    before, absolute or by edges, and 0 for the first. With ``bits`` both are
    shares of the largest code.
    """
    step = max(1, step)
    top = float((1 << bits) - 1) if bits else 1.0
    sampled = numbered(planes.select(F.col(clip).alias("clip"), F.col(order).alias("_o"), F.col(plane).alias("_p")), ["clip"], ["_o"]).where(F.col("frame") % step == 0)
    rows = in_blocks(sampled.withColumn("_at", F.floor(F.col("frame") / step)), "_at", 1, BLOCK)
    rows = own_rows(rows.withColumn("_before", F.lag("_p").over(block_window(["clip"], "_at"))), "_at", BLOCK)
    total = F.aggregate("_p", F.lit(0.0), lambda z, x: z + x.cast("double"))
    motion = F.coalesce(difference(F.col("_p"), F.col("_before"), width, edges, bits), F.lit(0.0))
    return rows.select("clip", "frame", (F.try_divide(total, F.size("_p")) / top).alias("brightness"), motion.alias("motion"))


def verification(now: Column, other: Column, bits: int | None = None) -> tuple[Column, Column]:
    """Mean and largest absolute difference of two planes; shares of the largest code with ``bits``."""
    top = float((1 << bits) - 1) if bits else 1.0
    diff = F.zip_with(now, other, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    total = F.aggregate(diff, F.lit(0.0), lambda z, x: z + x)
    return F.try_divide(total, F.size(diff)) / top, F.array_max(diff) / top
