"""Onset envelopes of long sampled signals, and offsets measured between them.

Samples (``clip``, ``pos`` from 0 without gaps, ``value``) are cut into blocks of
windows; each block also gets the samples that its first and last window reach
into the next blocks. A block is one batched FFT. What a whole signal decides, its
peak and the loudest band of any window, comes from aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import align
from .lookup import sent_if_small
from .ordering import block_window, cut, in_blocks, own_rows

#: Windows of one block.
WINDOWS = 2048
#: Least power of a band and the range in decibels that is kept below the loudest band (fixed values of the published envelope).
FLOOR, RANGE = 1e-10, 80.0


def mel_points(low: float, high: float, count: int) -> np.ndarray:
    """Frequencies evenly spread on the mel scale that is linear up to 1000 Hz and logarithmic beyond."""
    step, knee = 200.0 / 3, 1000.0
    ratio = np.log(6.4) / 27.0
    to_mel = lambda f: f / step if f < knee else knee / step + np.log(f / knee) / ratio
    mels = np.linspace(to_mel(low), to_mel(high), count)
    return np.where(mels < knee / step, mels * step, knee * np.exp(ratio * (mels - knee / step)))


def mel_weights(rate: float, size: int, bands: int) -> np.ndarray:
    """Triangular filters of equal area, one row for each band, over the bins of a real FFT of ``size`` samples."""
    bins = np.linspace(0.0, rate / 2.0, size // 2 + 1)
    edges = mel_points(0.0, rate / 2.0, bands + 2)
    rise = (bins[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - bins[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0.0, np.minimum(rise, fall)) * (2.0 / (edges[2:] - edges[:-2]))[:, None]


def band_powers(samples: np.ndarray, hop: int, size: int, weights: np.ndarray) -> np.ndarray:
    """Power in each band of all windows of ``size`` samples that start every ``hop`` samples."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    windows = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    spectrum = np.fft.rfft(windows * hann, axis=1)
    return (spectrum.real**2 + spectrum.imag**2) @ weights.T


def mono(samples: DataFrame, channels: list[str], name: str = "value") -> DataFrame:
    """Mean of the channels as one signal."""
    total = F.lit(0.0)
    for c in channels:
        total = total + F.col(c)
    return samples.withColumn(name, total / len(channels)).drop(*[c for c in channels if c != name])


def window_powers(samples: DataFrame, rate: float, hop: int, size: int, bands: int, windows: int = WINDOWS) -> DataFrame:
    """``clip``, ``window``, ``powers``: band powers of windows centred on every ``hop``-th sample.

    Samples are divided by the clip's peak, and count as 0 before the first and
    after the last; a clip of n samples has 1 + n // hop windows. Null samples
    count as 0.
    """
    whole = samples.groupBy("clip").agg(F.max(F.abs("value")).alias("_peak"), (F.max("pos") + 1).alias("_n"))
    scaled = F.when(F.col("_peak") > 0, F.col("value") / F.col("_peak")).otherwise(F.col("value"))
    # window t reads the samples from t * hop - size // 2 on: the first and the last block whose windows hold a sample
    first = F.greatest(F.lit(0), F.floor((F.ceil((F.col("pos") - size + size // 2 + 1) / hop)) / windows))
    last = F.floor(F.floor((F.col("pos") + size // 2) / hop) / windows)
    dealt = samples.join(sent_if_small(whole), "clip").select("clip", "pos", F.coalesce(scaled, F.lit(0.0)).alias("value"), "_n", F.explode(F.sequence(first, last)).alias("_b"))
    weights = mel_weights(rate, size, bands)

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(key[1]) * windows
        count = min(windows, 1 + int(pdf["_n"].iloc[0]) // hop - start)
        if count <= 0:
            return pd.DataFrame({"clip": pd.Series(dtype=object), "window": pd.Series(dtype="int64"), "powers": pd.Series(dtype=object)})
        line = np.zeros((count - 1) * hop + size)
        at = pdf["pos"].to_numpy() - (start * hop - size // 2)
        inside = (at >= 0) & (at < len(line))
        line[at[inside]] = pdf["value"].to_numpy()[inside]
        return pd.DataFrame({"clip": key[0], "window": np.arange(start, start + count), "powers": list(band_powers(line, hop, size, weights))})

    kind = samples.schema["clip"].dataType.simpleString()
    return dealt.groupBy("clip", "_b").applyInPandas(work, f"clip {kind}, window long, powers array<double>")


def onset_envelope(samples: DataFrame, rate: float = 16000.0, hop: int = 512, size: int = 2048, bands: int = 128, windows: int = WINDOWS) -> DataFrame:
    """``clip``, ``pos``, ``onset``: how much the bands' loudness rises, on average, from one window to the next.

    Loudness is in decibels, at most 80 below the clip's loudest band. The rise
    into window t stands ``size // (2 * hop)`` windows later, as the published
    envelope shifts it for centred windows; the first ones are 0. Clips without
    samples have no rows.
    """
    loud = lambda p: 10.0 * F.log10(F.greatest(p, F.lit(FLOOR)))
    powers = cut(window_powers(samples, rate, hop, size, bands, windows))
    top = powers.groupBy("clip").agg(loud(F.max(F.array_max("powers"))).alias("_top"), F.count("*").alias("_m"))
    levels = powers.join(sent_if_small(top), "clip")
    decibels = F.transform("powers", lambda p: F.greatest(loud(p), F.col("_top") - RANGE))
    rows = in_blocks(levels.select("clip", "window", "_m", decibels.alias("level")), "window", 1, windows)
    before = F.lag("level").over(block_window(["clip"], "window"))
    rise = F.aggregate(F.zip_with("level", before, lambda b, a: F.greatest(F.lit(0.0), b - a)), F.lit(0.0), lambda z, x: z + x) / bands
    raised = own_rows(rows.withColumn("rise", rise), "window", windows).where("rise is not null")
    shift = size // (2 * hop)
    moved = raised.select("clip", (F.col("window") + shift).alias("pos"), F.col("rise").alias("onset"), "_m").where(F.col("pos") < F.col("_m")).drop("_m")
    still = top.select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(shift).cast("long"), F.col("_m") - 1))).alias("pos"), F.lit(0.0).alias("onset"))
    return moved.unionByName(still)


def measure_offsets(envelopes: DataFrame, clips: DataFrame, reference: str | Column, hop: float, rate: float) -> DataFrame:
    """Offset of each clip's envelope against that of the reference.

    ``clips`` has ``clip`` and ``fps``, and names clips that may lack an envelope:
    these, like all clips if the reference has none, become rows with an error,
    an offset of 0 and no frames. Columns: ``clip``, ``offset_seconds``,
    ``frames`` (null without a frame rate), ``correlation``, ``error``. The
    correlation is that of standardised envelopes, the offset that of its first
    maximum over all lags.
    """
    is_reference = F.col("clip") == (reference if isinstance(reference, Column) else F.lit(reference))
    z = cut(align.zscore(envelopes, "clip", "onset").select("clip", "pos", "z"))
    found = align.block_correlation(z.where(is_reference).drop("clip"), z.where(~is_reference))
    best = align.best_lag(found.withColumn("corr_norm", F.lit(None).cast("double")), ["clip"])
    timed = clips.where(~is_reference).join(best.select("clip", "lag", "corr_raw"), "clip", "left")
    got = align.offsets_from_lags(timed, hop, rate)
    missing = F.col("lag").isNull()
    return got.select(
        "clip",
        F.when(missing, 0.0).otherwise(F.col("offset_seconds")).alias("offset_seconds"),
        "frames",
        F.when(missing, 0.0).otherwise(F.col("corr_raw")).alias("correlation"),
        F.when(missing, F.lit("no onset envelope")).alias("error"),
    )
