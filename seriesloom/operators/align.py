"""Alignment of series by cross-correlation, offset gates and baselines, stream choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import cut

#: Positions of a cell that is correlated by one FFT.
CELL = 4096


def zscore(series: DataFrame, key: str, value: str, name: str = "z") -> DataFrame:
    """Value less its key's mean over its population deviation plus 1e-8."""
    stats = series.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return series.join(stats, key).withColumn(name, (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-8)).drop("_m", "_s")


def _cells(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Series cut into cells of ``block`` positions: offsets in the cell and values as arrays."""
    at = F.floor(F.col("pos") / block)
    return rows.groupBy(*keys, at.alias("cell")).agg(F.collect_list(F.struct((F.col("pos") - at * block).cast("int").alias("at"), "z")).alias("zs"))


def block_correlation(a: DataFrame, b: DataFrame, block: int = CELL) -> DataFrame:
    """``clip``, ``lag``, ``corr_raw``, ``pairs``: sums of products of ``a`` (``pos``, ``z``) and each clip of ``b`` (``clip``, ``pos``, ``z``) over all lags.

    Both sides are cut into cells of ``block`` positions. Two cells are correlated
    by FFT, and what each distance of cells adds to a lag is summed by lag, so
    the rows grow with cells times cells and not with positions times positions.
    A lag has a row if any two positions are that far apart; positions may have
    gaps, one position has one value.
    """
    left, right = _cells(a, [], block), cut(_cells(b, ["clip"], block))
    # each cell of a goes to the distances at which any clip has a cell: an equality join on cells
    reach = right.agg(F.min("cell").alias("_from"), F.max("cell").alias("_to"))
    fanned = left.crossJoin(F.broadcast(reach)).where("_from is not null")  # one row
    fanned = fanned.select(F.col("cell").alias("_cell"), F.col("zs").alias("za"), F.explode(F.sequence("_from", "_to")).alias("cell"))
    pairs = right.join(fanned, "cell").select("clip", (F.col("cell") - F.col("_cell")).alias("apart"), "za", F.col("zs").alias("zb"))
    kind = b.schema["clip"].dataType.simpleString()
    sums = pairs.mapInPandas(_correlated(block), f"clip {kind}, lag long, corr_raw double, pairs double")
    whole = sums.groupBy("clip", "lag").agg(F.sum("corr_raw").alias("corr_raw"), F.rint(F.sum("pairs")).cast("long").alias("pairs"))
    return whole.where("pairs > 0")


def _correlated(block: int):
    def line(cells: list, weights: bool) -> np.ndarray:
        out = np.zeros((len(cells), 2 * block))
        for row, cell in enumerate(cells):
            for x in cell:
                out[row, x["at"]] = 1.0 if weights else x["z"]
        return np.fft.rfft(out, axis=1)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in frames:
            for start in range(0, len(pdf), 64):
                part = pdf.iloc[start : start + 64]
                both = np.stack([np.conj(line(part["za"], w)) * line(part["zb"], w) for w in (False, True)], 1)
                for key, got in zip(zip(part["clip"], part["apart"]), both):
                    sums[key] = sums[key] + got if key in sums else got
        shift = np.concatenate([np.arange(block), np.arange(-block, 0)])
        for (clip, apart), spectra in sums.items():
            corr, pairs = np.fft.irfft(spectra, 2 * block, axis=1)
            some = np.rint(pairs) > 0
            yield pd.DataFrame({"clip": clip, "lag": apart * block + shift[some], "corr_raw": corr[some], "pairs": np.rint(pairs[some])})

    return work


def best_lag(correlations: DataFrame, by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """First lag with the highest correlation; values equal to ``digits`` digits tie."""
    rank = F.struct(F.round("corr_raw", digits).alias("c"), (-F.col("lag")).alias("l"))
    return correlations.groupBy(*(by or [])).agg(F.max_by("lag", rank).alias("lag"), F.max_by("corr_raw", rank).alias("corr_raw"), F.max_by("corr_norm", rank).alias("corr_norm"))


def offsets_from_lags(lags: DataFrame, hop: float, rate: float, fps: str = "fps") -> DataFrame:
    """Seconds and frames, rounded half to even, of each lag."""
    seconds = F.col("lag") * float(hop) / float(rate)
    return lags.withColumn("offset_seconds", seconds).withColumn("frames", F.when(F.col(fps) > 0, F.rint(seconds * F.col(fps))).cast("long"))


def gate_offsets(offsets: DataFrame, most_seconds: float, least_corr: float) -> DataFrame:
    """Nulls ``frames`` of measurements with a fault and names all faults in ``error``; ``suggested`` keeps them."""
    faults = F.filter(
        F.array(
            F.nullif(F.col("error"), F.lit("")),
            F.when(F.abs("offset_seconds") > most_seconds, F.lit("offset too large")),
            F.when(F.col("correlation") < least_corr, F.lit("correlation too low")),
            F.when(F.col("frames").isNull(), F.lit("no frame rate")),
        ),
        lambda x: x.isNotNull(),
    )
    out = offsets.withColumn("suggested", F.col("frames")).withColumn("_f", faults)
    return out.withColumn("frames", F.when(F.size("_f") == 0, F.col("frames"))).withColumn("error", F.nullif(F.array_join("_f", "; "), F.lit(""))).drop("_f")


def shift_to_zero(offsets: DataFrame, by: str, frames: str = "frames") -> DataFrame:
    """``trim``: frames less the least of the group, to which the reference adds a 0."""
    low = offsets.groupBy(by).agg(F.least(F.lit(0), F.min(frames)).alias("_l"))
    return offsets.join(low, by).withColumn("trim", F.col(frames) - F.col("_l")).drop("_l")


def apply_deltas(plans: DataFrame, by: str, baseline: str = "baseline", delta: str = "delta") -> DataFrame:
    """``trim``: baseline plus delta, raised by what the group's least lies below zero."""
    sums = plans.withColumn("_t", F.col(baseline) + F.coalesce(delta, F.lit(0)))
    low = sums.groupBy(by).agg(F.greatest(F.lit(0), -F.min("_t")).alias("_up"))
    return sums.join(low, by).withColumn("trim", F.col("_t") + F.col("_up")).drop("_t", "_up")


def estimate_frames(offsets: DataFrame, fps: str = "fps") -> DataFrame:
    """``frames`` where given, 0 for no offset in seconds, else seconds times rate."""
    guess = F.when(F.abs("offset_seconds") < 1e-9, F.lit(0.0)).when(F.col(fps) > 0, F.rint(F.col("offset_seconds") * F.col(fps)))
    return offsets.withColumn("frames", F.coalesce("frames", guess.cast("long")))


def score_streams(candidates: DataFrame) -> DataFrame:
    """``score`` of audio streams against their clip's reference stream (columns ``ref_*``).

    The weights are fixed values.
    """
    same = lambda c: F.coalesce(F.col(c) == F.col(f"ref_{c}"), F.lit(False))
    known = lambda c: F.coalesce(F.col(f"ref_{c}").cast("string"), F.lit("")).isin("", "0") == F.lit(False)
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0") == F.lit(False)
    family = lambda c: F.substring_index(F.col(c), ".", 1)
    score = (
        F.when(known("language") & same("language"), 100.0).when(known("language") & ~has("language"), 10.0).otherwise(0.0)
        + F.when(same("codec_name"), 30.0).when(family("codec_name") == family("ref_codec_name"), 20.0).otherwise(0.0)
        + F.when(same("channels"), 10.0).otherwise(0.0)
        + F.when(known("channel_layout") & same("channel_layout"), 5.0).otherwise(0.0)
        + F.when(known("sample_rate") & same("sample_rate"), 10.0)
        .when(known("sample_rate") & has("sample_rate"), -F.abs(F.col("sample_rate") - F.col("ref_sample_rate")) / 1000.0)
        .otherwise(0.0)
        + F.when(known("bitrate") & has("bitrate"), -F.abs(F.col("bitrate") - F.col("ref_bitrate")) / 10000.0).otherwise(0.0)
        + F.when(F.col("is_default"), 3.0).otherwise(0.0)
        + F.when(F.col("is_forced"), 1.0).otherwise(0.0)
        + F.coalesce(F.col("bitrate") / 1e5, F.lit(0.0))
    )
    return candidates.withColumn("score", score)


def choose_stream(scored: DataFrame, clip: str = "clip") -> DataFrame:
    """Stream with the highest score of each clip; the lowest index of equals."""
    order = Window.partitionBy(clip).orderBy(F.col("score").desc(), "index")
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def chosen_streams(clips: DataFrame, scored: DataFrame, overrides: DataFrame, clip: str = "clip") -> DataFrame:
    """``stream`` and ``forced`` of every clip: the override, else the stream with the highest score, else 0.

    ``overrides`` has the clip and ``override``; of equal scores the lowest index counts.
    """
    best = scored.groupBy(clip).agg(F.max_by("index", F.struct(F.col("score"), -F.col("index"))).alias("_b"))
    both = clips.select(clip).join(overrides.select(clip, "override"), clip, "left").join(best, clip, "left")
    return both.select(clip, F.coalesce("override", "_b", F.lit(0)).cast("long").alias("stream"), F.col("override").isNotNull().alias("forced"))


def default_stream(streams: DataFrame, group: str) -> DataFrame:
    """Index of each group's first default stream, else of its first one, else 0, as ``stream``."""
    first = F.min(F.when(F.col("is_default"), F.col("idx")))
    return streams.groupBy(group).agg(F.coalesce(first, F.min("idx"), F.lit(0)).alias("stream"))
