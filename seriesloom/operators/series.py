"""Frame series: metrics, thresholds, smoothing, planes.

A series has the columns ``clip``, ``frame`` and one double for each metric. No
clip has to fit into a task: numbers come from a range partitioning, neighbours
from blocks with halo rows, quantiles from histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.display import blank_props

from .ordering import block_window, in_blocks, numbered, own_rows
from .quantiles import exact_quantiles

#: Planes of one block.
PLANES = 1024


def clips_from_events(events: DataFrame) -> DataFrame:
    """``clip``, ``frame``, ``event_id``, ``luma``: event types as clips, in order of time, values scaled by the largest."""
    most = events.agg(F.max("value").alias("_most"))  # one row
    placed = numbered(events.select("event_type", "ts", "event_id", "user_id", "value"), ["event_type"], ["ts", "event_id"])
    return placed.crossJoin(F.broadcast(most)).select(
        F.col("event_type").alias("clip"), "frame", "event_id", "user_id", "value", F.try_divide("value", "_most").alias("luma")
    )


def _lagged(value: str) -> Column:
    return F.coalesce(F.abs(F.col(value) - F.lag(value).over(block_window(["clip"], "frame"))), F.lit(0.0))


def _smoothed(value: str, radius: int) -> Column:
    return F.avg(value).over(block_window(["clip"], "frame").rowsBetween(-radius, radius))


def lag_motion(series: DataFrame, value: str = "luma", name: str = "motion") -> DataFrame:
    """Absolute difference to the frame before; 0 for the first. Frames are numbered without gaps."""
    return own_rows(in_blocks(series, "frame", 1).withColumn(name, _lagged(value)), "frame")


def smooth(series: DataFrame, value: str, radius: int, name: str) -> DataFrame:
    """Centred mean over positions, cut off at the ends; the value itself for a radius of 0. Frames are numbered without gaps."""
    if radius <= 0:
        return series.withColumn(name, F.col(value))
    return own_rows(in_blocks(series, "frame", radius).withColumn(name, _smoothed(value, radius)), "frame")


def smooth_motion(series: DataFrame, value: str, radius: int) -> DataFrame:
    """``motion`` and its centred mean ``smooth``, both over the same blocks."""
    rows = in_blocks(series, "frame", radius + 1).withColumn("motion", _lagged(value))
    return own_rows(rows.withColumn("smooth", _smoothed("motion", radius) if radius > 0 else F.col("motion")), "frame")


def below_quantile(series: DataFrame, value: str, q: float) -> DataFrame:
    """Rows at or below their clip's quantile."""
    return series.join(exact_quantiles(series, "clip", value, {"_cut": q}), "clip").where(F.col(value) <= F.col("_cut")).drop("_cut")


def above_quantile(series: DataFrame, value: str, q: float) -> DataFrame:
    """Rows at or above their clip's quantile."""
    return series.join(exact_quantiles(series, "clip", value, {"_cut": q}), "clip").where(F.col(value) >= F.col("_cut")).drop("_cut")


def within(series: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows inside a band, its ends included."""
    return series.where(F.col(value).between(low, high))


def strided(series: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Every ``step``-th frame from ``start`` up to but without ``end``."""
    step = max(1, step)
    return series.where((F.col("frame") >= start) & (F.col("frame") < end) & ((F.col("frame") - start) % step == 0))


def uniform_step(series: DataFrame) -> DataFrame:
    """``step`` of each clip whose frames have one positive distance; 1 for a single frame, else null."""
    rows = in_blocks(numbered(series, ["clip"], ["frame"], "_pos"), "_pos", 1)
    gaps = own_rows(rows.withColumn("_g", F.col("frame") - F.lag("frame").over(block_window(["clip"], "_pos"))), "_pos")
    one = F.min("_g") == F.max("_g")
    return gaps.groupBy("clip").agg(F.when(F.count("*") <= 1, F.lit(1)).when(one & (F.min("_g") > 0), F.min("_g")).cast("long").alias("step"))


def plane_stats(planes: DataFrame, plane: str) -> DataFrame:
    """Mean, least and largest sample of each plane."""
    total = F.aggregate(plane, F.lit(0.0), lambda z, x: z + x.cast("double"))
    return planes.withColumns(
        {"plane_avg": F.try_divide(total, F.size(plane)), "plane_min": F.array_min(plane).cast("double"), "plane_max": F.array_max(plane).cast("double")}
    )


def plane_difference(planes: DataFrame, plane: str, order: str, clip: str) -> DataFrame:
    """Mean and largest absolute difference to the plane before; null for the first of a clip."""
    out = with_previous(planes, plane, order, clip, "_before")
    diff = F.zip_with(F.col(plane), F.col("_before"), lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    out = out.withColumn("_d", diff)
    total = F.aggregate("_d", F.lit(0.0), lambda z, x: z + x)
    return out.withColumns({"diff_avg": F.try_divide(total, F.size("_d")), "diff_max": F.array_max("_d")}).drop("_d", "_before")


def with_previous(planes: DataFrame, plane: str, order: str, clip: str, name: str) -> DataFrame:
    """``name``: the plane before in its clip; null for the first."""
    rows = in_blocks(numbered(planes, [clip], [order], "_pos"), "_pos", 1, PLANES)
    return own_rows(rows.withColumn(name, F.lag(plane).over(block_window([clip], "_pos"))), "_pos", PLANES).drop("_pos")


def fallback_metrics(frames: DataFrame, absdiff: bool = True) -> DataFrame:
    """Made-up brightness and motion that follow from the frame number alone."""
    f = F.col("frame").cast("double")
    return frames.withColumns({"brightness": (F.sin(f * 0.137) + 1) / 2, "motion": (F.cos(f * (0.21 if absdiff else 0.17)) + 1) / 2})


def verify_frame(series: DataFrame, value: str, threshold: float) -> DataFrame:
    """Frame of each clip to verify on: the first that reaches the threshold, else the highest, else the middle."""
    best = F.max_by("frame", F.struct(F.col(value), -F.col("frame")))
    picks = series.groupBy("clip").agg(
        F.min(F.when(F.col(value) >= threshold, F.col("frame"))).alias("first_hit"), best.alias("top"), F.floor(F.count("*") / 2).alias("middle")
    )
    return picks.select("clip", F.coalesce("first_hit", "top", "middle").cast("long").alias("frame"))


def verify_choice(series: DataFrame, clips: DataFrame, value: str, threshold: float) -> DataFrame:
    """``clip``, ``frame`` and whether it was found by looking: as asked, else the middle, else as ``verify_frame``.

    ``clips`` has ``clip``, ``num_frames``, ``manual`` (a frame, cut to the clip,
    or null) and ``auto``. A clip without frames is verified on frame 0.
    """
    last = F.greatest(F.lit(0), F.col("num_frames") - 1)
    found = clips.join(verify_frame(series, value, threshold).withColumnRenamed("frame", "_f"), "clip", "left")
    asked = F.col("manual").isNotNull()
    looked = ~asked & F.col("auto") & (F.col("num_frames") > 0) & F.col("_f").isNotNull()
    middle = F.least(last, F.floor(F.col("num_frames") / 2))
    frame = F.when(F.col("num_frames") <= 0, 0).when(asked, F.greatest(F.lit(0), F.least(F.col("manual"), last))).when(looked, F.col("_f")).otherwise(middle)
    return found.select("clip", frame.cast("long").alias("frame"), looked.alias("auto_selected"))


def trim_clips(series: DataFrame, clips: DataFrame) -> DataFrame:
    """Frames after trimming: ``trim`` frames cut off at the start, or as many blank ones put before it if negative.

    ``clips`` has ``clip`` and ``trim``. Blank frames have ``blank`` true and null metrics.
    """
    cut = series.join(clips, "clip").withColumn("frame", F.col("frame") - F.col("trim")).where("frame >= 0")
    own = cut.drop("trim").withColumn("blank", F.lit(False))
    extra = clips.where("trim < 0").select("clip", F.explode(F.sequence(F.lit(0).cast("long"), -F.col("trim").cast("long") - 1)).alias("frame"), F.lit(True).alias("blank"))
    return own.unionByName(extra, allowMissingColumns=True)


def prepare_clips(frames: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clips trimmed at both ends, led by blank frames, with their rate set anew: clips and frames.

    ``clips`` has ``clip``, ``trim_start`` (negative: so many blank frames before
    the first), ``trim_end`` (null: to the end; negative: so many frames off it; else the frame to stop before),
    ``fps_num`` and ``fps_den`` (null: as they are in ``source_num`` and
    ``source_den``) and ``props``, a map of the source's properties. The clips
    come back with ``num_frames``, ``num``, ``den`` and ``blank_props``, what their blank frames carry;
    frames as from ``trim_clips``. A rate whose denominator is not positive is an error.
    """
    total = frames.groupBy("clip").agg(F.count("*").alias("_n"))
    known = clips.join(total, "clip", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    stop = F.when(F.col("trim_end").isNull(), F.col("_n")).when(F.col("trim_end") < 0, F.greatest(F.lit(0), F.col("_n") + F.col("trim_end"))).otherwise(F.least("_n", "trim_end"))
    known = known.withColumn("_stop", stop)
    kept = frames.join(known.select("clip", "_stop"), "clip").where(F.col("frame") < F.col("_stop")).drop("_stop")
    rows = trim_clips(kept, known.select("clip", F.coalesce("trim_start", F.lit(0)).alias("trim")))
    den = F.when(F.col("fps_num").isNull(), F.col("source_den")).when(F.col("fps_den") > 0, F.col("fps_den")).otherwise(F.raise_error(F.lit("a rate's denominator must be positive")).cast("long"))
    start = F.coalesce("trim_start", F.lit(0))
    length = F.greatest(F.lit(0), F.col("_stop") - F.greatest(start, F.lit(0))) + F.greatest(F.lit(0), -start)
    table = known.select("clip", length.cast("long").alias("num_frames"), F.coalesce("fps_num", "source_num").alias("num"), den.alias("den"), F.when(start < 0, blank_props(F.col("props"))).alias("blank_props"))
    return table, rows


def metrics_or_fallback(verdicts: DataFrame, stored: DataFrame, measured: DataFrame, frames: DataFrame) -> DataFrame:
    """``clip``, ``frame``, ``brightness``, ``motion`` and their ``origin`` of every clip.

    ``verdicts`` has ``clip`` and ``status``: reused clips come from ``stored``,
    others from ``measured``, and clips that are in neither get made-up values for their ``frames``.
    """
    reused = verdicts.where("status = 'reused'").select("clip")
    columns = ["clip", "frame", "brightness", "motion"]
    old = stored.select(*columns).join(reused, "clip", "left_semi").withColumn("origin", F.lit("stored"))
    new = measured.select(*columns).join(reused, "clip", "left_anti").withColumn("origin", F.lit("measured"))
    found = old.unionByName(new)
    rest = frames.select("clip", "frame").join(found.select("clip").distinct(), "clip", "left_anti")
    return found.unionByName(fallback_metrics(rest).select(*columns).withColumn("origin", F.lit("made up")))


def slice_clips(frames: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Frames from ``start`` up to ``end``, counted from the end of the clip if negative, numbered anew."""
    total = frames.groupBy("clip").agg((F.max("frame") + 1).alias("_n"))
    edge = lambda k: F.greatest(F.lit(0), F.col("_n") + k) if k < 0 else F.lit(k)
    kept = frames.join(total, "clip").where((F.col("frame") >= edge(start)) & (F.lit(True) if end is None else F.col("frame") < edge(end)))
    return kept.withColumn("frame", F.col("frame") - edge(start)).drop("_n")


def levels(plane: Column, low_in: float, high_in: float, low_out: float, high_out: float, gamma: float = 1.0) -> Column:
    """Samples of a plane stretched from one range to another, cut to the first, with a gamma between."""
    share = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low_in) / (high_in - low_in)))
    return F.transform(plane, lambda v: F.pow(share(v), F.lit(1.0 / gamma)) * (high_out - low_out) + low_out)


def expand_limited(plane: Column, bits: int = 8) -> Column:
    """Samples of limited range stretched over all codes of a depth."""
    scale = float(1 << (bits - 8))
    return levels(plane, 16 * scale, 235 * scale, 0.0, float((1 << bits) - 1))


def post_gamma(plane: Column, bits: int, gamma: float) -> Column:
    """Gamma inside the limited range of a depth, whose ends stay."""
    full = float((1 << bits) - 1)
    low, high = float(round(16.0 / 255.0 * full)), float(round(235.0 / 255.0 * full))
    return levels(plane, low, high, low, high, gamma)
