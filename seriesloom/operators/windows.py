"""Selection windows of clips and what they have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalar import DEFAULT_FPS

EPSILON = 1e-9


def selection_windows(clips: DataFrame, lead: float, trail: float, shortest: float) -> DataFrame:
    """Adds ``start_frame``, ``end_frame``, ``start_seconds``, ``end_seconds`` and ``widened``.

    ``num_frames`` and ``fps`` are read. Lead and trail seconds are cut off; a
    window shorter than ``shortest`` seconds is widened at its end first, then at
    its start, as far as the clip goes. The half-open frame range of a clip with
    frames is never empty.
    """
    lead, trail, shortest = max(0.0, lead), max(0.0, trail), max(0.0, shortest)
    usable = (F.col("fps") > 0) & ~F.isnan("fps") & (F.col("fps") < float("inf"))
    base = clips.withColumn("_f", F.when(usable, F.col("fps")).otherwise(DEFAULT_FPS)).withColumn("_n", F.greatest(F.lit(0), "num_frames"))
    base = base.withColumn("_d", F.col("_n") / F.col("_f"))
    base = base.withColumn("_s0", F.least(F.lit(lead), "_d"))
    base = base.withColumn("_e0", F.greatest(F.col("_s0"), F.col("_d") - trail))
    short = (F.lit(shortest) > 0) & (F.col("_d") > 0) & (F.col("_e0") - F.col("_s0") < shortest)
    base = base.withColumn("widened", short)
    more = F.lit(shortest) - (F.col("_e0") - F.col("_s0"))
    end = F.least(F.col("_d"), F.col("_e0") + F.least(more, F.col("_d") - F.col("_e0")))
    start = F.greatest(F.lit(0.0), F.least(F.col("_s0"), F.col("_s0") - (more - (F.col("_d") - F.col("_e0")))))
    whole = F.lit(shortest) >= F.col("_d")
    base = base.withColumn("start_seconds", F.when(~short, F.col("_s0")).when(whole, 0.0).otherwise(start))
    base = base.withColumn("end_seconds", F.when(~short, F.col("_e0")).when(whole, F.col("_d")).otherwise(end))
    frame = lambda c: F.ceil(F.col(c) * F.col("_f") - EPSILON)
    base = base.withColumn("start_frame", F.greatest(F.lit(0), F.least(frame("start_seconds"), "_n")).cast("long"))
    last = F.greatest(F.col("start_frame"), F.least(frame("end_seconds"), "_n"))
    forced = F.when((last == F.col("start_frame")) & (F.col("start_frame") < F.col("_n")), F.col("start_frame") + 1).otherwise(last)
    return base.withColumn("end_frame", forced.cast("long")).drop("_f", "_n", "_d", "_s0", "_e0")


def common_window(windows: DataFrame, by: str | None = None, strict: bool = False) -> DataFrame:
    """Intersection of windows; the whole shortest clip where it is empty (``collapsed``).

    With ``strict`` a group whose shortest clip has no frames is an error.
    """
    grouped = windows.groupBy(by) if by else windows.groupBy()
    met = grouped.agg(F.max("start_frame").alias("_s"), F.min("end_frame").alias("_e"), F.min("num_frames").alias("_n"))
    gone = F.col("_e") <= F.col("_s")
    keys = [by] if by else []
    if strict:
        none = gone & (F.coalesce("_n", F.lit(0)) <= 0)
        met = met.withColumn("_n", F.when(none, F.raise_error(F.lit("no frames are left to select from")).cast("long")).otherwise(F.col("_n")))
    return met.select(
        *keys, F.when(gone, F.lit(0)).otherwise(F.col("_s")).cast("long").alias("start_frame"), F.when(gone, F.col("_n")).otherwise(F.col("_e")).cast("long").alias("end_frame"), gone.alias("collapsed")
    )
