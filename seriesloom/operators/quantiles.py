"""Exact quantiles of many groups at once by histogram refinement.

Each wanted order statistic keeps an interval that holds it. A round counts the
values inside each interval in bins, with the least and largest value of every
bin; the bin that holds the wanted rank becomes the next interval, cut down to
its own least and largest value. An interval of one value is found. Rows are
never shuffled or gathered, only counts of bins are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lookup import sent_if_small
from .ordering import cut

#: Bins of an interval in one round.
BINS = 1024


def order_statistics(series: DataFrame, by: str, value: str, ranks: DataFrame) -> DataFrame:
    """``by``, ``rank``, ``found``: the value of each wanted rank, counted from 0.

    ``ranks`` has ``by`` and ``rank``. Null values are left out; not-a-number
    counts as larger than all others, as everywhere in Spark.
    """
    values = series.select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    ends = values.groupBy("_g").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = ranks.select(F.col(by).alias("_g"), F.col("rank").cast("long").alias("rank")).distinct().join(ends, "_g")
    state = cut(state.withColumn("skip", F.lit(0).cast("long")))
    done = None
    while True:
        # equal ends are the value itself; compared as Spark orders them, so that not-a-number equals itself
        same = F.col("lo").eqNullSafe(F.col("hi"))
        now = state.where(same).select("_g", "rank", F.col("lo").alias("found"))
        done = now if done is None else done.unionByName(now)
        state = state.where(~same)
        if state.isEmpty():
            return done.select(F.col("_g").alias(by), "rank", "found")
        # ranks that share an interval share its counts
        intervals = state.select("_g", "lo", "hi").distinct()
        inside = values.join(sent_if_small(intervals), "_g").where("_v >= lo and _v <= hi")
        # halves keep the width of any two finite ends finite; infinite ends are bins of their own
        finite = (F.abs("lo") < float("inf")) & (F.abs("hi") < float("inf")) & ~F.isnan("hi")
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        far = F.when(F.col("_v").eqNullSafe(F.col("lo")), 0).when(F.col("_v").eqNullSafe(F.col("hi")), BINS - 1).otherwise(1)
        even = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        # numbers next to each other: their halves need not differ
        close = F.col("hi") / 2 - F.col("lo") / 2 <= 0
        binned = inside.withColumn("bin", F.when(~finite | close, far).otherwise(F.when(F.col("_v") == F.col("hi"), BINS - 1).otherwise(even)))
        counts = binned.groupBy("_g", "lo", "hi", "bin").agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        up_to = F.sum("n").over(Window.partitionBy("_g", "lo", "hi").orderBy("bin"))
        steps = counts.withColumn("upto", up_to).select("_g", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "n", "upto", "least", "most").alias("b")
        s = state.alias("s")
        at = F.col("s.rank") - F.col("s.skip")
        meets = (F.col("s._g").eqNullSafe(F.col("b._g"))) & (F.col("s.lo") == F.col("b._lo")) & (F.col("s.hi") == F.col("b._hi"))
        holds = (at < F.col("b.upto")) & (at >= F.col("b.upto") - F.col("b.n"))
        state = cut(
            s.join(steps, meets & holds).select(
                F.col("s._g").alias("_g"), F.col("s.rank").alias("rank"), F.col("b.least").alias("lo"), F.col("b.most").alias("hi"), (F.col("s.skip") + F.col("b.upto") - F.col("b.n")).alias("skip")
            )
        )


def exact_quantiles(series: DataFrame, by: str, value: str, qs: dict[str, float]) -> DataFrame:
    """``by`` and a column for each name of ``qs``: the quantile with linear interpolation, as ``percentile`` gives it.

    Shares beyond 0 to 1 give the extremes. Groups without values have no row.
    """
    sizes = series.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("_n"))
    wanted = None
    for name, q in qs.items():
        place = (F.col("_n") - 1) * F.lit(min(1.0, max(0.0, float(q))))
        one = sizes.select(by, F.lit(name).alias("_q"), place.alias("_place"), F.floor(place).alias("_below"), F.ceil(place).alias("_above"))
        wanted = one if wanted is None else wanted.unionByName(one)
    wanted = cut(wanted)
    ranks = wanted.select(by, F.explode(F.array("_below", "_above")).alias("rank"))
    found = order_statistics(series, by, value, ranks)
    ends = wanted
    for side in ("_below", "_above"):
        ends = ends.join(found.select(by, F.col("rank").alias(side), F.col("found").alias(f"{side}_v")), [by, side])
    between = (F.col("_above") - F.col("_place")) * F.col("_below_v") + (F.col("_place") - F.col("_below")) * F.col("_above_v")
    even = (F.col("_below") == F.col("_above")) | (F.col("_below_v") == F.col("_above_v"))
    value_of = F.when(even, F.col("_below_v")).otherwise(between)
    return ends.groupBy(by).agg(*[F.max(F.when(F.col("_q") == n, value_of)).alias(n) for n in qs])
