"""Queries over the tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions import scalar as S
from seriesloom.operators import align, audio, cache, geometry, lookup, match, metadata, planes, report, search, selection, series, windows
from seriesloom.operators.ordering import cut, numbered
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.sources.documents import natural_key

QUERIES: dict = {}
ORACLES: dict = {}

#: Frame rate of the clips made from events, and the gap of 6 seconds at it.
FPS, GAP = 24.0, 144
#: Categories of the default selection.
CATEGORIES = (
    selection.Category("Dark", 1, 20, GAP),
    selection.Category("Bright", 2, 10, GAP),
    selection.Category("Motion", 3, 15, GAP // 4),
)

FRAMES = """
    m AS (SELECT max(value) AS most FROM events),
    f AS (SELECT event_type AS clip, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame,
                 event_id, user_id, value, value / nullif(most, 0) AS luma FROM events, m),
    g AS (SELECT *, coalesce(abs(luma - lag(luma) OVER (PARTITION BY clip ORDER BY frame)), 0) AS motion FROM f),
    s AS (SELECT *, avg(motion) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS smooth FROM g)
"""


def query(sql: str | None = None):
    """Register a query, with its counterpart if SQL has one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def frames_of(spark: SparkSession, d: str) -> DataFrame:
    return series.clips_from_events(table(spark, d, "events"))


def motion_of(spark: SparkSession, d: str) -> DataFrame:
    return series.smooth_motion(frames_of(spark, d), "luma", 4)


def r9(c: str):
    return F.round(c, 9).alias(c)


# --- series -----------------------------------------------------------------


@query(f"WITH {FRAMES} SELECT clip, round(quantile_cont(luma, 0.2), 9) AS q20, round(quantile_cont(luma, 0.8), 9) AS q80 FROM f GROUP BY clip")
def luma_quantile(spark, d):
    q = exact_quantiles(frames_of(spark, d), "clip", "luma", {"q20": 0.2, "q80": 0.8})
    return q.select("clip", r9("q20"), r9("q80"))


@query(f"WITH {FRAMES} SELECT clip, frame, round(motion, 9) AS motion, round(smooth, 9) AS smooth FROM s")
def motion_smooth(spark, d):
    return motion_of(spark, d).select("clip", "frame", r9("motion"), r9("smooth"))


@query(f"WITH {FRAMES} SELECT clip, frame, round(luma, 9) AS luma FROM f WHERE frame >= 10 AND (frame - 10) % 7 = 0")
def strided_sample(spark, d):
    f = frames_of(spark, d)
    length = f.groupBy("clip").agg((F.max("frame") + 1).alias("length"))
    return series.strided(f.join(length, "clip"), 10, F.col("length"), 7).select("clip", "frame", r9("luma"))


@query(f"""WITH {FRAMES}, g2 AS (SELECT clip, frame - lag(frame) OVER (PARTITION BY clip ORDER BY frame) AS d FROM f WHERE frame % 3 = 1 OR (clip = 'view' AND frame = 0))
    SELECT clip, CASE WHEN count(*) <= 1 THEN 1 WHEN min(d) = max(d) AND min(d) > 0 THEN min(d) END AS step FROM g2 GROUP BY clip""")
def uniform_step(spark, d):
    return series.uniform_step(frames_of(spark, d).where("frame % 3 = 1 or (clip = 'view' and frame = 0)"))


@query(f"WITH {FRAMES} SELECT clip, frame, round(luma, 9) AS luma FROM f WHERE luma BETWEEN 0.7 AND 0.9")
def bright_fixed_range(spark, d):
    return series.within(frames_of(spark, d), "luma", 0.7, 0.9).select("clip", "frame", r9("luma"))


@query(f"""WITH {FRAMES}, q AS (SELECT clip, quantile_cont(smooth, 0.9) AS c FROM s GROUP BY clip)
    SELECT s.clip, frame FROM s JOIN q ON s.clip = q.clip WHERE round(smooth, 9) <= round(c, 9)""")
def scenecut_cap(spark, d):
    rounded = motion_of(spark, d)
    most = exact_quantiles(rounded, "clip", "smooth", {"c": 0.9})
    return rounded.join(most, "clip").where(F.round("smooth", 9) <= F.round("c", 9)).select("clip", "frame")


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 9) AS plane_avg,
    round(list_min(embedding)::DOUBLE, 9) AS plane_min, round(list_max(embedding)::DOUBLE, 9) AS plane_max FROM embeddings""")
def plane_stats(spark, d):
    return series.plane_stats(table(spark, d, "embeddings"), "embedding").select("vec_id", r9("plane_avg"), r9("plane_min"), r9("plane_max"))


@query("""WITH l AS (SELECT vec_id, label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
    x AS (SELECT vec_id, label, CASE WHEN b IS NULL THEN NULL ELSE list_transform(list_zip(a, b), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)) END AS v FROM l)
    SELECT vec_id, label, round(list_sum(v) / len(v), 9) AS diff_avg, round(list_max(v), 9) AS diff_max FROM x""")
def plane_absdiff(spark, d):
    out = series.plane_difference(table(spark, d, "embeddings"), "embedding", "vec_id", "label")
    return out.select("vec_id", "label", r9("diff_avg"), r9("diff_max"))


#: Embeddings as planes of 8 x 8 samples.
_WIDTH = 8


def _prewitt_sql(diff: str) -> str:
    """Mean gradient of an 8 x 8 list; a neighbour beyond an edge is the mirrored one."""
    at = lambda x, y: f"{diff}[({y}) * 8 + ({x}) + 1]"
    x0, x1, y0, y1 = "abs(i % 8 - 1)", "7 - abs(6 - i % 8)", "abs(i // 8 - 1)", "7 - abs(6 - i // 8)"
    x, y = "i % 8", "i // 8"
    gx = " + ".join(f"{at(x1, r)} - {at(x0, r)}" for r in (y0, y, y1))
    gy = " + ".join(f"{at(c, y1)} - {at(c, y0)}" for c in (x0, x, x1))
    return f"list_sum(list_transform(range(64), lambda i: sqrt(({gx}) * ({gx}) + ({gy}) * ({gy})))) / 64"


@query(f"""WITH l AS (SELECT vec_id, label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
    x AS (SELECT vec_id, label, CASE WHEN b IS NOT NULL THEN list_transform(list_zip(a, b), lambda z: z[2]::DOUBLE - z[1]::DOUBLE) END AS v FROM l)
    SELECT vec_id, label, round({_prewitt_sql("v")}, 9) AS edge_avg FROM x""")
def edge_motion(spark, d):
    rows = series.with_previous(table(spark, d, "embeddings"), "embedding", "vec_id", "label", "_before")
    return rows.select("vec_id", "label", F.round(planes.difference(F.col("embedding"), F.col("_before"), _WIDTH, True), 9).alias("edge_avg"))


_SAMPLED = """n AS (SELECT label AS clip, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings),
    l AS (SELECT clip, frame, embedding AS a, lag(embedding) OVER (PARTITION BY clip ORDER BY frame) AS b FROM n WHERE frame % 3 = 0),
    x AS (SELECT clip, frame, a, CASE WHEN b IS NOT NULL THEN list_transform(list_zip(a, b), lambda z: z[2]::DOUBLE - z[1]::DOUBLE) END AS v FROM l)"""
_BRIGHT = "round(list_sum(list_transform(a, lambda x: x::DOUBLE)) / 64, 9) AS brightness"


@query(f"""WITH {_SAMPLED} SELECT 'edges' AS kind, clip, frame, {_BRIGHT}, round(coalesce({_prewitt_sql("v")}, 0), 9) AS motion FROM x
    UNION ALL SELECT 'absolute', clip, frame, {_BRIGHT}, round(coalesce(list_sum(list_transform(v, lambda z: abs(z))) / 64, 0), 9) FROM x""")
def plane_metrics(spark, d):
    """Metrics of every third plane of each label, with both kinds of motion."""
    e = table(spark, d, "embeddings")
    both = [planes.collect_metrics(e, "embedding", _WIDTH, "label", "vec_id", 3, edges).withColumn("kind", F.lit(kind)) for kind, edges in (("edges", True), ("absolute", False))]
    return both[0].unionByName(both[1]).select("kind", "clip", "frame", r9("brightness"), r9("motion"))


@query("""WITH v AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)
    SELECT label, round(min(lo), 9) AS luma_min, round(max(hi), 9) AS luma_max FROM v WHERE k <= 3 GROUP BY label""")
def luma_bounds(spark, d):
    first = table(spark, d, "embeddings").withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("k <= 3")
    return series.plane_stats(first, "embedding").groupBy("label").agg(F.round(F.min("plane_min"), 9).alias("luma_min"), F.round(F.max("plane_max"), 9).alias("luma_max"))


@query("""WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n,
                     abs(list_min(embedding)::DOUBLE) * 40 AS lo, 255 * (0.5 + list_max(embedding)::DOUBLE) AS hi FROM embeddings),
    s AS (SELECT label, CASE WHEN hi <= 247 OR (hi - lo <= 6 AND lo <= 28) THEN 'limited' WHEN hi >= 241 AND lo <= 10 THEN 'full' END AS vote
          FROM v WHERE k IN (0, n // 4, n // 2, 3 * n // 4, n - 1))
    SELECT label, CASE WHEN count(vote) = count(*) AND min(vote) = max(vote) THEN min(vote) END AS color_range FROM s GROUP BY label""")
def range_vote(spark, d):
    v = numbered(table(spark, d, "embeddings"), ["label"], ["vec_id"], "k")
    v = v.join(v.groupBy("label").agg(F.count("*").alias("n")), "label")
    v = v.where("k in (0, n div 4, n div 2, 3 * n div 4, n - 1)")
    v = series.plane_stats(v, "embedding")
    vote = S.rgb_range(F.abs("plane_min") * 40, 255 * (0.5 + F.col("plane_max")))
    agreed = (F.count("vote") == F.count("*")) & (F.min("vote") == F.max("vote"))
    return v.withColumn("vote", vote).groupBy("label").agg(F.when(agreed, F.min("vote")).alias("color_range"))


@query(f"""WITH {FRAMES} SELECT clip, frame, round((sin(frame * 0.137) + 1) / 2, 9) AS brightness, round((cos(frame * 0.21) + 1) / 2, 9) AS motion FROM f""")
def fallback_metrics(spark, d):
    return series.fallback_metrics(frames_of(spark, d).select("clip", "frame")).select("clip", "frame", r9("brightness"), r9("motion"))


@query(f"""WITH {FRAMES} SELECT clip, coalesce(min(CASE WHEN luma >= 0.999 THEN frame END), arg_max(frame, (luma, -frame)), count(*) // 2) AS frame FROM f GROUP BY clip""")
def verify_frame(spark, d):
    return series.verify_frame(frames_of(spark, d), "luma", 0.999)


@query(f"""WITH {FRAMES}, r AS (SELECT clip, frame, smooth, row_number() OVER (PARTITION BY clip ORDER BY round(smooth, 9) DESC, frame) AS place FROM s)
    SELECT clip, frame, place FROM r WHERE place <= 15""")
def topk_motion(spark, d):
    order = Window.partitionBy("clip").orderBy(F.round("smooth", 9).desc(), "frame")
    return motion_of(spark, d).withColumn("place", F.row_number().over(order)).where("place <= 15").select("clip", "frame", "place")


# --- windows ----------------------------------------------------------------

_CLIPS = "c AS (SELECT o_orderkey AS clip, o_custkey % 50 AS grp, (o_orderkey % 5000)::BIGINT AS num_frames, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE 24.0 + o_orderkey % 7 END AS fps FROM orders)"


def clips_of(spark, d):
    o = table(spark, d, "orders")
    fps = F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(24.0 + F.col("o_orderkey") % 7)
    return o.select(F.col("o_orderkey").alias("clip"), (F.col("o_custkey") % 50).alias("grp"), (F.col("o_orderkey") % 5000).alias("num_frames"), fps.alias("fps"))


_WINDOWS = f"""{_CLIPS},
    b AS (SELECT *, CASE WHEN fps > 0 THEN fps ELSE 24000.0::DOUBLE / 1001.0::DOUBLE END AS f FROM c),
    b1 AS (SELECT *, num_frames / f AS d FROM b),
    b2 AS (SELECT *, least(10.0, d) AS s0 FROM b1),
    b3 AS (SELECT *, greatest(s0, d - 5.0) AS e0 FROM b2),
    b4 AS (SELECT *, d > 0 AND e0 - s0 < 20.0 AS widened FROM b3),
    b5 AS (SELECT *, CASE WHEN NOT widened THEN s0 WHEN 20.0 >= d THEN 0.0 ELSE greatest(0.0, least(s0, s0 - (20.0 - (e0 - s0) - (d - e0)))) END AS start_seconds,
                     CASE WHEN NOT widened THEN e0 WHEN 20.0 >= d THEN d ELSE least(d, e0 + least(20.0 - (e0 - s0), d - e0)) END AS end_seconds FROM b4),
    b6 AS (SELECT *, greatest(0, least(ceil(start_seconds * f - 1e-9), num_frames))::BIGINT AS start_frame FROM b5),
    b7 AS (SELECT *, greatest(start_frame, least(ceil(end_seconds * f - 1e-9), num_frames))::BIGINT AS last FROM b6),
    w AS (SELECT *, CASE WHEN last = start_frame AND start_frame < num_frames THEN start_frame + 1 ELSE last END AS end_frame FROM b7)"""


@query(f"WITH {_WINDOWS} SELECT clip, start_frame, end_frame, round(start_seconds, 6) AS start_seconds, round(end_seconds, 6) AS end_seconds, widened FROM w")
def selection_window(spark, d):
    w = windows.selection_windows(clips_of(spark, d), 10.0, 5.0, 20.0)
    return w.select("clip", "start_frame", "end_frame", F.round("start_seconds", 6).alias("start_seconds"), F.round("end_seconds", 6).alias("end_seconds"), "widened")


@query(f"""WITH {_WINDOWS}, x AS (SELECT grp, max(start_frame) AS s, min(end_frame) AS e, min(num_frames) AS n FROM w  GROUP BY grp)
    SELECT grp, CASE WHEN e <= s THEN 0 ELSE s END AS start_frame, CASE WHEN e <= s THEN n ELSE e END AS end_frame, e <= s AS collapsed FROM x""")
def window_intersection(spark, d):
    w = windows.selection_windows(clips_of(spark, d), 10.0, 5.0, 20.0)
    return windows.common_window(w, "grp")


# --- selection --------------------------------------------------------------


def candidates_of(spark, d):
    """Dark, bright and motion candidates; the place is what they are tried by."""
    return ranked_candidates(motion_of(spark, d).select("clip", "frame", F.round("luma", 9).alias("luma"), F.round("smooth", 9).alias("smooth")))


def ranked_candidates(s):
    q = exact_quantiles(s, "clip", "luma", {"low": 0.2, "high": 0.8})
    of = lambda rows, label, place: rows.select("clip", F.lit(label).alias("label"), "frame", place.alias("place"))
    known = s.join(q, "clip")
    dark = of(known.where("luma <= low"), "Dark", F.col("luma"))
    bright = of(known.where("luma >= high"), "Bright", -F.col("luma"))
    return dark.unionByName(bright).unionByName(of(s, "Motion", -F.col("smooth")))


_ROUNDED = f"{FRAMES}, z AS (SELECT clip, frame, round(luma, 9) AS luma, round(smooth, 9) AS smooth FROM s)"
_FOLD = "list_reduce({frames}, lambda a, x: CASE WHEN len(list_filter(a, lambda y: abs(y - x) < {gap})) > 0 THEN a ELSE list_append(a, x) END, []::BIGINT[])"


@query(f"""WITH {_ROUNDED}, q AS (SELECT clip, quantile_cont(luma, 0.2) AS c FROM z GROUP BY clip),
    l AS (SELECT z.clip, list(frame ORDER BY luma, frame) AS frames FROM z JOIN q ON z.clip = q.clip WHERE luma <= c GROUP BY z.clip)
    SELECT clip, unnest({_FOLD.format(frames='frames', gap=GAP)}) AS frame FROM l""")
def spaced_dark_frames(spark, d):
    dark = candidates_of(spark, d).where("label = 'Dark'")
    return selection.spaced_frames(dark, [F.col("place")], GAP).select("clip", "frame")


_SELECT = f"""{_ROUNDED},
    q AS (SELECT clip, quantile_cont(luma, 0.2) AS lo, quantile_cont(luma, 0.8) AS hi FROM z GROUP BY clip),
    o AS (SELECT z.clip,
                 list(frame ORDER BY luma, frame) FILTER (luma <= lo) AS fd,
                 list(frame ORDER BY luma DESC, frame) FILTER (luma >= hi) AS fb,
                 list(frame ORDER BY smooth DESC, frame) AS fm FROM z JOIN q ON z.clip = q.clip GROUP BY z.clip),
    k AS (SELECT clip, {_FOLD.format(frames='fd', gap=GAP)} AS kd, {_FOLD.format(frames='fb', gap=GAP)} AS kb, {_FOLD.format(frames='fm', gap=GAP // 4)} AS km FROM o),
    e AS (SELECT clip, list_concat(list_transform(kd, lambda x: {{'pr': 1, 'frame': x}}), list_transform(kb, lambda x: {{'pr': 2, 'frame': x}}), list_transform(km, lambda x: {{'pr': 3, 'frame': x}})) AS seq FROM k),
    y AS (SELECT clip, unnest(list_reduce(seq, lambda a, x: CASE
            WHEN len(list_filter(a, lambda y: abs(y.frame - x.frame) < CASE WHEN x.pr = 3 THEN {GAP // 4} ELSE {GAP} END)) > 0
              OR len(list_filter(a, lambda y: y.pr = x.pr)) >= CASE x.pr WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 15 END THEN a ELSE list_append(a, x) END,
            []::STRUCT(pr INTEGER, frame BIGINT)[])) AS s FROM e),
    sel AS (SELECT clip, s.frame AS frame, CASE s.pr WHEN 1 THEN 'Dark' WHEN 2 THEN 'Bright' ELSE 'Motion' END AS label FROM y)"""


@query(f"WITH {_SELECT} SELECT clip, frame, label FROM sel")
def spaced_all_categories(spark, d):
    return selection.select_frames(candidates_of(spark, d), CATEGORIES)


@query(f"""WITH {_SELECT} SELECT clip, frame, printf('sel=%s;score=%.4f;tc=%02d:%02d:%02d.%03d', label, luma, ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS note
    FROM (SELECT sel.clip, sel.frame, label, luma, round_even(sel.frame / 24.0 * 1000, 0)::BIGINT AS ms FROM sel JOIN z ON z.clip = sel.clip AND z.frame = sel.frame)""")
def selection_annotation(spark, d):
    got = selection.select_frames(candidates_of(spark, d), CATEGORIES)
    luma = frames_of(spark, d).select("clip", "frame", F.round("luma", 9).alias("luma"))
    none = F.lit(None).cast("string")
    note = selection.annotation(F.col("label"), F.col("luma"), none, S.timecode(F.col("frame"), F.lit(FPS)), none)
    return got.join(luma, ["clip", "frame"]).select("clip", "frame", note.alias("note"))


@query(f"""WITH {_ROUNDED}, q AS (SELECT clip, quantile_cont(luma, 0.2) AS c FROM z GROUP BY clip),
    l AS (SELECT z.clip, list(frame ORDER BY md5('7:' || frame::VARCHAR), frame) AS frames FROM z JOIN q ON z.clip = q.clip WHERE luma <= c GROUP BY z.clip)
    SELECT clip, unnest({_FOLD.format(frames='frames', gap=GAP)}) AS frame FROM l""")
def shuffled_dark_frames(spark, d):
    dark = candidates_of(spark, d).where("label = 'Dark'")
    return selection.spaced_frames(dark, selection.hashed_order(7), GAP).select("clip", "frame")


@query()
def python_shuffled_frames(spark, d):
    """Dark candidates in the order of Python's own generator; SQL has no such generator."""
    return selection.python_shuffle(candidates_of(spark, d).where("label = 'Dark'"), 7)


@query(f"""WITH {FRAMES}, w AS (SELECT clip, max(frame) // 4 AS a, max(frame) * 3 // 4 AS b FROM f GROUP BY clip), u AS (SELECT clip, frame FROM f WHERE frame % 50 = 3)
    SELECT u.clip, u.frame, u.frame >= a AND u.frame < b AS kept FROM u JOIN w ON u.clip = w.clip""")
def user_frames(spark, d):
    f = frames_of(spark, d)
    w = f.groupBy("clip").agg(F.floor(F.max("frame") / 4).alias("start_frame"), F.floor(F.max("frame") * 3 / 4).alias("end_frame"))
    kept, gone = selection.pinned_frames(f.where("frame % 50 = 3").select("clip", "frame"), w)
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


@query(f"""WITH {FRAMES}, t AS (SELECT clip, frame, round_even(frame / (24000.0::DOUBLE / 1001.0::DOUBLE) * 1000, 0)::BIGINT AS ms FROM f)
    SELECT clip, frame, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS timecode FROM t""")
def frame_timecode(spark, d):
    return frames_of(spark, d).select("clip", "frame", S.timecode(F.col("frame"), F.lit(S.DEFAULT_FPS)).alias("timecode"))


@query("SELECT event_id, round_even(value / 2, 0)::BIGINT AS half_even FROM events")
def half_even_round(spark, d):
    return table(spark, d, "events").select("event_id", F.rint(F.col("value") / 2).cast("long").alias("half_even"))


@query(f"""WITH {FRAMES}, t AS (SELECT clip, max(frame) + 1 AS total FROM f WHERE frame < 100 GROUP BY clip)
    SELECT f.clip, frame, greatest(0, least(total - 1, frame)) AS clamped, frame > total - 1 AS was_clamped, CASE WHEN frame - 12 >= 0 THEN frame - 12 END AS source FROM f JOIN t ON f.clip = t.clip""")
def clamp_and_trim(spark, d):
    f = frames_of(spark, d)
    t = f.where("frame < 100").groupBy("clip").agg((F.max("frame") + 1).alias("total"))
    clamped = S.clamp_frame(F.col("frame"), F.col("total"))
    return f.join(t, "clip").select("clip", "frame", clamped.alias("clamped"), (clamped != F.col("frame")).alias("was_clamped"), S.source_frame(F.col("frame"), F.lit(-12)).alias("source"))


# --- alignment --------------------------------------------------------------

_HOURS = """h AS (SELECT event_type AS clip, floor(epoch(ts) / 3600)::BIGINT AS hour, sum(value) AS v FROM events GROUP BY 1, 2),
    st AS (SELECT clip, avg(v) AS m, stddev_pop(v) AS s FROM h GROUP BY clip),
    zz AS (SELECT h.clip, hour AS pos, (v - m) / (s + 1e-8) AS z FROM h JOIN st ON h.clip = st.clip),
    ref AS (SELECT min(clip) AS r FROM zz),
    pairs AS (SELECT b.clip, b.pos - a.pos AS lag, sum(a.z * b.z) AS corr_raw FROM zz a JOIN zz b ON true, ref
              WHERE a.clip = r AND b.clip <> r GROUP BY 1, 2),
    nn AS (SELECT clip, count(*) AS n FROM zz GROUP BY clip),
    xc AS (SELECT p.clip, lag, round(corr_raw, 6) AS corr_raw, round(corr_raw / least(n, (SELECT n FROM nn, ref WHERE clip = r)), 6) AS corr_norm FROM pairs p JOIN nn ON nn.clip = p.clip)"""


def correlations_of(spark, d):
    """Correlation of each event type's hourly sums with those of the first type, over all lags."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("clip"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("pos")).agg(F.sum("value").alias("v"))
    z = cut(align.zscore(e, "clip", "v").select("clip", "pos", "z"))
    first = z.join(F.broadcast(z.agg(F.min("clip").alias("r"))), F.col("clip") == F.col("r")).drop("r")  # one row
    a, others = first.select("pos", "z"), z.join(F.broadcast(first.select("clip").distinct()), "clip", "left_anti")  # one row
    counts = others.groupBy("clip").agg(F.count("*").alias("_b")).crossJoin(F.broadcast(a.agg(F.count("*").alias("_a"))))
    out = align.block_correlation(a, others).join(counts, "clip")
    return out.select("clip", "lag", F.round("corr_raw", 6).alias("corr_raw"), F.round(F.col("corr_raw") / F.least("_a", "_b"), 6).alias("corr_norm"))


@query(f"WITH {_HOURS} SELECT * FROM xc")
def audio_xcorr(spark, d):
    return correlations_of(spark, d)


@query(f"WITH {_HOURS}, r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY corr_raw DESC, lag) AS k FROM xc) SELECT clip, lag, corr_raw, corr_norm FROM r WHERE k = 1")
def best_lag(spark, d):
    return align.best_lag(correlations_of(spark, d), ["clip"], 6)


#: Window, distance, bands and rate of the envelopes made from event values.
_SIZE, _HOP, _BANDS, _RATE = 256, 64, 24, 16000.0


def _envelope_sql() -> str:
    """The envelope by plain sums: every window's spectrum term by term."""
    weights = audio.mel_weights(_RATE, _SIZE, _BANDS)
    listed = ", ".join(f"({b}, {k}, {weights[b, k]!r}::DOUBLE)".replace("np.float64(", "(") for b, k in zip(*weights.nonzero()))
    shift = _SIZE // (2 * _HOP)
    return f"""
        y AS (SELECT event_type AS clip, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, value / max(abs(value)) OVER (PARTITION BY event_type) AS v FROM events),
        n AS (SELECT clip, count(*) AS n FROM y GROUP BY clip),
        win AS (SELECT clip, unnest(range(0, n // {_HOP} + 1)) AS w FROM n),
        cut AS (SELECT win.clip, w, pos - (w * {_HOP} - {_SIZE // 2}) AS i, v * (0.5 - 0.5 * cos(2 * pi() * (pos - (w * {_HOP} - {_SIZE // 2})) / {_SIZE})) AS v
                FROM win JOIN y ON y.clip = win.clip AND pos >= w * {_HOP} - {_SIZE // 2} AND pos < w * {_HOP} + {_SIZE // 2}),
        spec AS (SELECT clip, w, k, sum(v * cos(2 * pi() * ((i * k) % {_SIZE}) / {_SIZE})) AS re, sum(v * sin(2 * pi() * ((i * k) % {_SIZE}) / {_SIZE})) AS im
                 FROM cut, (SELECT unnest(range(0, {_SIZE // 2 + 1})) AS k) GROUP BY clip, w, k),
        mel(b, k, weight) AS (VALUES {listed}),
        lev AS (SELECT clip, w, b, 10 * log10(greatest(sum(weight * (re * re + im * im)), 1e-10)) AS db FROM spec JOIN mel USING (k) GROUP BY clip, w, b),
        cap AS (SELECT clip, w, b, greatest(db, max(db) OVER (PARTITION BY clip) - 80) AS db FROM lev),
        step AS (SELECT clip, w, db - lag(db) OVER (PARTITION BY clip, b ORDER BY w) AS rise FROM cap),
        env AS (SELECT win.clip, win.w AS pos, coalesce(x.onset, 0) AS onset FROM win
                LEFT JOIN (SELECT clip, w + {shift} AS pos, sum(greatest(rise, 0)) / {_BANDS} AS onset FROM step WHERE rise IS NOT NULL GROUP BY clip, w) x ON x.clip = win.clip AND x.pos = win.w)"""


def samples_of(spark, d):
    """Event values of each type in order of time, as a signal."""
    return frames_of(spark, d).select("clip", F.col("frame").alias("pos"), "value")


def envelopes_of(spark, d):
    return audio.onset_envelope(samples_of(spark, d), _RATE, _HOP, _SIZE, _BANDS)


@query(f"WITH {_envelope_sql()} SELECT clip, pos, round(onset, 6) AS onset FROM env")
def onset_envelope(spark, d):
    return envelopes_of(spark, d).select("clip", "pos", F.round("onset", 6).alias("onset"))


@query(f"""WITH {_envelope_sql()}, st AS (SELECT clip, avg(onset) AS m, stddev_pop(onset) AS s FROM env GROUP BY clip),
    z AS (SELECT env.clip, pos, (onset - m) / (s + 1e-8) AS z FROM env JOIN st ON st.clip = env.clip),
    c AS (SELECT b.clip, b.pos - a.pos AS lag, sum(a.z * b.z) AS c FROM z a JOIN z b ON a.clip = 'click' AND b.clip <> 'click' GROUP BY 1, 2),
    best AS (SELECT clip, lag, c, row_number() OVER (PARTITION BY clip ORDER BY round(c, 9) DESC, lag) AS r FROM c),
    t AS (SELECT DISTINCT event_type AS clip, CASE WHEN event_type <> 'view' THEN 24.0 END AS fps FROM events UNION ALL SELECT 'silent', 25.0)
    SELECT t.clip, coalesce(lag, 0) * {_HOP} / {_RATE}::DOUBLE AS offset_seconds, CASE WHEN fps > 0 THEN round_even(lag * {_HOP} / {_RATE}::DOUBLE * fps, 0)::BIGINT END AS frames,
           round(coalesce(c, 0), 6) AS correlation, CASE WHEN lag IS NULL THEN 'no onset envelope' END AS error
    FROM t LEFT JOIN best ON best.clip = t.clip AND r = 1 WHERE t.clip <> 'click'""")
def measured_offsets(spark, d):
    """Offsets of the event types' envelopes against that of clicks; one clip has no frame rate, one no samples."""
    rate = F.when(F.col("clip") != "view", 24.0)
    clips = table(spark, d, "events").select(F.col("event_type").alias("clip")).distinct().withColumn("fps", rate)
    clips = clips.unionByName(spark.range(1).select(F.lit("silent").alias("clip"), F.lit(25.0).alias("fps")))
    got = audio.measure_offsets(envelopes_of(spark, d), clips, "click", _HOP, _RATE)
    return got.withColumn("correlation", F.round("correlation", 6))


_OFFSETS = """o AS (SELECT o_orderkey AS clip, o_custkey % 100 AS grp, (o_orderkey % 400 - 200) * 512 / 48000.0 AS offset_seconds,
    (o_totalprice % 100) / 100 AS correlation, CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE 24.0 END AS fps, CASE WHEN o_orderkey % 17 = 0 THEN 'probe failed' END AS err FROM orders)"""


def offsets_of(spark, d):
    o = table(spark, d, "orders")
    lags = o.select(
        F.col("o_orderkey").alias("clip"), (F.col("o_custkey") % 100).alias("grp"), (F.col("o_orderkey") % 400 - 200).alias("lag"), (F.col("o_totalprice") % 100 / 100).alias("correlation"),
        F.when(F.col("o_orderkey") % 13 == 0, 0.0).otherwise(24.0).alias("fps"), F.when(F.col("o_orderkey") % 17 == 0, "probe failed").alias("error"),
    )
    return align.offsets_from_lags(lags, 512, 48000)


@query(f"""WITH {_OFFSETS}, p AS (SELECT *, CASE WHEN fps > 0 THEN round_even(offset_seconds * fps, 0)::BIGINT END AS fr FROM o),
    e AS (SELECT *, nullif(concat_ws('; ', err, CASE WHEN abs(offset_seconds) > 1.5 THEN 'offset too large' END, CASE WHEN correlation < 0.55 THEN 'correlation too low' END, CASE WHEN fr IS NULL THEN 'no frame rate' END), '') AS error FROM p)
    SELECT clip, CASE WHEN error IS NULL THEN fr END AS frames, fr AS suggested, error FROM e""")
def offset_gate(spark, d):
    return align.gate_offsets(offsets_of(spark, d), 1.5, 0.55).select("clip", "frames", "suggested", "error")


@query(f"""WITH {_OFFSETS}, p AS (SELECT clip, grp, CASE WHEN fps > 0 THEN round_even(offset_seconds * fps, 0)::BIGINT END AS fr FROM o)
    SELECT clip, grp, fr - least(0, min(fr) OVER (PARTITION BY grp)) AS trim FROM p""")
def offset_baseline(spark, d):
    """Clips without a frame rate have no trim, and none on the others'."""
    return align.shift_to_zero(offsets_of(spark, d), "grp").select("clip", "grp", "trim")


@query("""WITH p AS (SELECT o_orderkey AS clip, o_custkey % 100 AS grp, o_orderkey % 30 + (o_orderkey % 21 - 15) AS t FROM orders)
    SELECT clip, grp, t + greatest(0, -min(t) OVER (PARTITION BY grp)) AS trim FROM p""")
def manual_offsets(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("clip"), (F.col("o_custkey") % 100).alias("grp"), (F.col("o_orderkey") % 30).alias("baseline"), (F.col("o_orderkey") % 21 - 15).alias("delta"))
    return align.apply_deltas(o, "grp").select("clip", "grp", "trim")


_STREAMS = """s AS (SELECT p_partkey % 50 AS clip, p_partkey AS index, split_part(p_type, ' ', 1) AS language, p_brand || '.' || (p_size % 3) AS codec_name, p_size % 6 AS channels,
    split_part(p_type, ' ', 2) AS channel_layout, CASE p_size % 3 WHEN 0 THEN 48000 WHEN 1 THEN 44100 ELSE 0 END AS sample_rate, (p_retailprice::INTEGER) * 100 AS bitrate, p_size % 5 = 0 AS is_default, p_size % 7 = 0 AS is_forced FROM part)"""


def streams_of(spark, d):
    p = table(spark, d, "part")
    s = p.select(
        (F.col("p_partkey") % 50).alias("clip"), F.col("p_partkey").alias("index"), F.substring_index("p_type", " ", 1).alias("language"),
        F.concat("p_brand", F.lit("."), (F.col("p_size") % 3).cast("string")).alias("codec_name"), (F.col("p_size") % 6).alias("channels"), F.split_part("p_type", F.lit(" "), F.lit(2)).alias("channel_layout"),
        F.when(F.col("p_size") % 3 == 0, 48000).when(F.col("p_size") % 3 == 1, 44100).otherwise(0).alias("sample_rate"), (F.rint("p_retailprice").cast("int") * 100).alias("bitrate"), (F.col("p_size") % 5 == 0).alias("is_default"), (F.col("p_size") % 7 == 0).alias("is_forced"),
    )
    ref = s.where("clip = 0").groupBy("clip").agg(*[F.min_by(c, "index").alias(f"ref_{c}") for c in ("language", "codec_name", "channels", "channel_layout", "sample_rate", "bitrate")]).drop("clip")
    return s.crossJoin(F.broadcast(ref))


@query(f"""WITH {_STREAMS}, r AS (SELECT * FROM s WHERE clip = 0 ORDER BY index LIMIT 1),
    k AS (SELECT s.clip, s.index, CASE WHEN r.language <> '' AND s.language = r.language THEN 100 WHEN r.language <> '' AND s.language = '' THEN 10 ELSE 0 END
      + CASE WHEN s.codec_name = r.codec_name THEN 30 WHEN split_part(s.codec_name, '.', 1) = split_part(r.codec_name, '.', 1) THEN 20 ELSE 0 END
      + CASE WHEN s.channels = r.channels THEN 10 ELSE 0 END + CASE WHEN r.channel_layout <> '' AND s.channel_layout = r.channel_layout THEN 5 ELSE 0 END
      + CASE WHEN r.sample_rate <> 0 AND s.sample_rate = r.sample_rate THEN 10 WHEN r.sample_rate <> 0 AND s.sample_rate <> 0 THEN -abs(s.sample_rate - r.sample_rate) / 1000.0::DOUBLE ELSE 0 END
      + CASE WHEN r.bitrate <> 0 AND s.bitrate <> 0 THEN -abs(s.bitrate - r.bitrate) / 10000.0::DOUBLE ELSE 0 END
      + CASE WHEN s.is_default THEN 3 ELSE 0 END + CASE WHEN s.is_forced THEN 1 ELSE 0 END + s.bitrate / 1e5 AS score FROM s, r),
    o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY round(score, 6) DESC, index) AS k FROM k)
    SELECT clip, index, round(score, 6) AS score FROM o WHERE k = 1""")
def stream_score(spark, d):
    scored = align.score_streams(streams_of(spark, d)).withColumn("score", F.round("score", 6))
    return align.choose_stream(scored).select("clip", "index", "score")


# --- lookups and labels -----------------------------------------------------


@query("""WITH o AS (SELECT lower(n_name) AS key, n_nationkey * 10 AS value FROM nation UNION ALL SELECT c_custkey::VARCHAR, 7 FROM customer WHERE c_custkey % 9 = 0),
    k AS (SELECT c_custkey, 0 AS pr, c_custkey::VARCHAR AS key FROM customer UNION ALL SELECT c_custkey, 1, lower(c_name) FROM customer
          UNION ALL SELECT c_custkey, 2, lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, arg_min(value, pr) AS value FROM k JOIN o USING (key) GROUP BY c_custkey""")
def override_lookup(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    raw = nation.select(F.concat(F.lit(" "), F.col("n_name")).alias("key"), (F.col("n_nationkey") * 10).alias("value"), F.lit(0).alias("pos"))
    raw = raw.unionByName(customer.where("c_custkey % 9 = 0").select(F.col("c_custkey").cast("string").alias("key"), F.lit(7).alias("value"), F.lit(1).alias("pos")))
    rows = customer.join(lookup.sent_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return lookup.match_overrides(rows, "c_custkey", ["c_custkey", "c_name", "n_name"], lookup.normal_overrides(raw))


@query("SELECT event_id, coalesce(n_name, (user_id % 40)::VARCHAR) AS name FROM events LEFT JOIN nation ON n_nationkey = user_id % 40")
def code_decode(spark, d):
    codes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("label"))
    return lookup.decode(table(spark, d, "events").withColumn("c", F.col("user_id") % 40), "c", codes, "name").select("event_id", "name")


_PARTS = "p AS (SELECT p_partkey AS pos, p_brand || CASE WHEN p_partkey % 40 = 0 THEN '' ELSE ' ' || (p_size % 5) END AS raw, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' v' || (p_partkey % 4) ELSE '' END AS file FROM part)"


def parts_of(spark, d):
    p = table(spark, d, "part")
    raw = F.concat("p_brand", F.when(F.col("p_partkey") % 40 == 0, "").otherwise(F.concat(F.lit(" "), (F.col("p_size") % 5).cast("string"))))
    file = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" v"), (F.col("p_partkey") % 4).cast("string"))).otherwise(""))
    return p.select(F.col("p_partkey").alias("pos"), raw.alias("raw"), file.alias("file"))


@query(f"""WITH {_PARTS}, a AS (SELECT *, count(*) OVER (PARTITION BY raw) AS n, row_number() OVER (PARTITION BY raw ORDER BY pos) AS k,
      nullif(upper(regexp_extract(file, '(?i)(?:^|[^0-9a-z])(v[0-9]{{1,3}})(?:$|[^0-9a-z])', 1)), '') AS v FROM p),
    b AS (SELECT *, CASE WHEN n > 1 THEN trim(concat_ws(' ', raw, v)) ELSE raw END AS w FROM a), c AS (SELECT *, count(*) OVER (PARTITION BY raw, w) AS m FROM b)
    SELECT pos, CASE WHEN raw = '' THEN file WHEN m > 1 THEN raw || ' #' || k ELSE w END AS unique_label FROM c""")
def label_dedupe(spark, d):
    return lookup.dedupe_labels(parts_of(spark, d), "raw", "file", "pos").select("pos", "unique_label")


@query(f"WITH {_PARTS}, a AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY pos) AS k FROM p) SELECT pos, CASE WHEN k > 1 THEN raw || '_' || k ELSE raw END AS unique_label FROM a")
def safe_label_numbers(spark, d):
    return lookup.number_repeats(parts_of(spark, d), "raw", "pos").select("pos", "unique_label")


@query("SELECT c_mktsegment, min(c_custkey) AS first_pos FROM customer GROUP BY c_mktsegment")
def dedupe_ordered(spark, d):
    return lookup.first_seen(table(spark, d, "customer"), "c_mktsegment", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def unknown_keys(spark, d):
    """Customers without an order of the highest priority."""
    asked = table(spark, d, "customer").select("c_custkey")
    return lookup.unknown_keys(asked, table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH a AS (SELECT o_orderkey AS file, o_orderkey % 50 AS f, CASE WHEN o_orderkey % 4 = 0 THEN 9 ELSE o_orderkey % 50 END AS s, CASE WHEN o_orderkey % 10 = 0 THEN 'manual' ELSE 'auto' END AS t FROM orders WHERE o_orderkey % 2 = 0),
    b AS (SELECT o_orderkey AS file, o_orderkey % 33 AS n FROM orders WHERE o_orderkey % 3 = 0)
    SELECT file, CASE WHEN f IS NOT NULL AND (t = 'manual' OR f <> s) THEN f ELSE coalesce(n, f) END AS frames, coalesce(n, s) AS suggested, CASE WHEN f IS NOT NULL AND (t = 'manual' OR f <> s) THEN 'manual' ELSE 'auto' END AS status FROM a FULL JOIN b USING (file)""")
def offset_merge(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"))
    old = o.where("file % 2 = 0").select("file", (F.col("file") % 50).alias("frames"), F.when(F.col("file") % 4 == 0, 9).otherwise(F.col("file") % 50).alias("suggested"), F.when(F.col("file") % 10 == 0, "manual").otherwise("auto").alias("status"))
    return lookup.merge_offsets(old, o.where("file % 3 = 0").select("file", (F.col("file") % 33).alias("frames")))


# --- titles -----------------------------------------------------------------

_SIM = """l AS (SELECT n_name AS a, r_name AS b, lower(n_name) AS x, lower(r_name) AS y FROM nation, region),
    o AS (SELECT a, b, x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS t FROM l),
    w AS (SELECT a, b, x, y, s, t, 1 AS i, 0 AS n, 0 AS seen FROM o UNION ALL
          SELECT a, b, x, y, s, t, i + 1, n + CASE WHEN p > 0 THEN 1 ELSE 0 END, CASE WHEN p > 0 THEN seen + p ELSE seen END
          FROM (SELECT *, instr(substr(t, seen + 1), substr(s, i, 1)) AS p FROM w WHERE i <= length(s)))"""


@query(f"WITH RECURSIVE {_SIM} SELECT a AS left_title, b AS right_title, round(CASE WHEN x = y THEN 1.0 ELSE n / length(t) END, 9) AS similarity FROM w WHERE i = length(s) + 1")
def title_similarity(spark, d):
    pairs = table(spark, d, "nation").select(F.col("n_name").alias("left_title")).crossJoin(lookup.sent_if_small(table(spark, d, "region").select(F.col("r_name").alias("right_title"))))
    return pairs.select("left_title", "right_title", F.round(S.similarity(F.lower("left_title"), F.lower("right_title")), 9).alias("similarity"))


_SIGNS = "IVXLCDMIXC"


@query(f"""WITH RECURSIVE v AS (SELECT p_partkey, translate(p_partkey::VARCHAR, '0123456789', '{_SIGNS}') || CASE WHEN p_partkey % 9 = 4 THEN p_brand[1:1] ELSE '' END AS numeral FROM part), m(c, x) AS (VALUES ('I', 1), ('V', 5), ('X', 10), ('L', 50), ('C', 100), ('D', 500), ('M', 1000)),
    w AS (SELECT p_partkey, numeral, 1 AS i, 0 AS total, 0 AS last FROM v UNION ALL
          SELECT p_partkey, numeral, i + 1, total + CASE WHEN x > last THEN x - 2 * last ELSE x END, x FROM (SELECT w.*, coalesce(m.x, -10000000) AS x FROM w LEFT JOIN m ON m.c = substr(numeral, i, 1) WHERE i <= length(numeral)))
    SELECT p_partkey, numeral, CASE WHEN total > 0 AND regexp_full_match(numeral, '[IVXLCDM]+') THEN total END AS value FROM w WHERE i = length(numeral) + 1""")
def roman_to_int(spark, d):
    """Part numbers with signs for digits; every ninth ends in a letter that is no sign."""
    sign = F.translate(F.col("p_partkey").cast("string"), "0123456789", _SIGNS)
    rows = table(spark, d, "part").select("p_partkey", F.concat(sign, F.when(F.col("p_partkey") % 9 == 4, F.substring("p_brand", 1, 1)).otherwise("")).alias("numeral"))
    return rows.withColumn("value", S.roman_value(F.col("numeral")))


_TITLE = "trim(regexp_replace(regexp_replace(replace(p_name, '&', ' and '), '[^0-9A-Za-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, lower({_TITLE}) AS title, list_sort(list_distinct(list_filter([lower({_TITLE}), CASE WHEN lower({_TITLE}) LIKE 'the %' THEN substr(lower({_TITLE}), 5) END, replace(lower({_TITLE}), 'vv', 'w'), CASE WHEN lower({_TITLE}) LIKE '%w%' THEN replace(lower({_TITLE}), 'w', 'vv') END], lambda x: x IS NOT NULL AND x <> '')))::VARCHAR[] AS variants FROM part")
def title_variants(spark, d):
    t = S.normal_title(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", t.alias("title")).withColumn("variants", S.title_variants(F.col("title")))


@query("""WITH w AS (SELECT p_partkey, p_name, regexp_extract_all(p_name, '[A-Za-z0-9'']+') AS ws FROM part), k AS (SELECT *, list_filter(ws, lambda x: length(x) > 2) AS ks FROM w)
    SELECT p_partkey, CASE WHEN len(ks) > 0 AND len(ks) < len(ws) THEN array_to_string(ks, ' ') END AS reduced FROM k""")
def reduced_title(spark, d):
    return table(spark, d, "part").select("p_partkey", S.reduced_words(F.col("p_name")).alias("reduced"))


_PAIRS = """q AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^0-9a-z]+', ' ', 'g')) AS query, 1990 + p_size % 30 AS year FROM part),
    c AS (SELECT n_nationkey AS cand, trim(regexp_replace(lower(n_name), '[^0-9a-z]+', ' ', 'g')) AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'TV' ELSE 'MOVIE' END AS category, n_nationkey % 3 AS place, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 1990 + n_nationkey END AS cy, n_nationkey * 1.5 AS popularity FROM nation),
    l AS (SELECT *, CASE WHEN length(query) <= length(title) THEN query ELSE title END AS s, CASE WHEN length(query) <= length(title) THEN title ELSE query END AS t FROM q, c),
    w AS (SELECT p_partkey, cand, query, title, s, t, year, category, place, cy, popularity, 1 AS i, 0 AS n, 0 AS seen FROM l UNION ALL
          SELECT p_partkey, cand, query, title, s, t, year, category, place, cy, popularity, i + 1, n + CASE WHEN p > 0 THEN 1 ELSE 0 END, CASE WHEN p > 0 THEN seen + p ELSE seen END
          FROM (SELECT *, instr(substr(t, seen + 1), substr(s, i, 1)) AS p FROM w WHERE i <= length(s))),
    sc AS (SELECT p_partkey, cand, CASE WHEN query = title THEN 1.0 ELSE n / length(t) END + CASE WHEN category = 'TV' AND place = 0 THEN 0.01 ELSE 0 END
           + CASE WHEN cy IS NULL THEN -0.05 WHEN abs(cy - year) <= 2 THEN 0.05 * (3 - abs(cy - year)) ELSE -least(0.4 + 0.05 * (abs(cy - year) - 2), 0.7) END
           + CASE WHEN popularity > 0 THEN least(popularity / 200, 0.05) ELSE 0 END AS score FROM w WHERE i = length(s) + 1)"""


def scored_of(spark, d):
    """Parts with what they ask, and every entry's score for each different ask."""
    q = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("query"), (1990 + F.col("p_size") % 30).alias("year"))
    c = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("cand"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 2 == 0, "TV").otherwise("MOVIE").alias("category"), (F.col("n_nationkey") % 3).alias("place"),
        F.when(F.col("n_nationkey") % 5 != 0, 1990 + F.col("n_nationkey")).alias("candidate_year"), (F.col("n_nationkey") * 1.5).alias("popularity"),
    )
    # a file of few row groups would be read, and joined, by few tasks
    asked = q.select("p_partkey", match.ask_of()).repartition("p_partkey")
    return asked, match.score_all(q, c)


@query(f"WITH RECURSIVE {_PAIRS} SELECT p_partkey, cand, round(score, 6) AS score FROM sc ")
def title_score(spark, d):
    asked, scored = scored_of(spark, d)
    return asked.join(lookup.sent_if_small(scored), "ask").select("p_partkey", "cand", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_PAIRS}, o AS (SELECT *, row_number() OVER x AS k, lead(score) OVER x AS nxt FROM sc WINDOW x AS (PARTITION BY p_partkey ORDER BY round(score, 9) DESC, cand))
    SELECT p_partkey, cand, round(score, 6) AS score, round(score - nxt, 6) AS margin, coalesce(round(score - nxt, 9) < 0.08, false) AS ambiguous, round(score, 9) >= 0.92 AS sure FROM o WHERE k = 1 AND score >= 0.45""")
def resolve_margin(spark, d):
    asked, scored = scored_of(spark, d)
    won = cut(match.resolve(scored.withColumn("score", F.round("score", 9)), "ask", "cand", among_all=True))
    got = asked.join(lookup.sent_if_small(won), "ask")
    return got.select("p_partkey", "cand", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "ambiguous", "sure")


def titled_files(spark, d):
    """Parts as files, with titles of several forms; every fifth has no year."""
    k = F.col("p_partkey")
    title = F.when(k % 4 == 0, F.concat("p_name", F.lit(": part ii"))).when(k % 4 == 1, F.concat(F.lit("The "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(k.alias("id"), title.alias("title"), F.when(k % 5 != 0, (1990 + F.col("p_size") % 10 * 3 + k % 2).cast("int")).alias("year"))


def catalogue_of(spark, d):
    """An entry for each part name and year."""
    rows = table(spark, d, "part").groupBy(F.col("p_name").alias("title"), (1990 + F.col("p_size") % 10 * 3).cast("int").alias("year")).agg(F.min("p_partkey").alias("cand"), F.count("*").alias("n"))
    category = F.when(F.col("cand") % 2 == 0, "MOVIE").otherwise("TV")
    return rows.select("cand", F.when(F.col("cand") % 3 == 0, F.concat("title", F.lit(" saga"))).otherwise(F.col("title")).alias("title"), F.col("title").alias("_plain"), "year", category.alias("category"), (F.col("n") * 1.5).alias("popularity"))


_SEARCH = r"""f AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name || ': part ii' WHEN 1 THEN 'The ' || p_name ELSE p_name END AS title, p_name,
                 CASE WHEN p_partkey % 5 <> 0 THEN (1990 + p_size % 10 * 3 + p_partkey % 2)::INT END AS year FROM part),
    c0 AS (SELECT p_name, (1990 + p_size % 10 * 3)::INT AS cy, min(p_partkey) AS cand, count(*) * 1.5 AS popularity FROM part GROUP BY ALL),
    c AS (SELECT cand, p_name, p_name || CASE WHEN cand % 3 = 0 THEN ' saga' ELSE '' END AS title, cy, CASE WHEN cand % 2 = 0 THEN 'MOVIE' ELSE 'TV' END AS category, popularity FROM c0),
    q0 AS (SELECT id, year, 0 AS o, title AS query, 'primary-title' AS r FROM f UNION ALL SELECT id, year, 1, p_name || ': part 2', 'roman-numeral' FROM f WHERE id % 4 = 0
           UNION ALL SELECT id, year, 2, p_name, 'secondary-title' FROM f WHERE id % 4 = 0 UNION ALL SELECT id, year, 3, p_name || ' part', 'reduced-words' FROM f WHERE id % 4 = 0),
    q1 AS (SELECT id, year AS base, year + d AS year, category, k, d, o, query, CASE WHEN d = 0 THEN r ELSE printf('year-adjust %+d', d) END AS reason
           FROM (SELECT *, unnest(CASE WHEN year IS NULL THEN [0] ELSE [0, -1, 1] END) AS d FROM q0), (VALUES (0, 'MOVIE'), (1, 'TV')) AS g(k, category)),
    q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d <> 0, k, o, d) AS plan_no, trim(regexp_replace(regexp_replace(lower(query), '[^0-9a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS qn FROM q1),
    fv AS (SELECT id, unnest(list_distinct(list_filter([t, CASE WHEN t LIKE 'the %' THEN substr(t, 5) END, replace(t, 'vv', 'w'), CASE WHEN t LIKE '%w%' THEN replace(t, 'w', 'vv') END], lambda x: x IS NOT NULL))) AS v
           FROM (SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^0-9a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM f)),
    al AS (SELECT cand, unnest(list_distinct(list_filter([a, replace(a, 'vv', 'w'), CASE WHEN a LIKE '%w%' THEN replace(a, 'w', 'vv') END], lambda x: x IS NOT NULL))) AS a FROM (SELECT cand, lower(p_name) || ' part 2' AS a FROM c WHERE cand % 7 = 0)),
    words AS (SELECT DISTINCT qn AS x FROM q UNION SELECT DISTINCT v FROM fv), names AS (SELECT DISTINCT lower(title) AS y FROM c UNION SELECT DISTINCT a FROM al),
    pr AS MATERIALIZED (SELECT x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS t FROM words, names),
    w AS (SELECT x, y, s, t, 1 AS i, 0 AS n, 0 AS seen FROM pr UNION ALL
          SELECT x, y, s, t, i + 1, n + CASE WHEN p > 0 THEN 1 ELSE 0 END, CASE WHEN p > 0 THEN seen + p ELSE seen END FROM (SELECT *, instr(substr(t, seen + 1), substr(s, i, 1)) AS p FROM w WHERE i <= length(s))),
    sim AS MATERIALIZED (SELECT x, y, CASE WHEN x = y THEN 1.0::DOUBLE ELSE n / length(t) END AS sim FROM w WHERE i = length(s) + 1),
    hit AS (SELECT q.id, q.plan_no, c.cand, row_number() OVER (PARTITION BY q.id, q.plan_no ORDER BY round(sim, 9) DESC, c.popularity DESC, c.cand) - 1 AS place
            FROM q JOIN c ON c.category = q.category AND (q.year IS NULL OR c.cy = q.year) JOIN sim ON x = q.qn AND y = lower(c.title) WHERE sim >= 0.45),
    page AS (SELECT * FROM hit WHERE place < 20),
    best AS (SELECT h.id, h.plan_no, h.place, h.cand, max(sim) AS sim FROM page h JOIN fv ON fv.id = h.id JOIN c ON c.cand = h.cand JOIN sim ON x = fv.v AND y = lower(c.title) GROUP BY ALL),
    sc AS (SELECT b.id, b.plan_no, b.place, b.cand, q.reason, round(sim + CASE WHEN c.category = 'TV' AND place = 0 THEN 0.01 ELSE 0 END
             + CASE WHEN ty IS NULL THEN 0 WHEN abs(cy - ty) <= 2 THEN 0.05 * (3 - abs(cy - ty)) ELSE -least(0.4 + 0.05 * (abs(cy - ty) - 2), 0.7) END + least(popularity / 200, 0.05), 9) AS score
           FROM best b JOIN (SELECT *, CASE WHEN d = 0 THEN base ELSE year END AS ty FROM q) q ON q.id = b.id AND q.plan_no = b.plan_no JOIN c ON c.cand = b.cand)"""


def search_of(spark, d):
    """Files, one for each title and year, their members, the catalogue and the scored results of these files."""
    files, members = search.alike_files(titled_files(spark, d))
    entries = cut(catalogue_of(spark, d).drop("_plain"))
    plans = cut(match.query_plans(files, ("MOVIE", "TV"), 1))
    return files, members, entries, cut(search.score_results(cut(search.search(plans, entries)), plans, files, entries))


@query(f"WITH RECURSIVE {_SEARCH} SELECT id, plan_no, place, cand, score, reason FROM sc")
def title_search(spark, d):
    """What every plan of every file finds in the catalogue, scored."""
    _, members, _, scored = search_of(spark, d)
    return search.for_members(scored, members).select("id", "plan_no", "place", "cand", "score", "reason")


@query(f"""WITH RECURSIVE {_SEARCH},
    g AS (SELECT id, min(plan_no) AS stop FROM sc WHERE score >= 0.92 GROUP BY id),
    k AS (SELECT sc.* FROM sc LEFT JOIN g ON g.id = sc.id WHERE stop IS NULL OR plan_no <= stop),
    b1 AS (SELECT *, row_number() OVER (PARTITION BY id, cand ORDER BY score DESC, plan_no, place) AS r1 FROM k),
    b2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, plan_no, place) AS r2 FROM b1 WHERE r1 = 1),
    b3 AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, max(score) OVER (PARTITION BY id) AS top FROM b2 WHERE r2 <= 5),
    av AS (SELECT b3.id, b3.cand, b3.score, b3.top, max(greatest(sim, CASE WHEN (len(list_distinct(string_split(v, ' '))) <= len(string_split(v, ' ')) AND len(string_split(v, ' ')) >= 2 AND list_has_all(string_split(a, ' '), string_split(v, ' '))
             AND len(string_split(a, ' ')) > len(string_split(v, ' '))) OR (starts_with(a, v) AND length(v) >= 4) OR (starts_with(v, a) AND length(a) >= 4) THEN 0.9 ELSE 0 END)) AS alias
           FROM b3 JOIN al ON al.cand = b3.cand JOIN fv ON fv.id = b3.id JOIN sim ON x = v AND y = a WHERE n > 1 OR top < 0.92 GROUP BY ALL),
    lf AS (SELECT id, cand, round(greatest(score + greatest(0.1, alias * 0.25), alias + 0.05, top + 0.01), 9) AS up FROM av WHERE alias >= 0.7),
    z AS (SELECT k.id, k.cand, plan_no, place, k.score AS was, CASE WHEN up > k.score THEN up ELSE k.score END AS score, reason || CASE WHEN up > k.score THEN '+alias' ELSE '' END AS reason FROM k LEFT JOIN lf ON lf.id = k.id AND lf.cand = k.cand),
    o AS (SELECT *, row_number() OVER x AS r, lead(score) OVER x AS nxt FROM z WHERE score >= 0.45 WINDOW x AS (PARTITION BY id ORDER BY score DESC, was DESC, plan_no, place))
    SELECT id, cand, plan_no, score, round(score - coalesce(nxt, 0), 9) AS margin, nxt IS NOT NULL AND round(score - nxt, 9) < 0.08 AS ambiguous, reason FROM o WHERE r = 1""")
def resolved_titles(spark, d):
    """The entry each file resolves to, with other titles of every seventh entry."""
    files, members, entries, scored = search_of(spark, d)
    other = catalogue_of(spark, d).where("cand % 7 = 0").select("cand", F.concat("_plain", F.lit(" part 2")).alias("alias"))
    won = cut(search.resolve_titles(scored, files, entries, other))
    return search.for_members(won, members).select(*won.columns)


@query("""WITH t AS (SELECT n_nationkey AS id, n_name || ': part ii' AS title, CASE WHEN n_nationkey % 2 = 0 THEN 2000 END AS year FROM nation),
    c(c, category) AS (VALUES (0, 'MOVIE'), (1, 'TV')),
    f AS (SELECT id, year, c, category, 0 AS o, title AS query, 'primary-title' AS r FROM t, c UNION ALL
          SELECT id, year, c, category, 1, replace(title, 'part ii', 'part 2'), 'roman-numeral' FROM t, c UNION ALL
          SELECT id, year, c, category, 2, split_part(title, ':', 1), 'secondary-title' FROM t, c UNION ALL
          SELECT id, year, c, category, 3, 'NATION part', 'reduced-words' FROM t, c),
    y AS (SELECT *, unnest(CASE WHEN year IS NULL THEN [0] ELSE [0, -1, 1] END) AS d FROM f),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN d = 0 THEN 0 ELSE 1 END, c, o, d) AS plan_no FROM y)
    SELECT id, plan_no, query, year + d AS year, category, CASE WHEN d = 0 THEN r ELSE printf('year-adjust %+d', d) END AS reason FROM k""")
def query_plans(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(": part ii")).alias("title"), F.when(F.col("n_nationkey") % 2 == 0, 2000).alias("year"))
    return match.query_plans(t, ("MOVIE", "TV"), 1)


# --- colour and properties --------------------------------------------------


@query(f"""WITH {FRAMES}, v AS (SELECT event_id, CASE WHEN value > 1 THEN value / 4095.0 ELSE value END AS n FROM f),
    p AS (SELECT event_id, n, pow(n, 1.0::DOUBLE / (2523.0::DOUBLE / 4096.0 * 128.0)) AS q FROM v)
    SELECT event_id, CASE WHEN n <= 0 THEN 0 ELSE round(pow(greatest(q - 3424.0::DOUBLE / 4096.0, 0) / (2413.0::DOUBLE / 4096.0 * 32.0 - 2392.0::DOUBLE / 4096.0 * 32.0 * q), 1.0::DOUBLE / (2610.0::DOUBLE / 4096.0 / 4.0)) * 10000, 6) END AS nits FROM p""")
def pq_to_nits(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.pq_to_nits(F.col("value")), 6).alias("nits"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", metadata.json_number(F.col("props"), "$.k").alias("k"))


@query("""WITH p AS (SELECT event_id, list_extract(['BT709', '9', '2', 'st2084', 'x', '470bg', '2020ncl', 'BT1886', '170m', 'bt.709', 'arib-b67', '2020'], 1 + user_id % 12) AS v FROM events),
    c AS (SELECT event_id, v, CASE lower(v) WHEN 'bt709' THEN 1 WHEN 'bt1886' THEN 1 WHEN 'st2084' THEN 16 WHEN 'arib-b67' THEN 18 WHEN '170m' THEN 6 WHEN '9' THEN 9 WHEN '2020' THEN 2020 END AS transfer,
      CASE lower(v) WHEN 'bt709' THEN 1 WHEN 'bt.709' THEN 1 WHEN '9' THEN 9 WHEN '2020' THEN 9 WHEN '470bg' THEN 5 WHEN '170m' THEN 6 END AS primaries,
      CASE lower(v) WHEN 'bt709' THEN 1 WHEN 'bt.709' THEN 1 WHEN '9' THEN 9 WHEN '2020' THEN 9 WHEN '2020ncl' THEN 9 WHEN '470bg' THEN 5 WHEN '170m' THEN 6 END AS matrix FROM p)
    SELECT event_id, matrix, transfer, primaries, coalesce(transfer IN (16, 18), false) OR coalesce(primaries = 9, false) AS hdr FROM c""")
def color_codes(spark, d):
    names = F.array(*[F.lit(x) for x in "BT709 9 2 st2084 x 470bg 2020ncl BT1886 170m bt.709 arib-b67 2020".split()])
    v = F.element_at(names, (F.col("user_id") % 12 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("_Transfer"), v, F.lit("_Primaries"), v, F.lit("_Matrix"), v).alias("props"))
    c = metadata.color_codes(F.col("props"))
    return e.select("event_id", *[c[k].alias(k) for k in ("matrix", "transfer", "primaries")], metadata.signals_hdr(F.col("props")).alias("hdr"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN 1 WHEN user_id % 3 = 1 AND event_id % 2 = 0 THEN 2 END AS space FROM events""")
def source_spaces(spark, d):
    transfer = F.element_at(F.array(F.lit(16), F.lit(18), F.lit(1)), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", metadata.source_space(transfer, F.when(F.col("event_id") % 2 == 0, 9)).alias("space"))


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 0.002 ELSE user_id / 1000.0 END AS mdl_min, CASE WHEN user_id % 2 = 0 THEN 1000.0 ELSE user_id * 10.0 END AS mdl_max FROM events""")
def mastering_luminance(spark, d):
    own = F.create_map(F.lit("MasteringDisplayMinLuminance"), (F.col("user_id") / 1000).cast("string"), F.lit("MasteringDisplayMaxLuminance"), (F.col("user_id") * 10).cast("string"))
    both = F.create_map(F.lit("MasteringDisplayLuminance"), F.lit("0.002 1000"))
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, both).otherwise(own).alias("props"))
    low, high = metadata.mastering_luminance(F.col("props"))
    return e.select("event_id", low.alias("mdl_min"), high.alias("mdl_max"))


@query(f"WITH {FRAMES} SELECT event_id, round(greatest(0, least(1, luma * 1.25 - 0.1)) * 500, 6) AS nits FROM f")
def metric_entries(spark, d):
    return frames_of(spark, d).select("event_id", F.round(metadata.metric_entry(F.col("luma") * 1.25 - 0.1, 500.0), 6).alias("nits"))


@query(f"""WITH {FRAMES}, r AS (SELECT event_type AS clip, event_id AS idx, props AS record FROM events WHERE event_id % 3 = 0)
    SELECT f.clip, f.frame, r.record FROM f LEFT JOIN r ON r.clip = f.clip AND r.idx = f.frame + 5""")
def offset_records(spark, d):
    e = table(spark, d, "events")
    records = e.where("event_id % 3 = 0").select(F.col("event_type").alias("clip"), F.col("event_id").alias("idx"), F.col("props").alias("record"))
    return metadata.offset_join(frames_of(spark, d).select("clip", "frame").withColumn("trim", F.lit(5)), records).select("clip", "frame", "record")


# --- geometry ---------------------------------------------------------------

_GEOM = "c AS (SELECT p_partkey AS clip, p_partkey % 200 AS grp, 1280 + p_size * 13 AS width, 540 + (p_partkey % 97) * 7 AS height FROM part)"
_CROP = f"""{_GEOM}, m AS (SELECT *, (width % 4) // 2 AS "left", (height % 4) // 2 AS top, width % 4 - (width % 4) // 2 AS "right", height % 4 - (height % 4) // 2 AS bottom FROM c),
    mc AS (SELECT *, width - "left" - "right" AS cropped_w, height - top - bottom AS cropped_h FROM m)"""


def geom_of(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("clip"), (F.col("p_partkey") % 200).alias("grp"), (1280 + F.col("p_size") * 13).cast("long").alias("width"), (540 + F.col("p_partkey") % 97 * 7).cast("long").alias("height"))


@query(f'WITH {_CROP} SELECT clip, "left", top, "right", bottom, cropped_w, cropped_h FROM mc')
def mod_crop(spark, d):
    return geometry.mod_crop(geom_of(spark, d), 4).select("clip", "left", "top", "right", "bottom", "cropped_w", "cropped_h")


_BOX = f"""{_GEOM}, t AS (SELECT *, max(width / height) OVER (PARTITION BY grp) AS tr FROM c),
    h AS (SELECT *, round_even(width / tr, 0)::BIGINT AS th FROM t), h2 AS (SELECT *, greatest(2, th - th % 2) AS tt FROM h),
    x AS (SELECT *, CASE WHEN width / height >= tr * 0.98 OR tt >= height THEN 0 ELSE height - tt END AS cut FROM h2)"""


@query(f"WITH {_BOX} SELECT clip, cut // 2 AS top_extra, cut - cut // 2 AS bottom_extra FROM x")
def letterbox_offsets(spark, d):
    return geometry.letterbox_offsets(geom_of(spark, d), "grp", 2, 0.02).select("clip", "top_extra", "bottom_extra")


@query(f"""WITH {_CROP}, s AS (SELECT *, CASE WHEN cropped_h = 720 THEN cropped_w ELSE greatest(1, round_even(cropped_w * (720 / cropped_h), 0)::BIGINT) END AS scaled_w FROM mc),
    g AS (SELECT *, CASE WHEN clip % 2 = 0 THEN 3 ELSE 0 END AS p FROM s), e AS (SELECT *, CASE WHEN p > 0 THEN (16 - (scaled_w + p) % 16) % 16 ELSE 0 END AS more FROM g)
    SELECT clip, scaled_w, p + more // 2 AS pad_left, more - more // 2 AS pad_right, scaled_w + p + more AS final_w FROM e""")
def scale_and_pad(spark, d):
    out = geometry.scale_to(geometry.mod_crop(geom_of(spark, d), 4), F.lit(720))
    p = F.when(F.col("clip") % 2 == 0, 3).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"pad_left": p, "pad_right": zero, "pad_top": zero, "pad_bottom": zero})
    return geometry.pad_to_mod(out, "scaled_w", "scaled_h", 16, True).select("clip", "scaled_w", "pad_left", "pad_right", "final_w")


@query("""WITH c AS (SELECT p_partkey AS clip, p_size % 7 AS a, p_partkey % 5 AS b FROM part)
    SELECT clip, a - a % 2 AS near, b - b % 2 + CASE WHEN a % 2 <> 0 AND b % 2 <> 0 THEN 2 ELSE 0 END AS far, CASE WHEN a % 2 <> 0 OR b % 2 <> 0 THEN 'vertical' END AS axes FROM c""")
def even_axis(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("clip"), (F.col("p_size") % 7).cast("long").alias("a"), (F.col("p_partkey") % 5).alias("b"))
    near, far = geometry.even_axis(F.col("a"), F.col("b"))
    zero = F.lit(0).cast("long")
    return c.select("clip", near.alias("near"), far.alias("far"), geometry.odd_axes(F.col("a"), F.col("b"), zero, zero).alias("axes"))


_ALIGN = """g AS (SELECT *, min(width) OVER w = max(width) OVER w AS same_w, min(height) OVER w = max(height) OVER w AS same_h, min(cropped_h) OVER w AS mh, min(cropped_w) OVER w AS mw FROM {0} WINDOW w AS (PARTITION BY grp)),
    dd AS (SELECT *, CASE WHEN same_w THEN greatest(0, cropped_h - mh) ELSE 0 END AS dh, CASE WHEN NOT same_w AND same_h THEN greatest(0, cropped_w - mw) ELSE 0 END AS dw FROM g),
    al AS (SELECT * EXCLUDE ("left", top, "right", bottom, cropped_w, cropped_h), "left" + dw // 2 AS "left", "right" + dw - dw // 2 AS "right", top + dh // 2 AS top, bottom + dh - dh // 2 AS bottom, cropped_w - dw AS cropped_w, cropped_h - dh AS cropped_h FROM dd)"""


def _pad_sql(mod: int) -> str:
    """Widening of padding to a multiple, from columns w, h, pl, pr, pt, pb."""
    more = lambda size, a, b: f"CASE WHEN pl + pr + pt + pb > 0 THEN ({mod} - ({size} + {a} + {b}) % {mod}) % {mod} ELSE 0 END"
    return f"{more('w', 'pl', 'pr')} AS mw2, {more('h', 'pt', 'pb')} AS mh2"


@query(f"""WITH {_GEOM}, m AS (SELECT *, (width % 2) // 2 AS "left", (height % 2) // 2 AS top, width % 2 - (width % 2) // 2 AS "right", height % 2 - (height % 2) // 2 AS bottom FROM c),
    t AS (SELECT *, max(width / height) OVER (PARTITION BY grp) AS tr FROM m), h2 AS (SELECT *, greatest(2, round_even(width / tr, 0)::BIGINT - round_even(width / tr, 0)::BIGINT % 2) AS tt FROM t),
    bx AS (SELECT *, CASE WHEN width / height >= tr * 0.98 OR tt >= height THEN 0 ELSE height - tt END AS cut FROM h2),
    b2 AS (SELECT clip, grp, width, height, "left", "right", top + cut // 2 AS top, bottom + cut - cut // 2 AS bottom, width - "left" - "right" AS cropped_w, height - top - bottom - cut AS cropped_h FROM bx),
    {_ALIGN.format("b2")},
    sc AS (SELECT *, 720 AS h, greatest(1, CASE WHEN cropped_h = 720 THEN cropped_w ELSE round_even(cropped_w * (720 / cropped_h), 0)::BIGINT END) AS w FROM al),
    pd AS (SELECT *, (max(w) OVER x - w) // 2 AS pl, (max(w) OVER x - w) - (max(w) OVER x - w) // 2 AS pr, 0 AS pt, 0 AS pb FROM sc WINDOW x AS (PARTITION BY grp)),
    mo AS (SELECT *, {_pad_sql(2)} FROM pd)
    SELECT clip, "left", top, "right", bottom, cropped_w, cropped_h, w AS scaled_w, h AS scaled_h, pl + mw2 // 2 AS pad_left, pr + mw2 - mw2 // 2 AS pad_right, pt + mh2 // 2 AS pad_top, pb + mh2 - mh2 // 2 AS pad_bottom,
           w + pl + pr + mw2 AS final_w, h + pt + pb + mh2 AS final_h FROM mo""")
def geometry_plan(spark, d):
    """The whole plan of each clip at one height."""
    got = geometry.geometry_plan(geom_of(spark, d), "grp", 2, 720, 0.02)
    return got.select("clip", *_PLAN)


_RULES = {kind: geometry.GeometryRules(mod=4, letterbox="strict", tolerance=0.01, even=kind == "even", pad="auto", slack=300) for kind in ("even", "promoted")}
_PLAN = ("left", "top", "right", "bottom", "cropped_w", "cropped_h", "scaled_w", "scaled_h", "pad_left", "pad_right", "pad_top", "pad_bottom", "final_w", "final_h")


def _whole_sql(even: bool) -> str:
    """One kind of plan; sides of both axes are made even, or the odd ones named."""
    both = lambda s, a, b: (
        f"CASE WHEN {s} > 0 THEN {a} - {a} % 2 ELSE {a} END AS {a}, CASE WHEN {s} > 0 THEN {b} - {b} % 2 + CASE WHEN {a} % 2 <> 0 AND {b} % 2 <> 0 THEN 2 ELSE 0 END ELSE {b} END AS {b}" if even else f"{a}, {b}"
    )
    odd = lambda s, *c: f"CASE WHEN {s} > 0 AND (" + " OR ".join(f"{x} % 2 <> 0" for x in c) + ") THEN"
    promotion = "'none'" if even else f"""coalesce(nullif(concat_ws('+', {odd('sub_h', 'top', 'bottom', 'pt', 'pb')} 'vertical' END, {odd('sub_w', '"left"', '"right"', 'pl', 'pr')} 'horizontal' END), ''), 'none')"""
    widened = "SELECT * EXCLUDE (pl, pr, pt, pb, mw2, mh2), pl + mw2 // 2 AS pl, pr + mw2 - mw2 // 2 AS pr, pt + mh2 // 2 AS pt, pb + mh2 - mh2 // 2 AS pb"
    return f"""(WITH {_CROP}, t AS (SELECT *, clip % 2 AS sub_w, clip % 3 AS sub_h, max(width / height) OVER x AS tr, min(cropped_h) OVER x AS short FROM mc WINDOW x AS (PARTITION BY grp)),
        h1 AS (SELECT *, least(round_even(width / tr, 0)::BIGINT, short) AS th FROM t), h2 AS (SELECT *, greatest(4, th - th % 4) AS tt FROM h1),
        bx AS (SELECT *, CASE WHEN width / height >= tr * 0.99 OR tt >= height THEN 0 ELSE height - tt END AS cut FROM h2),
        b2 AS (SELECT clip, grp, width, height, sub_w, sub_h, "left", "right", top + cut // 2 AS top, bottom + cut - cut // 2 AS bottom, cropped_w, cropped_h - cut AS cropped_h FROM bx),
        {_ALIGN.format("b2")},
        ev AS (SELECT clip, grp, width, height, sub_w, sub_h, {both("sub_h", "top", "bottom")}, {both("sub_w", '"left"', '"right"')} FROM al),
        e2 AS (SELECT *, width - "left" - "right" AS cropped_w, height - top - bottom AS cropped_h FROM ev),
        tl AS (SELECT *, max(cropped_h) OVER x AS tall, max(width) OVER x AS wide FROM e2 WINDOW x AS (PARTITION BY grp)),
        s1 AS (SELECT *, greatest(1, CASE WHEN cropped_h = tall THEN cropped_w ELSE round_even(cropped_w * (tall / cropped_h), 0)::BIGINT END) AS w1 FROM tl),
        sc AS (SELECT *, least(w1, wide) AS w, CASE WHEN w1 > wide THEN greatest(1, round_even(cropped_h * (wide / cropped_w), 0)::BIGINT) ELSE tall END AS h FROM s1),
        r1 AS (SELECT *, max(w) OVER (PARTITION BY grp) - w AS rw, tall - h AS rh FROM sc),
        r2 AS (SELECT *, CASE WHEN rw > 0 AND rw <= 300 THEN rw ELSE 0 END AS gw, CASE WHEN rh > 0 AND rh <= 300 THEN rh ELSE 0 END AS gh FROM r1),
        pd AS (SELECT *, gw // 2 AS pl, gw - gw // 2 AS pr, gh // 2 AS pt, gh - gh // 2 AS pb FROM r2),
        pq AS ({widened} FROM (SELECT *, {_pad_sql(4)} FROM pd)),
        fe AS (SELECT * EXCLUDE (pl, pr, pt, pb), {both("sub_h", "pt", "pb")}, {both("sub_w", "pl", "pr")} FROM pq),
        fi AS ({widened} FROM (SELECT *, {_pad_sql(4)} FROM fe))
        SELECT '{"even" if even else "promoted"}' AS kind, clip, "left", top, "right", bottom, cropped_w, cropped_h, w AS scaled_w, h AS scaled_h, pl AS pad_left, pr AS pad_right, pt AS pad_top, pb AS pad_bottom,
               w + pl + pr AS final_w, h + pt + pb AS final_h, {promotion} AS promotion FROM fi)"""


@query(f"SELECT * FROM {_whole_sql(True)} UNION ALL SELECT * FROM {_whole_sql(False)}")
def whole_geometry(spark, d):
    """The plan with letterbox, alignment, common height and padding in one, with even sides or with those that ask for full chroma."""
    clips = geom_of(spark, d).withColumns({"sub_w": F.col("clip") % 2, "sub_h": F.col("clip") % 3})
    plans = [geometry.plan_geometry(clips, "grp", rules).select(F.lit(kind).alias("kind"), "clip", *_PLAN, "promotion") for kind, rules in _RULES.items()]
    return plans[0].unionByName(plans[1])


# --- reports ----------------------------------------------------------------


@query("""SELECT o_orderkey AS frame, o_orderpriority AS category, round(o_totalprice, 2) AS score, x.files AS files FROM orders
    LEFT JOIN (SELECT l_orderkey, array_to_string(list('line ' || l_linenumber || '=' || l_partkey ORDER BY l_linenumber, l_partkey), ',') AS files FROM lineitem GROUP BY l_orderkey) x ON x.l_orderkey = o_orderkey""")
def report_payload(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    number = F.col("l_linenumber")
    encodes = li.select(number.cast("int").alias("pos"), F.concat(F.lit("line "), number.cast("string")).alias("label"), number.cast("string").alias("safe_label")).distinct()
    files = li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("string").alias("safe_label"), F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("path"))
    details = o.select(F.col("o_orderkey").alias("frame"), F.col("o_orderpriority").alias("label"), F.round("o_totalprice", 2).alias("score"))
    out = report.report_frames(o.select(F.col("o_orderkey").alias("frame")), encodes, files, details)
    flat = F.array_join(F.transform("files", lambda x: F.concat(x["label"], F.lit("="), x["path"].cast("long").cast("string"))), ",")
    return out.select("frame", "category", "score", flat.alias("files"))


@query("SELECT lower(event_type) AS key, count(*) AS n, arg_min(event_type, event_id) AS label, min(event_id) AS first_pos FROM events GROUP BY 1")
def category_counts(spark, d):
    return report.category_counts(table(spark, d, "events"), "event_type", "event_id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER w AS files_so_far, sum(floor(l_quantity)::BIGINT) OVER w AS bytes_so_far FROM lineitem 
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING)""")
def upload_totals(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor("l_quantity").alias("q"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("o"))
    return report.running_total(li, "l_orderkey", "o", "q").select("l_orderkey", "l_linenumber", "l_partkey", "files_so_far", "bytes_so_far")


@query("""WITH x AS (SELECT l_orderkey AS frame, count(*) AS n, array_to_string(list(l_linenumber::VARCHAR ORDER BY l_linenumber::VARCHAR), ',') AS labels FROM lineitem GROUP BY 1)
    SELECT *, (SELECT min(n) = max(n) FROM x) AS even FROM x""")
def upload_plan(spark, d):
    names = table(spark, d, "lineitem").select(S.image_name(F.col("l_orderkey"), F.col("l_linenumber").cast("string")).alias("name"))
    return report.upload_plan(names).select("frame", "n", F.array_join("labels", ",").alias("labels"), "even")


# --- cache ------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, user_id, value FROM events), c AS (SELECT event_id, user_id % 7 AS version, user_id % 5 AS conf, event_id % 11 AS trim FROM e)
    SELECT event_id, CASE WHEN version = 6 THEN 'error' WHEN version = 5 OR conf = 0 OR trim = 3 THEN 'stale' ELSE 'reused' END AS status,
           CASE WHEN version = 6 THEN 'invalid_json' WHEN version = 5 THEN 'version_mismatch' WHEN conf = 0 THEN 'config_mismatch' WHEN trim = 3 THEN 'trim_start_mismatch' END AS reason FROM c""")
def cache_verdict(spark, d):
    c = table(spark, d, "events")
    checks = [(F.col("user_id") % 7 == 6, "error", "invalid_json"), (F.col("user_id") % 7 == 5, "stale", "version_mismatch"), (F.col("user_id") % 5 == 0, "stale", "config_mismatch"), (F.col("event_id") % 11 == 3, "stale", "trim_start_mismatch")]
    status, reason = cache.verdict(checks)
    return c.select("event_id", status.alias("status"), reason.alias("reason"))


_IDENT = """a AS (SELECT l_orderkey AS k, l_linenumber * 1000000 + l_partkey AS pos, l_partkey::VARCHAR AS path, l_suppkey AS size FROM lineitem ),
    b AS (SELECT k, pos, CASE WHEN k % 30 = 0 AND pos % 2 = 0 THEN path || 'x' ELSE path END AS path, CASE WHEN k % 50 = 0 THEN size + 1 WHEN k % 70 = 0 THEN NULL ELSE size END AS size FROM a WHERE NOT (k % 110 = 0 AND pos < 2000000))"""


@query(f"""WITH {_IDENT}, j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.pos, b.pos) AS pos, a.k IS NULL OR b.k IS NULL AS alone,
      CASE WHEN a.path IS DISTINCT FROM b.path THEN 'inputs_path_mismatch' WHEN a.size <> b.size THEN 'inputs_size_mismatch' END AS r FROM a FULL JOIN b ON a.k = b.k AND a.pos = b.pos)
    SELECT k, CASE WHEN bool_or(alone) THEN 'inputs_count_mismatch' ELSE arg_min(r, pos) FILTER (r IS NOT NULL) END AS reason FROM j GROUP BY k""")
def clip_identity(spark, d):
    li = table(spark, d, "lineitem")
    none = lambda t: F.lit(None).cast(t)
    a = li.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").cast("string").alias("path"), F.col("l_suppkey").alias("size")).withColumns({"name": F.lit("n"), "role": F.lit("ref"), "mtime": none("string"), "sha1": none("string")})
    b = a.where("not (k % 110 = 0 and pos < 2000000)")
    b = b.withColumn("path", F.when((F.col("k") % 30 == 0) & (F.col("pos") % 2 == 0), F.concat("path", F.lit("x"))).otherwise(F.col("path")))
    b = b.withColumn("size", F.when(F.col("k") % 50 == 0, F.col("size") + 1).when(F.col("k") % 70 != 0, F.col("size")))
    return cache.identity_reason(a, b, "k")


@query("SELECT c_custkey, sha1(concat_ws('|', c_name, c_nationkey::VARCHAR, coalesce(c_mktsegment, '~'))) AS digest FROM customer")
def fingerprints(spark, d):
    return table(spark, d, "customer").select("c_custkey", cache.fingerprint(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("digest"))


# --- names and URLs ---------------------------------------------------------


@query("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, url LIKE 'https://%' AS webhook_ok FROM pages")
def host_redact(spark, d):
    return table(spark, d, "pages").select("page_id", S.url_host(F.col("url")).alias("host"), S.safe_webhook(F.col("url")).alias("webhook_ok"))


@query(r"""WITH f AS (SELECT p_partkey, '[' || replace(p_brand, '#', '') || '] ' || p_name || ' ' || (1890 + p_partkey % 230) || ' 1080p x264.mkv' AS n FROM part)
    SELECT p_partkey, regexp_extract(n, '^\[([^\]]+)\]', 1) AS grp, TRY_CAST(nullif(regexp_extract(n, '(?:19|20)\d\d', 0), '') AS INTEGER) AS year,
           trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '\.[^.]*$', ''), '^\[[^\]]+\]', ''), '(1080p|x264)', '', 'g'), '\s+', ' ', 'g')) AS title FROM f""")
def filename_parts(spark, d):
    n = F.concat(F.lit("["), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("] "), F.col("p_name"), F.lit(" "), (1890 + F.col("p_partkey") % 230).cast("string"), F.lit(" 1080p x264.mkv"))
    f = table(spark, d, "part").select("p_partkey", n.alias("n"))
    return f.select("p_partkey", S.release_group(F.col("n")).alias("grp"), S.year_in(F.col("n")).alias("year"), S.strip_noise(F.col("n")).alias("title"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY regexp_replace(c_name, '\\d+', ''), TRY_CAST(regexp_extract(c_name, '\\d+') AS BIGINT)) AS place FROM customer")
def natural_order(spark, d):
    c = table(spark, d, "customer").select("c_custkey", natural_key(F.col("c_name")).alias("k"))
    return numbered(c, [], ["k", "c_custkey"], "place").select("c_custkey", (F.col("place") + 1).alias("place"))


@query(f"""WITH t AS (SELECT event_id, value FROM events), u AS (SELECT event_id, value, round_even(greatest(value, 0) * 10, 0)::BIGINT AS s, floor(value)::BIGINT AS c FROM t)
    SELECT event_id, printf('%02d:%02d:%02d.%d', s // 36000, s // 600 % 60, s // 10 % 60, s % 10) AS seconds_text, CASE WHEN value >= 3600 THEN printf('%d:%02d:%02d', c // 3600, c // 60 % 60, c % 60) ELSE printf('%02d:%02d', c // 60, c % 60) END AS clock FROM u""")
def time_texts(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", S.seconds_text(v).alias("seconds_text"), S.clock_text(v).alias("clock"))


# --- further lookups, titles and scalars ------------------------------------


@query("""WITH t AS (SELECT n_name, n_nationkey FROM nation)
    SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS trim_start, CASE WHEN n_nationkey % 3 = 0 THEN -n_nationkey END AS trim_end, CASE WHEN c_custkey % 5 = 0 THEN 24 END AS change_fps
    FROM customer JOIN t ON c_nationkey = n_nationkey""")
def build_plans(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    files = customer.join(lookup.sent_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    over = lambda df, k, v: df.select(F.lower(F.col(k).cast("string")).alias("key"), v.alias("value"))
    out = lookup.build_plans(
        files, over(nation.where("n_nationkey % 2 = 0"), "n_name", F.col("n_nationkey")), over(nation.where("n_nationkey % 3 = 0"), "n_name", -F.col("n_nationkey")), over(customer.where("c_custkey % 5 = 0"), "c_custkey", F.lit(24)), ["c_custkey", "n_name"], "c_custkey"
    )
    return out.select("c_custkey", "trim_start", "trim_end", "change_fps")


@query("""WITH c AS (SELECT c_nationkey AS grp, c_custkey AS pos, c_name AS name, lower(c_mktsegment) AS label, c_custkey % 7 = 0 AS analysed, CASE c_nationkey % 3 WHEN 0 THEN 'machinery' WHEN 1 THEN 'none' ELSE ' BUILDING ' END AS hint FROM customer),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN lower(name) = lower(trim(hint)) THEN 1 WHEN label = lower(trim(hint)) THEN 3 WHEN analysed THEN 4 ELSE 5 END, pos) AS k FROM c)
    SELECT grp, pos FROM r WHERE k = 1""")
def pick_reference(spark, d):
    hint = F.element_at(F.array(F.lit("machinery"), F.lit("none"), F.lit(" BUILDING ")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), F.col("c_name").alias("stem"), F.col("c_mktsegment").alias("label"), (F.col("c_custkey") % 7 == 0).alias("analysed"), hint.alias("hint"))
    return lookup.pick_reference(c, "grp", "hint", "pos").select("grp", "pos")


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 90 END, CASE WHEN o_orderkey % 5 <> 0 THEN round_even((o_orderkey % 400 - 200) / 100.0::DOUBLE * 24.0, 0)::BIGINT END) AS frames,
    CASE WHEN o_orderkey % 4 = 0 THEN 24000.0::DOUBLE / 1001 WHEN o_orderkey % 5 = 0 THEN 25.0 END AS fps,
    CASE WHEN o_orderkey % 400 > 300 THEN 'high' WHEN abs(o_orderkey % 400 - 200) < 50 THEN 'near' END AS mark, CASE WHEN o_orderkey % 5 - 1 <= 0 THEN 0 WHEN o_orderkey % 5 - 1 = 1 THEN 6 ELSE 9 END AS level,
    greatest(180.0, o_totalprice * 1000 / 262144 + 15) AS timeout FROM orders""")
def frame_hints(spark, d):
    k = F.col("o_orderkey")
    rate = S.first_rate((F.when(k % 4 == 0, 24000).otherwise(0), F.lit(1001)), (F.when(k % 5 == 0, 25), F.lit(1)))
    return table(spark, d, "orders").select(
        "o_orderkey", S.frame_hint(F.when(k % 3 == 0, k % 90), (k % 400 - 200) / 100.0, F.when(k % 5 == 0, 0.0).otherwise(24.0)).alias("frames"), rate.alias("fps"),
        S.highlight((k % 400 - 200).cast("double"), [("gt", 100.0, "high"), ("abs_lt", 50.0, "near")]).alias("mark"), S.compression_level(k % 5 - 1).alias("level"), S.upload_timeout(F.lit(180.0), F.col("o_totalprice") * 1000).alias("timeout"),
    )


@query("""WITH q AS (SELECT p_partkey, p_name, lower(p_name) AS a, split_part(lower(p_name), ' ', 1) AS b FROM part)
    SELECT p_partkey, CASE WHEN length(b) >= 4 AND a <> b THEN greatest(0.9, length(b) / length(a)) ELSE length(b) / length(a) END AS similarity FROM q""")
def alias_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", match.alias_similarity(F.lower("p_name"), F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1))).alias("similarity"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ': part (uncut) 1999|' || n_name || ': part (uncut)|' || n_name || ': part  1999|' || n_name || '|part (uncut) 1999' ELSE n_name || ' aka other|' || n_name || '|other' END AS forms FROM nation""")
def title_expansion(spark, d):
    t = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(": part (uncut) 1999"))).otherwise(F.concat("n_name", F.lit(" aka other")))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(match.expand_titles(t), "|").alias("forms"))


@query("""WITH c AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'TV' ELSE 'MOVIE' END AS category, c_acctbal AS score FROM customer),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN category = 'TV' THEN 0 ELSE 1 END, score DESC, c_custkey) AS k FROM c) SELECT c_nationkey, c_custkey, category FROM r WHERE k = 1""")
def best_external(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "TV").otherwise("MOVIE").alias("category"), F.col("c_acctbal").alias("score"))
    return match.best_external(c, "c_nationkey", "TV", "c_custkey").select("c_nationkey", "c_custkey", "category")


@query(f"""WITH {FRAMES}, c AS (SELECT clip, (row_number() OVER (ORDER BY clip) - 3) * 40 AS trim FROM (SELECT DISTINCT clip FROM f))
    SELECT f.clip, frame - trim AS frame, round(luma, 9) AS luma, false AS blank FROM f JOIN c ON c.clip = f.clip WHERE frame >= trim
    UNION ALL SELECT clip, unnest(range(-trim)) AS frame, NULL, true FROM c WHERE trim < 0""")
def trimmed_clips(spark, d):
    f = frames_of(spark, d).select("clip", "frame", r9("luma"))
    names = f.groupBy().agg(F.array_sort(F.collect_set("clip")).alias("c")).select(F.posexplode("c").alias("k", "clip"))
    return series.trim_clips(f, names.select("clip", ((F.col("k") - 2) * 40).cast("long").alias("trim")))


@query(f"WITH {_SELECT} SELECT label, count(*) AS n FROM sel GROUP BY label")
def selection_counts(spark, d):
    return selection.select_frames(candidates_of(spark, d), CATEGORIES).groupBy("label").agg(F.count("*").alias("n"))


_FULL = f"""{_ROUNDED}, w AS (SELECT clip, max(frame) // 10 AS a, max(frame) * 9 // 10 AS b FROM z GROUP BY clip),
    i AS (SELECT z.* FROM z JOIN w ON z.clip = w.clip WHERE frame >= a AND frame < b),
    q AS (SELECT clip, quantile_cont(luma, 0.2) AS lo, quantile_cont(luma, 0.8) AS hi FROM i GROUP BY clip),
    o AS (SELECT i.clip, list(frame ORDER BY frame) FILTER (frame % 97 = 5) AS fu,
                 list(frame ORDER BY luma, frame) FILTER (luma <= lo) AS fd,
                 list(frame ORDER BY luma DESC, frame) FILTER (luma >= hi) AS fb,
                 list(frame ORDER BY smooth DESC, frame) AS fm, list(frame ORDER BY md5('11:' || frame::VARCHAR), frame) AS fr FROM i JOIN q ON i.clip = q.clip GROUP BY i.clip),
    k AS (SELECT clip, coalesce(fu, []) AS fu, {_FOLD.format(frames='fd', gap=GAP)} AS kd, {_FOLD.format(frames='fb', gap=GAP)} AS kb, {_FOLD.format(frames='fm', gap=GAP // 4)} AS km, fr FROM o),
    e AS (SELECT clip, list_concat(list_concat(list_concat(list_transform(fu, lambda x: {{'pr': 0, 'frame': x}}), list_transform(kd, lambda x: {{'pr': 1, 'frame': x}})),
        list_concat(list_transform(kb, lambda x: {{'pr': 2, 'frame': x}}), list_transform(km, lambda x: {{'pr': 3, 'frame': x}}))), list_transform(fr, lambda x: {{'pr': 4, 'frame': x}})) AS seq FROM k),
    y AS (SELECT clip, unnest(list_reduce(seq, lambda a, x: CASE
            WHEN len(list_filter(a, lambda y: abs(y.frame - x.frame) < CASE x.pr WHEN 0 THEN 1 WHEN 3 THEN {GAP // 4} ELSE {GAP} END)) > 0
              OR len(list_filter(a, lambda y: y.pr = x.pr)) >= CASE x.pr WHEN 0 THEN 1000000 WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 3 THEN 15 ELSE 5 END THEN a ELSE list_append(a, x) END,
            []::STRUCT(pr INTEGER, frame BIGINT)[])) AS s FROM e)"""


@query(f"WITH {_FULL} SELECT clip, s.frame AS frame, CASE s.pr WHEN 0 THEN 'User' WHEN 1 THEN 'Dark' WHEN 2 THEN 'Bright' WHEN 3 THEN 'Motion' ELSE 'Random' END AS label FROM y")
def select_frames_full(spark, d):
    """User, dark, bright, motion and random frames of each clip's window, in that order of claims."""
    s = motion_of(spark, d).select("clip", "frame", F.round("luma", 9).alias("luma"), F.round("smooth", 9).alias("smooth"))
    w = s.groupBy("clip").agg(F.floor(F.max("frame") / 10).alias("start_frame"), F.floor(F.max("frame") * 9 / 10).alias("end_frame"))
    inside = selection.pinned_frames(s, w)[0]
    random = numbered(inside.select("clip", F.lit("Random").alias("label"), "frame"), ["clip"], [*selection.hashed_order(11), "frame"], "place")
    user = s.where("frame % 97 = 5").select("clip", F.lit("User").alias("label"), "frame", F.col("frame").alias("place"))
    found = ranked_candidates(inside).unionByName(random).unionByName(user)
    return selection.select_frames(found, (selection.USER, *CATEGORIES, selection.Category("Random", 4, 5, GAP, False)), w)


@query("""WITH k AS (SELECT o_orderkey AS k, o_orderkey % 256 AS a, o_orderkey * 7 % 256 AS b, o_orderkey * 13 % 256 AS c FROM orders)
    SELECT k, CASE k % 11 WHEN 0 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false WHEN 6 THEN true WHEN 7 THEN false WHEN 8 THEN NOT (k % 40 BETWEEN 16 AND 31) WHEN 9 THEN false WHEN 10 THEN false
      ELSE NOT (a IN (0, 10, 127) OR a >= 240 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 169 AND b = 254 OR a = 198 AND b IN (18, 19)
        OR a = 192 AND b = 0 AND c IN (0, 2) OR a = 198 AND b = 51 AND c = 100 OR a = 203 AND b = 0 AND c = 113) END AS safe,
      CASE k % 11 WHEN 0 THEN '::1' WHEN 5 THEN 'fd00::' || k % 9 WHEN 9 THEN 'fe80::1' END AS v6 FROM k""")
def webhook_safety(spark, d):
    k = F.col("o_orderkey")
    t = lambda c: c.cast("string")
    forms = (
        F.lit("https://[::1]/x"), F.concat(F.lit("https://"), t(k % 256), F.lit("."), t(k * 7 % 256), F.lit("."), t(k * 13 % 256), F.lit(".1/x")), F.lit("http://example.com/"), F.lit("https://LocalHost:8080/x"),
        F.concat(F.lit("https://h"), t(k), F.lit(".example.com/x")), F.concat(F.lit("https://[fd00::"), t(k % 9), F.lit("]/x")), F.concat(F.lit("https://u:p@[2606:4700::"), t(k % 9), F.lit("]:443/x")), F.lit("https://[::ffff:10.0.0.1]/"),
        F.concat(F.lit("https://172."), t(k % 40), F.lit(".0.1/")), F.lit("https://[FE80::1]:443/"), F.lit("https:///nohost"),
    )
    url = F.element_at(F.array(*forms), (k % 11 + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("k"), S.safe_webhook(url).alias("safe"), F.when((k % 11).isin(0, 5, 9), S.url_host(url)).alias("v6"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'MOVIE' WHEN 1 THEN 'TV' WHEN 2 THEN 'TV' WHEN 5 THEN 'MOVIE' END AS category, CASE WHEN c_custkey % 6 IN (0, 1, 2, 5) THEN c_custkey::VARCHAR END AS id FROM customer""")
def manual_ids(spark, d):
    k = F.col("c_custkey").cast("string")
    forms = (F.concat(F.lit("movie/"), k), F.concat(F.lit(" TV:"), k, F.lit(" ")), F.concat(F.lit("tv-"), k), k, F.concat(F.lit("film/"), k), F.concat(F.lit("movie"), k))
    got = S.manual_id(F.element_at(F.array(*forms), (F.col("c_custkey") % 6 + 1).cast("int")))
    return table(spark, d, "customer").select("c_custkey", got["category"].alias("category"), got["id"].alias("id"))


@query(r"""SELECT p_partkey, replace(replace(replace(replace(replace(replace(p_name || ': a=' || p_size || ', [x] it' || chr(39) || 's', ':', '\:'), '=', '\='), ',', '\,'), '[', '\['), ']', '\]'), chr(39), '\' || chr(39)) || '\\n' || '\\' AS text FROM part""")
def drawtext(spark, d):
    text = F.concat("p_name", F.lit(": a="), F.col("p_size").cast("string"), F.lit(", [x] it's\n\\"))
    return table(spark, d, "part").select("p_partkey", S.drawtext(text).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN trim(p_brand || ' / ' || p_name) ELSE p_name END AS raw, CASE WHEN p_partkey % 4 = 0 THEN 'given_name' WHEN p_partkey % 3 = 0 THEN trim(p_brand || ' _ ' || p_name) ELSE p_name END AS safe FROM part""")
def derived_labels(spark, d):
    k = F.col("p_partkey")
    raw, safe = S.label_pair(F.when(k % 3 == 0, F.concat("p_brand", F.lit(" / "), "p_name")).otherwise(F.lit("")), F.col("p_name"), F.when(k % 4 == 0, F.lit(" given:name ")))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw"), safe.alias("safe"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '|' || p_brand ELSE '' END AS titles FROM part""")
def title_candidates(spark, d):
    k = F.col("p_partkey")
    got = S.title_candidates(F.col("p_name"), F.upper("p_name"), F.when(k % 2 == 0, F.col("p_brand")), F.lit(" "), F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("p_name"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(got, "|").alias("titles"))


@query("""SELECT o_custkey AS clip, coalesce(arg_min(o_orderkey, o_orderkey) FILTER (o_orderpriority LIKE '1%'), min(o_orderkey), 0) AS stream FROM orders GROUP BY o_custkey""")
def default_stream(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").startswith("1").alias("is_default"))
    return align.default_stream(o, "clip")


@query("""SELECT o_custkey AS grp, coalesce(arg_min(o_clerk, o_orderkey) FILTER (o_orderkey % 3 <> 0), '') AS value FROM (SELECT *, o_orderpriority AS o_clerk FROM orders) GROUP BY o_custkey""")
def first_values(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise(F.lit("")).alias("v"))
    return lookup.first_filled(o, F.col("o_custkey"), "o_orderkey", "v")


@query(f"""WITH {FRAMES}, c AS (SELECT clip, count(*) AS n FROM f GROUP BY clip)
    SELECT f.clip, frame - 7 AS frame, round(luma, 9) AS luma FROM f JOIN c ON f.clip = c.clip WHERE frame >= 7 AND frame < n - 11""")
def sliced_clips(spark, d):
    return series.slice_clips(frames_of(spark, d).select("clip", "frame", r9("luma")), 7, -11)


@query("""SELECT event_id, value = floor(value) AND value >= 0 AND value < 500 AS valid FROM events""")
def valid_indices(spark, d):
    return table(spark, d, "events").select("event_id", S.valid_index(F.col("value"), F.lit(500)).alias("valid"))


@query(f"WITH {_SELECT}, c AS (SELECT DISTINCT clip FROM f) SELECT c.clip AS encode, sel.clip AS clip, sel.frame AS frame, sel.frame || ' - ' || c.clip || '.png' AS name FROM sel CROSS JOIN c")
def render_plan(spark, d):
    frames = selection.select_frames(candidates_of(spark, d), CATEGORIES)
    encodes = frames_of(spark, d).select(F.col("clip").alias("encode")).distinct()
    return report.render_plan(frames, encodes).select("encode", "clip", "frame", "name")
