"""Details of selected frames: merged field by field, written as JSON and read back.

A detail has ``clip``, ``frame``, ``label``, ``score``, ``source``, ``timecode``,
``clip_role`` and ``notes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import variants as V
from seriesloom.functions.scalar import timecode

#: Source of details that name none, and labels of frames without one (fixed values of the documents).
SOURCE, AUTO, CACHED = "select_frames.v1", "Auto", "Cached"
FIELDS = ("label", "score", "source", "timecode", "clip_role", "notes")
#: Names of the fields in a document.
NAMES = {"label": "type", "timecode": "ts_tc"}


def merge_details(writes: DataFrame, order: str, fps: Column, role: str = "analyze") -> DataFrame:
    """One detail for each frame from any number of writes: the first one that has a field gives it.

    Empty labels, timecodes and notes are none. A frame without label is "Auto", one
    without timecode gets it from its number and ``fps`` (an aggregate over the
    writes), one without role ``role``. Writes are aggregated, so that a frame
    may have any number of them.
    """
    some = lambda c: F.nullif(F.col(c), F.lit("")) if c != "score" else F.col(c)
    first = lambda c: F.min_by(some(c), F.when(some(c).isNotNull(), F.col(order)))
    merged = writes.groupBy("clip", "frame").agg(*[first(c).alias(c) for c in FIELDS], fps.alias("_fps"))
    return merged.select(
        "clip",
        "frame",
        F.coalesce("label", F.lit(AUTO)).alias("label"),
        "score",
        F.coalesce("source", F.lit(SOURCE)).alias("source"),
        F.coalesce("timecode", timecode(F.col("frame"), F.col("_fps"))).alias("timecode"),
        F.coalesce("clip_role", F.lit(role)).alias("clip_role"),
        "notes",
    )


def _record() -> Column:
    return F.struct(F.col("frame").alias("frame_index"), *[F.col(c).alias(NAMES.get(c, c)) for c in FIELDS])


def detail_documents(details: DataFrame) -> DataFrame:
    """``clip`` and ``selections``: a JSON list of its details by ascending frame, absent fields as nulls.

    A clip has as many details as frames were selected, which quotas bound.
    """
    listed = details.groupBy("clip").agg(F.array_sort(F.collect_list(_record())).alias("r"))
    return listed.select("clip", F.to_json("r", {"ignoreNullFields": "false"}).alias("selections"))


def details_by_frame(details: DataFrame) -> DataFrame:
    """``clip`` and ``details``: a JSON object of its details by frame number."""
    named = F.struct(F.col("frame").cast("string").alias("k"), F.struct(F.col("frame").alias("frame_index"), *[F.col(c).alias("type" if c == "label" else c) for c in FIELDS]).alias("v"))
    listed = details.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", named.alias("e")))).alias("r"))
    return listed.select("clip", F.to_json(F.map_from_entries(F.transform("r", lambda x: x["e"])), {"ignoreNullFields": "false"}).alias("details"))


def parse_details(documents: DataFrame, text: str = "selections") -> DataFrame:
    """Details of documents that are JSON lists of records; of records with one frame the last counts.

    Documents that are no list, entries that are no object and frames that are no
    whole number are left out. A missing or empty label is "Auto", a missing
    source the usual one; scores that are no finite number are null.
    """
    doc = documents.withColumn("_v", F.try_parse_json(text))
    listed = F.when(V.kind_of(F.col("_v")) == "ARRAY", V.part(F.col("_v"), "$", "array<variant>"))
    rows = doc.select("clip", F.posexplode(listed).alias("_pos", "_e")).where(V.kind_of(F.col("_e")) == "OBJECT")
    of = lambda c: V.part(F.col("_e"), f"$.{NAMES.get(c, c)}")
    word = lambda c: F.when(V.kind_of(of(c)) == "STRING", F.nullif(F.trim(V.part(of(c), "$", "string")), F.lit("")))
    frame = V.integer_of(V.part(F.col("_e"), "$.frame_index"))
    parsed = rows.select(
        "clip",
        "_pos",
        frame.alias("frame"),
        F.coalesce(word("label"), F.lit(AUTO)).alias("label"),
        V.number_of(of("score")).alias("score"),
        F.coalesce(word("source"), F.lit(SOURCE)).alias("source"),
        *[V.text_of(of(c)).alias(c) for c in ("timecode", "clip_role", "notes")],
    ).where("frame is not null")
    last = parsed.groupBy("clip", "frame").agg(F.max_by(F.struct(*FIELDS), "_pos").alias("d"))
    return last.select("clip", "frame", *[F.col(f"d.{c}").alias(c) for c in FIELDS])


def cached_selection(cached: DataFrame, asked: DataFrame) -> DataFrame:
    """Frames that were selected before under the same hash, with their labels.

    ``cached`` has ``clip``, ``hash``, ``frames`` (a list) and ``details`` (its
    JSON list); ``asked`` has ``clip`` and ``hash``. A frame without detail is
    labelled "Cached". Clips whose hash is another, or that have no frames, have no rows.
    """
    same = asked.select("clip", "hash").join(cached, ["clip", "hash"])
    frames = same.select("clip", F.explode("frames").alias("frame")).distinct()
    known = parse_details(same.select("clip", F.col("details").alias("selections"))).select("clip", "frame", F.col("label").alias("_l"))
    return frames.join(known, ["clip", "frame"], "left").select("clip", "frame", F.coalesce("_l", F.lit(CACHED)).alias("label"))
