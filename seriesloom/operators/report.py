"""Report payloads: frames with their files, selection details and category counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import scalar as S
from seriesloom.functions.scalar import category_key


def report_frames(frames: DataFrame, encodes: DataFrame, files: DataFrame, details: DataFrame) -> DataFrame:
    """Each frame with its details and the files of its encodes, in the encodes' order.

    ``frames``: frame. ``encodes``: pos, label, safe_label. ``files``: frame,
    safe_label, path. ``details``: frame, label, score.
    """
    own = files.join(encodes.select("pos", "label", "safe_label"), "safe_label")
    listed = own.groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label", "path"))), lambda x: F.struct(x["label"].alias("label"), x["path"].alias("path"))).alias("files"))
    more = details.select("frame", F.col("label").alias("category"), "score")
    return frames.join(listed, "frame", "left").join(more, "frame", "left").select("frame", "category", "score", "files")


def category_counts(details: DataFrame, label: str, pos: str) -> DataFrame:
    """Rows of each category by its key, with the label seen first and where."""
    keyed = details.withColumn("key", category_key(F.coalesce(F.col(label), F.lit("Auto"))))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by(label, pos).alias("label"), F.min(pos).alias("first_pos"))


def running_total(rows: DataFrame, by: str, order: str, size: str) -> DataFrame:
    """Files and bytes so far in each group."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"files_so_far": F.count("*").over(w), "bytes_so_far": F.sum(size).over(w)})


def upload_plan(names: DataFrame) -> DataFrame:
    """Frame and label of ``<frame> - <label>.png`` names, and whether all frames have as many labels."""
    parts = names.select("name", F.regexp_extract("name", r"^(\d+) - (.+)\.png$", 1).try_cast("long").alias("frame"), F.regexp_extract("name", r"^(\d+) - (.+)\.png$", 2).alias("label")).where("frame is not null")
    sizes = parts.groupBy("frame").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("label")).alias("labels"))
    even = sizes.agg((F.min("n") == F.max("n")).alias("even"))
    return sizes.crossJoin(F.broadcast(even))


def render_plan(frames: DataFrame, encodes: DataFrame) -> DataFrame:
    """Every chosen frame for every encode with its image's name; the few encodes are one array that each frame is given."""
    names = encodes.groupBy().agg(F.collect_set("encode").alias("encodes"))
    every = frames.crossJoin(names).withColumn("encode", F.explode("encodes")).drop("encodes")
    return every.withColumn("name", S.image_name(F.col("frame"), F.col("encode")))


def alignment_block(measured: DataFrame, by: str) -> DataFrame:
    """``by`` and maps by label: ``offsets_sec``, ``offsets_frames`` (where measured) and all ``measurements``.

    ``measured`` has ``label``, ``stream``, ``seconds``, ``frames``,
    ``correlation``, ``status``, ``applied`` and ``note``; of equal labels the
    first ``pos`` counts. A group has the clips that are compared with each other.
    """
    fields = ("stream", "seconds", "frames", "correlation", "status", "applied", "note")
    one = measured.groupBy(by, "label").agg(F.min_by(F.struct(*fields), "pos").alias("m"))
    listed = one.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("label", "m"))).alias("all"))
    pick = lambda f: F.map_from_entries(F.transform(F.filter("all", lambda x: x["m"][f].isNotNull()), lambda x: F.struct(x["label"], x["m"][f])))
    return listed.select(by, pick("seconds").alias("offsets_sec"), pick("frames").alias("offsets_frames"), F.map_from_entries("all").alias("measurements"))
