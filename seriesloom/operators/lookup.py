"""Override and code lookups, labels, ordered distinct, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalar import version_suffix

#: Lookup rows that are sent to all tasks at most.
SENT_ROWS = 500_000


def sent_if_small(table: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it is counted to be small, else to be shuffled.

    Without a hint Spark would send a larger one too, if its files are small.
    """
    return F.broadcast(table) if table.limit(SENT_ROWS + 1).count() <= SENT_ROWS else shuffled(table)


def shuffled(table: DataFrame) -> DataFrame:
    """The table, to be joined by shuffle: sizes estimated from compressed files may be far too small to send it by."""
    return table.hint("merge")


def normal_overrides(raw: DataFrame) -> DataFrame:
    """``key`` trimmed and lower-cased, empty ones gone; of equal keys the last ``pos`` wins."""
    clean = raw.withColumn("key", F.lower(F.trim("key"))).where("key <> ''")
    return clean.groupBy("key").agg(F.max_by("value", "pos").alias("value"))


def match_overrides(rows: DataFrame, row_id: str, keys: list[str], overrides: DataFrame) -> DataFrame:
    """``row_id`` and the override of the first of ``keys`` that has one; rows without are left out."""
    pairs = F.array(*[F.struct(F.lit(i).alias("pr"), F.lower(F.col(k).cast("string")).alias("key")) for i, k in enumerate(keys)])
    asked = rows.select(row_id, F.explode(pairs).alias("_k")).select(row_id, "_k.pr", "_k.key").where("key <> ''")
    found = asked.join(sent_if_small(overrides), "key").where("value is not null")
    return found.groupBy(row_id).agg(F.min_by("value", "pr").alias("value"))


def decode(rows: DataFrame, code: str, table: DataFrame, name: str) -> DataFrame:
    """``name``: label of a code by the table's ``code`` and ``label``, else the code as text."""
    known = table.select(F.col("code").alias(code), F.col("label").alias("_l"))
    return rows.join(sent_if_small(known), code, "left").withColumn(name, F.coalesce("_l", F.col(code).cast("string"))).drop("_l")


def dedupe_labels(rows: DataFrame, label: str, file: str, pos: str, prefer_file: bool = False) -> DataFrame:
    """``unique_label``: label, made unique by the version in the file's name or by a number.

    A row without label gets the file's name, as do all duplicates if
    ``prefer_file``.
    """
    own = F.coalesce(F.col(label), F.lit(""))
    same = Window.partitionBy("_l")
    out = rows.withColumn("_l", own).withColumn("_n", F.count("*").over(same)).withColumn("_k", F.row_number().over(same.orderBy(pos)))
    if prefer_file:
        named = F.when((F.col("_l") == "") | (F.col("_n") > 1), F.col(file)).otherwise(F.col("_l"))
        return out.withColumn("unique_label", named).drop("_l", "_n", "_k")
    version = version_suffix(F.col(file))
    out = out.withColumn("_v", F.when(F.col("_n") > 1, F.trim(F.concat_ws(" ", "_l", version))).otherwise(F.col("_l")))
    out = out.withColumn("_m", F.count("*").over(Window.partitionBy("_l", "_v")))
    named = F.when(F.col("_l") == "", F.col(file)).when(F.col("_m") > 1, F.concat("_l", F.lit(" #"), F.col("_k").cast("string"))).otherwise(F.col("_v"))
    return out.withColumn("unique_label", named).drop("_l", "_n", "_k", "_v", "_m")


def number_repeats(rows: DataFrame, label: str, pos: str) -> DataFrame:
    """``unique_label``: second and later rows of a label get ``_k``."""
    k = F.row_number().over(Window.partitionBy(label).orderBy(pos))
    return rows.withColumn("_k", k).withColumn("unique_label", F.when(F.col("_k") > 1, F.concat(label, F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col(label))).drop("_k")


def first_seen(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct keys with the position where each is first seen."""
    return rows.groupBy(key).agg(F.min(pos).alias("first_pos"))


def unknown_keys(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known."""
    return asked.join(known.select(key).distinct(), key, "left_anti")


def all_known(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row: whether every key is known."""
    return unknown_keys(asked, known, key).agg((F.count("*") == 0).alias("all_known"))


def merge_offsets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new offsets by file: frames that were set by hand, or differ from what was suggested, stay."""
    o = old.select("file", F.col("frames").alias("_f"), F.col("suggested").alias("_s"), F.col("status").alias("_t"))
    both = o.join(new.select("file", F.col("frames").alias("_n")), "file", "full_outer")
    manual = F.coalesce((F.col("_t") == "manual") | ~F.col("_f").eqNullSafe(F.col("_s")), F.lit(False)) & F.col("_f").isNotNull()
    return both.select(
        "file", F.when(manual, F.col("_f")).otherwise(F.coalesce("_n", "_f")).alias("frames"), F.coalesce("_n", "_s").alias("suggested"), F.when(manual, "manual").otherwise("auto").alias("status")
    )


def build_plans(files: DataFrame, trims: DataFrame, trim_ends: DataFrame, rates: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Files with the overrides for trims at both ends and for the frame rate that match them."""
    out = files
    for table, name in ((trims, "trim_start"), (trim_ends, "trim_end"), (rates, "change_fps")):
        out = out.join(match_overrides(files, row_id, keys, table).withColumnRenamed("value", name), row_id, "left")
    return out


def pick_reference(clips: DataFrame, by: str, hint: str, pos: str) -> DataFrame:
    """Reference clip of each group: by position, name, stem or label as the hint says, else the analysed, else the first."""
    h = F.lower(F.trim(hint))
    same = lambda c: F.lower(F.col(c)) == h
    rank = F.when(F.col(pos).cast("string") == h, 0).when(same("name"), 1).when(same("stem"), 2).when(same("label"), 3).when(F.col("analysed"), 4).otherwise(5)
    order = Window.partitionBy(by).orderBy(F.coalesce(rank, F.lit(5)), pos)
    return clips.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def first_filled(rows: DataFrame, group: Column, order: str, value: str) -> DataFrame:
    """First value of each group that is neither null nor empty, as ``value``; an empty text if there is none."""
    filled = F.nullif(F.col(value), F.lit(""))
    return rows.groupBy(group.alias("grp")).agg(F.coalesce(F.min_by(filled, F.when(filled.isNotNull(), F.col(order))), F.lit("")).alias("value"))


def first_by_name(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key in order; rows without a key are left out."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.col(pos)).alias("_r"))
    return first.select(key, "_r.*")


def pick_target(clips: DataFrame, by: str, target: str, pos: str, cost: str, names: list[str]) -> DataFrame:
    """The clip of each group that its target text names, by aggregates.

    A number that is a position names that clip; else the first clip with the text
    as one of its ``names``, in any case; else the first clip. Without a target it
    is the clip of the least cost, the first of equal ones.
    """
    asked = F.lower(F.trim(F.coalesce(F.col(target), F.lit(""))))
    named = F.lit(False)
    for n in names:
        named = named | F.coalesce(F.lower(F.col(n)) == asked, F.lit(False))
    rank = F.when(asked == "", F.struct(F.lit(0).alias("k"), F.col(cost).cast("double").alias("c"), F.col(pos).alias("p"))).otherwise(
        F.struct(F.when(F.col(pos).cast("string") == asked, 0).when(named, 1).otherwise(2).alias("k"), F.lit(0.0).alias("c"), F.col(pos).alias("p"))
    )
    picked = clips.groupBy(by).agg(F.min_by(F.struct(*[c for c in clips.columns if c != by]), rank).alias("_r"))
    return picked.select(by, "_r.*")
