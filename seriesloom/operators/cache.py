"""Fingerprints of inputs and verdicts on cached results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of metric documents that can be reused.
VERSION = 2


def identity_reason(asked: DataFrame, cached: DataFrame, by: str, with_sha1: bool = False) -> DataFrame:
    """``by`` and the first mismatch of clip identities at any position, or null.

    Both sides have ``by``, ``pos``, ``path``, ``name``, ``role``, ``size``,
    ``mtime``, ``sha1``. A null size or time matches any; digests only count if asked.
    """
    cols = ("path", "name", "role", "size", "mtime", "sha1")
    a = asked.select(by, "pos", *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("_a"))
    b = cached.select(by, "pos", *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("_b"))
    both = a.join(b, [by, "pos"], "full_outer")
    differ = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    known = lambda c: F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull() & (F.col(f"a_{c}") != F.col(f"b_{c}"))
    reason = (
        F.when(differ("path"), "inputs_path_mismatch")
        .when(differ("name"), "inputs_name_mismatch")
        .when(differ("role"), "inputs_role_mismatch")
        .when(known("size"), "inputs_size_mismatch")
        .when(known("mtime"), "inputs_mtime_mismatch")
    )
    if with_sha1:
        reason = reason.when(F.coalesce(F.col("a_sha1") != F.col("b_sha1"), F.lit(True)), "inputs_sha1_mismatch")
    found = both.groupBy(by).agg((F.count("_a") != F.count("_b")).alias("_n"), F.min_by(reason, F.when(reason.isNotNull(), F.col("pos"))).alias("_r"))
    return found.select(by, F.when(F.col("_n"), "inputs_count_mismatch").otherwise(F.col("_r")).alias("reason"))


def verdict(checks: list[tuple[Column, str, str]]) -> tuple[Column, Column]:
    """``status`` and ``reason`` of the first check that holds; reused if none does."""
    status, reason = F.lit("reused"), F.lit(None).cast("string")
    for holds, s, r in reversed(checks):
        hit = F.coalesce(holds, F.lit(False))
        status, reason = F.when(hit, s).otherwise(status), F.when(hit, r).otherwise(reason)
    return status, reason


def fingerprint(*parts: Column) -> Column:
    """SHA-1 of the parts as text; null parts count as a mark of their own."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))


def changed(rows: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose digest is not stored under their key: all that must be written again."""
    return rows.join(stored.select(key, digest), [key, digest], "left_anti")


def same_plan(left: str, right: str, names: list[str]) -> Column:
    """Whether two aliased rows agree in all names, nulls included."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


def file_inputs(spark: SparkSession, root: str, with_sha1: bool = True) -> DataFrame:
    """``path``, ``name``, ``size``, ``mtime`` and ``sha1`` of every file below a folder.

    Files are read whole, one to a row, so a digest is for files that fit into a
    row (2 GB); without ``with_sha1`` contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    digest = F.sha1("content") if with_sha1 else F.lit(None).cast("string")
    mtime = F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), mtime.alias("mtime"), digest.alias("sha1"))


def selection_key(clips: Column, config: Column, source: Column) -> Column:
    """Key of a cached selection: the hash of its clips' identities, configuration and source as JSON."""
    whole = F.to_json(F.struct(clips.alias("clips"), config.alias("config_hash"), source.alias("selection_source")), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(whole, 256))
