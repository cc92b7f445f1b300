"""A store of metric documents: written only where something changed, read with a status and a reason.

The folder holds the series as Parquet, by the digest of their document, and
numbered manifests with one JSON document for each key. A manifest is
complete or absent: Spark's job commit publishes it, and readers take the latest
complete one. Series of documents that did not change are not written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions import variants as V
from seriesloom.operators.cache import VERSION, identity_reason, verdict
from seriesloom.operators.ordering import cut

#: Fields of a clip's identity, in the order of a document.
CLIP = ("role", "path", "name", "size", "mtime", "sha1")
_MANIFEST = "key string, digest string, document string, selections string"


def _versions(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the complete manifests, ascending; a store that is not there has none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        path = status.getPath()
        if path.getName().startswith("v") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            found.append(int(path.getName()[1:]))
    return sorted(found)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """``key``, ``digest``, ``document`` and ``selections`` of the latest manifest; no rows if there is none."""
    known = _versions(spark, store)
    return spark.read.schema(_MANIFEST).parquet(f"{store}/manifest/v{known[-1]}") if known else spark.createDataFrame([], _MANIFEST)


def read_series(spark: SparkSession, store: str) -> DataFrame:
    """``key``, ``frame``, ``brightness``, ``motion`` of all documents of the latest manifest."""
    if not _versions(spark, store):
        return spark.createDataFrame([], "key string, frame long, brightness double, motion double")
    rows = spark.read.schema("key string, frame long, brightness double, motion double, digest string, part string").parquet(f"{store}/series").drop("part")
    return rows.join(manifest(spark, store).select("key", "digest"), ["key", "digest"], "left_semi").drop("digest")


def documents(headers: DataFrame, series: DataFrame) -> DataFrame:
    """``key``, ``digest`` and ``document`` of headers and their series.

    ``headers`` has ``key``, ``config_hash``, ``files``, ``analyzed_file``,
    ``release_group``, ``trim_start``, ``trim_end``, ``fps`` (a pair) and
    ``clips`` (a list of identities). The digest covers the header and all
    values, whatever their order: counts and sums of hashes, aggregated.
    """
    mark = F.xxhash64("frame", "brightness", "motion")
    values = series.groupBy("key").agg(F.count("brightness").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("sum"), F.bit_xor(mark).alias("xor"))
    head = F.to_json(
        F.struct(
            F.lit(VERSION).alias("version"), "config_hash", "files", "analyzed_file", "release_group", "trim_start", "trim_end", "fps",
            F.coalesce("n", F.lit(0)).alias("frames"), F.struct(F.col("clips"), F.col("analyzed_file")).alias("inputs"),
        ),
        {"ignoreNullFields": "false"},
    )
    made = headers.join(values, "key", "left").withColumn("document", head)
    digest = F.sha1(F.concat_ws("|", "document", F.coalesce(F.col("sum").cast("string"), F.lit("-")), F.coalesce(F.col("xor").cast("string"), F.lit("-"))))
    return made.select("key", digest.alias("digest"), "document")


def upsert(store: str, headers: DataFrame, series: DataFrame, selections: DataFrame | None = None) -> DataFrame:
    """Write what changed and publish it; ``key`` and whether it was written.

    ``selections`` may give ``key`` and a JSON list ``selections``, which counts
    as part of the document. Documents of other keys stay as they are. If nothing
    changed, no manifest is written. One writer at a time.
    """
    spark = headers.sparkSession
    made = documents(headers, series)
    none = F.lit(None).cast("string")
    made = made.join(selections.select("key", "selections"), "key", "left") if selections is not None else made.withColumn("selections", none)
    made = cut(made.withColumn("digest", F.sha1(F.concat_ws("|", "digest", F.coalesce("selections", F.lit("-"))))))
    old = manifest(spark, store)
    changed = cut(made.join(old.select("key", "digest"), ["key", "digest"], "left_anti"))
    if not changed.isEmpty():
        fresh = series.join(changed.select("key", "digest"), "key").select("key", F.col("frame").cast("long"), "brightness", "motion", "digest")
        # rows of one document lie in any number of files: a document may be of any length
        fresh.withColumn("part", F.substring("digest", 1, 2)).write.mode("append").partitionBy("part").parquet(f"{store}/series")
        kept = old.join(changed.select("key"), "key", "left_anti").select("key", "digest", "document", "selections")
        number = (_versions(spark, store) or [0])[-1] + 1
        kept.unionByName(changed.select("key", "digest", "document", "selections")).write.parquet(f"{store}/manifest/v{number}")
    return made.select("key").join(changed.select("key", F.lit(True).alias("w")), "key", "left").select("key", F.coalesce("w", F.lit(False)).alias("wrote"))


def _identity(entry: Column) -> Column:
    """A clip's identity of a document; null if it lacks its path or name."""
    path, name = (F.when(V.kind_of(V.part(entry, f"$.{c}")) == "STRING", V.part(entry, f"$.{c}", "string")) for c in ("path", "name"))
    rest = {
        "role": F.coalesce(V.text_of(V.part(entry, "$.role")), F.lit("")),
        "path": path,
        "name": name,
        "size": V.integer_of(V.part(entry, "$.size")),
        "mtime": V.text_of(V.part(entry, "$.mtime")),
        "sha1": V.text_of(V.part(entry, "$.sha1")),
    }
    return F.when(path.isNotNull() & name.isNotNull(), F.struct(*[rest[c].alias(c) for c in CLIP]))


def probe(stored: DataFrame, asked: DataFrame, with_sha1: bool = False) -> DataFrame:
    """``key``, ``status`` and ``reason`` of every document that is asked for.

    ``stored`` is a manifest, ``asked`` has the columns of ``headers`` that the
    document must agree with. Checks go in order, the first that fails names the
    reason; a document that passes all is reused. A clip identity counts as in
    ``identity_reason``.
    """
    doc = F.col("_v")
    text = lambda path: F.when(V.kind_of(V.part(doc, path)) == "STRING", V.part(doc, path, "string"))
    number = lambda path: F.when(V.kind_of(V.part(doc, path)) == "BIGINT", V.part(doc, path, "long"))
    rows = asked.join(stored.select("key", "document"), "key", "left").withColumn("_v", F.try_parse_json("document"))
    entries = V.part(doc, "$.inputs.clips", "array<variant>")
    observed = F.transform(entries, _identity)
    rows = cut(rows.withColumn("_seen", observed).withColumn("_listed", V.kind_of(V.part(doc, "$.inputs.clips")) == "ARRAY"))
    exploded = lambda column: rows.where("_listed").select("key", F.posexplode(column).alias("pos", "_c")).select("key", "pos", *[F.col(f"_c.{c}").alias(c) for c in CLIP])
    mismatch = identity_reason(exploded("clips"), exploded("_seen"), "key", with_sha1).select("key", F.col("reason").alias("_clips_reason"))
    both = rows.join(mismatch, "key", "left")
    fps = V.part(doc, "$.fps", "array<variant>")
    pair = F.transform(fps, V.integer_of)
    checks = [
        (F.col("document").isNull(), "missing", "not_found"),
        (doc.isNull(), "error", "invalid_json"),
        (V.kind_of(doc) != "OBJECT", "error", "invalid_payload"),
        (~number("$.version").eqNullSafe(F.lit(VERSION)), "stale", "version_mismatch"),
        (~F.coalesce(F.col("_listed"), F.lit(False)), "stale", "inputs_missing"),
        (F.exists("_seen", lambda c: c.isNull()), "stale", "inputs_invalid"),
        *[(F.col("_clips_reason") == r, "stale", r) for r in (f"inputs_{k}_mismatch" for k in ("count", "path", "name", "role", "size", "mtime", "sha1"))],
        (~text("$.config_hash").eqNullSafe(F.col("config_hash")), "stale", "config_mismatch"),
        (~text("$.analyzed_file").eqNullSafe(F.col("analyzed_file")), "stale", "analyzed_mismatch"),
        (F.lower(F.coalesce(text("$.release_group"), F.lit(""))) != F.lower(F.coalesce("release_group", F.lit(""))), "stale", "release_group_mismatch"),
        (~number("$.trim_start").eqNullSafe(F.col("trim_start")), "stale", "trim_start_mismatch"),
        (~number("$.trim_end").eqNullSafe(F.col("trim_end")), "stale", "trim_end_mismatch"),
        (F.exists(pair, lambda x: x.isNull()), "stale", "fps_invalid"),
        (~pair.eqNullSafe(F.col("fps")), "stale", "fps_mismatch"),
        (number("$.frames").isNull(), "error", "metric_type_error"),
        (number("$.frames") == 0, "stale", "empty_metrics"),
    ]
    status, reason = verdict(checks)
    return both.select("key", status.alias("status"), reason.alias("reason"))
