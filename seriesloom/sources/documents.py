"""Sources and sinks: metric tables, JSON documents, media listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File suffixes of media, those of the reference.
SUFFIXES = tuple("mkv m2ts mp4 webm ogm mpg vob iso ts mts mov qv yuv flv avi rm rmvb m2v m4v mp2 mpeg mpe mpv wmv avc hevc 264 265 av1".split())

METRICS = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("config_hash", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
        T.StructField("analyzed_file", T.StringType()),
        T.StructField("release_group", T.StringType()),
        T.StructField("trim_start", T.IntegerType()),
        T.StructField("trim_end", T.IntegerType()),
        T.StructField("fps", T.ArrayType(T.IntegerType())),
        T.StructField("brightness", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("motion", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def write_metrics(series: DataFrame, path: str) -> None:
    """Metrics as Parquet, one folder for each clip, so that reading one clip prunes the rest."""
    series.repartition("clip").sortWithinPartitions("clip", "frame").write.mode("overwrite").partitionBy("clip").parquet(path)


def read_metrics(spark: SparkSession, path: str, clips: list[str] | None = None) -> DataFrame:
    """Metrics of all clips, or of the named ones."""
    df = spark.read.parquet(path)
    return df.where(F.col("clip").isin(clips)) if clips is not None else df


def read_metric_documents(spark: SparkSession, path: str) -> DataFrame:
    """Metric documents with ``status`` and ``reason``: whole files are parsed, damaged ones are told apart."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("file", F.col("_metadata.file_path"))
    doc = F.from_json("value", METRICS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = raw.select("file", doc.alias("doc"))
    status = F.when(F.col("doc._corrupt").isNotNull() | F.col("doc").isNull(), "error").when(F.col("doc.version").eqNullSafe(F.lit(2)), "ok").otherwise("stale")
    reason = F.when(status == "error", "invalid_json").when(status == "stale", "version_mismatch")
    return out.withColumn("status", status).withColumn("reason", reason)


def document_series(documents: DataFrame) -> DataFrame:
    """``file``, ``frame``, ``brightness``, ``motion`` of readable documents."""
    ok = documents.where("status = 'ok'")
    pairs = lambda c, n: ok.select("file", F.explode(f"doc.{c}").alias("p")).select("file", F.col("p")[0].cast("long").alias("frame"), F.col("p")[1].alias(n))
    return pairs("brightness", "brightness").join(pairs("motion", "motion"), ["file", "frame"], "full_outer")


def discover_media(spark: SparkSession, root: str) -> DataFrame:
    """Media files of a folder with size and time, in natural order of their names."""
    files = spark.read.format("binaryFile").load(root).select("path", "length", "modificationTime")
    named = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    return named.orderBy(natural_key(F.col("name")))


def natural_key(name):
    """Sort key in which runs of digits compare as numbers."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r))
