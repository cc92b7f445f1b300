"""A training-data pipeline over ``documents``: filter, deduplicate, mix and pack.

Each stage works on what the one before it kept, written as Parquet and read
again. All but the last return the columns of ``documents``; the last returns
the pieces of the packed sequences. In every stage null texts count as empty and
empty tables give empty results; repeated rows stay as far as exact dedup does
not drop them, and columns of any name are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import queries
from seriesloom.llm.common import Scratch, Stored, free_prefix, remove, scratch_path
from seriesloom.llm.exact_dedup import exact_dedup
from seriesloom.llm.jaccard_join import similar_components
from seriesloom.llm.mixing import WEIGHTS, mix_documents
from seriesloom.llm.packing import harmonic_pack
from seriesloom.llm.quality import quality_model, quality_scores

#: The models are trained here, so SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    own = free_prefix(docs)
    model = quality_model(docs, _labels(spark, sf_dir))
    scored = quality_scores(docs, model, carry=tuple(docs.columns), prefix=own)
    return scored.where(f"{own}predicted = 1").select(*_columns(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts."""
    own = free_prefix(docs)
    return exact_dedup(docs, carry=tuple(docs.columns), prefix=own).where(f"{own}kept").select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that names its component; documents without words stay.

    Null identifiers stay as well: no other row can stand for them.
    """
    found = Stored(similar_components(docs), "similar").df
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    small = gone.count() <= 400_000
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say.

    The poor domain has no target: its documents went in the first stage, and no
    rates could bring its share up but by repeating the clean ones most like it.
    """
    weights = {d: w for d, w in WEIGHTS.items() if d != "poor"}
    own = free_prefix(docs)
    rated = mix_documents(docs, _labels(spark, sf_dir), weights, carry=tuple(docs.columns), prefix=own)
    often = rated.where(f"{own}copies > 0")
    return often.withColumn(f"{own}c", F.explode(F.sequence(F.lit(1), F.col(f"{own}copies")))).select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return harmonic_pack(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over ``documents``.

    A stage's working tables, and what the stage before it kept, go as soon as
    its own result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with Scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
