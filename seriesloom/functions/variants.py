"""Values of JSON documents as VARIANT: tolerant coercion, and per-frame levels found in several layouts."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import normal_title, pq_to_nits

#: Objects that may hold a frame's levels, tried in this order after the frame's own (fixed names of the document format).
LAYERS = ("cmv29_metadata", "cmv40_metadata")
LEVELS = ("Level1", "Level2", "Level5", "Level6")


def part(value: Column, path: str, kind: str = "variant") -> Column:
    """What lies at a path, null if nothing does or it is of another kind."""
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column) -> Column:
    """Kind of a value: VOID for a JSON null, null for none."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def is_number(value: Column) -> Column:
    """Whether a value is a number; truth values and texts are none."""
    return F.coalesce(kind_of(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit(False))


def members_of(value: Column) -> Column:
    """Members of an object by name, null if the value is none; only the object itself is looked at, not what it holds."""
    return part(value, "$", "map<string,variant>")


def filled(value: Column) -> Column:
    """The value if it is an object that holds anything, else null."""
    return F.when(F.size(members_of(value)) > 0, value)


def number_of(value: Column) -> Column:
    """A finite number, or a text that spells one; anything else is null."""
    got = F.when(is_number(value), part(value, "$", "double")).when(kind_of(value) == "STRING", F.trim(part(value, "$", "string")).try_cast("double"))
    return F.when(~F.isnan(got) & (F.abs(got) < float("inf")), got)


def integer_of(value: Column) -> Column:
    """A whole number: numbers lose their fraction, texts must spell a whole one; anything else is null."""
    number = F.when(is_number(value), part(value, "$", "double"))
    whole = F.when(~F.isnan(number) & (F.abs(number) < 2.0**63), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    text = F.trim(part(value, "$", "string"))
    spelled = F.when((kind_of(value) == "STRING") & text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    exact = F.when(kind_of(value) == "BIGINT", part(value, "$", "long"))
    return F.coalesce(exact, whole.cast("long"), spelled)


def seconds_of(value: Column, label: str) -> Column:
    """Seconds as a number or a text that spells one; an error that names the setting for anything else."""
    got = number_of(value)
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(F.lit(f"{label} must be numeric")).cast("double"))


def text_of(value: Column) -> Column:
    """A trimmed text that is not empty, or a number as text; anything else is null."""
    return F.when(kind_of(value) == "STRING", F.nullif(F.trim(part(value, "$", "string")), F.lit(""))).when(is_number(value), F.to_json(value))


def frames_of(document: Column) -> Column:
    """The objects of a document that is a list or holds one as ``frames``, in order; other entries are left out."""
    listed = F.coalesce(part(document, "$", "array<variant>"), part(document, "$.frames", "array<variant>"))
    return F.filter(listed, lambda f: members_of(f).isNotNull())


def _last_of(blocks: Column, k: int) -> Column:
    """The k-th level of the last block that has it and none before it."""

    def holds(block: Column) -> Column:
        out = block[LEVELS[k]].isNotNull()
        for earlier in LEVELS[:k]:
            out = out & block[earlier].isNull()
        return out

    return F.try_element_at(F.filter(blocks, holds), F.lit(-1))[LEVELS[k]]


def with_levels(rows: DataFrame, frame: str) -> DataFrame:
    """Rows with the object of each level of a frame, ``_Level1`` and so on.

    The frame's own data come before those of its nested record. The first level
    may stand in the data, else in a layer; a block of a later layer or place
    replaces what was found before. A block counts for its first level alone.
    What is used more than once is a column of its own, so it is read once.
    """
    spread = lambda block: F.struct(*[part(block, f"$.{name}").alias(name) for name in LEVELS])
    f, data, first = F.col(frame), F.col("_data"), F.col("_Level1")
    rows = rows.withColumn("_own", part(f, "$.vdr_dm_data"))
    rows = rows.withColumn("_data", F.coalesce(filled(F.col("_own")), part(f, "$.rpu.vdr_dm_data")))
    rows = rows.withColumns({f"_blocks{i}": F.transform(part(data, f"$.{layer}.ext_metadata_blocks", "array<variant>"), spread) for i, layer in enumerate(LAYERS)})
    rows = rows.withColumn("_Level1", part(data, "$.level1"))
    for i, layer in enumerate(LAYERS):
        rows = rows.withColumn("_Level1", F.coalesce(_last_of(F.col(f"_blocks{i}"), 0), filled(first), part(data, f"$.{layer}.level1")))
    places = [F.col(f"_blocks{i}") for i in reversed(range(len(LAYERS)))]
    return rows.withColumns({f"_{name}": F.coalesce(*[_last_of(b, k) for b in places]) for k, name in enumerate(LEVELS) if k})


def frame_levels(documents: DataFrame, document: str, keys: list[str]) -> DataFrame:
    """``keys``, ``frame`` and the values of each frame's levels; a frame without any keeps its row.

    ``document`` is a VARIANT column. Light in code values becomes nits.
    """
    # the outer form, as Spark would read each document again for a filter on lists that are not empty
    rows = documents.select(*keys, F.posexplode_outer(frames_of(F.col(document))).alias("frame", "_f")).where("frame is not null")
    rows = with_levels(rows, "_f")
    light = {"l1_min_nits": ("_Level1", "min_pq"), "l1_max_nits": ("_Level1", "max_pq"), "l1_avg_nits": ("_Level1", "avg_pq"), "l2_target_nits": ("_Level2", "target_max_pq")}
    rows = rows.withColumns({f"_v_{name}": part(F.col(level), f"$.{key}") for name, (level, key) in light.items()})
    rows = rows.withColumns({f"_n_{name}": F.when(is_number(F.col(f"_v_{name}")), part(F.col(f"_v_{name}"), "$", "double")) for name in light})
    plain = lambda level, key: part(F.col(level), f"$.{key}", "long")
    return rows.select(
        *keys,
        F.col("frame").cast("long").alias("frame"),
        *[pq_to_nits(F.col(f"_n_{name}")).alias(name) for name in light],
        *[plain("_Level5", f"active_area_{side}_offset").alias(f"l5_{side}") for side in ("left", "right", "top", "bottom")],
        plain("_Level6", "max_content_light_level").alias("l6_max_cll"),
        plain("_Level6", "max_frame_average_light_level").alias("l6_max_fall"),
    )


def compatible(text: Column) -> Column:
    """Text in Unicode form NFKC; only texts that are not plain ASCII are sent to Python, as Arrow batches."""

    @F.arrow_udf("string")
    def fold(batch: pa.Array) -> pa.Array:
        coded = batch.dictionary_encode()
        return pa.array([unicodedata.normalize("NFKC", t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return F.coalesce(fold(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def folded_title(title: Column) -> Column:
    """``normal_title`` after compatibility folding, so that wide and ligated letters count as plain ones."""
    return normal_title(compatible(title))
