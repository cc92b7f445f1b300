"""Frame properties: typed values out of maps and JSON, HDR signals, text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import sent_if_small

# Codes of matrix, primaries, transfer and range, and the names they go by (ITU-T H.273).
MATRIX = {"rgb": 0, "bt709": 1, "bt.709": 1, "709": 1, "bt470bg": 5, "470bg": 5, "smpte170m": 6, "170m": 6, "bt601": 6, "601": 6, "bt2020": 9, "bt.2020": 9, "2020": 9, "2020ncl": 9}
PRIMARIES = {"bt709": 1, "bt.709": 1, "709": 1, "bt470bg": 5, "470bg": 5, "smpte170m": 6, "170m": 6, "bt601": 6, "601": 6, "bt2020": 9, "bt.2020": 9, "2020": 9}
TRANSFER = {"bt709": 1, "709": 1, "bt1886": 1, "gamma2.2": 1, "st2084": 16, "smpte2084": 16, "pq": 16, "hlg": 18, "arib-b67": 18, "smpte170m": 6, "170m": 6, "bt601": 6, "601": 6}
RANGE = {"limited": 1, "tv": 1, "full": 0, "pc": 0, "jpeg": 0}
#: Transfers and primaries that mean HDR.
HDR_TRANSFER, HDR_PRIMARIES = (16, 18), (9,)


def code(value: Column, names: dict[str, int]) -> Column:
    """A code given as number or name."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    text = F.lower(F.trim(value))
    return F.coalesce(F.try_element_at(table, text), text.try_cast("int"))


def color_codes(props: Column) -> dict[str, Column]:
    """Matrix, primaries, transfer and range of a property map; 2, which means unspecified, is null."""
    get = lambda k, n: F.nullif(code(F.try_element_at(props, F.lit(k)), n), F.lit(2))
    return {"matrix": get("_Matrix", MATRIX), "primaries": get("_Primaries", PRIMARIES), "transfer": get("_Transfer", TRANSFER), "color_range": get("_ColorRange", RANGE)}


def color_overrides(files: DataFrame, row_id: str, file: str, overrides: DataFrame) -> DataFrame:
    """``row_id`` and the codes that the first fitting entry sets: that of the file, of its name, or of ``*``.

    ``overrides`` has ``key`` and texts or numbers ``matrix``, ``primaries``,
    ``transfer`` and ``range``; empty ones, and names that mean no code, are null.
    Keys count as they are written. Files without an entry have no row.
    """
    keys = F.array(F.col(file), F.regexp_extract(file, r"([^/]*)$", 1), F.lit("*"))
    asked = files.select(row_id, F.posexplode(keys).alias("_p", "key")).where("key <> ''")
    found = asked.join(sent_if_small(overrides), "key")
    first = found.groupBy(row_id).agg(F.min_by(F.struct("matrix", "primaries", "transfer", "range"), "_p").alias("o"))
    tables = {"matrix": MATRIX, "primaries": PRIMARIES, "transfer": TRANSFER, "range": RANGE}
    return first.select(row_id, *[code(F.col(f"o.{c}").cast("string"), names).alias(c) for c, names in tables.items()])


def signals_hdr(props: Column) -> Column:
    """Whether primaries, transfer or a mastering key say HDR."""
    codes = color_codes(props)
    mastering = F.exists(F.map_keys(props), lambda k: F.lower(k).contains("mastering") | F.lower(k).contains("contentlight"))
    return F.coalesce(codes["transfer"].isin(*HDR_TRANSFER), F.lit(False)) | F.coalesce(codes["primaries"].isin(*HDR_PRIMARIES), F.lit(False)) | mastering


def source_space(transfer: Column, primaries: Column) -> Column:
    """Number of the tone mapper's source space of HDR material: 1 for PQ, 2 for HLG, in wide primaries; else null."""
    return F.when((transfer == 16) & (primaries == 9), 1).when((transfer == 18) & (primaries == 9), 2)


def default_color(height: Column, matrix: Column) -> Column:
    """Matrix of SD or HD material where none is given."""
    return F.coalesce(matrix, F.when(height <= 576, 6).otherwise(1))


def luminance_values(text: Column) -> Column:
    """All numbers in a text, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


# Property keys of mastering luminance, in the order they are asked.
LOW_KEYS = ("_MasteringDisplayMinLumi", "_MasteringDisplayMinLuminance", "MasteringDisplayMinLumi", "MasteringDisplayMinLuminance", "MasteringDisplayMinimumLuminance")
HIGH_KEYS = ("_MasteringDisplayMaxLumi", "_MasteringDisplayMaxLuminance", "MasteringDisplayMaxLumi", "MasteringDisplayMaxLuminance", "MasteringDisplayMaximumLuminance")
BOTH_KEYS = ("_MasteringDisplayLuminance", "MasteringDisplayLuminance")


def mastering_luminance(props: Column) -> tuple[Column, Column]:
    """Least and largest mastering luminance: from keys of their own, else from the first that holds two numbers or more."""
    numbers = lambda k: luminance_values(F.coalesce(F.try_element_at(props, F.lit(k)), F.lit("")))
    first = lambda keys: F.coalesce(*[F.get(numbers(k), 0) for k in keys])
    both = F.coalesce(*[F.when(F.size(numbers(k)) >= 2, numbers(k)) for k in BOTH_KEYS])
    return F.coalesce(first(LOW_KEYS), F.array_min(both)), F.coalesce(first(HIGH_KEYS), F.array_max(both))


def keys_like(props: Column, mark: str) -> Column:
    """Sorted keys that hold a text, in any case."""
    return F.array_sort(F.filter(F.map_keys(props), lambda k: F.lower(k).contains(mark.lower())))


def metric_entry(score: Column, nits: float) -> Column:
    """Score, cut to 0 to 1, in nits; null for null and NaN."""
    return F.when(score.isNotNull() & ~F.isnan(score), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * nits)


def nits_label(value: Column) -> Column:
    """Nits without digits if whole to a thousandth, else with one; decimal ties go to even."""
    text = F.when(F.abs(value - F.rint(value)) < 1e-3, F.format_string("%.0f", F.rint(value))).otherwise(F.format_string("%.1f", F.bround(value, 1)))
    return F.when(value.isNotNull(), text)


def luminance_text(value: Column) -> Column:
    """Up to four digits without trailing zeros below 1, else one digit; decimal ties go to even."""
    small = F.regexp_replace(F.format_string("%.4f", F.bround(value, 4)), r"\.?0+$", "")
    return F.when(value < 1, small).when(value >= 1, F.format_string("%.1f", F.bround(value, 1)))


def _most_and_mean(start: str, most: Column, mean: Column) -> Column:
    kind = F.when(most.isNotNull() & mean.isNotNull(), "MAX/AVG").when(most.isNotNull(), "MAX").otherwise("AVG")
    nits = lambda c: F.concat(nits_label(c), F.lit("nits"))
    return F.when(most.isNotNull() | mean.isNotNull(), F.concat(F.lit(start), kind, F.lit(": "), F.concat_ws(" / ", nits(most), nits(mean))))


def _parts_line(start: str, joiner: str, *parts: Column) -> Column:
    line = F.concat_ws(joiner, *parts)
    return F.when(line != "", F.concat(F.lit(start), line))


def measurement_line(avg: Column, most: Column, category: Column) -> Column:
    """Line about a frame's brightness; null without values."""
    kind = F.coalesce(F.concat(F.lit(" ("), F.nullif(F.trim(category), F.lit("")), F.lit(")")), F.lit(""))
    return F.concat(_most_and_mean("Measurement ", most, avg), kind)


def mastering_line(props: Column) -> Column:
    """Line about the mastering display."""
    low, high = mastering_luminance(props)
    line = F.concat(F.lit("MDL: min: "), luminance_text(low), F.lit(" cd/m², max: "), luminance_text(high), F.lit(" cd/m²"))
    return F.coalesce(line, F.lit("MDL: Insufficient data"))


# Keys of the raw dynamic metadata block, and what other keys of dynamic metadata contain.
RPU_KEYS = ("DolbyVisionRPU", "_DolbyVisionRPU", "DolbyVisionRPU_b", "_DolbyVisionRPU_b")
DYNAMIC_MARKS = ("dolby", "dovi", "rpu", "l1")
#: Whole numbers among the fields of dynamic metadata, and other numbers.
WHOLE_FIELDS = ("block_index", "block_total", "l5_left", "l5_right", "l5_top", "l5_bottom")
OTHER_FIELDS = ("target_nits", "l1_average", "l1_maximum", "l2_target_nits", "l6_max_cll", "l6_max_fall")


def _dynamic_field(key: Column) -> Column:
    """Field that a key in lower case belongs to, or null."""
    has = key.contains
    some = lambda *marks: key.rlike("|".join(marks))
    side = F.when(has("left"), "left").when(has("right"), "right").when(has("top"), "top").when(has("bottom"), "bottom")
    return (
        F.when(has("block") & has("index"), "block_index")
        .when(has("block") & some("total", "count"), "block_total")
        .when(has("target") & some("nit", "pq", "brightness"), "target_nits")
        .when(has("l1") & some("avg", "average", "mean"), "l1_average")
        .when(has("l1") & has("max"), "l1_maximum")
        .when(has("l2") & has("target"), "l2_target_nits")
        .when(has("l5"), F.concat(F.lit("l5_"), side))
        .when(has("l6") & has("cll"), "l6_max_cll")
        .when(has("l6") & has("fall"), "l6_max_fall")
    )


def dynamic_metadata(props: Column) -> Column:
    """Struct of the dynamic metadata in a property map, in the order of its keys.

    The first number of a field holds, but the last of the active area's sides
    (those below 0 are passed over) and of level 6.
    """
    raw = lambda k: k.isin(*RPU_KEYS)
    spelled = F.transform(F.map_entries(props), lambda e: F.struct(e["key"].alias("raw"), F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    marked = F.filter(spelled, lambda e: ~raw(e["raw"]) & e["key"].rlike("|".join(DYNAMIC_MARKS)))
    read = F.transform(marked, lambda e: F.struct(_dynamic_field(e["key"]).alias("field"), _number(e["value"], "double").alias("value")))

    def fields(known: Column) -> Column:
        def value(f: str) -> Column:
            if f.startswith("l5_"):
                return F.try_element_at(F.filter(known, lambda e: (e["field"] == f) & (F.rint(e["value"]) >= 0)), F.lit(-1))["value"]
            if f.startswith("l6_"):
                return F.try_element_at(F.filter(known, lambda e: e["field"] == f), F.lit(-1))["value"]
            return F.get(F.filter(known, lambda e: (e["field"] == f) & e["value"].isNotNull()), 0)["value"]

        present = F.when(F.exists(F.map_keys(props), raw), True).alias("rpu_present")
        return F.struct(present, *[F.rint(value(f)).try_cast("long").alias(f) for f in WHOLE_FIELDS], *[value(f).alias(f) for f in OTHER_FIELDS])

    # a list of one, so that all fields share one reading of the map
    return F.get(F.transform(F.array(F.filter(read, lambda e: e["field"].isNotNull())), fields), 0)


def static_metadata(props: Column) -> Column:
    """Struct of mastering luminance and of the first numbers for the brightest pixel and frame."""
    low, high = mastering_luminance(props)
    read = F.transform(F.map_entries(props), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.trim(e["value"]).try_cast("double").alias("value")))
    first = lambda f: F.get(F.filter(read, lambda e: f(e["key"]) & e["value"].isNotNull()), 0)["value"]
    cll = first(lambda k: k.contains("cll") | (k.contains("contentlightlevel") & k.contains("max")))
    return F.struct(low.alias("min_luminance"), high.alias("max_luminance"), cll.alias("max_cll"), first(lambda k: k.contains("fall")).alias("max_fall"))


def range_name(props: Column) -> Column:
    """``full`` or ``limited`` by the first range key with code 0 or 1, or null."""
    keys = F.filter(F.map_entries(props), lambda e: F.lower(F.trim(e["key"])).isin("_colorrange", "colorrange") & F.trim(e["value"]).rlike(r"^[+-]?0*[01]$") & (F.trim(e["value"]).try_cast("int") >= 0))
    first = F.get(keys, 0)["value"].try_cast("int")
    return F.when(first == 0, "full").when(first == 1, "limited")


def range_line(name: Column) -> Column:
    return F.concat(F.lit("Range: "), F.initcap(F.nullif(F.trim(name), F.lit(""))))


def dynamic_line(label: Column, fields: Column) -> Column:
    """Line about the blocks and targets of dynamic metadata; null if there is nothing to say."""
    label = F.nullif(label, F.lit(""))
    known = F.coalesce(*[fields[f].cast("double") for f in ("block_index", "block_total", "target_nits", "l1_average", "l1_maximum")]).isNotNull()
    index, total = F.when(fields["block_index"] >= 0, fields["block_index"]), F.when(fields["block_total"] > 0, fields["block_total"])
    blocks = F.when(index.isNotNull() & total.isNotNull(), F.format_string("L2 %d/%d", index, total)).when(index.isNotNull(), F.format_string("L2 block %d", index)).when(total.isNotNull(), F.format_string("L2 blocks=%d", total))
    return _parts_line(
        "", " ",
        F.concat(F.lit("DoVi: "), label),
        F.when(fields["l2_target_nits"] != 0, F.concat(F.lit("(Target: "), nits_label(fields["l2_target_nits"]), F.lit("nits)"))),
        blocks,
        F.concat(F.lit("target "), nits_label(fields["target_nits"]), F.lit(" nits")),
        F.when(~known & label.isNotNull() & fields["rpu_present"].isNull(), "(no DV metadata)"),
    )


def level1_line(fields: Column) -> Column:
    return _most_and_mean("DV RPU Level 1 ", fields["l1_maximum"], fields["l1_average"])


def level5_line(fields: Column) -> Column:
    """Line about the active area; null if all its sides are 0 or unknown."""
    sides = [(mark, fields[f"l5_{side}"]) for mark, side in (("L:", "left"), ("R:", "right"), ("T:", "top"), ("B:", "bottom"))]
    line = _parts_line("DV L5 Active Area: ", " ", *[F.concat(F.lit(mark), c.cast("string")) for mark, c in sides])
    return F.when(F.exists(F.array(*[c for _, c in sides]), lambda v: F.coalesce(v, F.lit(0)) != 0), line)


def _light_line(start: str, cll: Column, fall: Column) -> Column:
    return _parts_line(start, " / ", F.concat(F.lit("MaxCLL "), nits_label(cll)), F.concat(F.lit("MaxFALL "), nits_label(fall)))


def level6_line(fields: Column) -> Column:
    return _light_line("DV L6 Metadata: ", fields["l6_max_cll"], fields["l6_max_fall"])


def hdr_line(fields: Column) -> Column:
    return _light_line("HDR: ", fields["max_cll"], fields["max_fall"])


def range_from_signal(low: Column, high: Column, color_range: Column, inferred: Column, overridden: Column) -> Column:
    """Range code corrected by sampled luma on the 8-bit scale: doubtful ones that look limited are, as are those without samples."""
    doubtful = F.coalesce(color_range, F.lit(0)) == 0
    unknown = (low.isNull() | high.isNull()) & (inferred | (~overridden & doubtful))
    looks = (inferred | doubtful) & low.between(12, 20) & (high <= 245)
    return F.when(unknown | F.coalesce(looks, F.lit(False)), 1).otherwise(color_range)


def normal_color(props: Column, overrides: Column, height: Column, yuv: Column, low: Column, high: Column) -> Column:
    """Struct of matrix, transfer, primaries and range codes that a clip is treated as.

    Overrides go before properties, then defaults by height for YUV material
    without HDR signs, then what the samples say of the range, then wide HDR.
    """
    own = color_codes(props)
    given = {k: code(F.try_element_at(overrides, F.lit(o)), n) for k, o, n in (("matrix", "matrix", MATRIX), ("transfer", "transfer", TRANSFER), ("primaries", "primaries", PRIMARIES), ("color_range", "range", RANGE))}
    now = {k: F.coalesce(given[k], own[k]) for k in own}
    marked = F.exists(F.map_keys(props), lambda k: F.lower(k).contains("mastering") | F.lower(k).contains("contentlight"))
    hdr = F.coalesce(now["transfer"].isin(*HDR_TRANSFER), F.lit(False)) | F.coalesce(now["primaries"].isin(*HDR_PRIMARIES), F.lit(False)) | marked
    usual = F.when(F.coalesce(height <= 576, F.lit(False)), 6).otherwise(1)
    wide = {"matrix": 9, "transfer": 16, "primaries": 9}
    out = {k: F.coalesce(now[k], F.when(hdr, v).when(yuv, usual)) for k, v in wide.items()}
    overridden = given["color_range"].isNotNull()
    guessed = F.coalesce(now["color_range"], F.when(~hdr & yuv, 1))
    out["color_range"] = range_from_signal(low, high, guessed, now["color_range"].isNull() & ~overridden, overridden)
    return F.struct(*[c.cast("int").alias(k) for k, c in out.items()])


def _number(text: Column, kind: str) -> Column:
    """A text as a number, or null; ``try_cast`` alone would throw and catch an exception for each text without any sign of one."""
    signs = r"[0-9]" if kind == "long" else r"[0-9]|(?i:nan|inf)"
    return F.when(text.rlike(signs), F.trim(text).try_cast(kind))


STREAMS = "struct<streams:array<struct<index:string,codec_name:string,channels:string,channel_layout:string,sample_rate:string,bit_rate:string,tags:map<string,string>,disposition:map<string,string>>>>"


def audio_streams(documents: DataFrame, by: str, document: str) -> DataFrame:
    """A typed row for each audio stream that a probe's JSON text lists under an index of 0 or more; damaged texts give none."""
    s = F.col("_s")
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    whole = lambda c: F.coalesce(_number(c, "long"), F.lit(0))
    mark = lambda m, k: F.try_element_at(m, F.lit(k))
    # the outer form, as Spark would read each text again for a filter on lists that are not empty
    rows = documents.select(by, F.explode_outer(F.from_json(document, STREAMS)["streams"]).alias("_s")).where(_number(s["index"], "long") >= 0)
    return rows.select(
        by, whole(s["index"]).alias("index"), text(mark(s["tags"], "language")).alias("language"), text(s["codec_name"]).alias("codec_name"), whole(s["channels"]).alias("channels"),
        text(s["channel_layout"]).alias("channel_layout"), whole(s["sample_rate"]).alias("sample_rate"), whole(s["bit_rate"]).alias("bitrate"),
        (whole(mark(s["disposition"], "default")) != 0).alias("is_default"), (whole(mark(s["disposition"], "forced")) != 0).alias("is_forced"),
    )


def json_number(props: Column, path: str) -> Column:
    """Number at a path of a JSON text; null if it is none."""
    return F.get_json_object(props, path).try_cast("double")


def offset_join(frames: DataFrame, records: DataFrame, trim: str = "trim") -> DataFrame:
    """Records of an export joined to frames at ``frame + trim``; frames without one stay unchanged."""
    keyed = records.select(F.col("clip"), F.col("idx").alias("_i"), F.col("record"))
    return frames.withColumn("_i", F.col("frame") + F.col(trim)).join(keyed, ["clip", "_i"], "left").drop("_i")
