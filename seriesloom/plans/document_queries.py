"""Queries over documents: levels in JSON, tolerant values, details of selections, the metric store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesloom.functions import variants as V
from seriesloom.operators import details, selection
from seriesloom.operators.ordering import cut, shared_folder
from seriesloom.sources import metric_store

from .queries import _SELECT, CATEGORIES, FPS, candidates_of, frames_of, query, r9, table

# --- JSON -------------------------------------------------------------------

#: Layouts of a frame around the number of an event's properties; the document's two frames follow each other.
_LAYOUTS = (
    """{"vdr_dm_data": {"level1": {"min_pq": 0, "max_pq": #, "avg_pq": "#"}}}""",
    """{"vdr_dm_data": {}, "rpu": {"vdr_dm_data": {"cmv29_metadata": {"level1": {"max_pq": #}}}}}""",
    """{"vdr_dm_data": {"level1": {}, "cmv29_metadata": {"ext_metadata_blocks": [{"Level1": {"max_pq": 1}, "Level2": {"target_max_pq": 9}}, {"Level2": {"target_max_pq": #}}, {"Level1": {"max_pq": #}}]}}}""",
    """{"rpu": {"vdr_dm_data": {"cmv40_metadata": {"ext_metadata_blocks": [{"Level5": {"active_area_left_offset": #, "active_area_top_offset": 4}}, {"Level6": {"max_content_light_level": #}}]}}}}""",
    """{"other": #}""",
    """{"vdr_dm_data": {"cmv29_metadata": {"level1": {"max_pq": #}}, "cmv40_metadata": {"level1": {"max_pq": 7}, "ext_metadata_blocks": [5, {"Level6": {"max_frame_average_light_level": #}}]}}}""",
)
_KEY = "regexp_extract(props, '[0-9]+', 0)"


def layered(spark, d):
    """A document for each event: a list, or an object with ``frames``, of two layouts around its number."""
    number = F.regexp_extract("props", "[0-9]+", 0)
    at = lambda shift: F.replace(F.element_at(F.array(*[F.lit(x) for x in _LAYOUTS]), ((F.col("event_id") + shift) % len(_LAYOUTS) + 1).cast("int")), F.lit("#"), number)
    listed = F.concat(F.lit("["), at(0), F.lit(", 5, "), at(1), F.lit("]"))
    text = F.when(F.col("event_id") % 2 == 0, listed).otherwise(F.concat(F.lit('{"frames": '), listed, F.lit("}")))
    # a file of few row groups would be read, and its documents parsed, by few tasks
    spread = table(spark, d, "events").select("event_id", "props").repartition("event_id")
    return spread.select("event_id", F.try_parse_json(text).alias("doc"))


def _levels_sql() -> str:
    """The same paths by DuckDB's own JSON functions."""
    listed = "[" + ", ".join("'" + x + "'" for x in _LAYOUTS) + "]"
    at = lambda shift: f"replace({listed}[(event_id + {shift}) % {len(_LAYOUTS)} + 1], '#', {_KEY})"
    full = lambda x: f"CASE WHEN json_type({x}) = 'OBJECT' AND len(json_keys({x})) > 0 THEN {x} END"
    block = lambda layer, name, others: (
        f"list_filter(json_extract(data, '$.{layer}.ext_metadata_blocks[*]'), lambda b: json_extract(b, '$.{name}') IS NOT NULL" + "".join(f" AND json_extract(b, '$.{o}') IS NULL" for o in others) + f")[-1]->'$.{name}'"
    )
    nits = lambda x: (
        f"CASE WHEN json_type({x}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CASE WHEN ({x})::DOUBLE <= 0 THEN 0 ELSE round(pow(greatest(pow(pq({x}::DOUBLE), 1 / (2523.0::DOUBLE / 4096 * 128)) - 3424.0::DOUBLE / 4096, 0)"
        f" / (2413.0::DOUBLE / 4096 * 32 - 2392.0::DOUBLE / 4096 * 32 * pow(pq({x}::DOUBLE), 1 / (2523.0::DOUBLE / 4096 * 128))), 1 / (2610.0::DOUBLE / 4096 / 4)) * 10000, 6) END END"
    )
    scaled = lambda text: text.replace("pq(", "(SELECT CASE WHEN v > 1 THEN v / 4095 ELSE v END FROM (SELECT ").replace("::DOUBLE), 1 / (2523", "::DOUBLE AS v)), 1 / (2523")
    return f"""
        WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN l ELSE '{{"frames": ' || l || '}}' END::JSON AS doc FROM (SELECT event_id, '[' || {at(0)} || ', 5, ' || {at(1)} || ']' AS l FROM events)),
        r AS (SELECT event_id, list_filter(CASE WHEN json_type(doc) = 'ARRAY' THEN json_extract(doc, '$[*]') ELSE json_extract(doc, '$.frames[*]') END, lambda f: json_type(f) = 'OBJECT') AS fs FROM t),
        f AS (SELECT event_id, unnest(fs) AS f, unnest(range(len(fs))) AS frame FROM r),
        v AS (SELECT event_id, frame, coalesce({full("json_extract(f, '$.vdr_dm_data')")}, json_extract(f, '$.rpu.vdr_dm_data')) AS data FROM f),
        a AS (SELECT *, coalesce({block("cmv29_metadata", "Level1", ())}, {full("json_extract(data, '$.level1')")}, json_extract(data, '$.cmv29_metadata.level1')) AS l1a FROM v),
        x AS (SELECT *, coalesce({block("cmv40_metadata", "Level1", ())}, {full("l1a")}, json_extract(data, '$.cmv40_metadata.level1')) AS l1,
                     coalesce({block("cmv40_metadata", "Level2", ("Level1",))}, {block("cmv29_metadata", "Level2", ("Level1",))}) AS l2,
                     coalesce({block("cmv40_metadata", "Level5", ("Level1", "Level2"))}, {block("cmv29_metadata", "Level5", ("Level1", "Level2"))}) AS l5,
                     coalesce({block("cmv40_metadata", "Level6", ("Level1", "Level2", "Level5"))}, {block("cmv29_metadata", "Level6", ("Level1", "Level2", "Level5"))}) AS l6 FROM a)
        SELECT event_id, frame, {scaled(nits("(l1->'$.min_pq')"))} AS l1_min_nits, {scaled(nits("(l1->'$.max_pq')"))} AS l1_max_nits, {scaled(nits("(l1->'$.avg_pq')"))} AS l1_avg_nits,
               {scaled(nits("(l2->'$.target_max_pq')"))} AS l2_target_nits, (l5->'$.active_area_left_offset')::BIGINT AS l5_left, (l5->'$.active_area_top_offset')::BIGINT AS l5_top,
               (l6->'$.max_content_light_level')::BIGINT AS l6_max_cll, (l6->'$.max_frame_average_light_level')::BIGINT AS l6_max_fall FROM x"""


@query(_levels_sql())
def json_layers(spark, d):
    """Levels of every frame, wherever a layout keeps them."""
    got = V.frame_levels(layered(spark, d), "doc", ["event_id"])
    nits = [F.round(c, 6).alias(c) for c in ("l1_min_nits", "l1_max_nits", "l1_avg_nits", "l2_target_nits")]
    return got.select("event_id", "frame", *nits, "l5_left", "l5_top", "l6_max_cll", "l6_max_fall")


@query(r"""WITH t AS (SELECT event_id, value, CASE event_id % 6 WHEN 0 THEN value::VARCHAR WHEN 1 THEN '" ' || floor(value)::BIGINT || ' "' WHEN 2 THEN '"' || event_type || '"' WHEN 3 THEN 'true' WHEN 4 THEN 'null' ELSE floor(value)::BIGINT::VARCHAR END::JSON AS j FROM events),
    k AS (SELECT event_id, value, json_type(j) AS k, trim(j->>'$') AS s FROM t)
    SELECT event_id, CASE WHEN k IN ('DOUBLE', 'BIGINT', 'UBIGINT') OR k = 'VARCHAR' THEN TRY_CAST(s AS DOUBLE) END AS number,
           CASE WHEN k IN ('BIGINT', 'UBIGINT') THEN s::BIGINT WHEN k = 'DOUBLE' THEN trunc(s::DOUBLE)::BIGINT WHEN k = 'VARCHAR' AND regexp_full_match(s, '[+-]?\d+') THEN s::BIGINT END AS whole,
           CASE WHEN k = 'VARCHAR' THEN s END AS text FROM k""")
def coerced_values(spark, d):
    """Numbers, whole numbers and texts read from values of any kind; truth values are none."""
    whole = F.floor("value").cast("string")
    forms = (F.col("value").cast("string"), F.concat(F.lit('" '), whole, F.lit(' "')), F.concat(F.lit('"'), "event_type", F.lit('"')), F.lit("true"), F.lit("null"), whole)
    v = F.try_parse_json(F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int")))
    rows = table(spark, d, "events").select("event_id", v.alias("v"))
    return rows.select("event_id", V.number_of(F.col("v")).alias("number"), V.integer_of(F.col("v")).alias("whole"), F.when(V.kind_of(F.col("v")) == "STRING", V.text_of(F.col("v"))).alias("text"))


@query()
def folded_words(spark, d):
    """Distinct words of the documents in compatible form, and as titles; SQL has no such folding."""
    words = table(spark, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", V.compatible(F.col("word")).alias("folded"), V.folded_title(F.col("word")).alias("title"))


# --- details of selections --------------------------------------------------

_TIME = "printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000)"
_DETAILS = f"""{_SELECT}, det AS (SELECT clip, frame, label, luma AS score, 'select_frames.v1' AS source, {_TIME} AS timecode, 'analyze' AS clip_role, CASE WHEN frame % 2 = 0 THEN 'n' || frame END AS notes
    FROM (SELECT sel.clip, sel.frame, label, luma, round_even(sel.frame / 24.0 * 1000, 0)::BIGINT AS ms FROM sel JOIN z ON z.clip = sel.clip AND z.frame = sel.frame))"""


def details_of(spark, d):
    """Details of the selected frames, merged from three writes to each."""
    chosen = cut(selection.select_frames(candidates_of(spark, d), CATEGORIES).join(frames_of(spark, d).select("clip", "frame", r9("luma")), ["clip", "frame"]))
    none = lambda t: F.lit(None).cast(t)
    one = lambda order, label, score, notes: chosen.select("clip", "frame", F.lit(order).alias("at"), label.alias("label"), score.alias("score"), none("string").alias("source"), F.lit("").alias("timecode"), none("string").alias("clip_role"), notes.alias("notes"))
    writes = one(0, F.lit(""), none("double"), F.lit("")).where("frame % 3 = 0").unionByName(one(1, F.col("label"), F.col("luma"), none("string")))
    writes = writes.unionByName(one(2, F.lit("Late"), F.lit(0.5), F.when(F.col("frame") % 2 == 0, F.concat(F.lit("n"), F.col("frame").cast("string"))).otherwise("")))
    return details.merge_details(writes, "at", F.lit(FPS))


@query(f"WITH {_DETAILS} SELECT * FROM det")
def selection_details(spark, d):
    return details_of(spark, d)


@query(f"WITH {_DETAILS} SELECT * FROM det")
def selection_round_trip(spark, d):
    """Details written as JSON, with entries that no reader may accept put before them, and read again."""
    bad = '[5, {"frame_index": "x"}, {"frame_index": true}, {"type": "Dark"}, '
    documents = details.detail_documents(details_of(spark, d))
    return details.parse_details(documents.withColumn("selections", F.concat(F.lit(bad), F.expr("substring(selections, 2)"))))


@query(f"""WITH {_DETAILS} SELECT clip, frame, label FROM det WHERE clip <> 'view' UNION ALL SELECT clip, max(frame) + 100000, 'Cached' FROM det WHERE clip <> 'view' GROUP BY clip""")
def cached_frames(spark, d):
    """Frames selected before under the same hash; one clip's hash differs, each clip has a frame without detail."""
    known = cut(details_of(spark, d))
    frames = known.groupBy("clip").agg(F.array_append(F.collect_list("frame"), F.max("frame") + 100000).alias("frames"))
    cached = details.detail_documents(known).withColumnRenamed("selections", "details").join(frames, "clip").withColumn("hash", F.lit("h"))
    asked = frames.select("clip", F.when(F.col("clip") == "view", "other").otherwise("h").alias("hash"))
    return details.cached_selection(cached, asked)


# --- metric store -----------------------------------------------------------

#: What differs in the request of each remainder of a user's number, and the verdict on it.
_ASKED = {
    1: "missing:not_found", 2: "stale:config_mismatch", 3: "stale:analyzed_mismatch", 4: "stale:release_group_mismatch", 5: "stale:trim_start_mismatch", 6: "stale:trim_end_mismatch", 7: "stale:fps_mismatch",
    8: "stale:inputs_path_mismatch", 9: "stale:inputs_name_mismatch", 10: "stale:inputs_role_mismatch", 11: "stale:inputs_size_mismatch", 12: "stale:inputs_mtime_mismatch", 13: "stale:inputs_count_mismatch",
}
_VERDICT = "CASE user_id % 16 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _ASKED.items()) + " ELSE 'reused:' END"


def _headers(series):
    """Headers of one document for each key: a clip of its own, with the key's number as size."""
    k = F.col("key")
    file = F.concat(k, F.lit(".mkv"))
    clip = F.struct(F.lit("analyze").alias("role"), F.concat(F.lit("/media/"), file).alias("path"), file.alias("name"), k.cast("long").alias("size"), F.lit("2024-01-01").alias("mtime"), F.lit(None).cast("string").alias("sha1"))
    return series.select("key").distinct().select(
        "key", F.lit("c1").alias("config_hash"), F.array(file).alias("files"), file.alias("analyzed_file"), F.lit("Group").alias("release_group"), F.lit(0).cast("long").alias("trim_start"),
        F.lit(None).cast("long").alias("trim_end"), F.array(F.lit(24), F.lit(1)).cast("array<long>").alias("fps"), F.array(clip).alias("clips"),
    )


@query(f"""SELECT user_id::VARCHAR AS key, split_part({_VERDICT}, ':', 1) AS status, nullif(split_part({_VERDICT}, ':', 2), '') AS reason, user_id % 3 = 0 AS wrote,
    count(*) AS frames, round(sum(value) + CASE WHEN user_id % 3 = 0 THEN count(*) ELSE 0 END, 6) AS total FROM events GROUP BY user_id""")
def cache_round_trip(spark, d):
    """Documents of each user's events written to a store, written again with a third of them changed, read back and judged."""
    shared_folder(spark)
    store = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    series = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("frame"), F.col("value").alias("brightness"), (F.col("value") / 2).alias("motion"))
    headers = cut(_headers(series))
    metric_store.upsert(store, headers, series)
    later = series.withColumn("brightness", F.when(F.col("key").try_cast("long") % 3 == 0, F.col("brightness") + 1).otherwise(F.col("brightness")))
    wrote = cut(metric_store.upsert(store, headers, later))
    k = F.col("key").try_cast("long") % 16
    change = lambda c, at, value: F.when(k == at, value).otherwise(F.col(c)).alias(c)
    field = lambda x, f, at, value: F.when(k == at, value).otherwise(x[f]).alias(f)
    clips = F.transform(
        "clips",
        lambda x: F.struct(
            field(x, "role", 10, F.lit("target")), field(x, "path", 8, F.lit("/elsewhere")), field(x, "name", 9, F.lit("other")), F.when(k == 11, x["size"] + 1).when(k != 15, x["size"]).alias("size"),
            field(x, "mtime", 12, F.lit("2025-01-01")), x["sha1"].alias("sha1"),
        ),
    )
    asked = headers.select(
        F.when(k == 1, F.concat("key", F.lit("?"))).otherwise(F.col("key")).alias("key"), change("config_hash", 2, F.lit("c2")), change("analyzed_file", 3, F.lit("other")),
        F.when(k == 4, "Other").when(k == 14, "GROUP").otherwise(F.col("release_group")).alias("release_group"), change("trim_start", 5, F.lit(1).cast("long")), change("trim_end", 6, F.lit(9).cast("long")),
        change("fps", 7, F.array(F.lit(25), F.lit(1)).cast("array<long>")), F.when(k == 13, F.concat(clips, clips)).otherwise(clips).alias("clips"),
    )
    found = metric_store.probe(metric_store.manifest(spark, store), asked).withColumn("key", F.rtrim(F.replace("key", F.lit("?"), F.lit(""))))
    sums = metric_store.read_series(spark, store).groupBy("key").agg(F.count("*").alias("frames"), F.round(F.sum("brightness"), 6).alias("total"))
    return found.join(wrote, "key").join(sums, "key").select("key", "status", "reason", "wrote", "frames", "total")
