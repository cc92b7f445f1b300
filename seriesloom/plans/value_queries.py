"""Queries of shown values, overlays, defaults and small lookups, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesloom.functions import display as D
from seriesloom.functions import scalar as S
from seriesloom.functions import variants as V
from seriesloom.operators import align, cache, geometry, lookup, metadata, planes, report, series
from seriesloom.operators.ordering import shared_folder

from .label_queries import nth, txt
from .queries import _CROP, FRAMES, frames_of, geom_of, offsets_of, query, table


@query(r"""WITH t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN value::VARCHAR WHEN 1 THEN (floor(value) * 1000)::BIGINT::VARCHAR WHEN 2 THEN '"1,' || lpad((event_id % 1000)::VARCHAR, 3, '0') || '"' WHEN 3 THEN '" Yes "'
                 WHEN 4 THEN 'false' WHEN 5 THEN 'null' ELSE '""' END::JSON AS j FROM events), k AS (SELECT event_id, json_type(j) AS k, j->>'$' AS s FROM t)
    SELECT event_id, CASE WHEN k = 'BOOLEAN' THEN s = 'true' WHEN k IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN s::DOUBLE <> 0 WHEN lower(trim(s)) IN ('true', 'yes', '1', 'enabled', 'on') THEN true WHEN lower(trim(s)) IN ('false', 'no', '0', 'disabled', 'off') THEN false END AS truth,
           CASE WHEN k = 'BOOLEAN' THEN (s = 'true')::INT::DOUBLE ELSE TRY_CAST(replace(s, ',', '') AS DOUBLE) END AS number,
           CASE WHEN k IN ('BIGINT', 'UBIGINT') THEN regexp_replace(s, '(\d)(\d{3})$', '\1 \2') WHEN k = 'DOUBLE' THEN printf('%.3f', s::DOUBLE) ELSE coalesce(s, '') END AS shown,
           coalesce(nullif(CASE WHEN k = 'VARCHAR' THEN s END, ''), 'none') AS plain FROM k""")
def display_values(spark, d):
    """Values of many kinds as truth, number and text."""
    k = F.col("event_id")
    forms = nth(k, txt("value"), txt((F.floor("value") * 1000).cast("long")), F.concat(F.lit('"1,'), F.lpad(txt(k % 1000), 3, "0"), F.lit('"')), F.lit('" Yes "'), F.lit("false"), F.lit("null"), F.lit('""'))
    rows = table(spark, d, "events").select("event_id", F.try_parse_json(forms).alias("v"))
    v = F.col("v")
    text = F.when(V.kind_of(v) == "STRING", V.part(v, "$", "string"))
    return rows.select("event_id", D.truth_of(v).alias("truth"), D.number_shown(v).alias("number"), D.shown(v, 3, " ").alias("shown"), D.display_filter(text, "none").alias("plain"))


@query(f"""WITH {_CROP} SELECT clip, concat_ws(chr(10), CASE WHEN clip % 3 > 0 THEN 'clip ' || clip END,
      CASE WHEN clip % 2 = 0 THEN cropped_w || ' × ' || cropped_h || '  (native)' ELSE cropped_w || ' × ' || cropped_h || ' → 1920 × 1080  (original → target)' END,
      CASE WHEN clip % 5 = 0 THEN 'Range: full' ELSE 'Frame Selection Type: Dark' END) AS text FROM mc""")
def overlay_texts(spark, d):
    """Overlays of cropped clips; every fifth shows a detail in place of the selection."""
    c, k = geometry.mod_crop(geom_of(spark, d), 4), F.col("clip")
    full = k % 2 != 0
    size = D.resolution_text(F.col("cropped_w"), F.col("cropped_h"), F.when(full, 1920).otherwise(F.col("cropped_w")), F.when(full, 1080).otherwise(F.col("cropped_h")))
    base = F.when(k % 3 > 0, F.concat(F.lit("clip "), txt(k))).otherwise("")
    plain, detail = D.overlay(base, size, F.lit("dark")), D.overlay(base, size, F.lit("dark"), F.lit("Range: full"), F.lit(None).cast("string"))
    return c.select("clip", F.when(k % 5 == 0, detail).otherwise(plain).alias("text"))


@query("""WITH k AS (SELECT p_partkey, ['_Matrix', 'Transfer', 'p' || p_size, '_MasteringDisplayMinLuminance', 'ContentLightLevelMax' || p_size % 3, '__ColorRange', 'ColorRanges'] AS ks FROM part)
    SELECT p_partkey, array_to_string(list_sort(list_filter(ks, lambda x: ltrim(lower(x), '_') IN ('matrix', 'primaries', 'transfer', 'colorrange') OR regexp_matches(ltrim(lower(x), '_'), '^(masteringdisplay|contentlightlevel)'))), ',') AS kept,
           array_to_string(list_sort(list_filter(ks, lambda x: contains(lower(x), 'color'))), ',') AS colour FROM k""")
def blank_properties(spark, d):
    """Properties that blank frames keep, and those whose name holds a text."""
    names = [F.lit("_Matrix"), F.lit("Transfer"), F.concat(F.lit("p"), txt("p_size")), F.lit("_MasteringDisplayMinLuminance"), F.concat(F.lit("ContentLightLevelMax"), txt(F.col("p_size") % 3)), F.lit("__ColorRange"), F.lit("ColorRanges")]
    props = F.map_from_arrays(F.array(*names), F.array(*[F.lit("1")] * len(names)))
    rows = table(spark, d, "part").select("p_partkey", props.alias("props"))
    kept = F.array_sort(F.map_keys(D.blank_props(F.col("props"))))
    return rows.select("p_partkey", F.array_join(kept, ",").alias("kept"), F.array_join(metadata.keys_like(F.col("props"), "Color"), ",").alias("colour"))


@query("""WITH e AS (SELECT s_nationkey AS k, list({'label': s_name, 'safe': replace(s_name, '#', '#')} ORDER BY s_suppkey) AS es, min(s_name) AS low FROM supplier GROUP BY s_nationkey)
    SELECT k, CASE k % 4 WHEN 0 THEN low WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE low END AS label FROM e""")
def default_encodes(spark, d):
    """The encode that a default names: with blanks around it, not at all, by an unknown name, by itself."""
    e = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("s_name").alias("label"), S.safe_label(F.col("s_name")).alias("safe_label")))).alias("es"))
    low = F.array_min(F.transform("es", lambda x: x["label"]))
    asked = nth(F.col("k"), F.concat(F.lit(" "), low, F.lit(" ")), F.lit(" "), F.lit("unknown"), low)
    return e.select("k", D.default_encode(asked, F.col("es")).alias("label"))


@query("""WITH c AS (SELECT c_nationkey AS grp, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, c_name AS name, c_mktsegment AS label, c_acctbal AS cost, CASE c_nationkey % 4 WHEN 0 THEN '2' WHEN 1 THEN ' Machinery ' WHEN 2 THEN NULL ELSE 'nothing' END AS target FROM customer),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN target IS NULL THEN 0 WHEN pos::VARCHAR = target THEN 0 WHEN lower(label) = lower(trim(target)) THEN 1 ELSE 2 END, CASE WHEN target IS NULL THEN cost ELSE 0 END, pos) AS k FROM c)
    SELECT grp, c_custkey FROM r WHERE k = 1""")
def picked_clip(spark, d):
    """The customer of each nation that a target names: by position, by segment, by least balance, by nothing."""
    from seriesloom.operators.ordering import numbered

    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("grp"), "c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("cost"), nth(F.col("c_nationkey"), "2", " Machinery ", None, "nothing").alias("target"))
    return lookup.pick_target(numbered(c, ["grp"], ["c_custkey"], "pos"), "grp", "target", "pos", "cost", ["name", "label"]).select("grp", "c_custkey")


@query("""SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(round(o_totalprice, 2), o_orderkey) AS price FROM orders GROUP BY o_custkey""")
def measurement_lookup(spark, d):
    """The first order of each customer, as measurements are looked up by their clip."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))
    return lookup.first_by_name(o, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "price")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE (event_id % 60000) / (event_id % 4)::DOUBLE END AS fps, round(CASE WHEN event_id % 5 = 0 THEN value * 255 WHEN event_id % 9 > 0 THEN value * 255 / (pow(2, event_id % 9 + 7) - 1) END, 9) AS value8 FROM events""")
def rates_and_depths(spark, d):
    """Rational rates as numbers, samples of many depths on the scale of 8 bits."""
    k = F.col("event_id")
    bits = F.when(k % 9 > 0, k % 9 + 7).otherwise(0)
    return table(spark, d, "events").select("event_id", S.fps_value(k % 60000, k % 4).alias("fps"), F.round(S.to_8bit(F.col("value"), bits, k % 5 == 0), 9).alias("value8"))


@query(r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1') AS stem,
    regexp_matches(lower(url || ' ' || page_id % 600), 'timeout|timed out|connection|temporarily|request failed|429|502|503|504') AS again FROM pages""")
def names_and_retries(spark, d):
    """Last parts of URLs without their suffix, and whether a message with a number in it names a passing failure."""
    name = F.regexp_extract("url", "([^/]*)$", 1)
    return table(spark, d, "pages").select("page_id", name.alias("name"), S.file_stem(name).alias("stem"), S.retryable(F.concat("url", F.lit(" "), txt(F.col("page_id") % 600))).alias("again"))


@query("""WITH o AS (SELECT o_orderkey AS clip, (o_orderkey % 400 - 200) * 512 / 48000.0::DOUBLE AS s, CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE 24.0 END AS fps FROM orders)
    SELECT clip, CASE WHEN clip % 3 = 0 THEN 7 WHEN abs(s) < 1e-9 THEN 0 WHEN fps > 0 THEN round_even(s * fps, 0)::BIGINT END AS frames FROM o""")
def estimated_frames(spark, d):
    """Frames as given, else from seconds and rate."""
    o = offsets_of(spark, d).withColumn("frames", F.when(F.col("clip") % 3 == 0, 7).cast("long"))
    return align.estimate_frames(o).select("clip", "frames")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_partkey % 10 = 0 AND l_suppkey % 2 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END AS p FROM lineitem)
    SELECT count(*) AS rows, count(*) FILTER (q IS NOT DISTINCT FROM p) AS same, count(*) FILTER (NOT (sha1(coalesce(q::BIGINT::VARCHAR, '~')) = sha1(coalesce(p::BIGINT::VARCHAR, '~')))) AS changed FROM a""")
def matching_plans(spark, d):
    """How many plans agree with what is stored, and how many digests differ."""
    null = F.lit(None).cast("double")
    left = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("id"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("v"))
    tenth = F.col("l_partkey") % 10 == 0
    pairs = left.select("id", F.when(tenth, null).otherwise(F.col("v")).alias("q"), F.when(tenth & (F.col("l_suppkey") % 2 == 0), null).when(F.col("l_partkey") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("p"))
    side = lambda c, name: F.struct(F.col(c).alias("v")).alias(name)
    both = pairs.select("id", side("q", "a"), side("p", "b"))
    mark = lambda c: cache.fingerprint(F.col(c).cast("long"))
    return both.agg(
        F.count("*").alias("rows"), F.count_if(cache.same_plan("a", "b", ["v"])).alias("same"), F.count_if(mark("a.v") != mark("b.v")).alias("changed"),
    )


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 9 END, CASE WHEN 540 + (p_partkey % 97) * 7 <= 576 THEN 6 ELSE 1 END) AS matrix FROM part""")
def default_matrix(spark, d):
    """Colour matrix as given, else by the height of a clip."""
    return geom_of(spark, d).select(F.col("clip").alias("p_partkey"), metadata.default_color(F.col("height"), F.when(F.col("clip") % 3 == 0, 9)).alias("matrix"))


@query("""SELECT bool_and(c_custkey IN (SELECT o_custkey FROM orders)) AS customers, (SELECT bool_and(o_custkey IN (SELECT c_custkey FROM customer)) FROM orders) AS orders FROM customer""")
def known_names(spark, d):
    """Whether all customers are known to the orders, and all customers of orders to the customers."""
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    one = lambda a, b, name: lookup.all_known(a, b, "c_custkey").withColumnRenamed("all_known", name)
    return one(c, o, "customers").crossJoin(one(o, c, "orders"))  # one row each


@query("""WITH l AS (SELECT vec_id, label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
    x AS (SELECT vec_id, CASE WHEN b IS NOT NULL THEN list_transform(list_zip(a, b), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)) END AS v FROM l)
    SELECT vec_id, round(list_sum(v) / len(v) / 255, 9) AS average, round(list_max(v) / 255, 9) AS maximum FROM x""")
def plane_verification(spark, d):
    """Difference to the plane before on the scale of 8 bits."""
    rows = series.with_previous(table(spark, d, "embeddings"), "embedding", "vec_id", "label", "_before")
    average, most = planes.verification(F.col("embedding"), F.col("_before"), 8)
    return rows.select("vec_id", F.round(average, 9).alias("average"), F.round(most, 9).alias("maximum"))


@query(f"""WITH {FRAMES}, c AS (SELECT clip, count(*) AS n, coalesce(min(CASE WHEN luma >= 0.5 THEN frame END), arg_max(frame, (luma, -frame))) AS hit FROM f GROUP BY clip)
    SELECT clip, CASE clip WHEN 'click' THEN n - 1 WHEN 'error' THEN n // 2 ELSE hit END AS frame, clip NOT IN ('click', 'error') AS auto_selected FROM c""")
def verify_choice(spark, d):
    """The frame to verify on: one clip asks for one beyond its end, one for the middle."""
    f = frames_of(spark, d)
    clips = f.groupBy("clip").agg(F.count("*").alias("num_frames"))
    clips = clips.select("clip", "num_frames", F.when(F.col("clip") == "click", 1 << 40).alias("manual"), (F.col("clip") != "error").alias("auto"))
    return series.verify_choice(f, clips, "luma", 0.5)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 9 WHEN s_suppkey % 3 = 1 THEN 1 ELSE 6 END AS matrix, CASE WHEN s_suppkey % 3 = 0 THEN 9 END AS primaries, CASE WHEN s_suppkey % 3 = 0 THEN 16 WHEN s_suppkey % 3 = 2 THEN 1 END AS transfer, CASE WHEN s_suppkey % 3 = 1 THEN 0 END AS range FROM supplier""")
def color_override(spark, d):
    """Colour codes set for a whole path, for a file name, or for all files."""
    k = F.col("s_suppkey")
    files = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("/media/"), "s_name").alias("file"))
    entry = lambda rows, key, *v: rows.select(key.alias("key"), *[F.lit(x).cast("string").alias(n) for x, n in zip(v, ("matrix", "primaries", "transfer", "range"))])
    own = files.where(k % 3 == 0)
    known = entry(own, F.col("file"), "BT2020", 9, "pq", "").unionByName(entry(files.where(k % 3 == 1), F.regexp_extract("file", "([^/]*)$", 1), "709", "none of them", None, "full"))
    known = known.unionByName(entry(spark.range(1), F.lit("*"), 6, None, "bt1886", None))
    return metadata.color_overrides(files, "s_suppkey", "file", known)


@query("""WITH c AS (SELECT DISTINCT o_custkey AS clip FROM orders), s AS (SELECT o_custkey AS clip, arg_max(o_orderkey, (round(o_totalprice, 2), -o_orderkey)) AS best FROM orders WHERE o_custkey % 4 <> 1 GROUP BY 1)
    SELECT c.clip, CASE WHEN c.clip % 5 = 0 THEN 3 ELSE coalesce(best, 0) END AS stream, c.clip % 5 = 0 AS forced FROM c LEFT JOIN s ON s.clip = c.clip""")
def chosen_streams(spark, d):
    """Streams by override, by score, or the first of clips that have none."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("index"), F.round("o_totalprice", 2).alias("score"))
    clips = o.select("clip").distinct()
    overrides = clips.where("clip % 5 = 0").withColumn("override", F.lit(3).cast("long"))
    return align.chosen_streams(clips, o.where("clip % 4 <> 1"), overrides)


@query("""WITH m AS (SELECT o_custkey % 50 AS grp, 'clip ' || o_custkey AS label, arg_min(CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey / 8.0::DOUBLE END, o_orderkey) AS sec0, min(o_orderkey) AS k FROM orders GROUP BY ALL),
    x AS (SELECT grp, label, CASE WHEN k % 7 > 0 THEN k / 8.0::DOUBLE END AS seconds, CASE WHEN k % 3 > 0 THEN k END AS frames FROM m)
    SELECT grp, count(*) AS clips, coalesce(array_to_string(list(label || '=' || printf('%.3f', seconds) ORDER BY label) FILTER (seconds IS NOT NULL), ','), '') AS offsets_sec,
           coalesce(array_to_string(list(label || '=' || frames ORDER BY label) FILTER (frames IS NOT NULL), ','), '') AS offsets_frames FROM x GROUP BY grp""")
def alignment_blocks(spark, d):
    """Offsets of the clips of a group by label, from each clip's first measurement."""
    k = F.col("o_orderkey")
    none = lambda t: F.lit(None).cast(t)
    m = table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).alias("grp"), F.concat(F.lit("clip "), txt("o_custkey")).alias("label"), k.alias("pos"), F.lit(0).alias("stream"), F.when(k % 7 > 0, k / 8).alias("seconds"),
        F.when(k % 3 > 0, k).alias("frames"), none("double").alias("correlation"), F.lit("auto").alias("status"), F.lit(True).alias("applied"), none("string").alias("note"),
    )
    out = report.alignment_block(m, "grp")
    flat = lambda c, shown: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), shown(e["value"]))), ",")
    return out.select("grp", F.size("measurements").cast("long").alias("clips"), flat("offsets_sec", lambda v: F.format_string("%.3f", v)).alias("offsets_sec"), flat("offsets_frames", txt).alias("offsets_frames"))


@query("""SELECT c_nationkey AS grp, sum(length(c_name) + 1) AS size, sha1(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS sha1 FROM customer GROUP BY c_nationkey""")
def file_digests(spark, d):
    """Sizes and digests of files that were written from the customers of each nation."""
    shared_folder(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_name").alias("value"))
    # a file for each nation: its names in order, one to a line
    rows.repartition("grp").sortWithinPartitions("grp", "value").write.partitionBy("grp").text(root)
    found = cache.file_inputs(spark, root).where(F.col("name").startswith("part-"))
    return found.select(F.regexp_extract("path", r"grp=(\d+)", 1).cast("long").alias("grp"), "size", "sha1")


@query("""SELECT l_orderkey, 'sha256:' || sha256('{"clips":[' || string_agg('{"path":"' || l_partkey || '","size":' || l_suppkey || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || '],"config_hash":"c","selection_source":"s"}') AS key FROM lineitem GROUP BY l_orderkey""")
def selection_keys(spark, d):
    """Cache keys of orders as selections over the parts as clips."""
    clips = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.struct(x["l_partkey"].cast("string").alias("path"), x["l_suppkey"].alias("size")))
    listed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(clips.alias("clips"))
    return listed.select("l_orderkey", cache.selection_key(F.col("clips"), F.lit("c"), F.lit("s")).alias("key"))


_CLIPS = """c AS (SELECT clip, count(*) AS n, row_number() OVER (ORDER BY clip) - 1 AS k FROM f GROUP BY clip),
    p AS (SELECT clip, n, [12, -8, 0, -3, 5][k + 1] AS a, [NULL, -20, 50, NULL, 100000][k + 1] AS e, k FROM c),
    q AS (SELECT *, CASE WHEN e IS NULL THEN n WHEN e < 0 THEN n + e ELSE least(n, e) END AS stop FROM p)"""


def _prepared(spark, d):
    f = frames_of(spark, d).select("clip", "frame", F.round("luma", 9).alias("luma"))
    names = f.groupBy().agg(F.array_sort(F.collect_set("clip")).alias("c")).select(F.posexplode("c").alias("k", "clip"))  # event types, a fixed few
    long = lambda *xs: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("k") + 1)
    props = F.create_map(F.lit("_Matrix"), F.lit("9"), F.lit("Note"), F.lit("x"))
    clips = names.select("clip", long(12, -8, 0, -3, 5).alias("trim_start"), long(None, -20, 50, None, 100000).alias("trim_end"), long(None, 25, None, None, 30).alias("fps_num"), long(None, 1, None, None, 1).alias("fps_den"), F.lit(24000).cast("long").alias("source_num"), F.lit(1001).cast("long").alias("source_den"), props.alias("props"))
    return series.prepare_clips(f, clips)


@query(f"""WITH {FRAMES}, {_CLIPS} SELECT clip, greatest(0, stop - greatest(a, 0)) + greatest(0, -a) AS num_frames, CASE WHEN k = 1 THEN 25 WHEN k = 4 THEN 30 ELSE 24000 END AS num, CASE WHEN k IN (1, 4) THEN 1 ELSE 1001 END AS den,
    CASE WHEN a < 0 THEN '_Matrix' END AS kept FROM q""")
def prepared_clips(spark, d):
    """Lengths, rates and the properties of blank frames of clips trimmed at both ends."""
    clips = _prepared(spark, d)[0]
    return clips.select("clip", "num_frames", "num", "den", F.when(F.col("blank_props").isNotNull(), F.array_join(F.map_keys("blank_props"), ",")).alias("kept"))


@query(f"""WITH {FRAMES}, {_CLIPS} SELECT f.clip, frame - a AS frame, round(luma, 9) AS luma, false AS blank FROM f JOIN q ON q.clip = f.clip WHERE frame < stop AND frame >= a
    UNION ALL SELECT clip, unnest(range(-a)), NULL, true FROM q WHERE a < 0""")
def prepared_frames(spark, d):
    return _prepared(spark, d)[1].select("clip", "frame", "luma", "blank")


@query(f"""WITH {FRAMES} SELECT clip, frame, round(CASE WHEN clip = 'click' THEN luma WHEN clip = 'error' THEN luma / 2 ELSE (sin(frame * 0.137) + 1) / 2 END, 9) AS brightness,
    round(CASE WHEN clip = 'click' THEN motion WHEN clip = 'error' THEN 0 ELSE (cos(frame * 0.21) + 1) / 2 END, 9) AS motion, CASE clip WHEN 'click' THEN 'stored' WHEN 'error' THEN 'measured' ELSE 'made up' END AS origin FROM g""")
def collected_metrics(spark, d):
    """Metrics of each clip from where they are to be had: stored, measured, or made up."""
    from .queries import motion_of

    m = motion_of(spark, d)
    stored = m.where("clip in ('click', 'error')").select("clip", "frame", F.col("luma").alias("brightness"), "motion")
    measured = m.where("clip in ('click', 'error')").select("clip", "frame", (F.col("luma") / 2).alias("brightness"), F.lit(0.0).alias("motion"))
    verdicts = m.select("clip").distinct().withColumn("status", F.when(F.col("clip") == "click", "reused").otherwise("stale"))
    got = series.metrics_or_fallback(verdicts, stored, measured, m)
    return got.select("clip", "frame", F.round("brightness", 9).alias("brightness"), F.round("motion", 9).alias("motion"), "origin")


@query("""WITH l AS (SELECT l_orderkey, list(l_linenumber::VARCHAR ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN len(v) <= 3 THEN array_to_string(v, ', ') ELSE array_to_string(list_concat(list_concat(v[1:2], ['…']), v[-1:]), ', ') END AS folded FROM l""")
def folded_lists(spark, d):
    """Line numbers of an order, the middle of long lists left out."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"].cast("string"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(listed.alias("v")).select("l_orderkey", S.fold_sequence(F.col("v"), 2, 1).alias("folded"))


@query("""WITH k AS (SELECT p_partkey, (1850 + p_partkey % 300) AS y, 540 + (p_partkey % 97) * 7 AS h, p_partkey % 3 AS sw, p_partkey % 2 AS sh, p_partkey % 5 = 0 AS v, p_partkey % 7 = 0 AS o FROM part)
    SELECT p_partkey, CASE WHEN y BETWEEN 1900 AND 2100 THEN y END AS year, h - h % 2 AS even, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE v AND sh > 0 OR o AND sw > 0 END AS full_chroma FROM k""")
def hints_and_parities(spark, d):
    """Years in texts, even sizes, and whether odd sides call for full chroma by policy or format."""
    k = F.col("p_partkey")
    policy = nth(k, "force_full_chroma", "subsamp_safe", "auto", "auto")
    return geom_of(spark, d).select(F.col("clip").alias("p_partkey"), "height").select(
        "p_partkey", S.year_hint(F.concat(F.lit(" "), txt(1850 + k % 300))).alias("year"), S.even_floor(F.col("height")).alias("even"),
        geometry.needs_full_chroma(k % 5 == 0, k % 7 == 0, k % 3, k % 2, policy).alias("full_chroma"),
    )


@query("SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) AS place FROM customer")
def names_in_order(spark, d):
    """Places of names sorted in any case, then by number."""
    from seriesloom.operators.ordering import numbered

    c = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("n"))
    return numbered(c, [], ["n", "c_custkey"], "place").select("c_custkey", (F.col("place") + 1).alias("place"))
