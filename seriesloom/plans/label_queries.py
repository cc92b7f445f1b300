"""Queries of labels, colour and dynamic metadata, geometry modes and levels, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions import labels as L
from seriesloom.operators import geometry, metadata, series
from seriesloom.plans.queries import _CROP, geom_of, query, table


def nth(k: Column, *values) -> Column:
    """The value at the remainder of ``k``."""
    forms = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))


def txt(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- labels -----------------------------------------------------------------


@query("""WITH k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN printf('S%02dE%02d', p_size, p_partkey % 120) WHEN 1 THEN (p_partkey % 120) || '-' || p_size WHEN 2 THEN '' ELSE 'x' END AS marker FROM part)
    SELECT p_partkey, marker, CASE WHEN p_partkey % 3 = 0 AND (p_partkey % 5 = 0 OR p_partkey % 6 = 0) AND marker = '' AND p_partkey % 7 <> 0 THEN 'f.mkv' ELSE concat_ws(' – ', nullif(concat_ws(' ', CASE WHEN p_partkey % 3 <> 0 THEN '[' || p_brand || ']' END, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 6 <> 0 THEN p_name END, nullif(marker, '')), ''), CASE WHEN p_partkey % 7 = 0 THEN p_type END) END AS label
    FROM k JOIN part USING (p_partkey)""")
def clip_labels(spark, d):
    k = F.col("p_partkey")
    season = F.when(k % 4 == 0, F.array(txt("p_size"))).when(k % 4 == 1, F.array(F.lit("one")))
    episode = F.when(k % 4 == 0, F.array(txt(k % 120))).when(k % 4 == 1, F.array(txt(k % 120), txt("p_size"))).when(k % 4 == 3, F.array(F.lit("x")))
    p = table(spark, d, "part").withColumn("marker", L.episode_marker(season, episode))
    title = F.when((k % 5 != 0) & (k % 6 != 0), F.col("p_name")).otherwise("")
    label = L.clip_label(F.when(k % 3 != 0, F.col("p_brand")), title, F.col("marker"), F.when(k % 7 == 0, F.col("p_type")), F.lit("f.mkv"))
    return p.select("p_partkey", "marker", label.alias("label"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 3 END AS a, CASE WHEN o_orderkey % 3 = 0 THEN -7 END AS b, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS n FROM orders""")
def track_overrides(spark, d):
    k = F.col("o_orderkey")
    entries = F.array(F.lit("a=3"), F.lit(" =4"), F.lit("none"), F.when(k % 2 == 0, F.concat(F.lit(" A = "), txt("o_custkey"))).otherwise("a=x"), F.when(k % 3 == 0, F.lit("b=-7")).otherwise("b=1.5"))
    m = L.track_overrides(entries)
    o = table(spark, d, "orders").select("o_orderkey", m.alias("m"))
    return o.select("o_orderkey", F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"), F.size("m").alias("n"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'MOVIE_' || c_custkey WHEN 1 THEN 'TV_' || c_custkey WHEN 2 THEN 'TV_' || c_custkey WHEN 3 THEN c_custkey::VARCHAR WHEN 4 THEN 'tt' || c_custkey ELSE '' END AS form FROM customer""")
def catalogue_forms(spark, d):
    k = F.col("c_custkey")
    form = L.catalogue_form(
        nth(k, F.concat(F.lit(" movie/"), txt(k)), F.concat(F.lit("Tv_"), txt(k)), txt(k), txt(k), F.concat(F.lit("tt"), txt(k)), F.lit(None).cast("string")),
        nth(k, "tv", F.lit(None).cast("string"), " TV ", "film", "movie", "tv"),
    )
    return table(spark, d, "customer").select("c_custkey", form.alias("form"))


@query(r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN trim(substr(regexp_replace(trim(p_name), '[^0-9A-Za-z._-]+', '_', 'g') || '_x' || repeat('y', p_size * 4), 1, 120), '._-') || '.url' WHEN 1 THEN 'k' || p_partkey || '.url' ELSE 'comparison.url' END AS name FROM part""")
def shortcut_names(spark, d):
    k = F.col("p_partkey")
    name = nth(k, F.concat(F.lit(" -"), F.col("p_name"), F.lit(" / x"), F.repeat(F.lit("y"), F.col("p_size") * 4)), F.lit("..."), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", L.shortcut_name(F.coalesce(name, F.lit("")), F.when(k % 3 == 1, F.concat(F.lit("https://x.org/c/k"), txt(k), F.lit("//"))).otherwise("")).alias("name"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 79)) || '…' ELSE t END AS line FROM
    (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g'), '[\pC\x{2028}\x{2029}\x{a0}\x{3000}]', '', 'g'), ' {2,}', ' ', 'g')) AS t FROM documents)""")
def console_lines(spark, d):
    esc = F.concat(F.lit("\x1b[31m "), F.coalesce("text", F.lit("")), F.lit("\x1b[0m"))
    return table(spark, d, "documents").select("doc_id", L.console_text(esc, 80).alias("line"))


@query("""SELECT p_partkey, p_name || ' (' || p_size || ') $' || '{nix} $5 ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '$' ELSE '' END AS name FROM part""")
def collection_names(spark, d):
    template = F.concat(F.lit("${Title} ($Size) ${nix} $$5 $Brand"), F.when(F.col("p_partkey") % 2 == 0, "$").otherwise(""))
    values = F.create_map(F.lit("Title"), F.col("p_name"), F.lit("Size"), txt("p_size"), F.lit("Brand"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", L.collection_name(template, values).alias("name"))


@query("""SELECT event_id, 'Frame Selection Type: ' || list_extract(['Dark', 'Motion', '(unknown)', 'my own', '(unknown)', 'Auto'], 1 + event_id % 6) AS line FROM events""")
def selection_lines(spark, d):
    return table(spark, d, "events").select("event_id", L.selection_line(nth(F.col("event_id"), " DARK", "motion", F.lit(None).cast("string"), " my own ", "  ", "auto")).alias("line"))


@query("""WITH t AS (SELECT page_id, coalesce(url, '') AS u, regexp_extract(coalesce(url, ''), '([^/]*)$', 1) AS tail FROM pages)
    SELECT page_id, CASE WHEN length(u) <= 26 THEN u WHEN NOT contains(u, '/') THEN left(u, 25) || '…' WHEN 25 - length(tail) <= 0 THEN '…' || right(tail, 25)
      ELSE left(u, least(25 - length(tail), length(u) - length(tail) - 1)) || '…' || tail END AS middle, CASE WHEN length(u) <= 26 THEN u ELSE left(u, 25) || '…' END AS tail_cut FROM t""")
def short_paths(spark, d):
    return table(spark, d, "pages").select("page_id", L.short_path(F.col("url"), 30).alias("middle"), L.short_path(F.col("url"), 30, False).alias("tail_cut"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = l_linenumber - 1 THEN 'analyze' WHEN l_linenumber = 1 THEN 'ref' WHEN l_linenumber = 2 THEN 'tgt' ELSE 'aux' || (l_linenumber - 1) END AS role FROM lineitem""")
def clip_roles(spark, d):
    name = lambda c: F.concat(F.lit("Clip"), txt(c))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", L.clip_role(F.col("l_linenumber") - 1, name(F.col("l_linenumber") - 1), F.upper(name(F.col("l_orderkey") % 5))).alias("role"))


# --- metadata ---------------------------------------------------------------


def dynamic_of(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    pairs = [
        ("DolbyVisionRPU", F.when(k % 2 == 0, F.lit("blob"))),
        ("DoVi_Block_Index", txt(k % 4)),
        ("DolbyVision_block_count", F.when(k % 3 == 0, txt(u % 9)).otherwise("x")),
        ("dovi_target_nits", F.when(k % 5 == 0, txt(u * 100))),
        ("DolbyVision_L1_Avg", F.when(k % 4 == 0, txt(u + 0.5))),
        ("dovi_L1_max", F.when(k % 8 == 0, txt(u * 3))),
        ("Dolby_L5_left", txt(k % 3 - 1)),
        ("Dolby_L5_top", F.when(k % 7 == 0, F.lit(" 140 "))),
        ("rpu_L6_MaxCLL", F.when(k % 6 == 0, txt(u * 10))),
        ("rpu_L6_MaxFALL", F.when(k % 9 == 0, txt(u * 2))),
        ("MaxCLL", F.when(k % 2 == 1, txt(u * 7))),
        ("L5_right", F.lit("9")),
    ]
    props = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in pairs]), lambda e: e["v"].isNotNull()))
    # a file of few row groups would be read, and its maps searched, by few tasks
    return table(spark, d, "events").select("event_id", "user_id").repartition("event_id").select("event_id", props.alias("props"))


_DYNAMIC = """e AS (SELECT event_id, user_id AS u, event_id % 4 AS bi, CASE WHEN event_id % 3 = 0 THEN user_id % 9 END AS bt, CASE WHEN event_id % 5 = 0 THEN user_id * 100 END AS tn, CASE WHEN event_id % 4 = 0 THEN user_id + 0.5 END AS la,
      CASE WHEN event_id % 8 = 0 THEN user_id * 3 END AS lm, CASE WHEN event_id % 3 >= 1 THEN event_id % 3 - 1 END AS ll, CASE WHEN event_id % 7 = 0 THEN 140 END AS lt, CASE WHEN event_id % 6 = 0 THEN user_id * 10 END AS cl, CASE WHEN event_id % 9 = 0 THEN user_id * 2 END AS fl FROM events)"""


@query(f"""WITH {_DYNAMIC} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN true END AS rpu_present, bi AS block_index, bt AS block_total, ll AS l5_left, NULL::BIGINT AS l5_right, lt AS l5_top, NULL::BIGINT AS l5_bottom,
    tn::DOUBLE AS target_nits, la::DOUBLE AS l1_average, lm::DOUBLE AS l1_maximum, NULL::DOUBLE AS l2_target_nits, cl::DOUBLE AS l6_max_cll, fl::DOUBLE AS l6_max_fall FROM e""")
def dynamic_metadata(spark, d):
    return dynamic_of(spark, d).select("event_id", metadata.dynamic_metadata(F.col("props")).alias("m")).select("event_id", "m.*")


@query(f"""WITH {_DYNAMIC} SELECT event_id, 'DoVi: on ' || CASE WHEN bt > 0 THEN 'L2 ' || bi || '/' || bt ELSE 'L2 block ' || bi END || CASE WHEN tn IS NOT NULL THEN ' target ' || tn || ' nits' ELSE '' END AS summary,
    CASE WHEN lm IS NOT NULL THEN 'DV RPU Level 1 MAX/AVG: ' || lm || 'nits / ' || u || '.5nits' WHEN la IS NOT NULL THEN 'DV RPU Level 1 AVG: ' || u || '.5nits' END AS level1,
    CASE WHEN ll > 0 OR lt > 0 THEN 'DV L5 Active Area: ' || concat_ws(' ', 'L:' || ll, 'T:' || lt) END AS level5,
    CASE WHEN cl IS NOT NULL OR fl IS NOT NULL THEN 'DV L6 Metadata: ' || concat_ws(' / ', 'MaxCLL ' || cl, 'MaxFALL ' || fl) END AS level6 FROM e""")
def dynamic_lines(spark, d):
    m = F.col("m")
    e = dynamic_of(spark, d).select("event_id", metadata.dynamic_metadata(F.col("props")).alias("m"))
    return e.select("event_id", metadata.dynamic_line(F.lit("on"), m).alias("summary"), metadata.level1_line(m).alias("level1"), metadata.level5_line(m).alias("level5"), metadata.level6_line(m).alias("level6"))


@query("""WITH e AS (SELECT event_id, user_id AS u, event_id % 4 AS k FROM events)
    SELECT event_id, CASE k WHEN 0 THEN 0.005 WHEN 1 THEN 0.05 END AS min_luminance, CASE k WHEN 0 THEN 1000.0 WHEN 1 THEN u + 400.0 WHEN 2 THEN u + 400.0 END AS max_luminance, (u * 10)::DOUBLE AS max_cll, CASE WHEN k = 2 THEN u::DOUBLE END AS max_fall,
      'HDR: MaxCLL ' || u * 10 || CASE WHEN k = 2 THEN ' / MaxFALL ' || u ELSE '' END AS line,
      CASE k WHEN 0 THEN 'MDL: min: 0.005 cd/m², max: 1000.0 cd/m²' WHEN 1 THEN 'MDL: min: 0.05 cd/m², max: ' || u + 400 || '.0 cd/m²' ELSE 'MDL: Insufficient data' END AS mdl,
      CASE k WHEN 1 THEN 'Range: Full' WHEN 2 THEN 'Range: Limited' END AS color_range FROM e""")
def static_metadata(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    light = (F.lit("ContentLightLevelMax"), txt(u * 10))
    props = (
        F.when(k % 4 == 0, F.create_map(F.lit("MasteringDisplayLuminance"), F.lit("min 0.005, max 1000"), F.lit("ColorRange"), F.lit("7"), *light))
        .when(k % 4 == 1, F.create_map(F.lit("MasteringDisplayMinimumLuminance"), F.lit("0.05"), F.lit("_MasteringDisplayMaxLumi"), txt(u + 400), F.lit("_ColorRange"), F.lit("0"), *light))
        .when(k % 4 == 2, F.create_map(F.lit("MasteringDisplayMaxLuminance"), txt(u + 400), F.lit("MaxFALL"), txt(u), F.lit("ColorRange"), F.lit("1"), *light))
        .otherwise(F.create_map(*light))
    )
    e = table(spark, d, "events").select("event_id", props.alias("props"))
    e = e.withColumn("m", metadata.static_metadata(F.col("props")))
    return e.select("event_id", "m.*", metadata.hdr_line(F.col("m")).alias("line"), metadata.mastering_line(F.col("props")).alias("mdl"), metadata.range_line(metadata.range_name(F.col("props"))).alias("color_range"))


@query("""WITH p AS (SELECT p_partkey AS clip, 400 + p_size * 10 AS height, p_partkey % 5 AS k, p_partkey % 3 AS s FROM part)
    SELECT clip, CASE k WHEN 0 THEN 9 WHEN 1 THEN 5 WHEN 4 THEN NULL ELSE CASE WHEN height <= 576 THEN 6 ELSE 1 END END AS matrix, CASE k WHEN 0 THEN 16 WHEN 1 THEN CASE WHEN height <= 576 THEN 6 ELSE 1 END WHEN 4 THEN NULL ELSE CASE WHEN height <= 576 THEN 6 ELSE 1 END END AS transfer,
      CASE k WHEN 0 THEN 9 WHEN 4 THEN NULL ELSE CASE WHEN height <= 576 THEN 6 ELSE 1 END END AS primaries,
      CASE k WHEN 0 THEN CASE s WHEN 0 THEN 1 WHEN 1 THEN 1 END WHEN 1 THEN 1 WHEN 2 THEN CASE s WHEN 2 THEN 0 ELSE 1 END WHEN 3 THEN CASE s WHEN 1 THEN 1 ELSE 0 END ELSE CASE s WHEN 2 THEN NULL ELSE 1 END END AS color_range FROM p""")
def normal_color(spark, d):
    k, s = F.col("p_partkey"), F.col("p_partkey") % 3
    none = F.create_map().cast("map<string,string>")
    one = lambda *x: F.create_map(*[F.lit(v) for v in x])
    props = nth(k, one("_Transfer", "pq"), none, one("_ColorRange", "full"), none, none)
    overrides = nth(k, none, one("matrix", "470bg"), none, one("range", "full"), none)
    low, high = F.when(s == 1, 16.0).when(s == 2, 2.0), F.when(s == 1, 235.0).when(s == 2, 250.0)
    got = metadata.normal_color(props, overrides, 400 + F.col("p_size") * 10, k % 5 != 4, low, high)
    return table(spark, d, "part").select(k.alias("clip"), got.alias("c")).select("clip", "c.*")


@query("""SELECT o_orderkey AS clip, (l_linenumber - 1)::BIGINT AS index, CASE WHEN l_linenumber % 2 = 0 THEN 'eng' ELSE '' END AS language, lower(l_returnflag) AS codec_name, floor(l_quantity)::BIGINT AS channels, '5.1' AS channel_layout,
      48000::BIGINT AS sample_rate, 0::BIGINT AS bitrate, l_linenumber = 1 AS is_default, false AS is_forced FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 50 <> 7""")
def audio_streams(spark, d):
    def entry(line):
        n = line["l_linenumber"]
        return F.struct(
            (n - 1).alias("index"), F.concat(F.lit(" "), line["l_returnflag"]).alias("codec_name"), F.floor(line["l_quantity"]).alias("channels"), F.lit("5.1").alias("channel_layout"), F.lit("48000").alias("sample_rate"), F.lit("N/A").alias("bit_rate"),
            F.when(n % 2 == 0, F.create_map(F.lit("language"), F.lit("ENG"))).alias("tags"), F.create_map(F.lit("default"), (n == 1).cast("int")).alias("disposition"),
        )

    # lines are shuffled as they are, their entries made where they have met
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("clip")).agg(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity")).alias("lines"))
    probes = lines.select("clip", F.to_json(F.struct(F.transform("lines", entry).alias("streams"))).alias("probe"))
    return metadata.audio_streams(probes.withColumn("probe", F.when(F.col("clip") % 50 == 7, "{bad").otherwise(F.col("probe"))), "clip", "probe")


# --- geometry and levels ----------------------------------------------------

_MODES = f"""{_CROP}, r AS (SELECT *, max(width / height) OVER w AS wide, min(cropped_h) OVER w AS short, max(cropped_w / cropped_h) OVER w AS inner_wide FROM mc WINDOW w AS (PARTITION BY grp)),
    t AS (SELECT *, least(round_even(width / wide, 0)::BIGINT, short) AS ts, least(round_even(cropped_w / inner_wide, 0)::BIGINT, short) AS tb FROM r),
    u AS (SELECT *, greatest(2, ts - ts % 2) AS us, greatest(2, tb - tb % 2) AS ub FROM t),
    x AS (SELECT *, CASE WHEN width / height >= wide OR us >= height THEN 0 ELSE height - us END AS cs, CASE WHEN cropped_w / cropped_h >= inner_wide OR ub >= cropped_h THEN 0 ELSE cropped_h - ub END AS cb FROM u),
    y AS (SELECT *, bool_and(cb > 0) OVER (PARTITION BY grp) AS everywhere FROM x), z AS (SELECT *, CASE WHEN everywhere THEN 0 ELSE cb END AS eb FROM y)"""


@query(f"WITH {_MODES} SELECT clip, top + cs // 2 AS top, bottom + cs - cs // 2 AS bottom, CASE WHEN cs > 0 THEN height - top - bottom - cs ELSE cropped_h END AS cropped_h FROM z")
def letterbox_strict(spark, d):
    return geometry.letterbox_strict(geometry.mod_crop(geom_of(spark, d), 4), "grp", 2).select("clip", "top", "bottom", "cropped_h")


@query(f"WITH {_MODES} SELECT clip, height, top + eb // 2 AS top, bottom + eb - eb // 2 AS bottom, cropped_h - eb AS cropped_h FROM z")
def letterbox_basic(spark, d):
    return geometry.letterbox_basic(geometry.mod_crop(geom_of(spark, d), 4), "grp", 2).select("clip", "height", "top", "bottom", "cropped_h")


@query("""WITH c AS (SELECT p_partkey AS clip, p_size % 2 AS sw, p_partkey % 2 AS sh, p_partkey % 3 AS a, p_size % 5 AS b, p_partkey % 7 = 0 AS p FROM part)
    SELECT clip, CASE WHEN v AND h THEN 'vertical+horizontal' WHEN v THEN 'vertical' WHEN h THEN 'horizontal' ELSE 'none' END AS axes FROM (SELECT clip, sh > 0 AND (b % 2 = 1 OR p) AS v, sw > 0 AND a % 2 = 1 AS h FROM c)""")
def promotion_axes(spark, d):
    k, z = F.col("p_partkey"), F.lit(0).cast("long")
    axes = geometry.promotion_axes(F.col("p_size") % 2, k % 2, (k % 3, z, z, (F.col("p_size") % 5).cast("long")), (z, F.when(k % 7 == 0, 1).otherwise(0).cast("long"), z, z))
    return table(spark, d, "part").select(k.alias("clip"), axes.alias("axes"))


_CODES = "v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 1000) % 256) AS p FROM embeddings)"


@query(f"""WITH {_CODES} SELECT vec_id, round(list_sum(list_transform(p, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x - 16.0::DOUBLE) / 219.0::DOUBLE)) * 255.0::DOUBLE)), 6) AS expanded,
    round(list_sum(list_transform(p, lambda x: pow(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x - 16.0::DOUBLE) / 219.0::DOUBLE)), 0.8::DOUBLE) * 219.0::DOUBLE + 16.0::DOUBLE)), 6) AS adjusted FROM v""")
def plane_levels(spark, d):
    plane = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("double"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    v = table(spark, d, "embeddings").select("vec_id", plane.alias("p"))
    return v.select("vec_id", total(series.expand_limited(F.col("p"))).alias("expanded"), total(series.post_gamma(F.col("p"), 8, 1.25)).alias("adjusted"))
