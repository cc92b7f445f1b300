"""Operators on small inputs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import labels as L
from seriesloom.functions import scalar as S
from seriesloom.operators import align, cache, geometry, lookup, match, metadata, report, selection, series, windows
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.sources import documents


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(spark, xs, clip="a"):
    return spark.createDataFrame([(clip, i, float(x)) for i, x in enumerate(xs)], "clip string, frame long, v double")


def test_quantile(spark):
    s = values(spark, [0, 1, 2, 3, 4])
    for q, want in ((0, 0.0), (0.25, 1.0), (0.5, 2.0), (1, 4.0), (-1, 0.0), (2, 4.0)):
        assert exact_quantiles(s, "clip", "v", {"x": q}).first().x == want


def test_smoothing_is_cut_off_at_the_ends(spark):
    s = series.smooth(values(spark, [0, 0, 9, 0, 0]), "v", 1, "s")
    assert [r.s for r in s.orderBy("frame").collect()] == [0, 3, 3, 3, 0]
    assert series.smooth(values(spark, [1, 2]), "v", 0, "s").where("s = v").count() == 2


def test_greedy_gap(spark):
    c = spark.createDataFrame([("a", f, i) for i, f in enumerate((0, 10, 20, 30, 100, 30))], "clip string, frame long, place int")
    assert sorted(r.frame for r in selection.spaced_frames(c, [F.col("place")], 24).collect()) == [0, 30, 100]


def test_two_folds_differ_from_one(spark):
    # frame 10 is kept for Dark and blocks 15, though Bright had it; a single fold would take 15
    rows = [("c", "Dark", 10, 1), ("c", "Dark", 15, 2), ("c", "Bright", 12, 1), ("c", "Bright", 40, 2)]
    cand = spark.createDataFrame(rows, "clip string, label string, frame long, place int")
    cats = (selection.Category("Bright", 1, 5, 6), selection.Category("Dark", 2, 5, 6))
    got = {(r.frame, r.label) for r in selection.select_frames(cand, cats).collect()}
    assert got == {(12, "Bright"), (40, "Bright")}


def test_python_shuffle_follows_the_generator(spark):
    cand = values(spark, range(20)).select("clip", "frame")
    want = list(range(20))
    random.Random(5).shuffle(want)
    got = [r.frame for r in selection.python_shuffle(cand, 5).orderBy("place").collect()]
    assert got == want


def test_selection_windows(spark):
    clips = spark.createDataFrame([(1, 2400, 24.0), (2, 60, 30.0), (3, 0, 24.0)], "clip int, num_frames int, fps double")
    w = {r.clip: r for r in windows.selection_windows(clips, 10.0, 5.0, 5.0).collect()}
    assert (w[1].start_frame, w[1].end_frame, w[1].start_seconds, w[1].end_seconds, w[1].widened) == (240, 2280, 10.0, 95.0, False)
    assert (w[2].start_frame, w[2].end_frame, w[2].widened) == (0, 60, True)
    assert (w[3].start_frame, w[3].end_frame) == (0, 0)


def test_scalars(spark):
    assert one(spark, S.timecode(F.lit(1439), F.lit(24.0))) == "00:00:59.958"
    assert one(spark, S.timecode(F.lit(1), F.lit(0.0))) is None
    assert one(spark, S.roman_value(F.lit("MCMXCIV"))) == 1994
    assert one(spark, S.roman_value(F.lit("ABC"))) is None
    assert round(one(spark, S.similarity(F.lit("abc"), F.lit("xaybzc"))), 6) == 0.5
    assert round(one(spark, S.similarity(F.lit("the witch"), F.lit("the vvitch"))), 6) == 0.8
    assert one(spark, S.clock_text(F.lit(None).cast("double"))) == "--:--"
    assert one(spark, S.number(F.lit("1,234.5"))) == 1234.5
    assert one(spark, S.year_hint(F.lit("1899"))) is None
    assert one(spark, S.version_suffix(F.lit("show - 01 v2"))) == "V2"
    assert one(spark, S.safe_label(F.lit("a/b:c"))) == "a_b_c"
    assert one(spark, S.safe_webhook(F.lit("https://10.0.0.1/x"))) is False
    assert one(spark, S.fold_sequence(F.array(*[F.lit(str(i)) for i in range(6)]), 2, 1)) == "0, 1, …, 5"
    assert one(spark, S.pq_to_nits(F.lit(0.0))) == 0.0
    assert abs(one(spark, S.pq_to_nits(F.lit(1.0))) - 10000) < 1e-6
    assert one(spark, S.even_floor(F.lit(7))) == 6
    assert one(spark, S.strip_noise(F.lit("[Grp] The.Matrix.1999.1080p.x264.mkv"))) == "The Matrix 1999"


def test_correlation_finds_the_delay(spark):
    rng = random.Random(3)
    x = [rng.random() for _ in range(60)]
    a = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, pos long, v double")
    b = spark.createDataFrame([("b", i, x[i - 7] if i >= 7 else 0.0) for i in range(60)], "k string, pos long, v double")
    c = align.block_correlation(align.zscore(a, "k", "v").drop("k"), align.zscore(b, "k", "v").withColumnRenamed("k", "clip"), 16).withColumn("corr_norm", F.lit(0.0))
    assert align.best_lag(c).first().lag == 7


def test_manual_offsets(spark):
    rows = [("g", 0, 0), ("g", 0, -5), ("h", 10, 0), ("h", 20, 5)]
    plans = spark.createDataFrame(rows, "grp string, baseline int, delta int")
    got = sorted((r.grp, r.trim) for r in align.apply_deltas(plans, "grp").collect())
    assert got == [("g", 0), ("g", 5), ("h", 10), ("h", 25)]


def test_geometry(spark):
    c = spark.createDataFrame([(1, 1923, 1079), (1, 1920, 1080)], "grp int, width long, height long")
    assert all((r.width - r.left - r.right) % 2 == 0 and (r.height - r.top - r.bottom) % 2 == 0 for r in geometry.mod_crop(c, 2).collect())
    b = spark.createDataFrame([(1, 1280, 720), (1, 1280, 1080)], "grp int, width long, height long")
    got = {r.height: (r.top_extra, r.bottom_extra) for r in geometry.letterbox_offsets(b, "grp", 2, 0.02).collect()}
    assert got == {720: (0, 0), 1080: (180, 180)}
    s = geometry.scale_to(geometry.mod_crop(c.where("width = 1920"), 2), F.lit(540)).first()
    assert (s.scaled_w, s.scaled_h) == (960, 540)
    plan = geometry.geometry_plan(b, "grp", 2, 720, 0.02).collect()
    assert {(r.final_w, r.final_h) for r in plan} == {(1280, 720)}
    assert one(spark, geometry.needs_full_chroma(F.lit(False), F.lit(True), F.lit(1), F.lit(1), F.lit("auto"))) is True


def test_match(spark):
    rows = [("The Matrix", 1999, "The Matrix", "MOVIE", 0, 1999, 15.0, 603), ("The Matrix", 1999, "The Matrix Reloaded", "MOVIE", 1, 2003, 12.0, 604)]
    pairs = spark.createDataFrame(rows, "query string, year int, title string, category string, place int, candidate_year int, popularity double, id int")
    best = match.resolve(match.score_candidates(pairs), "query", "id").first()
    assert best.id == 603 and best.sure and not best.ambiguous
    assert one(spark, match.roman_title(F.lit("Rocky II"))) == "Rocky 2"


def test_metadata(spark):
    props = F.create_map(F.lit("MasteringDisplayLuminance"), F.lit("0.002 1000"), F.lit("_Transfer"), F.lit("16"))
    low, high = metadata.mastering_luminance(props)
    assert one(spark, low) == 0.002 and one(spark, high) == 1000.0
    assert one(spark, metadata.signals_hdr(props)) is True
    assert one(spark, metadata.metric_entry(F.lit(1.25), 500.0)) == 500.0
    assert one(spark, metadata.measurement_line(F.lit(120.0), F.lit(160.0), F.lit("bright"))) == "Measurement MAX/AVG: 160nits / 120nits (bright)"
    assert one(spark, metadata.measurement_line(F.lit(23.4), F.lit(715.0), F.lit(None).cast("string"))) == "Measurement MAX/AVG: 715nits / 23.4nits"


def test_labels_and_offsets(spark):
    rows = [(1, "x", "a v1"), (2, "x", "b"), (3, "x", "c"), (4, "", "d"), (5, "y", "e")]
    got = {r.pos: r.unique_label for r in lookup.dedupe_labels(spark.createDataFrame(rows, "pos int, label string, file string"), "label", "file", "pos").collect()}
    assert got == {1: "x V1", 2: "x #2", 3: "x #3", 4: "d", 5: "y"}
    old = spark.createDataFrame([("f", 5, 9, "auto"), ("g", 4, 4, "auto")], "file string, frames int, suggested int, status string")
    new = spark.createDataFrame([("f", 7), ("g", 6), ("h", 1)], "file string, frames int")
    merged = {r.file: (r.frames, r.status) for r in lookup.merge_offsets(old, new).collect()}
    assert merged == {"f": (5, "manual"), "g": (6, "auto"), "h": (1, "auto")}


def test_cache(spark):
    cols = "k int, pos int, path string, name string, role string, size long, mtime string, sha1 string"
    a = spark.createDataFrame([(1, 0, "p", "n", "r", 5, None, None), (2, 0, "p", "n", "r", 5, None, None), (3, 0, "p", "n", "r", 5, None, None)], cols)
    b = spark.createDataFrame([(1, 0, "p", "n", "r", None, None, None), (2, 0, "q", "n", "r", 5, None, None), (3, 0, "p", "n", "r", 6, None, None), (3, 1, "z", "n", "r", 6, None, None)], cols)
    got = {r.k: r.reason for r in cache.identity_reason(a, b, "k").collect()}
    assert got == {1: None, 2: "inputs_path_mismatch", 3: "inputs_count_mismatch"}


def test_sources(spark, tmp_path):
    s = series.fallback_metrics(values(spark, range(10)).select("clip", "frame"))
    documents.write_metrics(s, f"file://{tmp_path}/m")
    assert documents.read_metrics(spark, f"file://{tmp_path}/m", ["a"]).count() == 10
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.json").write_text('{"version": 2, "brightness": [[0, 0.1], [5, 0.5]], "motion": [[0, 0.2], [5, 1.0]]}')
    (folder / "b.json").write_text('{"version": 1}')
    (folder / "c.json").write_text("not json")
    docs = documents.read_metric_documents(spark, f"file://{folder}")
    assert {r.file.rsplit("/", 1)[1]: r.status for r in docs.collect()} == {"a.json": "ok", "b.json": "stale", "c.json": "error"}
    assert sorted((r.frame, r.brightness, r.motion) for r in documents.document_series(docs).collect()) == [(0, 0.1, 0.2), (5, 0.5, 1.0)]
    for n in ("ep10.mkv", "ep2.mkv", "notes.txt"):
        (folder / n).write_bytes(b"x")
    assert [r.name for r in documents.discover_media(spark, f"file://{folder}").collect()] == ["ep2.mkv", "ep10.mkv"]


def test_report(spark):
    names = spark.createDataFrame([("1 - a.png",), ("1 - b.png",), ("2 - a.png",), ("x.txt",)], "name string")
    assert {(r.frame, r.n, r.even) for r in report.upload_plan(names).collect()} == {(1, 2, False), (2, 1, False)}
    d = spark.createDataFrame([(1, "Dark"), (2, "dark"), (3, None)], "pos int, label string")
    assert {(r.key, r.n) for r in report.category_counts(d, "label", "pos").collect()} == {("dark", 2), ("auto", 1)}


def test_user_and_random_frames_in_a_window(spark):
    """User frames inside the window are kept whatever is near, random ones fill up, and frames come in ascending order."""
    rows = [("c", "User", f, f) for f in (10, 75, 76, 180)] + [("c", "Dark", f, f) for f in range(220)] + [("c", "Random", f, f * 7 % 220) for f in range(220)]
    found = spark.createDataFrame(rows, "clip string, label string, frame long, place long")
    window = spark.createDataFrame([("c", 50, 150)], "clip string, start_frame long, end_frame long")
    kinds = (selection.USER, selection.Category("Dark", 1, 2, 10), selection.Category("Random", 2, 3, 5, False))
    got = [(r.frame, r.label) for r in selection.select_frames(found, kinds, window).collect()]
    assert [f for f, _ in got] == sorted(f for f, _ in got) and all(50 <= f < 150 for f, _ in got)
    assert [f for f, label in got if label == "User"] == [75, 76]
    assert [f for f, label in got if label == "Dark"] == [50, 60]
    random = [f for f, label in got if label == "Random"]
    assert len(random) == 3 and all(abs(a - b) >= 5 for a in random for b, _ in got if a != b)


@pytest.mark.parametrize(
    "url, safe",
    [("https://hooks.example.com/x", True), ("https://[::1]/x", False), ("https://[::ffff:127.0.0.1]/", False), ("https://198.18.0.1/", False), ("https://224.0.0.1/", True), ("https://8.8.8.8/", True), ("https://0.0.0.0/", False), ("https://localhost:80/", False), ("", False), (None, False), ("not-a-url", False), ("https://[2606:4700::1]:443/", True), ("https://[2001:db8::1]/", False), ("https://999.1.1.1/", True)],
)
def test_webhooks(spark, url, safe):
    row = spark.createDataFrame([(url,)], "u string").select(S.safe_webhook(F.col("u")).alias("s")).first()
    assert row.s is safe


def test_label_texts(spark):
    none = F.lit(None).cast("string")
    assert one(spark, L.selection_name(none)) == "(unknown)"
    assert one(spark, L.short_path(none, 40)) == ""
    assert one(spark, L.short_path(F.lit("/a/long/folder/of/names/file.mkv"), 24)) == "/a/long/fol…file.mkv"
    assert one(spark, L.short_path(F.lit("x/" + "y" * 40), 14)) == "…" + "y" * 9
    assert one(spark, L.collection_name(F.lit("$a${a}$$a $b ${"), F.create_map(F.lit("a"), F.lit("1")))) == "11$a $b ${"
    assert one(spark, L.console_text(F.lit("\x1b[1mhi\x07  there\n​you"), 8)) == "hi ther…"
    assert one(spark, L.console_text(none)) == ""
    assert one(spark, L.episode_marker(F.array(F.lit("1")), F.array(F.lit("3"), F.lit("4")))) == "S01E03"
    assert one(spark, L.episode_marker(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"))) == ""
    assert one(spark, L.clip_label(none, none, none, none, F.lit("f.mkv"))) == "f.mkv"


def test_metadata_texts(spark):
    double = lambda x: F.lit(x).cast("double")
    assert one(spark, metadata.nits_label(double(None))) is None
    assert one(spark, metadata.luminance_text(double(0.0))) == "0"
    assert one(spark, metadata.luminance_text(double(0.0050))) == "0.005"
    assert one(spark, metadata.measurement_line(double(None), double(8.25), F.lit(" "))) == "Measurement MAX: 8.2nits"
    assert one(spark, metadata.range_name(F.create_map(F.lit("ColorRange"), F.lit("7")))) is None
    assert one(spark, metadata.mastering_line(F.create_map().cast("map<string,string>"))) == "MDL: Insufficient data"
    empty = metadata.dynamic_metadata(F.create_map().cast("map<string,string>"))
    assert one(spark, metadata.dynamic_line(F.lit("on"), empty)) == "DoVi: on (no DV metadata)"
    assert one(spark, metadata.dynamic_line(F.lit(None).cast("string"), empty)) is None
    assert one(spark, metadata.level5_line(empty)) is None
