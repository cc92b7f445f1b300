"""Vectors, archives, URLs, classifier, mixing and the pipeline."""

import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import topk, url_filter, warc
from seriesloom.llm.mixing import CLOSE, DOMAINS, WEIGHTS, fit_rates, mix_documents, mix_with_totals
from seriesloom.llm.quality import dual_coordinate_descent, labelled_features, quality_model, quality_scores
from seriesloom.llm.url_filter import Rule, judge_urls

DATA = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not there")


def brute_top(rows, k=5):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted(usable, key=lambda r: r[1], reverse=True):
        if i % 50 == 0:
            asked[i] = v
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 3])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)]  # ties beyond k
    rows += [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (None, [1.0] * 8), (700, [1.0, 2.0]), (701, [0.5, 0.5]), (0, rows[0][1]), (750, [])]
    vectors = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(vectors).collect())
    assert got == brute_top([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert topk.exact_top_k(vectors.where("false")).count() == 0


def test_large_scores_are_exact(spark):
    rows = [(0, [3.1e5] * 4), (1, [2.9e5] * 4), (2, [2.9e5] * 3 + [2.9e5 + 0.004]), (50, [-3.1e5] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(vectors, k=2).collect())
    assert got == brute_top(rows, 2)


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def test_archives(spark, tmp_path):
    long, short = "é" * 700, "s" * 10
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, None, short), (4, "http://c/", short), (5, "http://d/", None), (None, "http://e/", long), (2, "http://f/", long), (7, "http://g/", "x" * 300000)]
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages_of(spark, rows)).collect())
    want = [("1", 1400, "revisit", 2), ("2", 1400, "response", None), ("2", 1400, "response", None), ("3", 10, "response", None), ("4", 10, "response", None), ("5", 0, "response", None), ("None", 1400, "revisit", 2), ("7", 300000, "response", None)]
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    assert warc.archive_round_trip(pages_of(spark, [])).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.page_records(pages_of(spark, rows)), path)
    assert [f for f in os.listdir(tmp_path / "w") if f.startswith("_")] == []
    by_uri = warc.read_warc(spark, path).where("record_type = 'response' and target_uri like 'http://g%'")
    assert [len(r.payload) for r in by_uri.collect()] == [300000]
    bare = warc.read_warc(spark, path, payload=False).where(F.col("record_type").isin("revisit"))
    assert bare.where("payload is null").count() == bare.count() == 2


def test_skipped_payloads_are_not_inflated(tmp_path, monkeypatch):
    base = dict.fromkeys(warc.HEADERS, None)
    data = b"".join(warc.encode_record(base | {"record_id": f"<{i}>", "record_type": t, "payload": os.urandom(200_000)}) for i, t in enumerate(["response", "revisit", "response"]))
    plain = tmp_path / "p.warc.gz"
    plain.write_bytes(data)
    from pyarrow import fs

    read = []
    with fs.LocalFileSystem().open_input_file(str(plain)) as f:

        class Counting:
            size, seek = f.size, f.seek

            def read(self, n):
                read.append(n)
                return f.read(n)

        got = list(warc.read_records(Counting(), lambda h: h["record_type"] == "revisit"))
    assert [g["record_id"] for g in got] == ["<1>"] and len(got[0]["payload"]) == 200_000
    assert sum(read) < 300_000


def test_members_without_length(tmp_path):
    import gzip

    base = dict.fromkeys(warc.HEADERS, None)
    raw = [zlib.decompress(warc.encode_record(base | {"record_id": f"<{i}>", "record_type": "response", "payload": b"p" * n}), 31) for i, n in enumerate((0, 5, 9000))]
    (tmp_path / "p.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw))
    from pyarrow import fs

    for take in (lambda h: True, lambda h: h["record_id"] == "<2>"):
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "p.warc.gz")) as f:
            got = {g["record_id"]: len(g["payload"]) for g in warc.read_records(f, take)}
        assert got.items() <= {"<0>": 0, "<1>": 5, "<2>": 9000}.items() and "<2>" in got


@pytest.mark.parametrize("with_length", [True, False])
def test_damaged_archives_are_errors(tmp_path, with_length):
    import gzip

    from pyarrow import fs

    base = dict.fromkeys(warc.HEADERS, None)
    whole = [warc.encode_record(base | {"record_id": f"<{i}>", "record_type": "response", "payload": os.urandom(n)}) for i, n in enumerate((20_000, 50_000, 10))]
    if not with_length:
        whole = [gzip.compress(zlib.decompress(w, 31)) for w in whole]
    short = gzip.compress(zlib.decompress(whole[1], 31)[:-30_000])
    flipped = bytearray(whole[1])
    flipped[40_000] ^= 1
    last = bytearray(whole[2])
    last[-8] ^= 1  # the checksum

    def read(data):
        (tmp_path / "a.warc.gz").write_bytes(data)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz")) as f:
            return [len(g["payload"]) for g in warc.read_records(f, lambda h: True)]

    assert read(b"".join(whole)) == [20_000, 50_000, 10]
    for data in (b"".join(whole)[:-5], (whole[0] + whole[1])[:-20_000], whole[0] + bytes(flipped) + whole[2], whole[0] + short + whole[2], b"".join(whole[:2]) + bytes(last), whole[0] + b"junk", whole[0] + whole[1][:30]):
        with pytest.raises((ValueError, IndexError)):
            read(data)


def test_url_rules(spark):
    rows = [
        (1, "https://www.example.org/es/x?q#f", None), (2, "HTTP://Example.ORG/en/12", None), (3, "http://other.org/a", None), (4, "http://x.com/fr/", None), (5, "http://x.com/de/1", None),
        (6, "http://x.com", None), (7, None, None), (8, "no scheme", None), (9, "http://notexample.org/es/", None), (10, "http://net/", None), (10, "http://net/", None), (None, "http://x.com?de/", None),
    ]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages_of(spark, rows)).collect()}
    assert (1, "www.example.org", "/es/x", "example.org/es/", "block") in got
    assert (2, "example.org", "/en/12", "example.org/en/1", "block") in got
    assert (3, "other.org", "/a", "org/", "allow") in got
    assert (4, "x.com", "/fr/", "com/fr/", "allow") in got and (5, "x.com", "/de/1", "com/de/", "block") in got
    assert (6, "x.com", "", None, "allow") in got and (7, "", "", None, "allow") in got and (8, "", "", None, "allow") in got
    assert (9, "notexample.org", "/es/", "org/", "allow") in got and (None, "x.com", "", None, "allow") in got
    assert judge_urls(pages_of(spark, rows).where("false")).count() == 0


def test_distrust_runs_against_links(spark):
    """Hosts that link to blocked ones are blocked; those that these link to, or that are trusted, are not."""
    rules = (Rule("block", "bad.example", "/"), Rule("allow", "good.example", "/"))
    link = lambda h: f'<a class="x" href="https://{h}/p">t</a>'
    rows = [(1, "http://bad.example/1", link("victim.example")), (2, "http://farm.example/1", link("bad.example") * 3), (3, "http://good.example/1", link("farm2.example")), (4, "http://farm2.example/1", link("bad.example")), (5, "http://victim.example/1", "")]
    rows += [(6, "http://lonely.example/", "<a href='/in'>x</a>")]
    got = {r.page_id: r.verdict for r in judge_urls(pages_of(spark, rows), rules).collect()}
    trust, distrust = defaultdict(float), defaultdict(float)
    edges = {"bad.example": ["victim.example"], "farm.example": ["bad.example"] * 3, "good.example": ["farm2.example"], "farm2.example": ["bad.example"]}
    d = url_filter.DAMPING
    seeds = ({"good.example": 1 - d}, {"bad.example": 1 - d})
    trust.update(seeds[0])
    distrust.update(seeds[1])
    into = defaultdict(list)
    for a, bs in edges.items():
        for b in bs:
            into[b].append(a)
    for _ in range(200):
        t2, d2 = defaultdict(float, seeds[0]), defaultdict(float, seeds[1])
        for a, bs in edges.items():
            for b in bs:
                t2[b] += d * trust[a] / len(bs)
        for b, as_ in into.items():
            for a in as_:
                d2[a] += d * distrust[b] / len(as_)
        trust, distrust = t2, d2
    for i, u, _ in rows:
        h = u.split("/")[2]
        want = {"bad.example": "block", "good.example": "allow"}.get(h) or ("block" if distrust[h] - trust[h] > url_filter.EXCESS * (1 - d) + 1e-9 else "allow")
        assert got[i] == want, h
    assert url_filter.host_links(pages_of(spark, rows)).count() == 4


def test_dual_descent_separates():
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(200):
        label = rng.random() < 0.3
        rows.append(np.unique(np.concatenate([rng.integers(10, 60, 8), [1 if label else 2]])))
        y.append(1.0 if label else -1.0)
    w = dual_coordinate_descent(rows, np.array(y), np.ones(64))
    assert np.mean([np.sign(w[r].sum()) == t for r, t in zip(rows, y)]) > 0.98


@here
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model(docs, labels)
    scored = quality_scores(docs, model)
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or score is null").count() == 0
    assert scored.where("predicted <> cast(score >= 0.3 as int)").count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored.limit(50).collect())
    both = scored.where("held_out").join(labels, "doc_id")
    assert both.where("predicted = quality").count() / both.count() > 0.97
    assert both.where("quality = 1 and predicted = 0").count() <= 1


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b c d", "x"), (3, "", "x"), (4, "word " * 20000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 0), (9, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, quality_model(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    mixed = mix_documents(docs.select("doc_id", "text"), labels)
    assert mixed.count() == 4 and mixed.where("rate < 0 or copies < 0 or rate is null").count() == 0
    assert mix_documents(docs.select("doc_id", "text").where("false"), labels).count() == 0


def test_labels_joined_to_features_alike(spark, monkeypatch):
    from seriesloom.llm import quality

    docs = spark.createDataFrame([(i, f"text number {i}!!", 1) for i in range(40)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(0, 40, 3)] + [(0, 1, 1), (1, 5, 5)], "doc_id long, quality int, toxic int")
    kinds = {"quality": "shapes", "toxic": "words"}
    few = sorted(tuple(r) for r in labelled_features(docs, labels, kinds).df.collect())
    assert len(few) > 5 and any(r[2] is None for r in few)
    monkeypatch.setattr(quality, "SENT_LABELS", 0)
    assert sorted(tuple(r) for r in labelled_features(docs, labels, kinds).df.collect()) == few


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        p = rng.dirichlet([6, 1, 0.5])
        rows.append((i, int(rng.integers(1, 500)), *map(float, p)))
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_fine double, p_toxic double, p_poor double")
    steps, targets, reached = fit_rates(members, {"fine": 0.9, "toxic": 0.08, "poor": 0.02}, steps=60)
    n = np.array([r[1] for r in rows], float)
    p = np.array([r[2:] for r in rows])
    r = np.ones(len(rows))
    for s in steps:
        r = np.maximum(0, r - p @ np.array(s))
    assert np.allclose((r * n) @ p, reached, rtol=1e-9)
    miss = np.abs(np.array(reached) - targets).sum() / sum(targets)
    assert miss < np.abs(n @ p - targets).sum() / sum(targets) * 0.2 and len(DOMAINS) == 3


def awkward(docs):
    """The documents with nulls, an empty and a very long text, repeated rows, and columns that an operator might use for itself."""
    names = "keep_id group_size kept text_sha256 held_out score predicted n_tokens p_fine p_poor rate copies first run edge label features order _text _n _c0 __c sig node"
    odd = docs.sparkSession.createDataFrame([(None, None), (None, "no identifier but a text of its own"), (-1, ""), (-2, "long " * 50_000), (-3, None), (-4, "twice"), (-4, "twice")], "doc_id long, text string")
    out = docs.unionByName(odd, allowMissingColumns=True)
    for i, n in enumerate(names.split()):
        out = out.withColumn(n, F.lit(f"x{i}"))
    return out


@here
def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline as cp

    whole = awkward(spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60"))
    whole.write.parquet(f"{tmp_path}/w")
    whole = spark.read.parquet(f"{tmp_path}/w")
    for title, stage in cp.STAGES:
        assert stage(spark, whole.where("false"), DATA).count() == 0, title
        out = stage(spark, whole, DATA)
        got = out.collect()
        if title == cp.STAGES[-1][0]:
            assert sorted({str(r.doc_id) for r in got}) == sorted({str(r.doc_id) for r in whole.select("doc_id").collect()})
            continue
        assert out.columns == whole.columns
        kept = {(r.doc_id, r.text) for r in got}
        assert kept <= {(r.doc_id, r.text) for r in whole.select("doc_id", "text").collect()} and kept, title
        assert all(r[n] == f"x{i}" for r in got for i, n in enumerate(whole.columns[5:])), title
        if title == "exact dedup":
            assert sorted(str(r.doc_id) for r in got if not r.text) == ["-3"] and [r.doc_id for r in got].count(-4) == 1
        if title == "n-gram Jaccard join":
            assert (None, None) in kept and (None, "no identifier but a text of its own") in kept and (-3, None) in kept


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="tables are not there")
def test_mixing_meets_its_targets(spark):
    """The production fit on all documents: targets are met, and clean documents stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rated, totals = mix_with_totals(docs, labels)
    assert all(abs(got - want) <= CLOSE * want for want, got in totals.values())
    clean = rated.join(labels.where("quality = 1 and toxic = 0").select("doc_id"), "doc_id")
    assert clean.where("copies > 0").count() > 0.97 * clean.count()
    rows = rated.select("n_tokens", *[f"p_{d}" for d in DOMAINS], "rate").toPandas().to_numpy(float)
    want = least_change(rows[:, 0], rows[:, 1:4], np.array([t for t, _ in totals.values()]))
    assert np.abs(rows[:, 4] - want).max() < 0.02


def least_change(tokens, p, targets):
    """Rates nearest to one, by tokens, that meet the targets: the multipliers of the dual, by plain ascent with restarts."""
    mult = np.zeros(len(targets))
    for _ in range(200):
        rate = np.maximum(0, 1 - p @ mult)
        miss = (rate * tokens) @ p - targets
        if np.abs(miss / targets).max() < 1e-10:
            break
        free = p * (tokens * (rate > 0))[:, None]
        mult = mult + np.linalg.lstsq(free.T @ p, miss, rcond=None)[0]
    return np.maximum(0, 1 - p @ mult)


@here
def test_pipeline_stages(spark):
    """Each stage against a plain version of it on its own input."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 400")
    names = docs.columns
    for title, stage in cp.STAGES:
        rows = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, DATA)
        got = out.collect()
        if title != cp.STAGES[-1][0]:
            assert out.columns == names
        ids = sorted(r.doc_id for r in got)
        if title == "exact dedup":
            best = {}
            for r in rows:
                key = "".join((r["text"] or "").split(" ")).translate({ord(c): None for c in "\t\n\x0b\x0c\r"})
                best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
            assert ids == sorted(b[1] for b in best.values())
        if title == "n-gram Jaccard join":
            from tests.llm.test_text_operators import brute_components

            comps = brute_components([(r["doc_id"], r["text"]) for r in rows])
            assert ids == sorted(int(d) for d, _, c in comps if d == c)
        if title == "quality classifier":
            bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
            assert len(bad & set(ids)) <= 0.1 * len(bad & {r["doc_id"] for r in rows}) and len(ids) > 0.8 * len(rows)
        if title == "mixing sources to target weights":
            often = {r.doc_id: r.copies for r in mix_documents(docs, spark.read.parquet(f"{DATA}/labels.parquet"), {d: w for d, w in WEIGHTS.items() if d != "poor"}).collect()}
            assert ids == sorted(i for i, n in often.items() for _ in range(n)) and ids
        if title == "packing":
            assert {r.doc_id for r in got} == {r["doc_id"] for r in rows}
        docs = spark.createDataFrame(got, out.schema)
