"""Conversation repair, clustering and MinHash against brute force; special tokens, large vectors, skipped payloads, scratch tables."""

import hashlib
import io
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesloom.llm import common, conversations, jaccard_join, kmeans, minhash, url_filter, warc
from seriesloom.llm.conversations import compose, damaged, piece_paths, repair_conversations, repaired_turns
from seriesloom.llm.html_text import extract_pages
from seriesloom.llm.kmeans import clusters
from seriesloom.llm.minhash import minhash_components
from seriesloom.llm.packing import encoder
from seriesloom.llm.topk import exact_top_k
from seriesloom.llm.url_filter import Rule

SPACE = " \t\n\x0b\x0c\r"


# --- conversations ----------------------------------------------------------


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit == 0:
            continue
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        out += [(c, t, "user" if hit == 4 else r, x)] * (2 if hit == 3 else 1)
    return out


def brute_repair(rows):
    """All edits by a plain table over (turns read, state), with insertions closed at each turn."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, r, x in rows:
        kept = x.strip(SPACE)
        faults.append("b" if not kept else "d" if (r, x) in seen else "t" if kept[-1] not in ".!?" else "")
        seen.add((r, x))
    known = [t for t, _, _ in rows if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    role = {"u": "user", "a": "assistant"}
    follow = {"0": "u", "s": "u", "u": "a", "a": "u"}

    def closed(states):
        for s in ("0", "s", "u", "a", "u", "a"):
            if s in states:
                c, a, text = states[s]
                new = (c + 3, a + "I", text + [f"{role[follow[s]]}:"])
                if follow[s] not in states or new[:2] < states[follow[s]][:2]:
                    states[follow[s]] = new
        return states

    states = closed({"0": (0, "", [])})
    for (_, r, x), fault in zip(rows, faults):
        new = {}
        for s, (c, a, text) in states.items():
            moves = [(s, c + 4, "D", text)]
            if fault not in ("b", "d"):
                add = 3 if fault == "t" else 0
                i = r[:1]
                if (s == "0" and i == "s") or (i == follow[s]):
                    moves.append((i, c + add, "K", text + [f"{r}:{x}"]))
                moves.append((follow[s], c + 3 + add, "R", text + [f"{role[follow[s]]}:{x}"]))
            for to, cost, e, text2 in moves:
                if to not in new or (cost, a + e) < new[to][:2]:
                    new[to] = (cost, a + e, text2)
        states = closed(new)
    cost, audit, text = min(states[s] for s in ("0", "a") if s in states)
    gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
    sha = hashlib.sha256("\n".join(text).encode()).hexdigest()
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha)


def conversation_rows(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "  ", "", "What?", "Well...", "and so on ", "ok!\n", None, "ünï."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(most)):
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"line {rng.randrange(9)}."))
    return rows


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place long, audit string")


def repaired(spark, rows, **kw):
    t = turns_of(spark, rows)
    got = repair_conversations(damaged(t), t, **kw)
    return {r.conv_id: tuple(r)[1:] for r in got.collect()}, got.columns


def test_repair_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 3)  # conversations of several pieces
    rows = conversation_rows(1, 60, 14)
    rows += [(500, t, "user" if t % 3 else "assistant", f"long {t % 7}" + "." * (t % 2)) for t in range(300)]
    rows += [(501, 5, "user", "again.")] * 40  # repeated rows
    rows += [(502, t, "system", "x.") for t in range(30)]
    random.Random(2).shuffle(rows)
    got, names = repaired(spark, rows)
    assert names == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    by = {}
    for c, t, r, x in brute_damage(rows):
        by.setdefault(c, []).append((t, r, x))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: brute_repair(by[c]) if c in by else empty for c in {r[0] for r in rows}}
    assert empty in got.values() or len(by) == len(got)


def test_pieces_compose_to_the_whole():
    rng = random.Random(3)
    for _ in range(60):
        turns = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(1, 24)))
        cost, audit = conversations.cheapest(turns)
        for size in (1, 2, 5):
            before = {"0": (0, "")}
            for s in range(0, len(turns), size):
                before = compose(before, {(x, y): p for x in "0sua" for y, p in piece_paths(turns[s : s + size], x).items()})
            assert min(p for k, p in before.items() if k in conversations.ENDS) == (cost, audit)


def test_repaired_turns_follow_the_grammar(spark):
    rows = conversation_rows(4, 20, 9)
    turns = turns_of(spark, rows)
    got = {}
    for r in sorted(repaired_turns(turns).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.position)):
        got.setdefault(r.conv_id, []).append(r.role[0])
    assert got and all(re.fullmatch("s?(ua)+", "".join(g)) for g in got.values())


def test_no_conversations(spark):
    assert repaired(spark, [])[0] == {}


# --- clusters ---------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(256.0 * float(x))) for x in v]
            if sum(x * x for x in q) <= 1 << 60:
                kept.append((i, q))
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), np.array(q, np.int32).tobytes(), q) for i, q in kept if i is not None)
    c = [q for _, _, q in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, m)), j) for j, m in enumerate(c)) for _, q in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            mine = [q for (_, q), (_, a) in zip(kept, at) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    inertia = sum(d for d, _ in at)
    fits = lambda x: x if x < 1 << 63 else None
    part = {j: fits(sum(d for d, a in at if a == j)) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, part[j], fits(inertia), sha[j]) for (i, _), (d, j) in zip(kept, at)), key=repr)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=12) + 3 * (i % 4)).tolist()) for i in range(120)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (200, None), (201, [1.0] * 11), (202, [float("nan")] + [0.0] * 11), (203, [None] + [0.0] * 11), (204, [1e30] * 12), (205, [4e6] * 12), (206, [-4e5] * 12)]
    rows += [(300 + i, [0.5] * 12) for i in range(9)]  # ties
    v = spark.createDataFrame([(i, x, 5, 1) for i, x in rows], "vec_id long, embedding array<double>, cluster int, q int")
    got = clusters(v, k=9, rounds=3, dims=12, segment=5)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows, 9, 3, 12)
    assert clusters(v.where("false"), dims=12).count() == 0
    few = v.where("vec_id in (1, 2)")
    assert sorted(r.cluster for r in clusters(few, dims=12).collect()) == [0, 1]


def test_screening_saves_exact_distances():
    rng = np.random.default_rng(2)
    c = rng.integers(-2000, 2000, (40, 64))
    x = (c[rng.integers(0, 40, 500)] + rng.integers(-40, 40, (500, 64))).astype(np.int64)
    near, d, took = kmeans.screened(x, kmeans.segment_norms(x), c, kmeans.segment_norms(c))
    full = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    assert (near == full.argmin(1)).all() and (d == full.min(1)).all() and took < 0.5 * full.size


# --- MinHash ----------------------------------------------------------------


def brute_near(rows, width, percent):
    sets = []
    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def near_texts(seed, bases=40):
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 12, 40, 120, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(60))
    out += [passage + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    return out


EDGES = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9005, "ONE two three"), (9006, "one two THREE"), (9006, "one two three"), (None, "one two three"), (9008, "word " * 20000), (None, None)]


@pytest.mark.parametrize("bucket", [4096, 2])
def test_minhash_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(minhash, "BUCKET", bucket)  # buckets of a key cut into parts
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    rows = list(enumerate(near_texts(1))) + EDGES
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node long, kept string")
    got = minhash_components(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = got.collect()
    assert sorted((tuple(r)[:3] for r in found), key=repr) == brute_near(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id if r.doc_id is not None and r.component_id is not None else None) for r in found)
    assert minhash_components(df.where("false")).count() == 0


def test_jaccard_join_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    rows = list(enumerate(near_texts(5, 30)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similar_components(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_near(rows, 5, 75)


def test_folded_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    for n in (5, 60, 700, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3 + 1, dtype=np.uint64)]))
        minis = [jaccard_join.folded(jaccard_join.parity_sketch(s)) for s in (a, b)]
        size = min(map(len, minis))
        rows = np.stack([np.frombuffer(m.ljust(jaccard_join.MINI, b"\0"), np.uint8) for m in minis])
        assert jaccard_join._apart(rows[:1], rows[1], np.array([size]))[0] <= len(np.setxor1d(a, b))
        assert jaccard_join._apart(rows[:1], rows[0], np.array([size]))[0] == 0


# --- pages and hosts --------------------------------------------------------


def page_of(k, body, extra=""):
    words = " ".join(f"w{k}x{i}" for i in range(60))
    return f"<html><body><div class='wrap'><article><h1>Title {k}</h1><p>{words} one.</p>{body}<p>{words[::-1]} two.</p></article></div>{extra}</body></html>"


def test_boilerplate_by_consensus(spark):
    """What a host's pages repeat goes whatever its name, as do comments and adverts by theirs; copies of a page prove nothing."""
    notes = "<div class='zz-box'>Read our other stories today.</div>"
    rows = [(i, f"http://a.example/{i}", page_of(i, notes + f"<section class='own'>Own part {i}.</section>")) for i in range(8)]
    rows += [(100 + i, "http://copies.example/1", page_of(500, notes)) for i in range(9)]
    marked = ["user-comments", "reader-comments", "ad-300x250", "related-articles", "sidebar-content"]
    rows += [(200 + i, f"http://b.example/{i}", page_of(900 + i, f"<div class='{c}'>Said aside {i}.</div>")) for i, c in enumerate(marked)]
    rows += [(300, "http://c.example/", page_of(990, notes))]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert "other stories" not in got[i] and f"Own part {i}." in got[i] and f"w{i}x59 one." in got[i]
    assert all("other stories" in got[100 + i] for i in range(9)) and "other stories" in got[300]
    assert all("Said aside" not in got[200 + i] and "one." in got[200 + i] for i in range(5))


def test_distrust_reaches_its_fixed_point(spark, monkeypatch):
    """In a ring of hosts scores follow from a linear system; twice the rounds change no verdict."""
    names = [f"h{i}.example" for i in range(6)]
    to = {i: [(i + 1) % 6, (i + 2) % 6] for i in range(6)}
    rows = [(i, f"http://{names[i]}/", "".join(f"<a href='http://{names[j]}/'>x</a>" for j in to[i])) for i in range(6)]
    rules = (Rule("block", names[0], "/"), Rule("allow", names[3], "/"))
    move = np.zeros((6, 6))
    for i, js in to.items():
        for j in js:
            move[i, j] += 0.5
    d = url_filter.DAMPING
    solve = lambda m, seed: np.linalg.solve(np.eye(6) - d * (m / np.maximum(m.sum(1, keepdims=True), 1e-300)).T, (1 - d) * seed)
    trust, distrust = solve(move, np.eye(6)[3]), solve(move.T, np.eye(6)[0])
    want = {i: "block" if i == 0 or i != 3 and distrust[i] - trust[i] > url_filter.EXCESS * (1 - d) else "allow" for i in range(6)}
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(table, rules).collect()} == want
    monkeypatch.setattr(url_filter, "EVERY", 12)
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(table, rules).collect()} == want


def test_sample_below_a_bound(spark, monkeypatch):
    """More rows than are drawn: those of the least hashes, half of each class."""
    from seriesloom.llm import quality

    rng = random.Random(3)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), np.array([i % 2, 2 + rng.randrange(50)], np.uint16).tobytes(), i % 2) for i in range(900)]
    seen = []
    fit = quality.dual_coordinate_descent
    monkeypatch.setattr(quality, "dual_coordinate_descent", lambda found, *a: (seen.append(len(found)), fit(found, *a))[1])
    known = spark.createDataFrame(rows, "order long, features binary, label int")
    quality.train(known, sample_rows=200)
    assert seen[0] == 200
    seen.clear()
    quality.train(known, sample_rows=5000)
    assert seen[0] == 900


# --- mends ------------------------------------------------------------------


def test_added_tokens_in_any_case():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), encoder(path)
    forms = []
    for token in mine.added:
        for t in (token, token.upper(), token.title(), token.capitalize()):
            forms += [t, f"x {t} y", f"a{t}B", f"Ünï {t}. Öl", f"{t}{t}", f" {t}\nNEXT Word"]
    assert mine.added
    ids, ends = mine.encode(pa.array(forms))
    for text, s, e in zip(forms, [0, *ends], ends):
        assert ids[s:e].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_large_components_are_defined(spark):
    rows = [(0, [1e9] * 4), (50, [1e6] * 4), (51, [3e38, 0.0, 0.0, 1.0]), (52, [1.0, 2.0, 3.0, 4.0]), (53, [-1e6] * 4), (100, [0.5] * 4)]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    q = {i: [int(256 * x) for x in v] for i, v in rows if i not in (0, 51)}
    want = []
    for a in (50, 100):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:5]
        want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_chunk_maps_compose():
    """Two maps give one, and the scan over composed maps gives what running the chunks one after the other gives."""
    from seriesloom.llm import token_counts as T

    assert T.compose({1: 2, 3: 4}, {2: 7}) == {1: 7}
    rng = random.Random(1)
    full = [{s: rng.randrange(5) for s in range(5)} for _ in range(13)]
    for start in range(5):
        state = start
        for m, p in zip(full, T.prefix_compose(full)):
            state = m[state]
            assert p[start] == state
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert T.special_strings(path) == ("<|endoftext|>",)
    library, machine = Tokenizer.from_file(path), T.transducer(path)
    table = np.frombuffer(T.character_classes(path), np.uint8)
    texts = ["".join(rng.choices("abcdefgh", k=n)) for n in (255, 256, 257, 3000, 20000)] + ["ab" * 4000 + " x " + "zq" * 900, "a" * 5000, "Ünï" * 1500 + "<|endoftext|>" + "=" * 3000]
    texts.append("".join(texts))
    got = T.count_tokens(machine, table, texts, list(T.special_strings(path)))
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


class Held(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="tables are not there")
def test_unwanted_payloads_are_not_inflated(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    payloads = [(p.html or "").encode() for p in pages]
    about = {c: None for c in warc.HEADERS} | {"record_type": "response", "date": warc.DATE}
    raw = [warc.encode_record(about | {"record_id": f"<urn:page:{p.page_id}>", "target_uri": p.url, "payload_length": len(x), "payload": x}) for p, x in zip(pages, payloads)]
    heads = sum(len(zlib.decompress(r, 31)) - len(x) - 4 for r, x in zip(raw, payloads))
    inflated = []
    more = warc._Member.more
    monkeypatch.setattr(warc._Member, "more", lambda self, limit: (inflated.append(len(out := more(self, limit))), out)[1])
    assert list(warc.read_records(Held(b"".join(raw)), lambda f: False)) == []
    assert sum(inflated) == heads
    inflated.clear()
    assert [r["payload"] for r in warc.read_records(Held(b"".join(raw)), lambda f: True, False)] == [None] * len(pages)
    assert sum(inflated) == heads
    assert [r["payload"] for r in warc.read_records(Held(b"".join(raw)), lambda f: True)] == payloads


def test_scratch_tables_go(spark):
    before = set(common._LIVE)
    with common.Scratch():
        kept = common.Stored(spark.range(5), "five")
        assert kept.df.count() == 5 and set(common._LIVE) - before == {kept.path}
    assert set(common._LIVE) == before and not os.path.exists(kept.path.removeprefix("file://"))
    other = common.Stored(spark.range(3), "three")
    other.drop()
    assert not os.path.exists(other.path.removeprefix("file://"))


def test_scratch_tables_go_after_the_session(tmp_path):
    """In a process of its own: tables of a stopped session are removed when it ends."""
    import subprocess
    import sys

    code = (
        "from seriesloom.session import build_session\n"
        "from seriesloom.llm.common import Stored\n"
        f"spark = build_session('gone', 'local[1]', **{{'spark.checkpoint.dir': 'file://{tmp_path}'}})\n"
        "print(Stored(spark.range(4), 'four').path)\n"
        "spark.stop()\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), timeout=300)
    path = next(x for x in done.stdout.splitlines() if "seriesloom-four" in x).removeprefix("file://")
    assert done.returncode == 0 and not os.path.exists(path)


def test_mixing_tells_targets(spark):
    from tests.llm.test_mixing_whole import members_of
    from seriesloom.llm import mixing

    members = members_of(spark, 0.001, 1000)
    steps, targets, reached = mixing.fit_rates(members, mixing.WEIGHTS)
    assert np.allclose(reached[:2], targets[:2], rtol=mixing.CLOSE) and reached[2] < members.agg(F.sum(F.col("n_tokens") * F.col("p_poor"))).first()[0]
