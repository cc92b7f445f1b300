"""Text operators against brute force and edge cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import os
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seriesloom.llm import html_text, jaccard_join, shingles, token_counts
from seriesloom.llm.components import components
from seriesloom.llm.exact_dedup import exact_dedup
from seriesloom.llm.html_text import Page, extract_pages
from seriesloom.llm.packing import cut_points, harmonic_pack

SPACE = "[\\x20\\x09-\\x0D]"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs_of(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, keep_id string, node long")


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (7, "Ünï code ﬁ ǅ 🙂 <|endoftext|> don't 's"), (8, "word " * 30000), (9, "a" * 50000)]


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def near_copies(seed=1):
    """Texts with near copies of several strengths, a common passage and exact copies."""
    rng = random.Random(seed)
    passage = text(rng, 40)
    out, i = [], 0
    for _ in range(40):
        base = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(rng.choice([6, 30, 90, 250]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
            t = " ".join(w)
            out.append((i, t + ("\n" + passage if rng.random() < 0.3 else "")))
            i += 1
    rows = out + [(1000 + k, out[k][1].upper()) for k in range(5)]
    rng.shuffle(rows)
    return rows


def brute_sets(rows):
    out = []
    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        w = [x for x in re.split(SPACE + "+", low) if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted((str(d), len(sets[i]), str(least[find(i)] if sets[i] else d)) for i, (d, _) in enumerate(rows))


def found_components(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_shingles_match_tuples():
    rows = near_copies(3) + EDGES
    for s, b in zip(shingles.shingle_sets([t for _, t in rows]), brute_sets(rows)):
        assert len(s) == len(b)
    a, b = shingles.shingle_sets(["A  b\nc d e f", "a b c d e f "])
    assert a.tolist() == b.tolist()


def test_long_texts_are_hashed_in_parts(monkeypatch):
    t = text(random.Random(2), 5000) * 60
    whole = shingles.shingle_sets([t])[0]
    monkeypatch.setattr(shingles, "PART", 1000)
    assert shingles.shingle_sets([t])[0].tolist() == whole.tolist()


@pytest.mark.parametrize("frequent", [128, 2])
def test_components_match_brute_force(spark, monkeypatch, frequent):
    """With a low bound, most shingles are frequent, and combinations and long-set singles come into play."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = near_copies(frequent) + EDGES
    got = found_components(jaccard_join.similar_components(docs_of(spark, rows).repartition(3)))
    assert got == brute_components(rows)


def test_texts_without_identifiers_link_others(spark):
    """Two texts that only a third one links, whose rows have no identifier."""
    w = [f"w{i}" for i in range(60)]
    first, bridge, last = (" ".join(w[k : k + 50]) for k in (0, 5, 10))
    rows = [(7, first), (None, bridge), (3, last), (None, bridge), (9, "other words here only"), (None, "other words here only too"), (None, None)]
    want = brute_components(rows)
    assert [c for d, _, c in want if d in ("7", "3")] == ["3", "3"]
    assert {c for d, _, c in brute_components([rows[0], rows[2]])} == {"3", "7"}
    assert found_components(jaccard_join.similar_components(docs_of(spark, rows))) == want


@pytest.mark.parametrize("meet, sent", [(256, 400_000), (4, 0)])
def test_components_of_a_large_group(spark, monkeypatch, meet, sent):
    """Copies at many distances from one text, with frequent shingles only, in few and in many parts."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 5)
    for name, value in (("MEET", meet), ("SENT_IDS", sent)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            w[k] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    assert found_components(jaccard_join.similar_components(docs_of(spark, rows))) == brute_components(rows)


def test_signatures_meet_in_every_linked_pair():
    rng = np.random.default_rng(5)
    levels = np.where(rng.random(jaccard_join.COUNTERS) < 0.5, 9, 0).astype(np.uint8)
    for n in (2, 3, 5, 20, 90, 180, 195, 230, 260, 400):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            keep = rng.permutation(a)[: max(1, int(np.ceil(len(a) * rng.uniform(0.75, 1))))]
            b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 1 + n // 5), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both) or a.tolist() == b.tolist():
                continue
            (sa, pa, _, _), (sb, pb, _, _) = jaccard_join.signatures(a, levels), jaccard_join.signatures(b, levels)
            ma, mb = 7 * (len(a) - pa) // 3 - len(a), 7 * (len(b) - pb) // 3 - len(b)
            fit_a = {s for s, m in zip(sa.tolist(), ma) if m >= len(b)}
            fit_b = {s for s, m in zip(sb.tolist(), mb) if m >= len(a)}
            assert fit_a & fit_b
            x, y = (np.frombuffer(jaccard_join.parity_sketch(s), np.uint8) for s in (a, b))
            assert jaccard_join.may_link(x, len(a), y, len(b))


def test_components_of_links(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2), (2, 1), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links.where("a is not null")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_empty_table(spark):
    none = docs_of(spark, [])
    assert jaccard_join.similar_components(none).count() == 0
    assert exact_dedup(none).count() == 0
    assert harmonic_pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert token_counts.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_exact_dedup(spark):
    rng = random.Random(4)
    rows = EDGES + [(100 + i, rng.choice(["a b", "ab", "a  b", "c d", "e"])) for i in range(200)] + [(11, "ONE"), (12, "o ne")]
    got = exact_dedup(docs_of(spark, rows).repartition(5), carry=("text",)).collect()
    assert len(got) == len(rows)
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(SPACE, "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    kept = {}
    for r in got:
        norm = re.sub(SPACE, "", r.text or "")
        best = min(groups[norm])
        assert (r.keep_id, r.group_size) == (best[3], len(groups[norm]))
        kept[norm] = kept.get(norm, 0) + r.kept
        if r.kept:
            assert (r.doc_id, len(r.text or "")) == (best[3], -best[0])
    assert set(kept.values()) == {1}


def test_cut_points():
    for n in [1, 2, 255, 256, 257, 2048, 2049, 4095, 4096, 4097, 9000, 12288]:
        at = 0
        for start, size in cut_points(n, 4096):
            assert start == at and 0 < size <= 4096
            at += size
        assert at == n


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(8)
    rows = EDGES + [(200 + i, text(rng, rng.randrange(1, 900))) for i in range(60)]
    got = harmonic_pack(docs_of(spark, rows).repartition(3), path, with_ids=True).collect()
    whole = Tokenizer.from_file(path)
    want = sorted(zlib.crc32(np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, t in rows)
    pieces, bins = {}, {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert total == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    single = [ps for ps in pieces.values() if sum(p.length for p in ps) == ps[0].doc_tokens]
    crcs = [zlib.crc32(b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start))) for ps in single]
    assert set(crcs) <= set(want) and len(crcs) >= len(rows) - 3


def test_token_counts_match_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(6)
    signs = list("  \n\t'strevldmaAbB19!,.") + ["é", "'re", "<|endoftext|>", " ", "漢", "🙂", "the", "ing", "\r\n", "   "]
    rows = EDGES + [(300 + i, "".join(rng.choices(signs, k=rng.randrange(80)))) for i in range(800)] + [(2000, "=" * 3000), (2001, "ab" * 20000)]
    whole = Tokenizer.from_file(path)
    want = sorted((str(d), len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    got = token_counts.token_counts(docs_of(spark, rows), path).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


@pytest.mark.parametrize("segment, most", [(1 << 20, 120_000), (768, 300), (256, 50)])
def test_chunks_without_a_word_start(monkeypatch, segment, most):
    """Words of many chunks, whose maps are applied to guesses first, in one and in many segments."""
    monkeypatch.setattr(token_counts, "SEGMENT", segment)
    monkeypatch.setattr(token_counts, "MAX_STATES", most)
    path = public_tokenizers.path("byte_bpe_50k.json")
    table = np.frombuffer(token_counts.character_classes(path), np.uint8)
    machine, whole = token_counts.Transducer(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = ["ab" * 3000, "=" * 3000, "a" * 5000, "".join(rng.choices("abcdefghij", k=6000)), "".join(rng.choices("thein", k=3000)) + " x " + "zz" * 500, "漢字" * 900, "".join(rng.choices("abc ", k=5000))]
    want = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_tokens(machine, table, texts, []) == want
    assert [token_counts.count_tokens(machine, table, [t], [])[0] for t in texts] == want


def test_transducer_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    table = np.frombuffer(token_counts.character_classes(path), np.uint8)
    machine, whole = token_counts.Transducer(path), Tokenizer.from_file(path)
    for t in ("antidisestablishmentarianism and more", "quite another text", "antidisestablishmentarianism"):
        assert token_counts.count_tokens(machine, table, [t], []) == [len(whole.encode(t).ids)]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<div class="content-12"><article class="post-7"><h1>Title &amp; more</h1><p>First <b>para</b>graph<br>goes  on<p>Second&nbsp;one
<ul><li>x<li>y</ul><div class="share-box">Share</div><section id="comments"><p>me too, and at some length</p></section></article></div>
<aside>side</aside><div class="cookie-notice">ok?</div><form><p>f</p></form><footer>&copy; s</footer></body></html>"""


def test_page_text():
    assert Page(PAGE).main_text() == "Title & more\nFirst paragraph goes on\nSecond one\nx\ny"
    page = Page(PAGE)
    assert page.path(page.best()[0]) == ("html", "body", "div.content-", "article.post-")
    for html, want in ((None, ""), ("", ""), ("plain &lt;x", "plain <x"), ("<p>a < b", "a < b"), ('<p title="a>b">c', "c"), ("<div>a<!-- x", "a"), ("<script>x", "")):
        assert Page(html).main_text() == want


def test_marks_that_say_something_else():
    """Classes that only contain a mark, and marks on what holds the whole page, drop nothing."""
    w = "word " * 50
    for html, want in (
        (f'<body><div class="layout with-sidebar"><h1>T</h1><p>{w}</p><div class="sidebar">S</div></div></body>', f"T\n{w.strip()}"),
        (f'<body><div class="no-comments post"><p>{w}</p></div></body>', w.strip()),
        (f'<article><p>{w}</p><section class="related-work"><p>see also</p></section><div class="toc-content"><p>more</p></div></article>', f"{w.strip()}\nsee also\nmore"),
        (f'<body><form id="aspnetForm"><h1>A</h1><p>{w}</p><form class="search"><p>find</p></form></form></body>', f"A\n{w.strip()}"),
        ('<article><p title="the hidden gem">Seen</p><p hidden>not</p></article>', "Seen"),
        ("<body><nav>n</nav><div class='ad'>Buy this now</div><article></article></body>", ""),
        (f"<body><article><p>{w}</p></article><div class='site-footer'>f</div><div id='postComments'><p>c</p></div><div role='navigation'>n</div></body>", w.strip()),
    ):
        assert Page(html).main_text() == want


def test_adverts_inside_a_line():
    html = '<article><p>Hello <span class="advert">BUY <span>x</span> NOW</span> world <ins class="adsbygoogle"><div>ad</div>!</ins></p><p>next <button>Click</button> <span class="big">end</span><p>a <span class="ad">open<p>b</article>'
    assert Page(html).main_text() == "Hello world\nnext end\na\nb"


def test_malformed_and_deep_pages_take_little_time():
    began = time.process_time()
    for html in ("<a <" * 250_000, "<p t='" * 80_001, "<p t='>" * 80_001, "<p a=\"x>'\" b='\">" * 50_000, "<div>" * 100_000 + "x", "<svg>" * 100_000, "<script>" * 50_000, "<!-- " * 100_000, "<" * 500_000, "<div><p class='a\">" * 50_000 + "</p></div>" * 50_000, "<span class=ad>" * 100_000 + "<p>x" * 1000):
        page = Page(html)
        page.main_text()
        page.path(page.best()[0])
    assert time.process_time() - began < 15


class PlainReader(HTMLParser):
    """Text of the article element, block by block, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.lines, self.held, self.inside, self.skip = [], "", 0, 0

    def end_block(self):
        if text := " ".join(self.held.split()):
            self.lines.append(text)
        self.held = ""

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style") or dict(attrs).get("class") == "ad"
        if tag == "br":
            self.held += " "
        elif tag not in ("b", "a"):
            self.end_block()

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "br"):
            self.end_block()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.held += data


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="tables are not there")
def test_pages_match_a_plain_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    for r in pages.collect():
        reader = PlainReader()
        # the advert of these pages is one element before the article
        reader.feed(re.sub(r'<div class="ad">.*?</div>', "", r.html or "", flags=re.S))
        reader.close()
        assert got[r.page_id] == "\n".join(reader.lines)


def test_many_hosts_are_joined_alike(spark, monkeypatch):
    page = lambda i: "<body>" + "".join(f"<div class='{'ab'[k]}'><p>{'text ' * (k * i % 7 + 1)}</p></div>" for k in range(2)) + "</body>"
    pages = spark.createDataFrame([(i, f"http://h{i % 4}/", page(i)) for i in range(60)], "page_id long, url string, html string")
    few = sorted(map(tuple, extract_pages(pages).collect()))
    monkeypatch.setattr(html_text, "SENT_HOSTS", 0)
    assert sorted(map(tuple, extract_pages(pages).collect())) == few


def test_hosts_vote(spark):
    """A page whose own best container differs follows its host."""
    good = "<body><div class='main-1'><p>" + "long text of the article " * 20 + "</p></div><div class='extra'><p>tail</p></div></body>"
    odd = "<body><div class='main-2'><p>short</p></div><div class='extra'><p>" + "a much longer tail than the article " * 20 + "</p></div></body>"
    rows = [(i, "https://h.example/" + str(i), good) for i in range(5)] + [(9, "https://H.example/9", odd), (10, None, good), (11, "https://other.example", None), (12, "https://other.example", odd)]
    pages = spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, winner string")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    assert got[9].text == "short" and got[12].text.startswith("a much longer") and got[11].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(rows)
    assert extract_pages(pages.where("false")).count() == 0
