"""Main text of web pages by host-wide consensus on container paths.

Each page's containers are scored by the text they hold outside of boilerplate.
The deepest container that still holds most of it casts a vote, as a path of
tags and classes with numbers left out, and Spark adds up the votes of each host.
Pages are then extracted anew with their host's winning path; a page that does
not have it uses its own best container. The same consensus tells boilerplate
inside: a small container that says the same on most of the host's pages, which
otherwise differ, is left out whatever its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, pick, small_batches, text_slices
from .url_filter import host_of

#: Share of a page's text that a container must hold to stand for it.
HOLDS = 0.7
#: Share from which a marked container that has an article's structure is taken for the page's layout.
LAYOUT = 0.5
#: Containers below this depth count as part of the one above.
DEEPEST = 512
#: Unclosed quotes in tags after which quotes in tags are no longer looked at.
UNCLOSED = 16
#: Hosts whose paths are sent to all tasks at most; beyond it, a shuffled join over so many parts of a host is used.
SENT_HOSTS, PARTS = 100_000, 16
#: Pages of a host, copies counted once, that have a container at least, and share of them on which it says the same, for it to be boilerplate.
LEAST_PAGES, REPEATED = 5, 0.5
#: Share of a page's text above which a container is never taken for boilerplate.
SMALL = 0.2
#: Votes gathered in a task before they are handed on.
HELD_VOTES = 50_000

#: Elements whose content is never text of the page, up to their end tag or the page's end.
RAW = frozenset("script style noscript template textarea title iframe".split())
#: The same, if they have an end tag.
CLOSED = frozenset("object svg math select canvas audio video".split())
#: Elements that always hold boilerplate, and those that do unless they hold the page's layout.
NEVER = frozenset("nav footer menu dialog head".split())
ASIDE = frozenset("aside form fieldset".split())
#: Elements inside a line that hold boilerplate, and those whose classes are looked at for it.
INLINE_ASIDE = frozenset("button label".split())
INLINE = frozenset("span ins small a em".split())
#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that can stand for a page's text.
CONTAINERS = frozenset("article body div main section td center blockquote table html".split())
#: Elements that end one of their name before them.
ENDED = frozenset("p li dt dd tr td th".split())
#: Elements that show an article's structure, and paragraphs that do so together.
STRUCTURE, PARAGRAPHS = frozenset("article main h1".split()), 3
#: Words of classes, identifiers and roles that mark boilerplate.
MARKS = frozenset(
    "ad ads adsbygoogle advert advertisement adverts advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist complementary contentinfo consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation navi newsletter notice notices alert notification overlay pagination pager popup promo promotion related recommended replies respond search share sharing sidebar sidebar-content sidenav signup social sponsor sponsored subscribe subscription toc toolbar topbar widget widgets".split()
)
#: Words that may stand beside a mark in a compound name without changing what it says; any other word does.
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global header container wrapper wrap box block area section slot unit bar list item items link links post posts article story inner outer row col column group panel icon icons button buttons form thread text title label js the user users reader readers visitor visitors articles stories news x".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
_NUMBERS = re.compile(r"\d+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW | CLOSED}


def _is_mark(name: str) -> bool:
    """Whether a class, identifier or role says boilerplate by itself: a mark, or marks beside words that change nothing."""
    if name.lower() in MARKS:
        return True
    parts = [p.lower() for p in _PART.split(_NUMBERS.sub("", name)) if p]
    return any(p in MARKS for p in parts) and all(p in MARKS or p in BESIDE for p in parts)


def _step(name: str, rest: str) -> tuple[str, bool, bool]:
    """An element's part of a path, whether it is marked as boilerplate, and whether it is hidden."""
    if not rest or rest.isspace():
        return name, False, False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    words = found.get("class", "").split()
    step = f"{name}.{_NUMBERS.sub('', words[0].lower())}" if words else name
    hidden = "hidden" in found or found.get("aria-hidden") == "true"
    marked = name not in ("html", "body", "article", "main") and any(map(_is_mark, words + found.get("id", "").split() + found.get("role", "").split()))
    return step, marked, hidden


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether an end tag, and attributes of each tag, in one pass; comments and the like have no name.

    Quoted attributes may hold ``>``. A tag whose quote is never closed ends at
    its first ``>``; one without ``>`` takes the rest of the page.
    """
    at, n, unclosed = 0, len(html), 0
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            end = n if end < 0 else end + 3
            yield start, end, "", False, ""
        elif html.startswith(("<!", "<?"), start):
            cdata = html.startswith("<![CDATA[", start)
            end = html.find("]]>" if cdata else ">", start)
            end = n if end < 0 else end + (3 if cdata else 1)
            yield start, end, "", False, html[start + 9 : end - 3] if cdata else ""
        else:
            closing = html.startswith("</", start)
            name = _NAME.match(html, start + 1 + closing)
            if name is None:
                at = start + 1  # a bare character
                continue
            first = html.find(">", name.end())
            if first < 0:
                yield start, n, "", False, ""
                return
            end, look = -1, name.end()
            while unclosed < UNCLOSED and (stop := _STOP.search(html, look)):
                if stop[0] == ">":
                    end = stop.start()
                    break
                look = html.find(stop[0], stop.end()) + 1
                if not look:
                    unclosed += 1
                    break
            if end < 0:
                end = first
            yield start, end + 1, name[0].lower(), closing, html[name.end() : end]
            end += 1
        at = end


class Page:
    """Blocks of a page in order, each with its container and whether it is boilerplate.

    Containers of the same path of tags and classes are one; they form a tree in
    which each comes after its parent. Marked elements form another one.
    """

    def __init__(self, html: str | None) -> None:
        self.parent, self.step, self.depth = [-1], [""], [0]
        self.named: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[str, int, int, int]] = []  # text, container, mark, characters inside links
        #: Marks: parent, whether never text, and what shows an article's structure.
        self.above, self.never, self.shows = [-1], [False], [0]
        if html:
            self._read(html)
        self.weights = [max(0.0, len(t) - 1.5 * linked) for t, _, _, linked in self.blocks]
        aside = self._aside()
        self.text = [not aside[m] for _, _, m, _ in self.blocks]

    def _node(self, parent: int, step: str) -> int:
        if self.depth[parent] >= DEEPEST:
            return parent
        node = self.named.get((parent, step))
        if node is None:
            node = self.named[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.step.append(step)
            self.depth.append(self.depth[parent] + 1)
        return node

    def _mark(self, above: int, never: bool) -> int:
        self.above.append(above)
        self.never.append(never)
        self.shows.append(0)
        return len(self.above) - 1

    def _read(self, html: str) -> None:
        # element, container, mark, and whether inside a line and not text
        stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        count: dict[str, int] = {}
        held: list[str] = []
        endless: set[str] = set()
        linked, in_link, at, skip = 0, False, 0, 0

        def push(name: str, node: int, mark: int, mute: bool) -> None:
            stack.append((name, node, mark, mute))
            count[name] = count.get(name, 0) + 1

        def pop() -> None:
            count[stack.pop()[0]] -= 1

        def say(text: str) -> None:
            nonlocal linked
            if not stack[-1][3]:
                held.append(text)
                linked += len(text) if in_link else 0

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join(unescape("".join(held)).split())
                if text:  # what was said before an element that is not text belongs to the one around it
                    k = -1
                    while stack[k][3]:
                        k -= 1
                    self.blocks.append((text, stack[k][1], stack[k][2], linked))
                held.clear()
            linked = 0

        for start, end, name, closing, rest in tags(html):
            if start < skip:
                continue
            if start > at:
                say(html[at:start])
            at = end
            if not name:
                if rest:
                    say(rest.replace("&", "&amp;"))
                continue
            if closing:
                if name == "a":
                    in_link = False
                if name in BLOCKS:
                    flush()
                if count.get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if name in _ENDS:
                say(" ")
                last = None if name in endless else _ENDS[name].search(html, end)
                if last or name in RAW:
                    at = skip = last.end() if last else len(html)
                else:
                    endless.add(name)
                continue
            if name == "a":
                in_link = True
            if name == "br":
                say(" ")
            elif name in INLINE_ASIDE or name in INLINE and rest and _step(name, rest)[1:] != (False, False):
                push(name, stack[-1][1], self._mark(stack[-1][2], True), True)
            elif name in BLOCKS:
                flush()
                if name == "hr":
                    continue
                if name in ENDED:  # elements inside the line end with it
                    while stack[-1][3]:
                        pop()
                if stack[-1][0] == "p" or name in ENDED and stack[-1][0] == name or name == "body" and stack[-1][0] == "head":
                    pop()
                step, marked, hidden = _step(name, rest)
                _, node, mark, _ = stack[-1]
                never = name in NEVER or hidden
                if never or marked or name in ASIDE or name == "header" and not (count.get("article") or count.get("main")):
                    mark = self._mark(mark, never)
                self.shows[mark] += PARAGRAPHS if name in STRUCTURE else name == "p"
                push(name, self._node(node, step) if name in CONTAINERS else node, mark, False)
            elif count.get(name):  # inside one of its name that is not text
                push(name, stack[-1][1], stack[-1][2], stack[-1][3])
        if at < len(html):
            say(html[at:])
        flush()

    def _aside(self) -> list[bool]:
        """Whether each mark keeps its blocks out: those that hold the layout of the page do not."""
        held, shows = [0.0] * len(self.above), list(self.shows)
        for (_, _, mark, _), w in zip(self.blocks, self.weights):
            held[mark] += w
        for m in range(len(held) - 1, 0, -1):
            if not self.never[m]:
                held[self.above[m]] += held[m]
                shows[self.above[m]] += shows[m]
        out = [False]
        for m in range(1, len(held)):
            layout = not self.never[m] and held[m] >= LAYOUT * held[0] > 0 and shows[m] >= PARAGRAPHS
            out.append(not layout or out[self.above[m]])
        return out

    def best(self) -> tuple[int, float]:
        """The deepest container that holds most of the page's text, and the text's weight."""
        sums = [0.0] * len(self.parent)
        for (_, node, _, _), w, text in zip(self.blocks, self.weights, self.text):
            if text:
                sums[node] += w
        for k in range(len(sums) - 1, 0, -1):
            sums[self.parent[k]] += sums[k]
        good = [k for k in range(len(sums)) if sums[k] >= HOLDS * sums[0]]
        most = max((self.depth[k], sums[k]) for k in good)
        return max((k for k in good if (self.depth[k], sums[k]) == most), key=self.path), sums[0]

    def path(self, node: int) -> tuple[str, ...]:
        out = []
        while node > 0:
            out.append(self.step[node])
            node = self.parent[node]
        return tuple(reversed(out))

    def find(self, path: tuple[str, ...]) -> int:
        """The container of a path, or -1."""
        node = 0
        for step in path:
            node = self.named.get((node, step), -1)
            if node < 0:
                break
        return node

    def main_text(self, path: tuple[str, ...] | None = None, repeated: list[tuple[str, ...]] = ()) -> str:
        """Blocks below the path, one to a line; below the page's own best container if the path holds none of its text.

        Containers of the paths ``repeated`` are left out, unless nothing else is there.
        """
        top = -1 if path is None else self.find(path)
        if top < 0 or not self._below(top):
            top = self.best()[0]
        gone = {node for p in repeated if (node := self.find(p)) > 0}
        return "\n".join(self._below(top, gone) or self._below(top))

    def _below(self, top: int, gone: set[int] = frozenset()) -> list[str]:
        around, k = set(), top
        while k >= 0:
            around.add(k)
            k = self.parent[k]
        below = [k == top for k in range(len(self.parent))]
        for k in range(1, len(below)):
            below[k] = (below[k] or below[self.parent[k]]) and (k not in gone or k in around)
        return [t for (t, node, _, _), text in zip(self.blocks, self.text) if text and below[node]]

    def parts(self, best: int) -> Iterator[tuple[str, int]]:
        """Path of each small container that is not around the best one, and a hash of all text below it."""
        held: dict[int, list[str]] = {}
        around, k = {0}, best
        while k > 0:
            around.add(k)
            k = self.parent[k]
        for (t, node, _, _), text in zip(self.blocks, self.text):
            while text and node not in around:
                held.setdefault(node, []).append(t)
                node = self.parent[node]
        most = SMALL * sum(len(t) for (t, _, _, _), text in zip(self.blocks, self.text) if text)
        for node, lines in held.items():
            if sum(map(len, lines)) <= most:
                yield "\n".join(self.path(node)), text_hash(lines)

    def whole(self) -> int:
        """A hash of all text of the page."""
        return text_hash([t for (t, _, _, _), text in zip(self.blocks, self.text) if text])


def text_hash(lines: list[str]) -> int:
    v = xxhash.xxh3_64_intdigest("\n".join(lines).encode())
    return v - (1 << 64) if v >> 63 else v


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes for containers of main text (no ``said``), and what other containers say on which page."""
    held: dict[tuple, float] = {}

    def hand_on() -> pa.RecordBatch:
        host, path, said, page = zip(*held)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip((host, path, said, page), kinds)] + [pa.array(held.values(), pa.float64())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["host", "path", "said", "page", "votes"])

    for batch in text_slices(batches, "html"):
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html)
            node, weight = page.best()
            if weight > 0:
                key = (host, "\n".join(page.path(node)), None, None)
                held[key] = held.get(key, 0.0) + weight
                whole = page.whole()
                for path, said in page.parts(node):
                    held[host, path, said, whole] = 0.0
        if len(held) > HELD_VOTES:
            yield hand_on()
    if held:
        yield hand_on()


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row.

    Null or empty html has an empty text; pages with a null url, or one without a
    host, vote together as one host. Ties between paths go to the one that sorts
    last. Repeated rows vote and are extracted one by one; an empty table gives
    an empty result; other columns are ignored. Malformed and deeply nested
    pages take time in proportion to their length.
    """
    small_batches(pages.sparkSession)
    slim = pick(pages, *dict.fromkeys([id_col, url_col, html_col])).select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host_of(F.col(f"`{url_col}`")).alias("host")
    )
    votes = Stored(slim.select("host", "html").mapInArrow(_votes, "host string, path string, said long, page long, votes double"), "votes").df
    summed = votes.where("said is null").groupBy("host", "path").agg(F.round(F.sum("votes"), 3).alias("votes"))
    winners = summed.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("winner"))
    # what a container says on pages that differ: copies of a page are one
    said = votes.where("said is not null").select("host", "path", "said", "page").distinct().groupBy("host", "path", "said").agg(F.count("*").alias("pages"))
    often = said.groupBy("host", "path").agg(F.sum("pages").alias("all"), F.max("pages").alias("most")).where((F.col("all") >= LEAST_PAGES) & (F.col("most") >= REPEATED * F.col("all")))
    paths = often.groupBy("host").agg(F.collect_list("path").alias("repeated"), F.count("*").alias("n"))
    winners = Stored(winners.join(paths, "host", "left").select("host", "winner", "repeated", F.coalesce("n", F.lit(0)).alias("n")), "paths").df
    if (winners.agg(F.count("*") + F.sum("n")).first()[0] or 0) <= SENT_HOSTS:
        joined = slim.join(F.broadcast(winners), "host", "left")
    else:  # a host's pages are dealt out to several tasks
        parts = winners.drop("n").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = slim.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int")).join(parts, ["host", "part"], "left")
    joined = joined.select("page_id", "url", "html", "winner", "repeated")
    schema = T.StructType([slim.schema["page_id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = []
            for html, winner, repeated in zip(*[batch.column(c).to_pylist() for c in ("html", "winner", "repeated")]):
                path = None if winner is None else tuple(winner.split("\n")) if winner else ()
                texts.append(Page(html).main_text(path, [tuple(p.split("\n")) for p in repeated or ()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.mapInArrow(work, schema)
