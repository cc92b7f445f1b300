"""URL verdicts from rules and from trust and distrust spread over host links.

Native DataFrame operations only. Hosts whose pages the rules allow are trusted
seeds, hosts whose pages they block are distrusted ones, each by the share of its
pages. Personalised PageRank carries trust along links, and distrust against
them: who links to blocked hosts is suspect. A page without a rule is blocked if
its host's distrust exceeds its trust by a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Change of all scores together over some rounds, as a share of a seed's own score, at which rounds end; what later ones would add is less than that.
RESIDUAL = 1e-4
#: A host is blocked if distrust exceeds trust by this share of what a seed all of whose pages are blocked has by itself.
EXCESS = 0.5
#: Rules that are written into the plan at most.
MAX_RULES = 1_000
#: Rounds after which lineage is cut and the change is looked at.
EVERY = 6
#: A link with a host of its own, after a scheme or two slashes.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]*)"""


@dataclass(frozen=True)
class Rule:
    """A host with a path prefix, and whether to allow or block it and its subdomains."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules of the production query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Host of a url: what follows ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path of a url: what follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links between different hosts: ``src``, ``dst`` and their number ``w``."""
    found = pages.select(host_of(F.col(f"`{url_col}`")).alias("src"), F.explode(F.regexp_extract_all(F.col(f"`{html_col}`"), F.lit(LINK), F.lit(1))).alias("dst"))
    named = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return named.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def _spread(seeds: DataFrame, links: DataFrame, start: str, end: str) -> DataFrame:
    """``host`` and ``score`` of personalised PageRank along ``start`` to ``end``, in rounds until ``RESIDUAL``.

    Scores only grow from round to round, each time by ``DAMPING`` of the growth
    before at most: the number of rounds follows from the logarithm of the
    seeds' mass, and the sum of all scores tells what is left.
    """
    out = links.groupBy(start).agg(F.sum("w").alias("total"))
    shares = Stored(links.join(out, start).select(F.col(start).alias("a"), F.col(end).alias("b"), (F.col("w") / F.col("total")).alias("share")), "shares").df
    own = seeds.select("host", ((1 - DAMPING) * F.col("seed")).alias("score"))
    now, mass, last = own, 0.0, None
    while True:
        for _ in range(EVERY):
            moved = shares.join(now, F.col("a") == F.col("host")).select(F.col("b").alias("host"), (DAMPING * F.col("score") * F.col("share")).alias("score"))
            now = moved.unionByName(own).groupBy("host").agg(F.sum("score").alias("score"))
        kept = Stored(now, "rank")
        now, before, mass = kept.df, mass, kept.df.agg(F.sum("score")).first()[0] or 0.0
        if last is not None:
            last.drop()
        last = kept
        if mass - before <= RESIDUAL * (1 - DAMPING):
            return now


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    A null url, or one without ``://``, has an empty host and path and no rule;
    it is allowed, as are hosts that nothing is known of. Null html has no links.
    Null identifiers and repeated rows are judged row by row; repeated rows count
    as often in a host's shares. An empty table gives an empty result.
    """
    slim = pick(pages, *dict.fromkeys([id_col, url_col, html_col]))
    url = F.col(f"`{url_col}`")
    parts = slim.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = parts.withColumn("_m", match_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg((F.coalesce(F.col("_m.verdict"), F.lit("")) == v).cast("double"))
    seeds = Stored(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")), "seeds").df
    good = seeds.where("good > 0").select("host", F.col("good").alias("seed"))
    bad = seeds.where("bad > 0").select("host", F.col("bad").alias("seed"))
    links = Stored(host_links(slim, url_col, html_col), "links").df
    if links.isEmpty():  # nothing to spread: scores are the seeds' own
        trust, distrust = (x.select("host", ((1 - DAMPING) * F.col("seed")).alias("score")) for x in (good, bad))
    else:
        trust, distrust = _spread(good, links, "src", "dst"), _spread(bad, links, "dst", "src")
    scores = distrust.withColumnRenamed("score", "bad").join(trust.withColumnRenamed("score", "good"), "host", "left")
    excess = F.round(F.col("bad") - F.coalesce("good", F.lit(0.0)), 12)
    blocked = Stored(scores.where(excess > EXCESS * (1 - DAMPING)).select("host", F.lit(True).alias("_b")), "blocked").df
    method = F.when(F.col("_b"), F.lit("block")).otherwise(F.lit("allow"))
    done = judged.join(blocked, "host", "left")
    return done.select("page_id", "host", "path", F.col("_m.rule").alias("rule"), F.coalesce(F.col("_m.verdict"), method).alias("verdict"))
