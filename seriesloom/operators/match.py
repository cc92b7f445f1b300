"""Title matching: query plans, candidate scores, resolution with a margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalar import normal_title, primary_title, reduced_words, roman_value, similarity

from .lookup import sent_if_small
from .ordering import cut

#: Least score of a match, score that ends the search, and margin below which a match is ambiguous.
LEAST, SURE, MARGIN = 0.45, 0.92, 0.08
ROMAN = r"(?i)\b([ivxlcdm]+)\b"


def roman_title(title: Column) -> Column:
    """Title with its first roman numeral as a number, if that is more than 1."""
    sign = F.regexp_extract(title, ROMAN, 1)
    value = roman_value(F.nullif(sign, F.lit("")))
    return F.when(value > 1, F.regexp_replace(title, F.concat(F.lit(r"^(.*?)\b"), sign, F.lit(r"\b")), F.concat(F.lit("$1"), value.cast("string"))))


def query_plans(titles: DataFrame, categories: tuple[str, ...], tolerance: int) -> DataFrame:
    """``id``, ``plan_no``, ``query``, ``year``, ``category``, ``reason`` in the order of the search.

    Each category asks for the title and its derivations; equal queries are asked
    once. With a year, the queries follow again for the years around it.
    """
    t = F.col("title")
    forms = F.array(t, roman_title(t), primary_title(t), reduced_words(t))
    names = F.array(*[F.lit(x) for x in ("primary-title", "roman-numeral", "secondary-title", "reduced-words")])
    cats = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(c).alias("n")) for i, c in enumerate(categories)])
    base = titles.select("id", "year", F.explode(cats).alias("_c"), forms.alias("_f")).select("id", "year", "_c", F.posexplode("_f").alias("_o", "_q"))
    base = base.where("_q is not null and trim(_q) <> ''")
    first = Window.partitionBy("id", F.lower("_q"), "_c.n").orderBy("_o")
    base = base.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    years = F.concat(F.array(F.lit(0)), F.when((F.lit(tolerance) > 0) & F.col("year").isNotNull(), F.filter(F.sequence(F.lit(-tolerance), F.lit(tolerance)), lambda d: d != 0)).otherwise(F.array().cast("array<int>")))
    out = base.select("id", "_c", "_o", "_q", "year", F.explode(years).alias("d"))
    order = Window.partitionBy("id").orderBy((F.col("d") != 0).cast("int"), "_c.c", "_o", "d")
    reason = F.when(F.col("d") == 0, names[F.col("_o")]).otherwise(F.concat(F.lit("year-adjust "), F.format_string("%+d", "d")))
    return out.select("id", F.row_number().over(order).alias("plan_no"), F.trim("_q").alias("query"), (F.col("year") + F.col("d")).alias("year"), F.col("_c.n").alias("category"), reason.alias("reason"))


def score_candidates(pairs: DataFrame, tolerance: int = 2) -> DataFrame:
    """``score`` of rows of ``query``, ``year``, ``title``, ``category``, ``place``, ``candidate_year``, ``popularity``."""
    q, t = normal_title(F.col("query")), normal_title(F.col("title"))
    return pairs.withColumn("score", similarity(q, t) + year_and_fame(tolerance))


def score_all(asked: DataFrame, candidates: DataFrame, tolerance: int = 2) -> DataFrame:
    """``candidates`` for each different ``query`` and ``year``, as ``ask``, with their ``score``: every pair, none left out.

    Titles are compared once for each two different ones. The result is written
    to the shared folder; rows of ``asked`` are joined to it by ``ask_of``.
    """
    q, t = normal_title(F.col("query")), normal_title(F.col("title"))
    entries = candidates.withColumn("_t", t)
    names, titles = asked.select(q.alias("_q")).distinct(), entries.select("_t").distinct()
    alike = cut(names.crossJoin(sent_if_small(titles)).withColumn("_s", similarity(F.col("_q"), F.col("_t"))))
    asks = asked.select("query", "year").distinct().select("query", "year", ask_of(), q.alias("_q"))
    pairs = asks.join(sent_if_small(alike), "_q").join(sent_if_small(entries), "_t")
    return cut(pairs.withColumn("score", F.col("_s") + year_and_fame(tolerance)).select("ask", *candidates.columns, "score"))


def ask_of() -> Column:
    """``ask``: what the score of a row depends on."""
    return F.struct("query", "year").alias("ask")


def year_and_fame(tolerance: int = 2) -> Column:
    """What ``year`` against ``candidate_year``, ``category`` with ``place``, and ``popularity`` add to a score (fixed weights)."""
    gap = F.abs(F.col("candidate_year") - F.col("year"))
    by_year = (
        F.when(F.col("year").isNull(), 0.0)
        .when(F.col("candidate_year").isNull(), -0.05)
        .when(gap <= tolerance, 0.05 * (tolerance - gap + 1))
        .otherwise(-F.least(0.4 + 0.05 * (gap - tolerance), F.lit(0.7)))
    )
    first_tv = F.when((F.col("category") == "TV") & (F.col("place") == 0), 0.01).otherwise(0.0)
    fame = F.when(F.col("popularity") > 0, F.least(F.col("popularity") / 200.0, F.lit(0.05))).otherwise(0.0)
    return first_tv + by_year + fame


def resolve(scored: DataFrame, key: str, candidate: str, among_all: bool = False) -> DataFrame:
    """Best candidate of each key at or above ``LEAST``, its lead over the next such one or over nothing, and whether that next one is too near.

    With ``among_all`` the next one is that of all candidates, and without one the lead is null.
    """
    order = Window.partitionBy(key).orderBy(F.round("score", 9).desc(), candidate)
    viable = scored if among_all else scored.where(F.col("score") >= LEAST)
    out = viable.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order))
    margin = F.col("score") - (F.col("_next") if among_all else F.coalesce("_next", F.lit(0.0)))
    near = F.col("_next").isNotNull() & (F.round(margin, 9) < MARGIN)
    return out.where((F.col("_r") == 1) & (F.col("score") >= LEAST)).select(key, candidate, "score", margin.alias("margin"), near.alias("ambiguous"), (F.col("score") >= SURE).alias("sure"))


def expand_titles(title: Column) -> Column:
    """Searchable forms of a title in order, the first of equal ones in any case.

    The title, single blanks, without years, without parentheses, both sides of a
    delimiter, the parts around ``aka``.
    """
    plain = F.trim(F.regexp_replace(title, r"\s+", " "))
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    sides = []
    for mark in (":", " - ", " – ", " — "):
        at = F.instr(plain, mark)
        sides += [F.when(at > 0, F.substring(plain, F.lit(1), at - 1)), F.when(at > 0, F.substring(plain, at + len(mark), F.length(plain)))]
    parts = F.when(plain.rlike(r"(?i)\baka\b"), F.split(plain, r"(?i)\baka\b")).otherwise(F.array().cast("array<string>"))
    forms = F.concat(
        F.array(F.trim(title), plain, squeezed(F.regexp_replace(plain, r"\b(19|20)\d{2}\b", "")), F.trim(F.regexp_replace(plain, r"\([^)]*\)", "")), *sides),
        parts,
        F.array(F.when(plain.rlike("(?i)vvitch"), F.regexp_replace(plain, "(?i)vvitch", "witch"))),
    )
    clean = F.filter(F.transform(forms, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    start = F.array().cast("array<string>")
    return F.aggregate(clean, start, lambda z, x: F.when(F.exists(z, lambda y: F.lower(y) == F.lower(x)), z).otherwise(F.concat(z, F.array(x))))


def alias_similarity(query: Column, alias: Column) -> Column:
    """Similarity of two normalised titles, at least 0.9 if one begins with the other or holds all its words and more."""
    q, a = F.split(query, " "), F.split(alias, " ")
    holds = (F.size(q) >= 2) & F.forall(q, lambda w: F.array_contains(a, w)) & (F.size(a) > F.size(q))
    begins = (alias.startswith(query) & (F.length(query) >= 4)) | (query.startswith(alias) & (F.length(alias) >= 4))
    return F.greatest(similarity(query, alias), F.when((holds | begins) & (query != "") & (alias != ""), 0.9).otherwise(0.0))


def best_external(candidates: DataFrame, key: str, preference: str | None, place: str) -> DataFrame:
    """Best candidate of each key: those of the preferred category first, then by score, then by place."""
    rank = F.when(F.col("category") == preference, 0).otherwise(1) if preference else F.lit(0)
    order = Window.partitionBy(key).orderBy(rank, F.col("score").desc(), place)
    return candidates.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
