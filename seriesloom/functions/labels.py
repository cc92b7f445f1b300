"""Column functions for labels, names and lines of text that people read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the selection categories.
SELECTION_NAMES = ("dark", "bright", "motion", "user", "random", "auto", "cached")


def filled(text: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(text, F.lit(""))


def episode_marker(season: Column, episode: Column) -> Column:
    """``S01E02`` from the first season and first episode of two text arrays; else the episodes joined by dashes."""
    whole = lambda c: F.try_element_at(c, F.lit(1)).try_cast("int")
    joined = F.coalesce(F.array_join(episode, "-"), F.lit(""))
    both = whole(season).isNotNull() & whole(episode).isNotNull()
    return F.when(both, F.format_string("S%02dE%02d", whole(season), whole(episode))).otherwise(joined)


def clip_label(group: Column, title: Column, marker: Column, episode_title: Column, file: Column) -> Column:
    """``[group] title marker – episode title`` of the parts that there are; the file's name without any."""
    head = filled(F.trim(F.concat_ws(" ", F.concat(F.lit("["), filled(group), F.lit("]")), filled(title), filled(marker))))
    return F.coalesce(filled(F.concat_ws(" – ", head, filled(episode_title))), file)


def track_overrides(entries: Column) -> Column:
    """Map of the entries ``key=number`` of a text array, keys in lower case; the last of a key holds, others are passed over."""
    parts = F.transform(
        entries,
        lambda e: F.struct(F.lower(F.trim(F.substring_index(e, "=", 1))).alias("key"), F.trim(F.substring(e, F.instr(e, "=") + 1, F.length(e))).alias("value")),
    )
    good = F.filter(F.zip_with(entries, parts, lambda e, p: F.when(e.contains("="), p)), lambda p: (p["key"] != "") & p["value"].rlike(r"^[+-]?\d+$"))
    keys = F.array_distinct(F.transform(good, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(good, lambda p: p["key"] == k), -1)["value"].cast("int")
    return F.map_from_arrays(keys, F.transform(keys, last))


def catalogue_form(identifier: Column, category: Column) -> Column:
    """``MOVIE_12`` of an identifier that names its category or is given one; other texts stay as they are."""
    form = r"(?i)^(movie|tv)[/_:-]?(\d+)$"
    text, kind = F.trim(F.coalesce(identifier, F.lit(""))), F.lower(F.trim(F.coalesce(category, F.lit(""))))
    named = F.concat(F.upper(F.regexp_extract(text, form, 1)), F.lit("_"), F.regexp_extract(text, form, 2))
    return F.when(text.rlike(form), named).when(text.rlike(r"^\d+$") & kind.isin("movie", "tv"), F.concat(F.upper(kind), F.lit("_"), text)).otherwise(text)


def name_part(text: Column, most: int = 120) -> Column:
    """Text that can be a file's name: runs of other characters become one underscore, at most ``most`` characters."""
    ends = lambda c: F.regexp_replace(c, r"^[._-]+|[._-]+$", "")
    clean = ends(F.regexp_replace(F.regexp_replace(F.trim(text), r"[^0-9A-Za-z._-]+", "_"), "_+", "_"))
    return F.regexp_replace(F.substring(clean, 1, most), r"[._-]+$", "")


def shortcut_name(name: Column, url: Column, fallback: str = "comparison") -> Column:
    """Name of a shortcut's file: of the collection, else of the URL's last part, else ``fallback``."""
    last = F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)
    return F.concat(F.coalesce(filled(name_part(name)), filled(name_part(last)), F.lit(fallback)), F.lit(".url"))


def console_text(text: Column, most: int | None = 512) -> Column:
    """Text for a terminal: no escape sequences or control characters, single blanks, an ellipsis beyond ``most`` characters."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "\\x1B(?:[@-Z\\\\\\-_]|\\[[0-?]*[ -/]*[@-~])", "")
    shown = F.regexp_replace(F.regexp_replace(plain, r"[\r\n]", " "), r"[[\p{C}\p{Z}]&&[^ \t]]", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(shown, " {2,}", " "), r"\t{2,}", "\t"), r"^[ \t]+|[ \t]+$", "")
    if most is None or most < 0:
        return clean
    if most <= 1:
        return F.when(F.length(clean) > most, F.lit("…"[:most])).otherwise(clean)
    cut = F.concat(F.regexp_replace(F.substring(clean, 1, most - 1), r"[ \t]+$", ""), F.lit("…"))
    return F.when(F.length(clean) > most, cut).otherwise(clean)


def collection_name(template: Column, values: Column) -> Column:
    """Template with ``$name`` and ``${name}`` replaced from a map; unknown names stay, two dollars become one."""
    name = "[_a-zA-Z][_a-zA-Z0-9]*"
    tokens = F.regexp_extract_all(template, F.lit(rf"(\$\$|\$\{{{name}\}}|\${name}|[^$]+|\$)"), F.lit(1))
    key = lambda t: F.regexp_replace(t, r"[${}]", "")
    put = lambda t: F.when(t == "$$", F.lit("$")).when(t.rlike(r"^\$[_a-zA-Z{]"), F.coalesce(F.try_element_at(values, key(t)), t)).otherwise(t)
    return F.array_join(F.transform(tokens, put), "")


def selection_name(label: Column) -> Column:
    """Name of a selection category as shown; other labels trimmed, ``(unknown)`` for none."""
    clean = filled(F.trim(label))
    return F.coalesce(F.when(F.lower(clean).isin(*SELECTION_NAMES), F.initcap(clean)).otherwise(clean), F.lit("(unknown)"))


def selection_line(label: Column) -> Column:
    return F.concat(F.lit("Frame Selection Type: "), selection_name(label))


def short_path(path: Column, width: int, middle: bool = True) -> Column:
    """Path cut to ``width`` less four, at least ten: in the middle before its last part, or at the end."""
    limit = max(10, width - 4)
    text = F.coalesce(path, F.lit(""))
    at_end = F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    if not middle:
        return F.when(F.length(text) <= limit, text).otherwise(at_end)
    tail = F.regexp_extract(text, r"([^/\\]*)$", 1)
    room = F.lit(limit - 1) - F.length(tail)
    head = F.substring(text, F.lit(1), F.least(room, F.length(text) - F.length(tail) - 1))
    in_middle = F.when(room <= 0, F.concat(F.lit("…"), F.substring(tail, F.lit(-(limit - 1)), F.lit(limit - 1)))).otherwise(F.concat(head, F.lit("…"), tail))
    return F.when(F.length(text) <= limit, text).when(text.rlike(r"[/\\]"), in_middle).otherwise(at_end)


def clip_role(pos: Column, name: Column, analysed: Column) -> Column:
    """``analyze`` for the analysed file, else ``ref``, ``tgt``, ``aux2`` and on by position."""
    return F.when(F.lower(name) == F.lower(analysed), "analyze").when(pos == 0, "ref").when(pos == 1, "tgt").otherwise(F.concat(F.lit("aux"), pos.cast("string")))
