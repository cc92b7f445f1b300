"""How values are shown: truth values, numbers, filters, overlay lines, defaults among labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import variants as V
from .labels import selection_line, short_path
from .scalar import safe_label

#: Texts that mean true and false (fixed values).
TRUE_TEXTS = ("true", "yes", "1", "enabled", "on")
FALSE_TEXTS = ("false", "no", "0", "disabled", "off")
#: Properties that blank frames keep, by their name or the start of it without leading underscores (fixed values).
KEPT_NAMES = ("matrix", "primaries", "transfer", "colorrange")
KEPT_STARTS = ("masteringdisplay", "contentlightlevel")


def truth_of(value: Column) -> Column:
    """Truth of a VARIANT: truth values, numbers other than 0, and the texts that mean one; anything else is null."""
    text = F.lower(F.trim(V.part(value, "$", "string")))
    spelled = F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False)
    return F.when(V.kind_of(value) == "BOOLEAN", V.part(value, "$", "boolean")).when(V.is_number(value), V.part(value, "$", "double") != 0).when(V.kind_of(value) == "STRING", spelled)


def number_shown(value: Column) -> Column:
    """Number of a VARIANT: truth values are 1 and 0, texts may have thousands commas; anything else is null."""
    text = F.trim(F.replace(V.part(value, "$", "string"), F.lit(","), F.lit(""))).try_cast("double")
    return F.when(V.kind_of(value) == "BOOLEAN", V.part(value, "$", "boolean").cast("double")).when(V.is_number(value), V.part(value, "$", "double")).when(V.kind_of(value) == "STRING", text)


def shown(value: Column, decimals: int = 2, separator: str | None = None) -> Column:
    """Text of a VARIANT: nothing for null, whole numbers with a thousands separator, others with so many decimals, ties of their decimal text away from 0."""
    whole = F.to_json(value) if separator is None else F.replace(F.format_number(V.part(value, "$", "long"), 0), F.lit(","), F.lit(separator))
    kind = V.kind_of(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), "")
        .when(kind == "BOOLEAN", F.to_json(value))
        .when(kind == "BIGINT", whole)
        .when(V.is_number(value), F.format_string(f"%.{decimals}f", V.part(value, "$", "double")))
        .when(kind == "STRING", V.part(value, "$", "string"))
        .otherwise(F.to_json(value))
    )


def display_filter(text: Column, name: str, width: int = 80) -> Column:
    """A text through a named filter; other names leave it as it is."""
    empty = F.coalesce(text, F.lit("")) == ""
    if name == "bool":
        return F.when(empty, "false").otherwise("true")
    if name in ("none", "unchanged", "tallest"):
        return F.when(empty, name).otherwise(text)
    return short_path(text, width) if name == "ellipsis" else text


def blank_props(props: Column) -> Column:
    """The properties that blank frames before a clip carry."""
    plain = lambda k: F.lower(F.ltrim(k, F.lit("_")))

    def kept(k: Column, _: Column) -> Column:
        out = plain(k).isin(*KEPT_NAMES)
        for start in KEPT_STARTS:
            out = out | plain(k).startswith(start)
        return out

    return F.map_filter(props, kept)


def default_encode(label: Column, encodes: Column) -> Column:
    """Label of the encode that a text names: by its label, else by its file-safe label; null for none.

    ``encodes`` is a list of structs of ``label`` and ``safe_label``.
    """
    asked = F.nullif(F.trim(label), F.lit(""))
    plain = F.get(F.filter(encodes, lambda e: e["label"] == asked), F.lit(0))["label"]
    safe = F.get(F.filter(encodes, lambda e: e["safe_label"] == safe_label(asked)), F.lit(0))["label"]
    return F.when(asked.isNotNull(), F.coalesce(plain, safe))


def resolution_text(width: Column, height: Column, final_width: Column, final_height: Column) -> Column:
    """Cropped size, and the final one if it is another."""
    size = lambda w, h: F.concat_ws(" × ", w.cast("string"), h.cast("string"))
    before, after = size(width, height), size(final_width, final_height)
    return F.when(before == after, F.concat(before, F.lit("  (native)"))).otherwise(F.concat(before, F.lit(" → "), after, F.lit("  (original → target)")))


def overlay(base: Column, resolution: Column, selection: Column, *details: Column) -> Column:
    """Lines of an overlay: the base text if there is any, the resolution, then the selection, or in its place the details that are there."""
    more = details or (selection_line(selection),)
    return F.concat_ws("\n", F.nullif(base, F.lit("")), resolution, *[F.nullif(line, F.lit("")) for line in more])
