"""Crop, letterbox, scale and padding plans as integer columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import cut


def half(c: Column) -> Column:
    return F.floor(c / 2).cast("long")


def mod_crop(clips: DataFrame, mod: int) -> DataFrame:
    """``left``, ``top``, ``right``, ``bottom`` and the cropped size; the far side takes the odd pixel."""
    w, h = (F.col("width") % mod, F.col("height") % mod) if mod > 1 else (F.lit(0), F.lit(0))
    out = clips.withColumns({"left": half(w), "top": half(h)}).withColumns({"right": (w - F.col("left")).cast("long"), "bottom": (h - F.col("top")).cast("long")})
    return out.withColumns({"cropped_w": F.col("width") - F.col("left") - F.col("right"), "cropped_h": F.col("height") - F.col("top") - F.col("bottom")})


def letterbox_offsets(clips: DataFrame, by: str, mod: int, tolerance: float, max_height: int | Column | None = None) -> DataFrame:
    """``top_extra`` and ``bottom_extra`` that bring each clip to its group's widest ratio."""
    ratio = F.col("width") / F.col("height")
    widest = clips.where("width > 0 and height > 0").groupBy(by).agg(F.max(ratio).alias("_t"))
    target = F.rint(F.col("width") / F.col("_t")).cast("long")
    if max_height is not None:
        target = F.least(target, F.lit(max_height))
    if mod > 1:
        target = target - target % mod
    target = F.greatest(F.lit(max(mod, 1)), target)
    cut = F.when((ratio >= F.col("_t") * (1.0 - max(0.0, tolerance))) | (target >= F.col("height")), 0).otherwise(F.col("height") - target)
    out = clips.join(widest, by, "left").withColumn("_c", F.coalesce(cut, F.lit(0)).cast("long"))
    return out.withColumn("top_extra", half(F.col("_c"))).withColumn("bottom_extra", F.col("_c") - F.col("top_extra")).drop("_c", "_t")


def align_crops(clips: DataFrame, by: str) -> DataFrame:
    """Crops groups of equal width to their least cropped height, else those of equal height to the least width."""
    g = clips.groupBy(by).agg(
        (F.countDistinct(F.when(F.col("width") > 0, F.col("width"))) == 1).alias("_w"), (F.countDistinct(F.when(F.col("height") > 0, F.col("height"))) == 1).alias("_h"), F.min("cropped_h").alias("_mh"), F.min("cropped_w").alias("_mw")
    )
    out = clips.join(g, by)
    dh = F.when(F.col("_w"), F.greatest(F.lit(0), F.col("cropped_h") - F.col("_mh"))).otherwise(0)
    dw = F.when(~F.col("_w") & F.col("_h"), F.greatest(F.lit(0), F.col("cropped_w") - F.col("_mw"))).otherwise(0)
    out = out.withColumns({"_dh": dh, "_dw": dw})
    out = out.withColumns({"top": F.col("top") + half(F.col("_dh")), "bottom": F.col("bottom") + F.col("_dh") - half(F.col("_dh")), "left": F.col("left") + half(F.col("_dw")), "right": F.col("right") + F.col("_dw") - half(F.col("_dw"))})
    out = out.withColumns({"cropped_w": F.col("cropped_w") - F.col("_dw"), "cropped_h": F.col("cropped_h") - F.col("_dh")})
    return out.drop("_w", "_h", "_mh", "_mw", "_dh", "_dw")


def _with_shortest(clips: DataFrame, by: str) -> DataFrame:
    return clips.join(clips.groupBy(by).agg(F.min("cropped_h").alias("_short")), by)


def _more_cut(clips: DataFrame) -> DataFrame:
    """Extra rows taken off; an error if none would be left."""
    left = F.col("_full") - F.col("top") - F.col("bottom") - F.col("top_extra") - F.col("bottom_extra")
    cut = F.col("top_extra") + F.col("bottom_extra") > 0
    height = F.when(~cut, F.col("cropped_h")).when(left > 0, left).otherwise(F.raise_error(F.lit("letterbox detection removed all pixels")).cast("long"))
    return clips.withColumns({"cropped_h": height, "top": F.col("top") + F.col("top_extra"), "bottom": F.col("bottom") + F.col("bottom_extra")})


def letterbox_strict(clips: DataFrame, by: str, mod: int, tolerance: float = 0.0) -> DataFrame:
    """Crops found by the ratio of the whole frame, with targets no taller than the group's shortest crop."""
    out = letterbox_offsets(_with_shortest(clips, by), by, mod, tolerance, F.col("_short"))
    return _more_cut(out.withColumn("_full", F.col("height"))).drop("_short", "_full", "top_extra", "bottom_extra")


def letterbox_basic(clips: DataFrame, by: str, mod: int, tolerance: float = 0.0) -> DataFrame:
    """Crops found by the ratio of what is left, only in groups where some clips are boxed and some are not."""
    inner = _with_shortest(clips, by).withColumns({"_w": F.col("width"), "_full": F.col("height"), "width": F.col("cropped_w"), "height": F.col("cropped_h")})
    out = letterbox_offsets(inner, by, mod, tolerance, F.col("_short"))
    some = out.groupBy(by).agg(F.bool_and(F.col("top_extra") + F.col("bottom_extra") > 0).alias("_all"))
    out = out.join(some, by).withColumns({c: F.when(F.col("_all"), 0).otherwise(F.col(c)).cast("long") for c in ("top_extra", "bottom_extra")})
    return _more_cut(out).withColumns({"width": F.col("_w"), "height": F.col("_full")}).drop("_short", "_w", "_full", "_all", "top_extra", "bottom_extra")


def scale_to(clips: DataFrame, target: Column) -> DataFrame:
    """``scaled_w`` and ``scaled_h`` of the cropped size at a target height, half to even."""
    h = F.greatest(F.lit(1), F.rint(target).cast("long"))
    w = F.when(h == F.col("cropped_h"), F.col("cropped_w")).otherwise(F.rint(F.col("cropped_w") * (h / F.col("cropped_h"))).cast("long"))
    return clips.withColumns({"scaled_h": h, "scaled_w": F.greatest(F.lit(1), w)})


def pad_to_mod(clips: DataFrame, width: str, height: str, mod: int, center: bool) -> DataFrame:
    """Widens existing padding until the final size is a multiple of ``mod``; adds ``final_w`` and ``final_h``."""
    padded = F.col("pad_left") + F.col("pad_top") + F.col("pad_right") + F.col("pad_bottom") > 0
    out = clips
    for size, near, far, final in ((width, "pad_left", "pad_right", "final_w"), (height, "pad_top", "pad_bottom", "final_h")):
        total = F.col(size) + F.col(near) + F.col(far)
        more = F.when(padded & (F.lit(mod) > 1), F.pmod(-total, F.lit(max(mod, 1)))).otherwise(0)
        out = out.withColumn(f"_{near}", half(more) if center else F.lit(0).cast("long")).withColumn(f"_{far}", more - F.col(f"_{near}"))
        out = out.withColumn(final, (total + more).cast("long"))
    for c in ("pad_left", "pad_right", "pad_top", "pad_bottom"):
        out = out.withColumn(c, (F.col(c) + F.col(f"_{c}")).cast("long"))
    return out.drop("_pad_left", "_pad_right", "_pad_top", "_pad_bottom")


def even_axis(first: Column, second: Column) -> tuple[Column, Column]:
    """Both ends of an axis made even; a pixel taken from each goes to the far end as two."""
    a, b = F.greatest(F.lit(0), first), F.greatest(F.lit(0), second)
    return a - a % 2, b - b % 2 + F.when((a % 2 != 0) & (b % 2 != 0), 2).otherwise(0)


def odd_axes(top: Column, bottom: Column, left: Column, right: Column) -> Column:
    """``vertical``, ``horizontal`` or both joined by a plus, for axes with an odd end; null for none."""
    odd = lambda *c: F.exists(F.array(*c), lambda x: x % 2 != 0)
    return F.nullif(F.concat_ws("+", F.when(odd(top, bottom), "vertical"), F.when(odd(left, right), "horizontal")), F.lit(""))


def promotion_axes(sub_w: Column, sub_h: Column, crop: tuple[Column, ...], pad: tuple[Column, ...]) -> Column:
    """Axes with subsampled chroma and an odd end of crop or padding (left, top, right, bottom each), or ``none``."""
    odd = lambda *c: F.exists(F.array(*c), lambda x: x % 2 != 0)
    vertical = F.when((sub_h > 0) & odd(crop[1], crop[3], pad[1], pad[3]), "vertical")
    horizontal = F.when((sub_w > 0) & odd(crop[0], crop[2], pad[0], pad[2]), "horizontal")
    return F.coalesce(F.nullif(F.concat_ws("+", vertical, horizontal), F.lit("")), F.lit("none"))


def needs_full_chroma(vertical_odd: Column, horizontal_odd: Column, sub_w: Column, sub_h: Column, policy: Column) -> Column:
    """Whether odd crops or padding call for full chroma: by policy, else where that axis is subsampled."""
    auto = (vertical_odd & (sub_h > 0)) | (horizontal_odd & (sub_w > 0))
    return F.when(policy == "force_full_chroma", True).when(policy == "subsamp_safe", False).otherwise(auto)


def geometry_plan(clips: DataFrame, by: str, mod: int, target_height: int | None, tolerance: float, center: bool = True) -> DataFrame:
    """Crop, letterbox, alignment, scale and padding of every clip against its group.

    The letterbox is added to the crop of the modulus; scaled clips are padded to
    the group's widest and tallest size.
    """
    out = cut(letterbox_offsets(mod_crop(clips, mod), by, mod, tolerance))
    out = out.withColumns({"top": F.col("top") + F.col("top_extra"), "bottom": F.col("bottom") + F.col("bottom_extra"), "cropped_h": F.col("cropped_h") - F.col("top_extra") - F.col("bottom_extra")})
    out = cut(align_crops(out, by))
    tallest = out.groupBy(by).agg(F.max("cropped_h").alias("_tall"))
    out = out.join(tallest, by)
    out = cut(scale_to(out, F.lit(target_height) if target_height else F.col("_tall")))
    largest = out.groupBy(by).agg(F.max("scaled_w").alias("_fw"), F.max("scaled_h").alias("_fh"))
    out = out.join(largest, by)
    w, h = F.col("_fw") - F.col("scaled_w"), F.col("_fh") - F.col("scaled_h")
    split = (lambda c: (half(c), c - half(c))) if center else (lambda c: (F.lit(0).cast("long"), c))
    (left, right), (top, bottom) = split(w), split(h)
    out = out.withColumns({"pad_left": left, "pad_right": right, "pad_top": top, "pad_bottom": bottom}).drop("_fw", "_fh", "_tall")
    return pad_to_mod(out, "scaled_w", "scaled_h", mod, center)


@dataclass(frozen=True)
class GeometryRules:
    """How clips are brought to a common geometry.

    ``letterbox`` is off, strict or basic; ``aligned`` crops groups of equal
    width or height alike; ``height`` is a common height, else that of the
    tallest crop if ``upscale``; ``pad`` is off, on, or auto: no more than
    ``slack`` pixels; ``even`` keeps crops and padding even on axes with
    subsampled chroma.
    """

    mod: int = 2
    letterbox: str = "off"
    tolerance: float = 0.0
    aligned: bool = True
    even: bool = False
    height: int | None = None
    upscale: bool = True
    pad: str = "off"
    slack: int = 8


def _even_sides(clips: DataFrame, near: str, far: str, subsampled: str) -> DataFrame:
    """Both sides of an axis made even where its chroma is subsampled."""
    a, b = even_axis(F.col(near), F.col(far))
    held = F.coalesce(F.col(subsampled) > 0, F.lit(False))
    return clips.withColumns({f"_{near}": F.when(held, a).otherwise(F.col(near)), f"_{far}": F.when(held, b).otherwise(F.col(far))}).withColumns({near: F.col(f"_{near}").cast("long"), far: F.col(f"_{far}").cast("long")}).drop(f"_{near}", f"_{far}")


def plan_geometry(clips: DataFrame, by: str, rules: GeometryRules) -> DataFrame:
    """Crop, letterbox, alignment, scale, padding and final size of every clip against its group.

    ``clips`` has ``width``, ``height``, ``sub_w`` and ``sub_h``. What a group
    decides is an aggregate joined to its clips, each level once: the result of a
    level is written before the next one reads it. Adds ``left``, ``top``,
    ``right``, ``bottom``, ``cropped_*``, ``scaled_*``, ``pad_*``, ``final_*``
    and ``promotion``, the axes whose odd sides ask for full chroma; none if sides
    are kept even instead.
    """
    out = mod_crop(clips, rules.mod)
    if rules.letterbox in ("strict", "basic"):
        boxed = letterbox_strict if rules.letterbox == "strict" else letterbox_basic
        out = cut(boxed(out, by, rules.mod, rules.tolerance))
    if rules.aligned:
        out = cut(align_crops(out, by))
    if rules.even:
        out = _even_sides(_even_sides(out, "top", "bottom", "sub_h"), "left", "right", "sub_w")
        out = out.withColumns({"cropped_w": F.col("width") - F.col("left") - F.col("right"), "cropped_h": F.col("height") - F.col("top") - F.col("bottom")})
    group = out.groupBy(by).agg(F.max("cropped_h").alias("_tall"), F.max("width").alias("_wide"))
    out = out.join(group, by)
    wanted = F.lit(max(1, rules.height)).cast("long") if rules.height else F.col("_tall") if rules.upscale else F.col("cropped_h")
    target = wanted if rules.upscale else F.least(wanted, F.col("cropped_h"))
    out = scale_to(out, target)
    if rules.upscale:
        over = F.col("scaled_w") > F.col("_wide")
        lower = F.greatest(F.lit(1), F.rint(F.col("cropped_h") * (F.col("_wide") / F.col("cropped_w"))).cast("long"))
        out = out.withColumns({"scaled_h": F.when(over, lower).otherwise(F.col("scaled_h")), "scaled_w": F.least("scaled_w", "_wide")})
    out = cut(out)
    zero, room = F.lit(0).cast("long"), {"w": F.lit(None).cast("long"), "h": F.lit(None).cast("long")}
    if rules.pad in ("on", "auto"):
        widest = out.groupBy(by).agg(F.max("scaled_w").alias("_fw"))
        out = out.join(widest, by)
        room["w"] = (F.col("_wide") if rules.height else F.col("_fw")) - F.col("scaled_w")
        if rules.height or rules.upscale:
            room["h"] = wanted - F.col("scaled_h")
    fits = lambda c: F.when((c > 0) & (F.lit(rules.pad == "on") | (c <= max(0, rules.slack))), c).otherwise(zero)
    w, h = fits(room["w"]), fits(room["h"])
    out = out.withColumns({"pad_left": half(w), "pad_right": w - half(w), "pad_top": half(h), "pad_bottom": h - half(h)}).drop("_tall", "_wide", "_fw")
    out = pad_to_mod(out, "scaled_w", "scaled_h", rules.mod, True)
    if rules.even:
        out = _even_sides(_even_sides(out, "pad_top", "pad_bottom", "sub_h"), "pad_left", "pad_right", "sub_w")
        # evened sides may miss the multiple, which is then met once more
        return pad_to_mod(out, "scaled_w", "scaled_h", rules.mod, True).withColumn("promotion", F.lit("none"))
    sides = lambda prefix: tuple(F.col(f"{prefix}{c}") for c in ("left", "top", "right", "bottom"))
    return out.withColumn("promotion", promotion_axes(F.col("sub_w"), F.col("sub_h"), sides(""), sides("pad_")))
