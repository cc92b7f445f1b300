"""Column functions: time text, number coercion, colour maths, file names, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frame rate assumed where none is given.
DEFAULT_FPS = 24000.0 / 1001.0

# Fixed values of the PQ transfer function (SMPTE ST 2084).
PQ_M1 = 2610.0 / 4096.0 / 4.0
PQ_M2 = 2523.0 / 4096.0 * 128.0
PQ_C1 = 3424.0 / 4096.0
PQ_C2 = 2413.0 / 4096.0 * 32.0
PQ_C3 = 2392.0 / 4096.0 * 32.0


def fps_value(num: Column, den: Column) -> Column:
    """Frames a second of a rational rate; 0 without a usable denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0))), F.lit(0.0))


def timecode(frame: Column, fps: Column) -> Column:
    """``HH:MM:SS.mmm`` of a frame; null where the rate is not positive."""
    ms = F.rint(frame / fps * 1000).cast("long")
    return F.when(
        fps > 0,
        F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000),
    )


def seconds_text(value: Column) -> Column:
    """``HH:MM:SS.s``, tenths rounded half to even."""
    tenths = F.rint(F.greatest(value, F.lit(0.0)) * 10).cast("long")
    return F.format_string("%02d:%02d:%02d.%d", F.floor(tenths / 36000), F.floor(tenths / 600) % 60, F.floor(tenths / 10) % 60, tenths % 10)


def clock_text(value: Column) -> Column:
    """``MM:SS``, or ``H:MM:SS`` from an hour on; dashes for null, NaN and infinity."""
    s = F.floor(value).cast("long")
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    short = F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(usable, F.when(value >= 3600, long).otherwise(short)).otherwise(F.lit("--:--"))


def pq_to_nits(value: Column) -> Column:
    """Luminance of a PQ value from 0 to 1, or of a 12-bit code above 1."""
    v = F.when(value > 1, value / 4095.0).otherwise(value)
    p = F.pow(v, F.lit(1.0 / PQ_M2))
    linear = F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (PQ_C2 - PQ_C3 * p), F.lit(1.0 / PQ_M1)) * 10000.0
    return F.when(v <= 0, F.lit(0.0)).otherwise(linear)


def to_8bit(value: Column, bits: Column, is_float: Column) -> Column:
    """Sample value on the scale of 8 bits; null without a positive depth."""
    whole = F.when(bits > 0, value * 255.0 / (F.pow(F.lit(2.0), bits) - 1))
    return F.when(is_float, value * 255.0).otherwise(whole)


def rgb_range(low8: Column, high8: Column) -> Column:
    """``limited`` or ``full`` from the extremes of RGB planes on the 8-bit scale, or null."""
    limited = (high8 <= 235 + 12) | ((high8 - low8 <= 6) & (low8 <= 16 + 12))
    full = (high8 >= 235 + 6) & (low8 <= 16 - 6)
    return F.when(low8.isNull() | high8.isNull(), F.lit(None).cast("string")).when(limited, "limited").when(full, "full")


def even_floor(value: Column) -> Column:
    """The value, one less if it is odd."""
    return value - (value % 2 != 0).cast("int")


def clamp_frame(frame: Column, total: Column) -> Column:
    """Frame within a clip of ``total`` frames."""
    return F.greatest(F.lit(0), F.least(total - 1, frame))


def source_frame(frame: Column, trim: Column) -> Column:
    """Frame before trimming; null inside the blank frames of a negative trim."""
    return F.when(trim >= 0, frame + trim).when(frame + trim >= 0, frame + trim)


def number(text: Column) -> Column:
    """Number in a text that may hold thousands separators; null if there is none or it is not finite."""
    v = F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def year_hint(text: Column) -> Column:
    """A year from 1900 to 2100."""
    y = F.trim(text).try_cast("int")
    return F.when(y.between(1900, 2100), y)


def year_in(text: Column) -> Column:
    """First year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(text, r"(?:19|20)\d\d", 0), F.lit("")).try_cast("int")


def release_group(name: Column) -> Column:
    """Text in the brackets that open a file name."""
    return F.nullif(F.regexp_extract(name, r"^\[([^\]]+)\]", 1), F.lit(""))


def version_suffix(stem: Column) -> Column:
    """Version mark such as ``V2`` that begins a part of a file's stem and has no further digit."""
    return F.nullif(F.upper(F.regexp_extract(stem, r"(?i)(?:^|[^0-9a-z])(v[0-9]{1,3})(?![0-9])", 1)), F.lit(""))


def file_stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def safe_label(label: Column) -> Column:
    """Label that can be part of a file name."""
    clean = F.trim(F.regexp_replace(label, r'[<>:"/\\|?*]', "_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("comparison"))


def label_pair(label: Column, stem: Column, override: Column) -> tuple[Column, Column]:
    """Raw and safe label of a clip: the label, else its file's stem; the safe one may be given."""
    raw = F.coalesce(F.nullif(label, F.lit("")), stem)
    clean = safe_label(F.coalesce(F.nullif(F.trim(override), F.lit("")), raw))
    return F.coalesce(F.nullif(F.trim(raw), F.lit("")), clean), clean


def drawtext(text: Column) -> Column:
    """Text escaped for a filter's argument."""
    for mark in ("\\", ":", "=", ",", "[", "]", "'"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return F.replace(text, F.lit("\n"), F.lit("\\\\n"))


def manual_id(text: Column) -> Column:
    """``category`` and ``id`` of a catalogue identifier such as ``tv/12``; null if it is none."""
    form = r"^(movie|tv)[/:-]?(\d+)$"
    clean = F.lower(F.trim(text))
    return F.when(clean.rlike(form), F.struct(F.upper(F.regexp_extract(clean, form, 1)).alias("category"), F.regexp_extract(clean, form, 2).alias("id")))


def title_candidates(*titles: Column) -> Column:
    """Titles of a payload in order, without empty ones and repeats in another case."""
    given = F.filter(F.transform(F.array(*titles), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    seen = F.array_distinct(F.transform(given, F.lower))
    return F.transform(seen, lambda key: F.element_at(F.filter(given, lambda t: F.lower(t) == key), 1))


def image_name(frame: Column, label: Column) -> Column:
    """Name of a frame's image."""
    return F.concat(frame.cast("string"), F.lit(" - "), safe_label(label), F.lit(".png"))


def category_key(label: Column) -> Column:
    """Lower-case key of a category."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("uncategorized"))


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, all that logs may show; an address in brackets without them."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.lower(F.nullif(F.regexp_replace(host, r"^\[|\]$", ""), F.lit("")))


def private_v4(host: Column) -> Column:
    """Whether a host is an IPv4 address that no public server has."""
    part = lambda k: F.split_part(host, F.lit("."), F.lit(k)).try_cast("int")
    a, b, c = part(1), part(2), part(3)
    # fixed ranges: this network, private, loopback, link-local, protocol, documentation, benchmarking, reserved
    inside = (
        a.isin(0, 10, 127)
        | (a >= 240)
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return host.rlike(rf"^{octet}(?:\.{octet}){{3}}$") & inside


def private_v6(host: Column) -> Column:
    """Whether a host is an IPv6 address outside of global unicast and multicast, or one kept for documentation and tunnels."""
    hextet = lambda k: F.conv(F.coalesce(F.nullif(F.split_part(host, F.lit(":"), F.lit(k)), F.lit("")), F.lit("0")), 16, 10).cast("int")
    a, b = hextet(1), hextet(2)
    kept = (a == 0x2002) | ((a == 0x2001) & ((b < 0x200) | (b == 0xDB8))) | ((a == 0x3FFF) & (b < 0x1000))
    outside = ~(a.between(0x2000, 0x3FFF) | (a >= 0xFF00))
    return host.contains(":") & (outside | kept)


def safe_webhook(url: Column) -> Column:
    """Whether a URL is https and its host neither this machine's name nor a private or reserved address, by its text alone."""
    host = url_host(url)
    return F.coalesce(F.lower(url).startswith("https://") & host.isNotNull() & (host != "localhost") & ~private_v4(host) & ~private_v6(host), F.lit(False))


def upload_timeout(base: Column, size: Column) -> Column:
    """Seconds allowed for an upload: the base, or the time at 256 KiB a second plus 15 s."""
    return F.greatest(base, size / (256.0 * 1024.0) + 15.0)


def retryable(message: Column, marks: tuple[str, ...] = ("timeout", "timed out", "connection", "temporarily", "request failed", "429", "502", "503", "504")) -> Column:
    """Whether an error text names a passing failure."""
    return F.lower(message).rlike("|".join(marks))


def fold_sequence(values: Column, head: int, tail: int, joiner: str = ", ") -> Column:
    """Head and tail of a list with an ellipsis between; the whole list if it is short enough or no tail is asked."""
    whole = F.array_join(values, joiner)
    if tail <= 0:
        return whole
    ends = F.concat(F.slice(values, 1, head), F.array(F.lit("…")), F.slice(values, -tail, tail))
    return F.when(F.size(values) <= head + tail, whole).otherwise(F.array_join(ends, joiner))


def roman_value(text: Column) -> Column:
    """Value of a roman numeral, read with subtraction of what a larger sign follows; null if it is none."""
    signs = F.create_map(*[F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair])
    values = F.transform(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(signs, c), F.lit(-10000000)))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda z, v: F.struct((z["sum"] + F.when(v > z["last"], v - 2 * z["last"]).otherwise(v)).alias("sum"), v.alias("last"))
    total = F.aggregate(values, start, step, lambda z: z["sum"])
    return F.when(F.upper(text).rlike("^[IVXLCDM]+$") & (total > 0), total)


def normal_title(title: Column) -> Column:
    """Lower-case words and digits of a title with single blanks; ``&`` becomes ``and``."""
    spelled = F.replace(F.coalesce(title, F.lit("")), F.lit("&"), F.lit(" and "))
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(spelled, r"[^0-9A-Za-z\s]", " "), r"\s+", " ")))


def title_variants(title: Column) -> Column:
    """Sorted spellings of a normalised title: as is, without a leading article, and with vv and w exchanged."""
    out = F.array(
        title,
        F.when(title.startswith("the "), F.substring(title, F.lit(5), F.length(title))),
        F.replace(title, F.lit("vv"), F.lit("w")),
        F.when(title.contains("w"), F.replace(title, F.lit("w"), F.lit("vv"))),
    )
    return F.array_sort(F.array_distinct(F.filter(out, lambda x: x.isNotNull() & (x != ""))))


def similarity(left: Column, right: Column) -> Column:
    """Characters of the shorter text found one after the other in the longer, as a share of the longer.

    A character that no longer occurs is passed over; equal texts give 1, an
    empty one 0.
    """
    shorter = F.when(F.length(left) <= F.length(right), left).otherwise(right)
    longer = F.when(F.length(left) <= F.length(right), right).otherwise(left)
    pair = F.struct(shorter.alias("s"), longer.alias("l"))
    chars = F.filter(F.split(pair["s"], ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(z: Column, c: Column) -> Column:
        place = F.locate_from(c, longer, z["at"] + 1) if hasattr(F, "locate_from") else F.call_function("locate", c, longer, z["at"] + 1)
        return F.struct((z["n"] + (place > 0).cast("int")).alias("n"), F.when(place > 0, place).otherwise(z["at"]).alias("at"))

    hits = F.aggregate(chars, start, step, lambda z: z["n"])
    usable = (F.length(left) > 0) & (F.length(right) > 0)
    return F.when(~usable | left.isNull() | right.isNull(), F.lit(0.0)).when(left == right, F.lit(1.0)).otherwise(hits / F.length(longer))


def primary_title(title: Column) -> Column:
    """What stands before the first kind of delimiter that occurs: colon, dash between blanks, parenthesis."""
    out = F.lit(None).cast("string")
    for mark in reversed((":", " - ", " (", " – ")):
        head = F.trim(F.substring_index(title, mark, 1))
        out = F.when(title.contains(mark) & (head != "") & (head != title), head).otherwise(out)
    return out


def reduced_words(title: Column) -> Column:
    """Words of more than two characters, if that leaves any out and some in."""
    words = F.regexp_extract_all(title, F.lit(r"([A-Za-z0-9']+)"), F.lit(1))
    kept = F.filter(words, lambda w: F.length(w) > 2)
    return F.when((F.size(kept) > 0) & (F.size(kept) < F.size(words)), F.array_join(kept, " "))


def strip_noise(name: Column) -> Column:
    """Title part of a release's file name."""
    # fixed list of words that name formats, not titles
    noise = (
        "480p|576p|720p|1080p|2160p|4320p|x264|h264|hevc|x265|av1|hdr|sdr|remux|webrip|web-dl|bluray|blu-ray|"
        "dvdrip|multi|10bit|proper|repack|extended|uhd|nf|amzn"
    )
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"^\[[^\]]+\]", "")
    spaced = F.translate(stem, "[]{}()_.", "        ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, rf"(?i)\b({noise})\b", ""), r"\s+", " "))


def frame_hint(stored: Column, seconds: Column, fps: Column) -> Column:
    """Frames as stored, else seconds times rate, half to even."""
    return F.coalesce(stored.cast("long"), F.when(fps > 0, F.rint(seconds * fps)).cast("long"))


def first_rate(*pairs: tuple[Column, Column]) -> Column:
    """First positive rate among pairs of numerator and denominator, or null."""
    return F.coalesce(*[F.when((n > 0) & (d > 0), n.cast("double") / d) for n, d in pairs])


def highlight(value: Column, rules: list[tuple[str, float, str]]) -> Column:
    """Name of the first rule that holds: ``gt``, ``lt``, ``abs_gt``, ``abs_gte``, ``abs_lt`` with a bound."""
    tests = {"gt": lambda v, b: v > b, "lt": lambda v, b: v < b, "abs_gt": lambda v, b: F.abs(v) > b, "abs_gte": lambda v, b: F.abs(v) >= b, "abs_lt": lambda v, b: F.abs(v) < b}
    return F.coalesce(*[F.when(tests[kind](value, bound), F.lit(name)) for kind, bound, name in rules], F.lit(None).cast("string"))


def compression_level(level: Column) -> Column:
    """PNG level of 0, 1 or 2, clamped: 0, 6 or 9."""
    return F.element_at(F.array(F.lit(0), F.lit(6), F.lit(9)), (F.greatest(F.lit(0), F.least(F.lit(2), level)) + 1).cast("int"))


def valid_index(value: Column, total: Column) -> Column:
    """Whether a number is whole and lies within a clip of ``total`` frames."""
    return (value == F.floor(value)) & (value >= 0) & (value < total)
