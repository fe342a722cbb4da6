"""Column functions for times, texts, addresses and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python's str.strip() and str.split() take as white space beyond those of a plain Java \s.
SPACE = r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def bound(value: Column, then) -> Column:
    """then(value), with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def half_even(x: Column) -> Column:
    """To the nearest integer, ties to even, as BIGINT."""
    return F.rint(x).cast("long")


def exact_round(digits: int):
    """A function of a DOUBLE column that rounds to so many decimals, correctly from the binary value, exact ties to even; no built-in does.

    x * 10^digits is taken as its rounded product and that product's error, which splitting x into two halves of its bits gives
    exactly. The error decides what lies next to a tie. Beyond a magnitude the doubles are farther apart than the decimals, and x stays.
    """
    scale = float(10**digits)
    whole = float(1 << (52 - int(scale).bit_length() + 1))

    def rounded(x: Column) -> Column:
        a = F.abs(x)
        product = a * scale
        spread = a * 134217729.0
        high = spread - (spread - a)
        error = (high * scale - product) + (a - high) * scale
        floor = F.floor(product).cast("double")
        part = product - floor
        odd = floor % 2 != 0
        # without branches, as generated code computes what they share only once outside of them
        up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & odd))) | ((part == 0) & (error == 0.5) & odd)
        down = (part == 0) & (error == -0.5) & odd
        nearest = (floor + up.cast("double") - down.cast("double")) / scale
        return F.get(F.array(x, F.signum(x) * nearest), (~((a >= whole) | (x == 0))).cast("int"))

    return rounded


#: Fixed pattern: the byte sequences of UTF-8 beyond ASCII, one char of ISO-8859-1 per byte, and any other byte beyond ASCII.
_MULTIBYTE = "([\\xC2-\\xDF][\\x80-\\xBF]|\\xE0[\\xA0-\\xBF][\\x80-\\xBF]|[\\xE1-\\xEC\\xEE\\xEF][\\x80-\\xBF]{2}|\\xED[\\x80-\\x9F][\\x80-\\xBF]|\\xF0[\\x90-\\xBF][\\x80-\\xBF]{2}|[\\xF1-\\xF3][\\x80-\\xBF]{3}|\\xF4[\\x80-\\x8F][\\x80-\\xBF]{2})|[\\x80-\\xFF]"


def lenient_text(content: Column) -> Column:
    """UTF-8 bytes as text; bytes that are not part of a whole character are left out."""
    return F.encode(F.regexp_replace(F.decode(content, "ISO-8859-1"), _MULTIBYTE, "$1"), "ISO-8859-1").cast("string")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def collapse_space(x: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(x, rf"{SPACE}+", " "))


def strip_tags(x: Column) -> Column:
    """Without <...> and white space at the ends."""
    return strip(F.regexp_replace(x, "<[^>]+>", ""))


def parse_time(x: Column, strict: bool = False) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS[.frac] as DOUBLE. Minutes and seconds may exceed 59. Blank and null give null.

    What cannot be read gives null, or an error if strict. Leading parts are whole numbers.
    """
    text = strip(x.cast("string"))
    parts = F.split(text, ":")
    n = F.size(parts)
    lead = lambda i: F.get(parts, i).try_cast("long").cast("double")
    last = F.get(parts, n - 1).try_cast("double")
    seconds = F.when(n == 1, last).when(n == 2, lead(0) * 60 + last).when(n == 3, lead(0) * 3600 + lead(1) * 60 + last)
    if strict:
        seconds = F.coalesce(seconds, F.raise_error(F.concat(F.lit("not a time: "), text)).cast("double"))
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("double")).otherwise(seconds)


def format_time(seconds: Column) -> Column:
    """H:MM:SS, or MM:SS where the hours are 0; rounded half-even. Null, as in the other forms, stays null."""
    t = half_even(seconds)
    h, m, s = F.floor(t / 3600), F.floor(F.pmod(t, F.lit(3600)) / 60), F.pmod(t, F.lit(60))
    return F.when(h != 0, F.format_string("%d:%02d:%02d", h, m, s)).when(t.isNotNull(), F.format_string("%02d:%02d", m, s))


def format_clock(seconds: Column) -> Column:
    """M:SS without hours; rounded half-even."""
    t = half_even(seconds)
    return F.when(t.isNotNull(), F.format_string("%d:%02d", F.floor(t / 60), F.pmod(t, F.lit(60))))


def cue_clock(seconds: Column) -> Column:
    """M:SS without hours; truncated."""
    t = seconds.cast("long")
    return F.when(t.isNotNull(), F.format_string("%d:%02d", F.floor(t / 60), F.pmod(t, F.lit(60))))


def cue_stamp(seconds: Column) -> Column:
    """[MM:SS], truncated; minutes run past 59."""
    t = seconds.cast("long")
    return F.when(t.isNotNull(), F.format_string("[%02d:%02d]", F.floor(t / 60), F.pmod(t, F.lit(60))))


def is_url(x: Column) -> Column:
    """http or https with a host, in any case."""
    return F.coalesce(x.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def is_video_host(x: Column) -> Column:
    """Whether the address is at one of the two video hosts, a leading www. and then m. aside; ports and other subdomains fail."""
    host = F.lower(F.regexp_extract(x, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^m\.", "")
    return F.coalesce(host.isin("youtube.com", "youtu.be"), F.lit(False))


def is_significant(text: Column, min_chars: int = 10) -> Column:
    """At least so many characters other than U+0020."""
    return F.length(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(""))) >= min_chars


def size_label(size: Column) -> Column:
    """Whole KB under a megabyte, else MB with one decimal."""
    return F.when(size < 1024 * 1024, F.format_string("%d KB", half_even(size / 1024))).otherwise(F.format_string("%.1f MB", size / (1024.0 * 1024.0)))


def shortened(text: Column, limit: int = 400) -> Column:
    return F.substring(text, 1, limit)


def state_name(state: Column) -> Column:
    """The last dotted part of a state's name."""
    return F.substring_index(state, ".", -1)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
