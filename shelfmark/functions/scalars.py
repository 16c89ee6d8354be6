"""Scalar column functions: text, paths, identity, sizes and encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that trimming removes; Spark's own trim takes the space alone.
BLANK = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ws_trim(x: Column | str) -> Column:
    return F.btrim(_c(x), F.lit(BLANK))


def backslashed(path: Column | str) -> Column:
    return F.translate(_c(path), "/", "\\")


def norm_path(path: Column | str) -> Column:
    """Trimmed, lower case, backslashes, no separator at the end; null is empty."""
    return F.regexp_replace(backslashed(F.lower(ws_trim(F.coalesce(_c(path), F.lit(""))))), r"\\+$", "")


def stable_id(path: Column | str) -> Column:
    """Path identity: 16 hex digits of the SHA-1 of the normalised path. A
    separator at the end doesn't change it (a deliberate deviation)."""
    return F.substring(F.sha1(F.encode(norm_path(path), "UTF-8")), 1, 16)


def segments(path: Column | str) -> Column:
    return F.filter(F.split(backslashed(path), r"\\"), lambda s: s != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also within its lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def last(array: Column, back: int = 1) -> Column:
    """The element ``back`` places from the end, null where there is none."""
    return F.try_element_at(array, F.lit(-back))


def extension(name: Column | str) -> Column:
    """Lower-case extension without its dot; leading dots start none."""
    return F.lower(raw_extension(name))


def raw_extension(name: Column | str) -> Column:
    return F.regexp_extract(_c(name), r"(?s)^\.*[^.].*\.([^.]*)$", 1)


def stem(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def clean_names(files: Column | str) -> Column:
    return F.array_sort(F.transform(_c(files), lambda f: F.lower(ws_trim(F.coalesce(f, F.lit(""))))))


def fingerprint(files: Column | str, size: Column | str) -> Column:
    """Content identity that survives a move: the multiset of names, their count
    and the bytes in all; null without names."""
    names = clean_names(files)
    text = F.concat(F.array_join(names, "|"), F.lit("::"), F.size(names).cast("string"), F.lit("::"), F.coalesce(_c(size), F.lit(0)).cast("string"))
    return F.when(F.size(names) > 0, F.substring(F.md5(F.encode(text, "UTF-8")), 1, 16))


def loose_fingerprint(files: Column | str) -> Column:
    """As ``fingerprint``, whatever the bytes."""
    names = clean_names(files)
    text = F.concat(F.array_join(names, "|"), F.lit("::"), F.size(names).cast("string"))
    return F.when(F.size(names) > 0, F.substring(F.md5(F.encode(text, "UTF-8")), 1, 16))


def megabytes(size: Column | str, digits: int) -> Column:
    """Bytes as MB, half up in integers: the same at every tie on every engine."""
    step = 10 ** (6 - digits)
    shifted = _c(size).cast("long") + F.lit(step // 2)
    return (shifted - F.pmod(shifted, F.lit(step))) / F.lit(step) / F.lit(float(10**digits))


def duration(seconds: Column | str) -> Column:
    """89s, 59m, 1h30m: seconds below 90, minutes below 90, then hours."""
    s = F.greatest(F.lit(0), F.floor(_c(seconds)).cast("long"))
    minutes = F.floor(s / 60).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    return (
        F.when(s < 90, F.concat(s.cast("string"), F.lit("s")))
        .when(minutes < 90, F.concat(minutes.cast("string"), F.lit("m")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit("m")))
    )


def thousands(number: Column | str) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(_c(number).cast("long"), 0)


def whole_megabytes(size: Column | str) -> Column:
    """Bytes as a whole number of MB with separators, half up."""
    return thousands(F.floor((F.coalesce(_c(size).cast("long"), F.lit(0)) + 500_000) / 1_000_000))


def gigabytes(size: Column | str) -> Column:
    """Bytes as GB with two digits, half up in integers."""
    cents = F.floor((F.coalesce(_c(size).cast("long"), F.lit(0)) + 5_000_000) / 10_000_000).cast("long")
    return F.concat(thousands(F.floor(cents / 100)), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def stamped(prefix: str, at: Column | str, suffix: str = "") -> Column:
    """A name that holds a time, and sorts by it."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(_c(at), "yyyyMMdd_HHmmss"), F.lit(suffix))


def hex_colour(text: Column | str, fallback: str) -> Column:
    """#rgb or #rrggbb as it is, anything else as ``fallback``."""
    clean = ws_trim(_c(text))
    return F.when(clean.rlike("^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"), clean).otherwise(F.lit(fallback))


def rgb(colour: Column | str) -> Column:
    """Red, green and blue of a hex colour, from 0 to 1."""
    digits = F.regexp_replace(_c(colour), "^#", "")
    wide = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    return F.transform(F.sequence(F.lit(1), F.lit(5), F.lit(2)), lambda k: F.conv(F.substring(wide, k, F.lit(2)), 16, 10).cast("long") / F.lit(255.0))


def html_escaped(text: Column | str) -> Column:
    out = _c(text)
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def file_uri(path: Column | str) -> Column:
    """file:/// and the path, percent-encoded but for / and :."""
    out = F.url_encode(F.translate(_c(path), "\\", "/"))
    for code, plain in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.concat(F.lit("file:///"), out)


def script_safe(json: Column | str) -> Column:
    return F.replace(_c(json), F.lit("</"), F.lit("<\\/"))


def primary_file() -> Column:
    """The file to look for: the recorded one, else the first, else the folder's name."""
    return F.coalesce(F.nullif("primary_file", F.lit("")), F.get("model_files", F.lit(0)), last(segments("path")))
