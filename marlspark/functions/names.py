"""Codes, names and addresses that come from outside: whether they may be used, and what they are stored as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shape of a taxonomy code and the longest name, characters that no file name holds, stems that some systems keep, types that are stored.
CODE, NAME_CHARS = "^[a-z0-9][a-z0-9_-]{0,99}$", 200
UNSAFE, RESERVED = r'[\x00-\x1f<>:"/\\|?*]', r"^(?i:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\.|$)"
STORED_TYPES = ("txt", "md", "pdf", "docx", "xlsx", "csv")
#: Code units of a stem that leave room for a number behind it.
STEM_UNITS = 160
#: IPv4 networks that aren't public, as first address and prefix length.
NOT_PUBLIC = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
)


def taxonomy_code(code: Column) -> Column:
    """The code without outer blanks; null if it isn't one."""
    value = F.trim(F.coalesce(code, F.lit("")))
    return F.when(value.rlike(CODE), value)


def taxonomy_name(name: Column) -> Column:
    """The name without outer blanks; null if it is empty or too long."""
    value = F.trim(F.coalesce(name, F.lit("")))
    return F.when(F.length(value).between(1, NAME_CHARS), value)


def stored_parts(name: Column) -> Column:
    """A struct of (stem, suffix) that a file is stored under; null for types that aren't stored.

    Folders go, characters that no name holds become underscores, outer blanks and dots go, a reserved stem gets
    an underscore before it, and long stems are cut.
    """
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    clean = F.btrim(F.regexp_replace(base, UNSAFE, "_"), F.lit(" ."))
    suffix = F.regexp_extract(clean, r"^.+(\.[^.]+)$", 1)
    stem = F.substr(clean, F.lit(1), F.length(clean) - F.length(suffix))
    free = F.when(stem.rlike(RESERVED), F.concat(F.lit("_"), stem)).otherwise(stem)
    # A character beyond the basic plane takes two units, and is left out where only one is left.
    cut = F.regexp_extract(free, rf"^(?s)(.{{0,{STEM_UNITS}}})", 1)
    wide = F.length(cut) + F.length(F.regexp_replace(cut, r"[^\x{10000}-\x{10ffff}]", "")) > STEM_UNITS
    astral = lambda k: F.length(F.regexp_replace(F.substr(cut, F.lit(1), k), r"[^\x{10000}-\x{10ffff}]", ""))
    room = F.array_max(F.filter(F.sequence(F.lit(0), F.length(cut)), lambda k: k + astral(k) <= STEM_UNITS))
    units = F.substr(cut, F.lit(1), room)
    return F.when(F.lower(F.substring(suffix, 2, 10)).isin(*STORED_TYPES), F.struct(F.when(wide, units).otherwise(cut).alias("stem"), suffix.alias("suffix")))


def safe_code(value: Column) -> Column:
    """A code as part of a path; `unknown` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "[^A-Za-z0-9._-]+", "_"), F.lit("")), F.lit("unknown"))


def shown_filename(value: Column) -> Column:
    """The last part of a path, of 255 characters at most; `image` if there is none."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(value, F.lit("")), F.lit("image")), r"\\", "/"), "(?:/+\\.?)+$", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_extract(path, "([^/]*)$", 1), 1, 255), F.lit("")), F.lit("image"))


def _number(address: Column) -> Column:
    parts = F.transform(F.split(address, r"\."), lambda p: p.cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)


def unsafe_url(url: Column) -> Column:
    """Why a url may not be fetched: INVALID, CREDENTIALS or LOCAL; null if nothing in its text speaks against it.

    Names are not resolved: whoever fetches must look at the addresses too.
    """
    value = F.trim(F.coalesce(url, F.lit("")))
    authority = F.regexp_extract(value, r"^(?i:https?)://([^/?#]*)", 1)
    account = F.regexp_extract(authority, "^(.*)@", 1)
    host = F.lower(F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)(?::[0-9]*)?$", 1))
    name = F.rtrim(host, F.lit("."))
    four = name.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")
    inside = F.lit(False)
    for first, length in NOT_PUBLIC:
        a, b, c, d = map(int, first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        inside = inside | _number(name).between(low, low + (1 << 32 - length) - 1)
    six = name.rlike(r"^\[(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:.*|2001:db8:.*)\]$")
    local = (name == "localhost") | F.endswith(name, F.lit(".localhost")) | F.endswith(name, F.lit(".local")) | (four & inside) | six
    return F.when(host == "", "INVALID").when(F.regexp_replace(account, ":", "") != "", "CREDENTIALS").when(local, "LOCAL")
