"""Vectors, ids, boxes and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Similarity of unit vectors, held to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def unit(v: Column, dimension: Column | int) -> Column:
    """The vector at norm 1; null for a wrong size, a value that isn't finite or a zero norm."""
    norm = F.sqrt(dot(v, v))
    bad = (F.size(v) != dimension) | F.exists(v, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))) | (norm == 0)
    return F.when(~bad, F.transform(v, lambda x: x.cast("double") / norm))


def stable_id(kind: str, value: Column) -> Column:
    """A positive 63-bit id: the first eight bytes of a SHA-256 without the top bit, 1 instead of 0."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), value.cast("string")), 256), 1, 16)
    top = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return F.greatest(F.shiftleft(top, 32).bitwiseOR(low), F.lit(1).cast("long"))


def image_id(code: Column, checksum: Column, color: Column, salt: str = "") -> Column:
    """A 62-bit id with bit 62 set, of zero-separated parts."""
    digest = F.substring(F.sha2(F.concat_ws("\x00", code, checksum, color, F.lit(salt)), 256), 1, 16)
    top = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x3FFFFFFF))
    return F.shiftleft(top, 32).bitwiseOR(F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")).bitwiseOR(F.lit(1 << 62))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """UUID version 5 of a name in a namespace (32 hex digits)."""
    digest = F.lower(F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8"))))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, length: Column, mean_length: Column, weight: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def rrf(*ranks: Column, k: int = 60) -> Column:
    """Reciprocal rank fusion; a null rank adds nothing."""
    return sum((F.coalesce(1.0 / (r + k), F.lit(0.0)) for r in ranks[1:]), F.coalesce(1.0 / (ranks[0] + k), F.lit(0.0)))


def weighted(a: Column, b: Column, wa: float, wb: float) -> Column:
    """Weighted score, weights brought to a sum of 1."""
    return a * (wa / (wa + wb)) + b * (wb / (wa + wb))


def page_count(total: Column, size: int) -> Column:
    return F.ceil(total / size)


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: float = 0.06, least: float = 0.03) -> Column:
    """A box of shares of the picture as pixels: held to it, too small ones refused (null), with a margin."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    left, top, right, bottom = clamp(x1), clamp(y1), clamp(x2), clamp(y2)
    mx, my = (right - left) * margin, (bottom - top) * margin
    box = F.struct(
        F.bround(clamp(left - mx) * width).cast("int").alias("left"),
        F.bround(clamp(top - my) * height).cast("int").alias("top"),
        F.bround(clamp(right + mx) * width).cast("int").alias("right"),
        F.bround(clamp(bottom + my) * height).cast("int").alias("bottom"),
    )
    return F.when((right - left >= least) & (bottom - top >= least), box)


def in_rect(cx: Column, cy: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a centre point lies in a rectangle, edges included."""
    return cx.between(x1, x2) & cy.between(y1, y2)
