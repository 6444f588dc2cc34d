"""Urls, stamps, descriptions and boxes that come from outside, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlspark.functions.text import clean

#: Media types by extension, markers where the public part of a description ends, labels of specifications.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "html": "text/html", "pdf": "application/pdf"}
MARKERS = ("- Mã sản phẩm:", "- Mã SP:", "- Loại sản phẩm:", "- Màu sắc:", "- Chất liệu:")
SPECS = {"material": r"Chất\s*liệu|Chat\s*lieu", "sole": "Đế|De", "height": r"Độ\s*cao|Chiều\s*cao"}


def safe_url(value: Column) -> Column:
    """The url if it is http or https and has a host; else null."""
    url = F.trim(value)
    return F.when(url.rlike(r"^(?i:https?)://[^/?#]+"), url)


def mime_of(url: Column) -> Column:
    """Media type by the extension of the url's path; image/jpeg if that says nothing."""
    extension = F.lower(F.regexp_extract(F.regexp_extract(url, r"^[^?#]*", 0), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair]), extension), F.lit("image/jpeg"))


def utc(value: Column) -> Column:
    """A stamp with zone or `Z` as a timestamp; naive ones are UTC; a space before the offset is a lost plus sign."""
    fixed = F.regexp_replace(F.trim(value), r" (\d{2}:\d{2})$", "+$1")
    fixed = F.when(F.trim(value).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"), F.trim(value)).otherwise(fixed)
    return F.try_to_timestamp(fixed)


def zoned(value: Column) -> Column:
    """A stamp as a timestamp if it says its zone; else null."""
    return F.when(clean(value).rlike(r"\d{2}:\d{2}.*(?:[Zz]|[+\- ]\d{2}:?\d{2})$"), utc(value))


def iso_seconds(stamp: Column) -> Column:
    return F.date_format(F.date_trunc("second", stamp), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def specification(description: Column, kind: str) -> Column:
    """The value behind a label, up to the line's end or the next ` - Label:`; null if there is none."""
    found = clean(F.regexp_extract(clean(description), rf"(?iu)(?:^|\n|[-•]\s*)(?:{SPECS[kind]})\s*:\s*([^\n\r]+)", 1))
    return F.nullif(F.trim(F.get(F.split(found, r"\s+-\s+[A-Za-zÀ-ỹĐđ][^:]{0,40}:", 2), F.lit(0))), F.lit(""))


def public_description(description: Column) -> Column:
    """The description up to the first marker."""
    text = clean(description)
    cut = F.least(*[F.nullif(F.instr(text, m), F.lit(0)) for m in MARKERS])
    return clean(F.when(cut.isNotNull(), F.substr(text, F.lit(1), cut - 1)).otherwise(text))


def parse_box(box: Column) -> Column:
    """(y1, x1, y2, x2) in thousandths as shares; null unless there are four in range and in order."""
    y1, x1, y2, x2 = (F.get(box, F.lit(i)) for i in range(4))
    ok = (F.size(box) == 4) & F.forall(box, lambda v: v.between(0, 1000)) & (x1 < x2) & (y1 < y2)
    return F.when(ok, F.struct(*[(v / 1000).alias(n) for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))]))


def asset_name(page: Column, number: Column, checksum: Column) -> Column:
    return F.format_string("p%04d-%03d-%s.png", page, number, F.substring(checksum, 1, 12))


def escape_search(value: Column) -> Column:
    """Text to go between quotation marks in a shop search."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r'(["\\])', r"\\$1")


#: The shape of a delay in seconds.
DELAY = "[0-9]{1,8}(?:[.][0-9]{1,9})?"
QUOTA = "array<struct<retryDelay: string, violations: array<struct<quotaId: string, quotaValue: string>>>>"


def retry_after(details: Column, header: Column) -> Column:
    """The longest delay, in seconds, that an error's details (QUOTA) or its header ask for; null if none does."""
    given = F.transform(details, lambda d: F.regexp_extract(d["retryDelay"], f"^({DELAY})s$", 1))
    asked = F.concat(F.coalesce(given, F.array()), F.array(F.regexp_extract(F.coalesce(header, F.lit("")), f"^{DELAY}$", 0)))
    return F.array_max(F.transform(asked, lambda x: F.nullif(x, F.lit("")).cast("double")))


def quota_windows(details: Column) -> Column:
    """Which of day, minute and month the quotas' names speak of, sorted."""
    names = F.transform(F.flatten(F.transform(details, lambda d: F.coalesce(d["violations"], F.array()))), lambda v: F.lower(v["quotaId"]))
    return F.filter(F.array(*map(F.lit, ("day", "minute", "month"))), lambda w: F.exists(names, lambda n: F.contains(n, w)))


def next_run(now: Column, requested: Column, running: Column, retry_at: Column, enabled: Column, last_success: Column, hours: Column) -> Column:
    """When a scheduled job runs next: now if asked for, never while it runs, after a pending retry, else an interval after its last success."""
    usual = F.coalesce(last_success + F.make_dt_interval(hours=hours), now)
    return F.when(requested, now).when(running, None).when(retry_at > now, retry_at).when(enabled, usual)


def daily_key(now: Column, zone: Column, at: Column, mode: Column) -> Column:
    """The key of today's run where the zone's clock has reached `at` (HH:mm:ss); else null. now: a timestamp."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(now, F.current_timezone()), zone)
    return F.when(F.date_format(local, "HH:mm:ss") >= at, F.concat(F.lit("daily:"), F.date_format(local, "yyyy-MM-dd"), F.lit(":"), mode))
