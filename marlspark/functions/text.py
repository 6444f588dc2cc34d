"""Text normalisers and tokenisers as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"


def _bases() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, from their decompositions."""
    pairs = []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = unicodedata.normalize("NFD", chr(point))[0]
        if plain != chr(point):
            pairs.append((chr(point), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _bases()

#: Tokens that stand for several.
ALIASES = {"hcm": ("hồ", "chí", "minh"), "tphcm": ("hồ", "chí", "minh")}


def without_accents(text: Column) -> Column:
    """Drop combining marks of precomposed or decomposed Latin text; đ becomes d."""
    plain = F.translate(text, ACCENTED + "đĐ", PLAIN + "dD")
    return F.regexp_replace(plain, r"\p{Mn}+", "")


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


@cache
def not_plain() -> str:
    """A class of all characters that NFKC may change: by themselves, or by joining the one before them."""
    joining = {chr(c) for c in (*range(0x1160, 0x1200), *range(0xD7B0, 0xD800))}  # vowels and ends of Hangul syllables
    changed = []
    for point in range(0x80, sys.maxunicode + 1):
        c = chr(point)
        parts = unicodedata.decomposition(c)
        if parts and not parts.startswith("<"):
            joining.update(chr(int(p, 16)) for p in parts.split()[1:])
        if not 0xD800 <= point < 0xE000 and (unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c):
            changed.append(point)
    ranges: list[list[int]] = []
    for point in sorted({*changed, *map(ord, joining)}):
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    # Most characters of Latin texts are passed over by the first class, which has few ranges.
    return r"(?![\x00-\x9f\xc0-\u0131])[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return pd.Series([unicodedata.normalize("NFKC", t) if isinstance(t, str) else None for t in texts], dtype=object)


def nfkc(text: Column) -> Column:
    """NFKC; only texts that it may change go to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(not_plain()), text)), text)


def tokens(text: Column) -> Column:
    """Lower-case word tokens of the text in NFKC with aliases put in their place."""

    def spelled(x: Column) -> Column:
        out = F.array(x)
        for alias, words in ALIASES.items():
            out = F.when(x == alias, F.array(*map(F.lit, words))).otherwise(out)
        return out

    def aliased(found: Column) -> Column:
        return F.when(F.arrays_overlap(found, F.array(*map(F.lit, ALIASES))), F.flatten(F.transform(found, spelled))).otherwise(found)

    return let(F.regexp_extract_all(F.lower(nfkc(F.coalesce(text, F.lit("")))), F.lit(WORD), F.lit(0)), aliased)


def query_form(text: Column) -> Column:
    """Lower case, no accents, runs of other characters as one space."""
    return F.trim(F.regexp_replace(without_accents(F.lower(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    """Case-folded, no accents, words joined by hyphens."""
    return F.btrim(F.regexp_replace(without_accents(casefold(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-"), F.lit("-"))


def spaced(text: Column) -> Column:
    """Case-folded, no accents, words joined by spaces."""
    return F.trim(F.regexp_replace(without_accents(casefold(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " "))


def search_form(text: Column) -> Column:
    """Case-folded, no accents, punctuation kept, white space collapsed."""
    return F.trim(F.regexp_replace(without_accents(casefold(F.coalesce(text, F.lit("")))), r"\s+", " "))


def department_code(text: Column) -> Column:
    """Upper case, no accents, white space as underscore, nothing else but letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.upper(without_accents(F.trim(text))), r"\s+", "_"), "[^A-Z0-9_]", "")


def search_text(title: Column, path: Column, heading: Column, content: Column) -> Column:
    """What is indexed of a chunk: title, section label and content on lines of their own."""
    label = F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise(F.coalesce(heading, F.lit("")))
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), label, F.coalesce(content, F.lit("")))


def present(*values: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values])


def clean(value: Column) -> Column:
    """The value as text without white space at its ends; null is empty."""
    return F.btrim(F.coalesce(value.cast("string"), F.lit("")), F.lit(" \t\n\r\f\v"))


def number(value: Column) -> Column:
    """Text that is a whole or decimal number as a double; else null."""
    text = clean(value)
    return F.when(text.rlike(r"^[+-]?(?:[0-9]+|(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"), text.try_cast("double"))


def contains_all_terms(haystack: Column, query: Column) -> Column:
    """Every white-space-separated term of a normalised query occurs in the normalised haystack."""
    return F.forall(F.split(query, " "), lambda t: F.contains(haystack, t))


# Intent of Vietnamese queries, on their query form. The phrases.
POLICY = r"\b(?:chinh sach|quy dinh|quy trinh)\b"
SECTION = r"\bbang\s+(?:tinh|loi|thuong|phat|quy|gia|dinh|phan|cham|diem)\b|\b(?:la gi|gom nhung gi|bao gom|chi tiet|tong quan|cach tinh|cach ap dung)\b|\bphuc loi\b"
LISTING = r"\b(?:liet ke|danh sach|tat ca|toan bo|tong cong|tong so|day du)\b"
WHERE_IS = r"\bco\b.+\bo dau\b|\b(?:cac|nhung)\b.+\b(?:o dau|nao)\b"
STOPWORDS = sorted(
    set(
        "chinh quy dinh trinh thong tin chi tiet tong cua la gi va ve cho toi biet cac nhung nao nhu the co duoc ap dung tai trong voi mot hay giai thich toan bo day du muc khi theo".split()
    )
)


def needs_policy(form: Column) -> Column:
    return form.rlike(POLICY)


def needs_section(form: Column) -> Column:
    return form.rlike(POLICY) | form.rlike(SECTION)


def needs_document(form: Column) -> Column:
    return form.rlike(LISTING) | form.rlike(WHERE_IS)


def key_terms(form: Column) -> Column:
    """Distinct terms of a query form that aren't stopwords."""
    return F.array_except(F.split(form, " "), F.array(*map(F.lit, [*STOPWORDS, ""])))


def heading_overlap(query_terms: Column, heading_terms: Column) -> Column:
    """A strong match: three shared terms, and half of the query's or three fifths of the heading's."""
    shared = F.size(F.array_intersect(query_terms, heading_terms))
    return (F.size(query_terms) >= 3) & (shared >= 3) & ((shared / F.size(query_terms) >= 0.5) | (shared / F.greatest(F.size(heading_terms), F.lit(1)) >= 0.6))


#: Fixed value: the shape of a numbered heading.
NUMBERED = r"^(?:\d+(?:\.\d+)*[.)]?|[IVXLCDM]+[.)])\s+"


def section_scope(path: Column, include_parent: Column | bool = False) -> Column:
    """The path up to its last numbered heading; with `include_parent` up to that number's parent, if it is there."""
    flagged = F.transform(path, lambda x, i: F.when(x.rlike(NUMBERED), i + 1).otherwise(0))
    last = F.array_max(flagged)
    number = F.regexp_extract(F.get(path, last - 1), r"^(\d+(?:\.\d+)*)", 1)
    parent = F.regexp_extract(number, r"^(.*)\.\d+$", 1)
    above = F.array_max(
        F.transform(path, lambda x, i: F.when((i < last - 1) & (F.regexp_extract(x, r"^(\d+(?:\.\d+)*)[.)]?\s+", 1) == parent), i + 1).otherwise(0))
    )
    wide = F.lit(include_parent) if isinstance(include_parent, bool) else include_parent
    end = F.when(F.coalesce(last, F.lit(0)) == 0, F.size(path)).when(wide & (F.length(parent) > 0) & (above > 0), above).otherwise(last)
    return F.slice(path, 1, end)


def is_broad_part(path: Column) -> Column:
    return query_form(F.element_at(path, -1)).rlike(r"^phan\s+[ivxlcdm]+\b")


def starts_with_path(path: Column, scope: Column) -> Column:
    """Whether `scope` is a prefix of `path`, or equal to it."""
    return (F.size(path) >= F.size(scope)) & (F.slice(path, 1, F.size(scope)) == scope)


def citations(text: Column, ids: Column) -> Column:
    """The text with its distinct source numbers behind it: `text [S1] [S2]`."""
    return F.concat_ws(" ", F.trim(text), F.array_join(F.transform(F.array_distinct(ids), lambda i: F.concat(F.lit("[S"), i.cast("string"), F.lit("]"))), " "))


def citation_state(ids: Column, answer: Column, sources: Column | int, max_statements: int, max_chars: int) -> Column:
    """Whether an answer may go out: `ok`, `statements`, `citations` or `length`, by the first check that fails.

    ids: an array for each statement, of the source numbers that it cites, which run from 1 to `sources`.
    """
    cited = F.flatten(ids)
    bad = (F.size(cited) == 0) | F.exists(cited, lambda i: (i < 1) | (i > sources))
    return F.when(F.size(ids) > max_statements, "statements").when(bad, "citations").when(F.length(answer) > max_chars, "length").otherwise("ok")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Put values into `{{name}}` places."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
