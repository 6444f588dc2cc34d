"""Documents into headings, sections and chunks.

Lines are rows: what a line looks like is a matter of patterns, what stands around it of lag and lead, and
its level and path of running values within the document, so all of it is window expressions. Only cutting
and packing, whose next step depends on the last, are small functions on one section's text, in Arrow
batches. `doc_id` is taken to be unique; null and empty texts have no chunks.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspark.operators.layout import HEADING_CHARS, heading_paths

SIZE, OVERLAP, MIN_CHARS, PERCENTILE = 1200, 180, 300, 80.0
#: Texts that a task cuts at once.
CUT_ROWS = 32
#: The shapes of headings, and warnings that look like one.
MARKDOWN = r"(?U)^(#{1,6})\s+(.+)$"
ROMAN = r"(?U)^([IVXLCDM]+)[.)]\s+(.+)$"
DECIMAL = r"(?U)^(\d+(?:\.\d+)+)[.)]?\s+(.+)$"
LETTER = r"(?U)^([a-zđ])[.)]\s+(.+)$"
WARNING = r"(?U)^(?:LƯU Ý|CHÚ Ý|CẢNH BÁO|KHÔNG ĐƯỢC|NGHIÊM CẤM)\b"
PDF_TABLE = "Bảng, trang PDF "
PARAGRAPH = r"\n\s*\n+"
SENTENCE = r"(?<=[.!?])\s+(?=\S)"
#: Where to cut, safest first, and what to join pieces with.
CUTS = ((PARAGRAPH, "\n\n"), (r"\n+", "\n"), (SENTENCE, " "), (r"(?<=[;:])\s+", " "), (r"\s+", " "))
#: The longest label, in characters and words, and the fewest letters of one in capitals.
LABEL_CHARS, LABEL_WORDS, CAPITAL_LETTERS = 120, 16, 4
#: Dotted numbers may nest deeper than Markdown; deeper levels count as this one.
LEVELS = 12

BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"
#: A text in which no line looks like this has no headings.
MAYBE = r"(?mU)^\s*(?:#{1,6}\s|[IVXLCDM]+[.)]\s|\d+(?:\.\d+)+[.)]?\s|[^\p{Ll}\n]*\p{Lu}[^\p{Ll}\n]*$)"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_label(value: Column) -> Column:
    """Short, starts with a letter, doesn't end like a sentence, holds no inline `label: body`."""
    short = (F.length(value) <= LABEL_CHARS) & (F.size(F.split(stripped(value), r"(?U)\s+")) <= LABEL_WORDS)
    return short & value.rlike(r"^\p{L}") & ~value.rlike(r"[.!?;]$") & ~value.rlike(":.*[^:]")


def outline(docs: DataFrame, natural: bool = True) -> DataFrame:
    """(doc_id, line, raw, level, reason, title) of each line; level is 0 for body lines.

    If a text has Markdown headings, they are its only ones. Else a line in capitals alone between blank
    lines opens level 1, where a second one or a numbered line behind it supports it; Roman, dotted and
    lettered numbers nest below it and each other.
    """
    document = Window.partitionBy("doc_id")
    order = document.orderBy("line")
    # From the last line backwards, so that the frame grows row by row.
    ahead = document.orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    lines = docs.select("doc_id", F.posexplode(F.split("text", BREAK)).alias("line", "raw")).withColumn("bare", stripped(F.col("raw")))
    bare, behind = F.col("bare"), F.col("behind")
    numbered = lambda pattern: bare.rlike(pattern) & is_label(F.regexp_extract(bare, pattern, 2))
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    seen = lines.select(
        "*",
        bare.rlike(MARKDOWN).alias("markdown"),
        numbered(ROMAN).alias("roman"),
        numbered(DECIMAL).alias("decimal"),
        numbered(LETTER).alias("letter"),
        F.last(F.nullif(bare, F.lit("")), ignorenulls=True).over(ahead).alias("behind"),
        (blank(F.lag("bare").over(order)) & blank(F.lead("bare").over(order))).alias("alone"),
    )
    letters = F.length(F.regexp_replace(bare, r"\P{L}", ""))
    loud = F.col("alone") & behind.isNotNull() & (F.upper(bare) == bare) & (F.lower(bare) != bare) & (letters >= CAPITAL_LETTERS) & is_label(bare) & ~bare.rlike(WARNING) & ~bare.rlike(ROMAN)
    counted = seen.withColumn("loud", loud).withColumn("marked", F.max("markdown").over(document)).withColumn("n", F.count_if("loud").over(document))
    supported = (F.col("n") > 1) | behind.rlike(ROMAN) | behind.rlike(DECIMAL)
    capital = (F.col("loud") & supported & ~F.col("marked")).alias("capital")
    parts = counted.select("*", capital).withColumn("part", F.count_if("capital").over(order))
    in_part = Window.partitionBy("doc_id", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    below = (F.col("part") > 0).cast("int")
    dots = F.length(F.regexp_replace(F.regexp_extract(bare, DECIMAL, 1), r"[^.]", ""))
    after_roman = F.coalesce(F.max(F.col("roman").cast("int")).over(in_part), F.lit(0))
    own = F.when(F.col("capital"), 0).when(F.col("roman"), 1 + below).when(F.col("decimal"), dots + below + after_roman).otherwise(0)
    levelled = parts.withColumn("own", own).withColumn("above", F.coalesce(F.last(F.when(F.col("own") > 0, F.col("own")), ignorenulls=True).over(in_part), F.lit(0)))
    kinds = [  # first that holds: condition, level, reason, title
        (F.col("markdown"), F.length(F.regexp_extract(bare, MARKDOWN, 1)), "markdown", F.regexp_extract(bare, MARKDOWN, 2)),
        (F.col("marked") | ~F.lit(natural), F.lit(0), "body", bare),
        (F.col("capital"), F.lit(1), "uppercase_section", bare),
        (F.col("roman"), F.col("own"), "roman_number", bare),
        (F.col("decimal"), F.col("own"), "section_number", bare),
        (F.col("letter") & (F.col("above") > 0), F.col("above") + 1, "letter_section", bare),
    ]
    kind = None
    for holds, level, reason, title in kinds:
        found = F.struct(level.cast("int").alias("level"), F.lit(reason).alias("reason"), F.substring(title, 1, HEADING_CHARS).alias("title"))
        kind = F.when(holds, found) if kind is None else kind.when(holds, found)
    none = F.struct(F.lit(0).alias("level"), F.lit("body").alias("reason"), bare.alias("title"))
    return levelled.select("doc_id", "line", "raw", kind.otherwise(none).alias("k")).select("doc_id", "line", "raw", "k.*")


def heading_rows(docs: DataFrame, natural: bool = True) -> DataFrame:
    """(doc_id, line, level, reason, text) of each heading."""
    return outline(docs.where(F.col("text").rlike(MAYBE)), natural).where("level > 0").select("doc_id", "line", "level", "reason", F.col("title").alias("text"))


def sections(docs: DataFrame, natural: bool = True) -> DataFrame:
    """(doc_id, section, path, body), in order; a heading closes all of its level and below.

    Texts without a line that may be a heading are one section each and aren't taken apart.
    """
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    whole = stripped(F.regexp_replace("text", BREAK, "\n"))
    plain = docs.where(~maybe).select("doc_id", F.lit(0).cast("long").alias("section"), F.array().cast("array<string>").alias("path"), F.coalesce(whole, F.lit("")).alias("body"))
    lines = outline(docs.where(maybe), natural).withColumn("level", F.least("level", F.lit(LEVELS)))
    pathed = heading_paths(lines, "doc_id", ["line"], "level", "title", LEVELS)
    numbered = pathed.withColumn("section", F.count_if(F.col("level") > 0).over(Window.partitionBy("doc_id").orderBy("line")))
    body = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line", "raw"))))
    joined = numbered.groupBy("doc_id", "section").agg(F.min_by("path", "line").alias("path"), body.alias("lines"))
    return plain.unionAll(joined.select("doc_id", "section", "path", stripped(F.array_join(F.transform("lines", lambda x: x["raw"]), "\n")).alias("body")))


def cut_windows(body: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of `size` that overlap; each ends at its last line or word end, if that isn't too early."""
    breaks = [m.start() for m in re.finditer("[ \n]", body)]
    found, start, end = [], 0, 0
    while end < len(body):
        end = start + size
        if end < len(body):
            last = bisect_left(breaks, end) - 1
            if last >= 0 and breaks[last] > start + max(overlap, size // 2):
                end = breaks[last]
        found.append(body[start:end].strip())
        start = max(start + 1, end - overlap)
    return [x for x in found if x]


def cut_pieces(value: str, limit: int) -> list[str]:
    """Pieces of at most `limit` characters.

    Pieces that are too long are cut at the safest kind of place, then the next; each piece knows the kind
    of cut before it. Then neighbours are put together again while they fit, across the finest cuts first.
    """
    if len(whole := value.strip()) <= limit:
        return [whole] if whole else []
    pieces = [(0, whole)]
    for rank, (pattern, _) in enumerate(CUTS, 1):
        finer = []
        for before, text in pieces:
            parts = [text] if len(text) <= limit else [p.strip() for p in re.split(pattern, text) if p.strip()]
            finer += [(rank if i else before, part) for i, part in enumerate(parts)]
        pieces = finer
    pieces = [(len(CUTS) + 1 if i else before, text[i : i + limit]) for before, text in pieces for i in range(0, len(text), limit)]
    for rank in range(len(CUTS), 0, -1):
        joint, packed = CUTS[rank - 1][1], []
        for before, text in pieces:
            if packed and before >= rank and len(packed[-1][1]) + len(joint) + len(text) <= limit:
                packed[-1] = (packed[-1][0], packed[-1][1] + joint + text)
            else:
                packed.append((before, text))
        pieces = packed
    return [text for _, text in pieces]


def _cut(rows: DataFrame, cut: Callable[[str], list[str]]) -> DataFrame:
    """`rows` with `parts`, the `cut` of each body; a batch is taken in small slices, so a task holds the strings of few texts."""
    names = rows.columns
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), "parts array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CUT_ROWS):
                batch = whole.slice(start, CUT_ROWS)
                parts = [None if x is None else cut(x) for x in batch.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.string()))], [*names, "parts"])

    return rows.mapInArrow(run, schema)


def paragraphs(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "(?U)" + PARAGRAPH), stripped), lambda x: F.length(x) > 0)


def units(body: Column, limit: int = SIZE) -> Column:
    """Paragraphs, or their sentences where they are too long."""
    sentences = lambda p: F.filter(F.transform(F.split(p, "(?U)" + SENTENCE), stripped), lambda x: F.length(x) > 0)
    return F.flatten(F.transform(paragraphs(body), lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(sentences(p))))


class _Places(dict):
    """Words to their place and sign in a vector, twice the place and one more for minus; each is hashed once."""

    def __init__(self, dimension: int) -> None:
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        self[word] = place = 2 * (h % self.dimension) + (0 if h & 0x10000 else 1)
        return place


def hashing_embedder(texts: list[str], dimension: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: a deterministic stand-in for a model.

    No word goes over a blank line, so a paragraph that several texts hold is counted once.
    """
    if not texts:
        return np.zeros((0, dimension))
    number: dict[str, int] = {}
    held = [[number.setdefault(part, len(number)) for part in text.split("\n\n")] for text in texts]
    places = _Places(dimension)
    found = [list(map(places.__getitem__, re.findall(r"\w+", part.lower()))) for part in number]
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    place = np.fromiter((x for part in found for x in part), dtype=np.int64, count=len(row))
    signed = np.bincount(row * 2 * dimension + place, minlength=len(found) * 2 * dimension).reshape(len(found), dimension, 2)
    counts = (signed[:, :, 0] - signed[:, :, 1]).astype(float)
    sizes = np.array([len(x) for x in held])
    out = np.add.reduceat(counts[[x for parts in held for x in parts]], np.cumsum(sizes) - sizes, axis=0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def pack_units(parts: list[str], gaps: list[float], threshold: float, limit: int, least: int) -> list[str]:
    """Units put together up to the limit, but not across a gap that reaches the threshold once there are `least` characters."""
    groups: list[str] = []
    for part, gap in zip(parts, [0.0, *gaps][: len(parts)], strict=True):
        full = not groups or len(groups[-1]) + 2 + len(part) > limit
        if full or (0 < threshold <= gap and len(groups[-1]) >= least):
            groups.append(part)
        else:
            groups[-1] = f"{groups[-1]}\n\n{part}"
    if len(groups) > 1 and len(groups[-1]) < least and len(groups[-2]) + 2 + len(groups[-1]) <= limit:
        tail = groups.pop()
        groups[-1] = f"{groups[-1]}\n\n{tail}"
    return groups


def by_meaning(bodies: DataFrame, embed: Callable[[list[str]], np.ndarray], limit: int, least: int, share: float, stays: Column) -> DataFrame:
    """`bodies` with `packing`: the body itself where it `stays`, else the body's units as packed `parts`, with a break where neighbouring windows of three
    differ most; the number of `units` and of those as long as the limit (`splits`); the `threshold`, null for one unit."""

    def packed(rows: list) -> list[dict]:
        if not rows:
            return []
        split = [[piece for x in row for piece in cut_pieces(x, limit)] for row in rows]
        vectors = embed(["\n\n".join(row[max(0, i - 1) : i + 2]) for row in split for i in range(len(row))])
        close = np.clip((vectors[:-1] * vectors[1:]).sum(axis=1), -1, 1)
        out, start = [], 0
        for row in split:
            gaps = 1 - close[start : start + len(row) - 1] if row else close[:0]
            threshold = float(np.percentile(gaps, share)) if len(gaps) else None
            splits = sum(len(x) >= limit for x in row) if len(row) > 1 else len(row)
            out.append({"parts": pack_units(row, gaps.tolist(), threshold or 0.0, limit, least), "units": len(row), "splits": splits, "threshold": threshold})
            start += len(row)
        return out

    # Of a body that stays there are no units, so that all bodies come from one pass over the texts.
    found = bodies.withColumn("_units", F.when(~stays, units(F.col("body"), limit)))
    names = bodies.columns
    schema = ", ".join([*(f"`{c}` {bodies.schema[c].dataType.simpleString()}" for c in names), "packing struct<parts: array<string>, units: int, splits: int, threshold: double>"])
    packing = pa.struct([("parts", pa.list_(pa.string())), ("units", pa.int32()), ("splits", pa.int32()), ("threshold", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CUT_ROWS):
                batch = whole.slice(start, CUT_ROWS)
                rows = batch.column("_units").to_pylist()
                told = iter(packed([row for row in rows if row is not None]))
                out = [{"parts": [body], "units": 1, "splits": 0, "threshold": None} if row is None else next(told) for row, body in zip(rows, batch.column("body").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, packing)], [*names, "packing"])

    return found.mapInArrow(run, schema)


def _chunks(pieces: DataFrame) -> DataFrame:
    """Chunks of (doc_id, section, path, parts), numbered in order."""
    listed = pieces.select("doc_id", "section", "path", F.posexplode("parts").alias("part", "content"))
    order = Window.partitionBy("doc_id").orderBy("section", "part")
    heading = F.get("path", F.size("path") - 1)
    return listed.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), heading.alias("heading"), F.col("path").alias("section_path"), "content")


def one_section(docs: DataFrame) -> DataFrame:
    """(doc_id, section, path, body) with the whole text of each document as its one section, headings or not."""
    return docs.select("doc_id", F.lit(0).cast("long").alias("section"), F.array().cast("array<string>").alias("path"), F.coalesce("text", F.lit("")).alias("body"))


def fixed_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, headings: bool = True) -> DataFrame:
    """Overlapping windows within sections: doc_id, chunk_index, heading, section_path, content.

    Without `headings` the windows are of the whole text, so a text that looks like a heading has its own.
    """
    if size < 200 or not 0 <= overlap < size:
        raise ValueError("size must be 200 or more, and overlap less than it")
    found = sections(docs) if headings else one_section(docs)
    return _chunks(_cut(found, lambda x: cut_windows(x, size, overlap)))


def recursive_chunks(docs: DataFrame, limit: int = SIZE) -> DataFrame:
    """Pieces of the whole text, cut at the safest places."""
    return _chunks(_cut(one_section(docs), lambda x: cut_pieces(x, limit)))


def adaptive_chunks(docs: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashing_embedder, limit: int = SIZE, least: int = MIN_CHARS, share: float = PERCENTILE) -> DataFrame:
    """Sections that fit stay whole, those of a table always do, others break by meaning."""
    return _chunks(_adaptive(docs, embed, limit, least, share).withColumn("parts", F.col("packing.parts")).drop("packing"))


def adaptive_stats(docs: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashing_embedder, limit: int = SIZE, least: int = MIN_CHARS, share: float = PERCENTILE) -> DataFrame:
    """What `adaptive_chunks` meets in each document: sections, units, sections of several units, their mean threshold
    (null if there are none) and units as long as the limit. Documents without a section have zeros."""
    rows = _adaptive(docs, embed, limit, least, share).select("doc_id", "packing.units", "packing.splits", "packing.threshold")
    sums = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sections"), F.sum("units").alias("units"), F.count_if(F.col("units") > 1).alias("semantic_sections"), F.avg("threshold").alias("average_threshold"), F.sum("splits").alias("splits")
    )
    return docs.select("doc_id").distinct().join(sums, "doc_id", "left").fillna(0, ["sections", "units", "semantic_sections", "splits"])


def _adaptive(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], limit: int, least: int, share: float) -> DataFrame:
    """Sections with their packing; those that fit, or are of a table, stay whole."""
    found = sections(docs).where(F.length("body") > 0)
    stays = (F.length("body") <= limit) | F.startswith("body", F.lit(PDF_TABLE))
    return by_meaning(found, embed, limit, least, share, stays)
