"""Benchmark decontamination by template canonicalisation.

Texts become templates: lower-case words in which numbers, names and units are typed placeholders, so a
question with other numbers or names keeps its template. Windows of five template tokens are hashed and
hash-joined with those of the benchmark. A document that holds at least `coverage` of an item's windows
is contaminated if the slots agree: each value of the item stands for one and the same value of the
document nearly throughout (`consistency`), as in a copy or a question with new parameters.

Words and windows come from array operations over the characters of many texts at once; what a slot said is
only looked up for windows that pass a bitmap of the benchmark's window hashes. The bitmap's size is fixed
whatever the benchmark's; the join decides. Windows with fewer than two plain words aren't taken as templates,
as tables of numbers would match each other; they stand for their own words. An item that is mostly made of
such (arithmetic, lists of names) is asked for by these too, which finds its copies. The join asks for an item's rarest windows first, as many
as no contaminated document can do without, so phrases common to items and corpus aren't paired out.

Coverage and consistency are judged for each occurrence, not for the document as a whole. A hit puts the
item's start at its own place less its place in the item. Hits that give one start are an occurrence, which
finds every copy whatever stands around it; so are hits whose starts lie in one stretch of the item's length
or four times that, as words put in or left out move the start. Stretches overlap by half, so starts that
differ by half a stretch always share one. The best occurrence is reported.

Defined results: null and empty texts match nothing; very long texts are taken whole, in pieces cut at white
space; lower case is by character; a text of fewer than five tokens is one window;
items with a null id or text are passed over; repeated rows count once for their doc_id; other texts under
one id are judged each, and the best is reported; an empty table on either side gives an empty result; a null doc_id is never reported and stays in `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspark.llm.common import BASE, mixed, powers, written

WINDOW = 5
COVERAGE = 0.5
CONSISTENCY = 0.8
BITMAP_BITS = 1 << 24
BROADCAST_WINDOWS = 500_000

#: Words that are units after a number.
UNITS = set(
    "mm cm m km in inch inches ft foot feet yd yards mile miles g kg mg lb lbs oz pound pounds ton tons t l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years jahre tage stunden ans jours heures años días horas usd eur dollar dollars cent cents euro euros percent prozent % $ € £ c f k degrees hz khz mhz ghz kb mb gb tb w kw v a".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/-]*(?:st|nd|rd|th|%|€|[a-z]{1,3})?", re.I)
BLANK = re.compile(r"[ \n]")
#: Odd multipliers of a window's positions, from a rule.
POSITION = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


#: Bits of a character's class.
SPACE, LEFT, RIGHT, DIGIT, UPPER, LOWER, CLOSER, STOP = (1 << k for k in range(8))
#: Characters that are worked on at once; a longer text goes in pieces cut at white space.
PIECE = 1 << 18
#: Codes of the placeholders.
NUM, UNIT, NAME = (np.uint64(k) for k in (1, 2, 3))


def _class_of(point: int) -> tuple[int, int]:
    """(class bits, lower-case code point) of a code point."""
    c = chr(point)
    word = c.isalnum() or c == "_"
    bits = SPACE * c.isspace() | LEFT * (word or c in "$€£%+-") | RIGHT * (word or c in "%€") | DIGIT * c.isdecimal()
    bits |= UPPER * c.isupper() | LOWER * c.islower() | CLOSER * (c in "\"')]}»”") | STOP * (c in ".!?:")
    low = c.lower()
    return bits, ord(low) if len(low) == 1 else point


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class bits, and a value of the lower-case form, for each code point of the basic plane."""
    bits, low = zip(*map(_class_of, range(1 << 16)), strict=True)
    return np.array(bits, dtype=np.uint8), mixed(np.array(low, dtype=np.uint64) + np.uint64(BASE))


@cache
def _unit_codes() -> np.ndarray:
    return np.sort(np.concatenate([_raw_words(u, True)[0] for u in UNITS]))


def _raw_words(text: str, opens: bool) -> tuple[np.ndarray, ...]:
    """(code, start, end, number, capital, opening) of the words of a text, all by array operations.

    code hashes the lower-case word, character by character; start and end leave out punctuation at its
    edges, and are equal if nothing else is there; opening: the word opens a line or a sentence, where a
    capital says nothing. `opens`: whether the text begins a line or sentence; last comes whether what
    follows it does.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bits, value = _classes()
    kind, values = bits[points & 0xFFFF], value[points & 0xFFFF]
    if (high := points > 0xFFFF).any():
        each, back = np.unique(points[high], return_inverse=True)
        found = np.array([_class_of(p) for p in each.tolist()], dtype=np.uint64)
        kind[high], values[high] = found[back, 0].astype(np.uint8), mixed(found[:, 1] + np.uint64(BASE))[back]
    solid = np.zeros(len(points) + 2, dtype=np.int8)
    solid[1:-1] = kind & SPACE == 0
    edge = np.diff(solid)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return (np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64),) * 2, *(np.zeros(0, dtype=bool),) * 3, opens or "\n" in text)
    left, right = np.append(np.flatnonzero(kind & LEFT != 0), len(points)), np.append(-1, np.flatnonzero(kind & RIGHT != 0))
    start = np.minimum(left[np.searchsorted(left, first)], after)
    end = np.maximum(right[np.searchsorted(right, after) - 1] + 1, start)
    up, down = powers(len(points))
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(points)], out=total[1:])
    code = mixed((total[end] - total[start]) * down[start] + np.uint64(7))
    # Numbers: only words with a digit near their start are looked at one by one.
    near = np.zeros(len(first), dtype=bool)
    for k in range(3):
        near |= (start + k < end) & (kind[np.minimum(start + k, len(points) - 1)] & DIGIT != 0)
    number = np.zeros(len(first), dtype=bool)
    for i in np.flatnonzero(near).tolist():
        number[i] = NUMBER.fullmatch(text, int(start[i]), int(end[i])) is not None
    big = np.flatnonzero(kind & UPPER != 0)
    small = np.flatnonzero(kind & LOWER != 0)
    capital = (end - start > 1) & (kind[np.minimum(start, len(points) - 1)] & UPPER != 0)
    at = np.flatnonzero(capital)
    held = lambda places: np.searchsorted(places, end[at]) - np.searchsorted(places, start[at] + 1)
    capital[at] = (held(big) == 0) & (held(small) > 0)
    last = after - 1
    while len(back := np.flatnonzero((last > first) & (kind[last] & CLOSER != 0))):
        last[back] -= 1
    line = np.searchsorted(np.flatnonzero(points == 10), np.append(first, len(points)))
    opening = np.concatenate([[opens or line[0] > 0], (np.diff(line) > 0) | (kind[last] & STOP != 0)])
    return code, start, end, number, capital, opening[:-1], bool(opening[-1])


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text, each of about PIECE characters, cut behind white space."""
    at = 0
    while len(text) - at > PIECE:
        cut = BLANK.search(text, at + PIECE)
        if cut is None:
            break
        yield at, text[at : cut.end()]
        at = cut.end()
    yield at, text[at:]


def templates(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(doc, code, slot, start, end, raw) of the tokens of all texts' templates; start and end are places in the text, raw is the word's own code."""
    group: list[tuple[int, int, str]] = []
    out: list[tuple[np.ndarray, ...]] = []
    opens = True

    def flush() -> None:
        # Texts stand on lines of their own; a piece that goes on in the next group ends the group.
        nonlocal opens
        joined = "".join(piece if piece[-1:].isspace() else piece + "\n" for _, _, piece in group)
        offset = np.cumsum([0, *(len(piece) + (not piece[-1:].isspace()) for _, _, piece in group)])
        code, start, end, number, capital, opening, opens = _raw_words(joined, opens)
        part = np.searchsorted(offset, start, side="right") - 1
        starts_text = np.array([at == 0 for _, at, _ in group])[part] & (np.diff(part, prepend=-1) > 0)
        shift = np.array([at for _, at, _ in group])[part] - offset[part]
        out.append((np.array([doc for doc, _, _ in group])[part], code, start + shift, end + shift, number, capital, opening | starts_text))
        group.clear()

    size = 0
    for doc, text in enumerate(texts):
        for at, piece in _pieces(text):
            group.append((doc, at, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
                size = 0
    if group:
        flush()
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none.astype(bool), none, none, none.astype(np.uint64)
    doc, code, start, end, number, capital, opening = map(np.concatenate, zip(*out, strict=True))
    keep = end > start
    doc, code, start, end, number, capital, opening = (x[keep] for x in (doc, code, start, end, number, capital, opening))
    behind = np.zeros(len(doc), dtype=bool)
    behind[1:] = number[:-1] & (doc[1:] == doc[:-1]) & ~number[1:]
    unit = behind.copy()
    unit[behind] = np.isin(code[behind], _unit_codes())
    name = capital & ~opening & ~number & ~unit
    codes = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, code)))
    return doc, codes, number | unit | name, start, end, code


def windows(doc: np.ndarray, codes: np.ndarray, slots: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first token, template's hash, hash of the words as they are, plain) of the windows of all texts; a text of fewer than WINDOW tokens is one window.

    A window of fewer than two plain words would match too much as a template; it isn't plain.
    """
    n = len(codes)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    length = np.diff(np.append(first, n))
    held = np.repeat(length, length)
    place = np.arange(n) - np.repeat(first, length)
    starts = np.flatnonzero((place + WINDOW <= held) | ((held < WINDOW) & (place == 0)))
    out, own, words = np.zeros(len(starts), dtype=np.uint64), np.full(len(starts), BASE, dtype=np.uint64), np.zeros(len(starts), dtype=np.int8)
    size = np.minimum(held[starts], WINDOW)
    for k in range(WINDOW):
        at, inside = np.minimum(starts + k, n - 1), k < size
        out += np.where(inside, codes[at] * POSITION[k], np.uint64(0))
        own += np.where(inside, raw[at] * POSITION[k], np.uint64(0))
        words += inside & ~slots[at]
    return starts, out ^ (out >> np.uint64(31)), own ^ (own >> np.uint64(31)), words >= np.minimum(2, size)


def _windows_of(df: DataFrame, key: str, bitmap: object = None) -> DataFrame:
    """(key, row, pos, hash, slots, n, size) of each window that may be in the bitmap; row: a hash of the text; n, size: its windows and its tokens.

    Without a bitmap the texts are items: one with fewer plain windows than others is asked for in its own words
    too, as a row by itself that holds the others.
    """

    def batch_of(keys: list, texts: list[str], bits: np.ndarray | None) -> pa.RecordBatch | None:
        import xxhash

        doc, codes, slots, start, end, raw = templates(texts)
        first, templated, worded, plain = windows(doc, codes, slots, raw)
        counts = [np.bincount(doc[first[side]], minlength=len(texts)) for side in (plain, ~plain)]
        if bits is None:
            others = ~plain & (counts[1] > counts[0])[doc[first]]
        else:
            held = lambda hashes: (bits[(hashes % np.uint64(BITMAP_BITS) >> np.uint64(3)).astype(np.int64)] >> (hashes & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            plain, others = plain & held(templated), held(worded)
        if not plain.any() and not others.any():
            return None
        hashes = np.concatenate([templated[plain], worded[others]])
        first, plain = np.concatenate([first[plain], first[others]]), np.arange(len(hashes)) < plain.sum()
        owner = doc[first]
        size = np.bincount(doc, minlength=len(texts))
        begins = np.searchsorted(doc, np.arange(len(texts)))
        n = np.where(plain, counts[0][owner], counts[1][owner])
        rows = np.zeros(len(texts), dtype=np.uint64)
        for d in np.unique(owner).tolist():
            rows[d] = xxhash.xxh64_intdigest(texts[d].encode("utf-8", "surrogatepass"))
        values = [[texts[d][start[j] : end[j]].lower() for j in range(i, min(i + WINDOW, begins[d] + size[d])) if slots[j]] if p else [] for i, d, p in zip(first.tolist(), owner.tolist(), plain.tolist(), strict=True)]
        named = rows[owner] ^ np.where(plain, 0, 1).astype(np.uint64) if bits is None else rows[owner]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([keys[d] for d in owner.tolist()], pa.int64()),
                pa.array(named.view(np.int64)),
                pa.array((first - begins[owner]).astype(np.int32)),
                pa.array(hashes.view(np.int64)),
                pa.array(values, pa.list_(pa.string())),
                pa.array(n.astype(np.int32)),
                pa.array(size[owner].astype(np.int32)),
            ],
            [key, "row", "pos", "hash", "slots", "n", "size"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            keys, texts, held = [], [], 0
            for i in range(batch.num_rows):
                if text := batch.column("text")[i].as_py():
                    keys.append(batch.column(key)[i].as_py())
                    texts.append(text)
                    held += len(text)
                if texts and (held >= 4 * PIECE or i + 1 == batch.num_rows):
                    if (out := batch_of(keys, texts, bits)) is not None:
                        yield out
                    keys, texts, held = [], [], 0

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, row long, pos int, hash long, slots array<string>, n int, size int")


def _places(start: Column, size: Column) -> Column:
    """The occurrences that a hit may belong to: its exact start, and the stretches of starts that hold it."""
    stretch = lambda kind, width, shift: F.struct(F.lit(kind).alias("kind"), F.floor((start + shift) / width).alias("at"))
    exact = F.struct(F.lit(0).alias("kind"), start.cast("long").alias("at"))
    return F.array(exact, stretch(1, size, F.lit(0)), stretch(2, size, size / 2), stretch(3, 4 * size, F.lit(0)), stretch(4, 4 * size, 2 * size))


def _bitmap(items: DataFrame) -> np.ndarray:
    """The bitmap of all window hashes, as bytes; it reaches the driver as two columns of at most one row a byte."""
    place = F.pmod("hash", F.lit(BITMAP_BITS))  # the same for signed and unsigned, as the size is a power of two
    bit = F.expr(f"shiftleft(1, cast(pmod(hash, {BITMAP_BITS}) & 7 as int))")
    byte = items.groupBy(F.shiftright(place, 3).cast("int").alias("byte")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    bitmap[byte.column("byte").to_numpy()] = byte.column("bits").to_numpy()
    return bitmap


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """(doc_id, item_id, coverage, consistency, kind): kind is `copy`, or `template` where slots differ."""
    mine = ["item_id", F.col("row").alias("item_row"), F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"), "n", "size"]
    items = written(_windows_of(benchmark, "item_id").select(*mine).distinct(), "bench-windows")
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(items))
    small = items.count() <= BROADCAST_WINDOWS
    sized = F.broadcast if small else (lambda df: df)
    found = written(_windows_of(docs, "doc_id", sent).select("doc_id", "row", "pos", "hash", "slots"), "bench-found")
    # A document with enough of an item's windows holds one of any n - needed + 1 of them, so the item's
    # rarest are asked first; a phrase of very many items and documents is joined for their pairs only.
    frequency = found.groupBy("hash").agg(F.count(F.lit(1)).alias("in_docs"))
    by_item = Window.partitionBy("item_id", "item_row")
    weighed = items.join(frequency, "hash").withColumn("common", F.col("in_docs") * F.count(F.lit(1)).over(Window.partitionBy("hash")))
    missed = F.col("n") - F.count(F.lit(1)).over(by_item)
    asked = F.col("n") - F.ceil(F.col("n") * coverage) + 1 - missed
    rarest = weighed.withColumn("at", F.row_number().over(by_item.orderBy("common", "item_pos"))).withColumn("asked", asked).where(F.col("at") <= F.col("asked"))
    key = ["doc_id", "row", "item_id", "item_row"]
    candidates = found.join(sized(rarest.select("hash", "item_id", "item_row")), "hash").select(*key).distinct()
    start = (F.col("pos") - F.col("item_pos")).alias("start")
    paired = candidates.join(sized(items), ["item_id", "item_row"]).join(found, ["doc_id", "row", "hash"])
    hits = written(paired.select(*key, "item_pos", start, "n", "size", "slots", "item_slots"), "bench-hits")
    share = (F.count_distinct("item_pos") / F.first("n")).alias("coverage")
    # No occurrence holds more of an item than the whole text.
    possible = hits.groupBy(*key).agg(share).where(F.col("coverage") >= coverage)
    placed = hits.join(possible.drop("coverage"), key, "left_semi").withColumn("place", F.explode(_places(F.col("start"), F.col("size"))))
    key.append("place")
    enough = placed.groupBy(*key).agg(share).where(F.col("coverage") >= coverage)
    pairs = placed.join(enough.drop("coverage"), key, "left_semi").select(*key, F.explode(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))).alias("p"))
    each = pairs.groupBy(*key, "p").agg(F.count(F.lit(1)).alias("c"))
    value = each.groupBy(*key, F.col("p.item").alias("value")).agg(F.max("c").alias("most"), F.sum("c").alias("all"), F.sum(F.when(F.col("p.item") == F.col("p.doc"), 0).otherwise(F.col("c"))).alias("changed"))
    slots = value.groupBy(*key).agg((F.sum("most") / F.sum("all")).alias("consistency"), F.sum("changed").alias("changed"))
    joined = enough.join(slots, key, "left").select("doc_id", "item_id", "coverage", F.coalesce("consistency", F.lit(1.0)).alias("consistency"), F.coalesce("changed", F.lit(0)).alias("changed"))
    order = F.struct("coverage", "consistency", (-F.col("changed")).alias("same"))
    best = joined.where(F.col("consistency") >= consistency).groupBy("doc_id", "item_id").agg(F.max(order).alias("best"))
    return best.select("doc_id", "item_id", "best.coverage", "best.consistency", F.when(F.col("best.same") < 0, "template").otherwise("copy").alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """`docs` without the contaminated ones."""
    bad = contaminated(docs.select("doc_id", "text"), benchmark, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
