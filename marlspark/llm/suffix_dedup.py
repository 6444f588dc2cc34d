"""Removal of long repeated strings with a sparse, distributed suffix array.

A string of `length` elements that starts in two places is found through an anchor: the position of the
smallest hash of 8 elements among the string's first `window` positions, the same in both places. So only
suffixes at anchors, about one in half a window, are sorted, and every possible start belongs to one anchor.
Elements are bytes, whose repeats are removed, or words, whose repeats are counted: a passage of 50 words
may be shorter than 400 bytes. Both kinds go through the same stages at once.

1. Anchors of all texts, with a hash of what any string through the anchor must share (its head). Equal
   texts count once here; they are repeated as a whole. Heads that occur once end here.
2. The context of an anchor is all that its strings cover. Contexts that occur twice are repeated as a
   whole; one of each goes on, and only if its head has other contexts. So groups of copies, however
   large, send out what differs among them.
3. The suffixes at these anchors are range-partitioned by their leading elements, then by the head's hash,
   with sampled splitters. Equal heads fall into one bucket, so no comparison is lost at a boundary: two
   suffixes on different sides differ within their heads. Heads that only start alike spread over buckets.
4. A bucket streams its heads; their suffixes are sorted by multikey quicksort, and what lies left of the
   anchors likewise; the common prefixes of neighbours give classes of equal strings for each length, and
   so the starts that occur twice, exactly.
5. Heads of more than `hot` different contexts would make a bucket too large. Their suffixes are dealt by
   longer strings instead: a ladder of ever longer strings to the left and right of such an anchor is
   counted by a shuffle with map-side sums; what occurs once ends its side. Starts that both sides still
   allow, few unless they are repeated, are hashed whole (128 bits) and counted the same way.

Defined results: null and empty texts have no bytes; texts shorter than `length` lose nothing; texts of
at least that size that are equal to another row's lose everything, repeated rows included; very long texts
are taken whole, in blocks; a null doc_id is an id of its own; an empty table gives an empty result; extra
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspark.llm.common import BASE, join_counted, mixed, powers, written

LENGTH, WINDOW = 400, 256
PASSAGE_WORDS, WORD_WINDOW = 50, 32
GRAM = 8
#: Leading bytes of a suffix that splitters are sampled from; the head's hash follows them.
SPLITTER_BYTES = 24
BUCKET_ROWS = 20_000
#: Different contexts of one head that a bucket takes at most; at 0.7 KB each they fit a Python worker several times over.
HOT = 20_000
LAST = (1 << 63) - 1
BLOCK = 1 << 20
WHOLE = (1 << 31) - 1
#: Odd multipliers of a gram's words and values of bytes, from rules.
PLACE = np.array([pow(BASE, 2 * k + 1, 1 << 64) for k in range(GRAM)], dtype=np.uint64)
BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def word_codes(text: bytes) -> bytes:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+`, big-endian, one behind the other."""
    data = np.frombuffer(text, dtype=np.uint8)
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = np.zeros(len(start), dtype=">u8"), 0
    while at < len(start):  # about a quarter of a MB at a time
        to = max(at + 1, int(np.searchsorted(start, start[at] + (1 << 18))))
        first, after = int(start[at]), int(end[to - 1])
        up, down = powers(after - first)
        total = np.zeros(after - first + 1, dtype=np.uint64)
        np.cumsum(BYTE[data[first:after]] * up[: after - first], out=total[1:])
        s, e = start[at:to] - first, end[at:to] - first
        out[at:to] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out.tobytes()


@dataclass(frozen=True)
class Kind:
    """What strings are made of: elements of `size` bytes; a string has `length` of them."""

    id: int
    size: int
    length: int
    window: int

    def __post_init__(self) -> None:
        if self.length < self.window + GRAM or self.window & (self.window - 1):
            raise ValueError("the window is a power of two and shorter than the strings by 8 at least")

    def sequence(self, text: bytes) -> bytes:
        return text if self.size == 1 else word_codes(text)

    def part(self, data: bytes, start: int, end: int) -> bytes:
        return data[start * self.size : end * self.size]

    def head(self, data: bytes, x: int) -> int:
        """Hash of what any string through the anchor at x holds behind it."""
        import xxhash

        return signed(xxhash.xxh3_64_intdigest(self.part(data, x, x + self.length - self.window + 1), self.id))

    def ladder(self) -> tuple[list[int], list[int]]:
        """Lengths to the left and right of a hot anchor at which its surroundings are counted."""
        left = [n for n in (4, 8, 16, 32, 64, 128, 256, 512) if n < self.window]
        return left, sorted({self.length - self.window + 1 + i * self.window // 8 for i in range(1, 8)} | {self.length})


BYTES = Kind(0, 1, LENGTH, WINDOW)
WORDS = Kind(1, 8, PASSAGE_WORDS, WORD_WINDOW)


def anchors(data: bytes, kind: Kind = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, lo, hi): each anchor and the first and last start that belong to it."""
    n = len(data) // kind.size - kind.length + 1
    found = [(np.zeros(0, dtype=np.int64),) * 3]
    for first in range(0, n, BLOCK):
        count = min(n - first, BLOCK)
        m = count + kind.window - 1
        if kind.size == 1:
            grams = np.ndarray(m, dtype="<u8", buffer=data, offset=first, strides=(1,))
        else:
            codes = np.frombuffer(data, dtype=">u8", count=m + GRAM - 1, offset=first * 8).astype(np.uint64)
            grams = sum(codes[k : k + m] * PLACE[k] for k in range(GRAM))
        value = (grams ^ (grams >> np.uint64(29))) * np.uint64(BASE)
        low = (value >> np.uint64(32) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
        step = 1
        while step < kind.window:  # the smallest of the next 2, 4, 8, ... positions, leftmost of equals
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        lo = np.concatenate([[0], cut])
        found.append((at[lo] + first, lo + first, np.concatenate([cut, [count]]) - 1 + first))
    x, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True))
    return x, lo, hi


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The rows' order as byte strings; words: big-endian 8-byte words. Three-way partitioning, word by word."""
    out = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        part = out[lo:hi]
        if hi - lo <= 24:
            out[lo:hi] = sorted(part.tolist(), key=lambda i: words[i, depth:].tolist())
            continue
        column = words[part, depth]
        pivot = np.sort(column[[0, (hi - lo) // 2, -1]])[1]
        less, more = column < pivot, column > pivot
        a, c = int(less.sum()), int(more.sum())
        out[lo:hi] = np.concatenate([part[less], part[~less & ~more], part[more]])
        for s, e, d in ((lo, lo + a, depth), (lo + a, hi - c, depth + 1), (hi - c, hi, depth)):
            if e - s > 1 and d < words.shape[1]:
                stack.append((s, e, d))
    return out


def _sorted_prefixes(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the zero-padded strings and each one's common prefix with the one before it (-1: the first)."""
    wide = -(-width // 8) * 8
    table = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), wide)
    order = multikey_order(table.view(">u8").astype(np.uint64))
    common = np.full(len(strings), -1)
    for start in range(1, len(strings), 4096):
        stop = min(start + 4096, len(strings))
        differ = table[order[start:stop]] != table[order[start - 1 : stop - 1]]
        common[start:stop] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    return order, common


def repeated_starts(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: list[bytes], kind: Kind = BYTES) -> np.ndarray:
    """Whether the start `a` elements before anchor i, for each (i, a), begins a string that occurs twice in the bucket.

    texts[i] holds the elements from lo[i] to hi[i] + length of the anchor's text.
    """
    m, size = len(x), kind.size
    cut = x - lo
    backwards = lambda t: t[::-1] if size == 1 else np.frombuffer(t, dtype=f"V{size}")[::-1].tobytes()
    right_order, right = _sorted_prefixes([t[c * size :] for t, c in zip(texts, cut.tolist(), strict=True)], kind.length * size)
    left_order, left = _sorted_prefixes([backwards(t[: c * size]) for t, c in zip(texts, cut.tolist(), strict=True)], kind.window * size)
    found = np.zeros((m, kind.window), dtype=bool)
    classes = np.empty(m, dtype=np.int64)
    for a in range(kind.window):
        here = np.flatnonzero((x - hi <= a) & (a <= cut))
        if len(here) < 2:
            continue
        classes[right_order] = np.cumsum(right < (kind.length - a) * size) * m
        key = classes[here]
        classes[left_order] = np.cumsum(left < a * size)
        key += classes[here]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        found[here, a] = count[inverse] > 1
    return found


def _spans(found: np.ndarray, x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first element, element after the last) for each run of repeated starts."""
    flat = np.zeros((found.shape[0], found.shape[1] + 2), dtype=np.int8)
    flat[:, 1:-1] = found
    change = np.diff(flat, axis=1)
    row, first = np.nonzero(change == 1)
    _, after = np.nonzero(change == -1)
    return row, x[row] - after + 1, x[row] - first + length


def ranged(suffixes: DataFrame, n: int) -> DataFrame:
    """Suffixes in n buckets; equal heads share one.

    The sample of keys that Spark takes for the splitters stays small with a suffix's leading bytes and its
    head's hash k. By the hash, heads that start alike spread over buckets, so a bucket's size is bounded
    by its share and the rows of one head, at most `hot`.
    """
    return suffixes.repartitionByRange(n, F.substring("head", 1, SPLITTER_BYTES), "k")


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 8192)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _schema(text: str) -> tuple[pa.Schema, str]:
    """The Arrow schema beside Spark's of `name type, ...`."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, types[t]) for n, t in (c.split() for c in text.split(", "))]), text


def _texts(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """(d, h, text as bytes, other columns) of each row."""
    others = [batch.column(c).to_pylist() for c in columns]
    yield from zip(batch.column("d").to_pylist(), batch.column("h").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), *others, strict=True)


FOUND = _schema("d long, h long, head long")
MARKS = _schema("d long, h long, kind int, x int, lo int, hi int, k long, c1 long, c2 long")
SUFFIXES = _schema("kind int, d long, h long, x int, lo int, hi int, k long, single boolean, head binary, bytes binary")
SPANS = _schema("d long, h long, kind int, s int, e int")
STEPS = _schema("d long, h long, step long")
STARTS = _schema("d long, h long, kind int, j int, k1 long, k2 long")
COLD, WARM = 1, 2


def _hot_spans(heated: DataFrame, kinds: list[Kind]) -> DataFrame:
    """Spans of anchors whose heads have very many contexts; heated: d, h, text, reps."""
    ladders = {kind.id: kind.ladder() for kind in kinds}

    def each(text: bytes, reps: list[dict]) -> Iterator[tuple]:
        for kind in kinds:
            if mine := [r for r in reps if r["state"] == WARM and r["kind"] == kind.id]:
                data = kind.sequence(text)
                yield from ((kind, data, r["x"], r["lo"], r["hi"], r["k"]) for r in mine)

    def steps_of(kind: Kind, data: bytes, x: int, lo: int, hi: int, k: int) -> tuple[list[int], list[int], list[int]]:
        """Lengths to the left and right that some start of this anchor covers, and the hashes of these strings."""
        import xxhash

        digest, seed = xxhash.xxh3_64_intdigest, k & (1 << 64) - 1
        left, right = ladders[kind.id]
        left, right = [n for n in left if n <= x - lo], [n for n in right if n <= hi + kind.length - x]
        return left, right, [signed(digest(kind.part(data, x - n, x), seed ^ n)) for n in left] + [signed(digest(kind.part(data, x, x + n), seed ^ n << 32)) for n in right]

    def cut_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, h, s) for b in batches for d, h, text, reps in _texts(b, "reps") for one in each(text, reps) for s in steps_of(*one)[2])
        yield from _batches(rows, STEPS[0])

    def cut_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def rows() -> Iterator[tuple]:
            for b in batches:
                for d, h, text, reps, again in _texts(b, "reps", "again"):
                    known = set(again or ())
                    for kind, data, x, lo, hi, k in each(text, reps):
                        left, right, mine = steps_of(kind, data, x, lo, hi, k)
                        alone_left = next((n for n, s in zip(left, mine, strict=False) if s not in known), kind.window + 1)
                        alone_right = next((n for n, s in zip(right, mine[len(left) :], strict=True) if s not in known), kind.length + 1)
                        # A start `a` elements before the anchor is one of a kind if it covers a string that is.
                        for a in range(max(x - hi, kind.length - alone_right + 1), min(x - lo, alone_left - 1) + 1):
                            v = xxhash.xxh3_128_intdigest(kind.part(data, x - a, x - a + kind.length), kind.id)
                            yield d, h, kind.id, x - a, signed(v >> 64), signed(v & (1 << 64) - 1)

        yield from _batches(rows(), STARTS[0])

    steps = written(heated.mapInArrow(cut_steps, STEPS[1]), "suffix-steps")
    shared = written(steps.groupBy("step").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-shared")
    again = join_counted(steps, shared, ["step"]).groupBy("d", "h").agg(F.collect_set("step").alias("again"))
    starts = written(heated.join(again, ["d", "h"], "left").select("d", "h", "text", "reps", "again").mapInArrow(cut_starts, STARTS[1]), "suffix-starts")
    twice = written(starts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-twice")
    hit = written(join_counted(starts, twice, ["k1", "k2"]).select("d", "h", "kind", "j"), "suffix-hot")
    return hit.select("d", "h", "kind", F.col("j").alias("s"), (F.col("j") + _length_of(kinds)).alias("e"))


def _length_of(kinds: list[Kind]) -> Column:
    out = F.lit(None).cast("int")
    for kind in kinds:
        out = F.when(F.col("kind") == kind.id, kind.length).otherwise(out)
    return out


def repeated_spans(docs: DataFrame, kinds: list[Kind], bucket_rows: int = BUCKET_ROWS, hot: int = HOT) -> DataFrame:
    """(d, h, spans): the spans of each row that hold repeated strings, as (kind, s, e); spans may overlap.

    d is the doc_id (nulls as the largest long), h a hash of the text; e is WHOLE for a text that is
    repeated as a whole.
    """
    by_id = {kind.id: kind for kind in kinds}
    shortest = min(kind.length if kind.size == 1 else 2 * kind.length - 1 for kind in kinds)
    d, h = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64("text")
    texts = docs.where(F.octet_length("text") >= shortest).select(d.alias("d"), h.alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    rows = written(texts.drop("text"), "suffix-rows")
    groups = rows.groupBy("h", "h2").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("copies"))
    one_each = written(groups.select("d", "h", "copies"), "suffix-texts")
    all_of_it = F.array(*[F.struct(F.lit(kind.id).alias("kind"), F.lit(0).alias("s"), F.lit(WHOLE).alias("e")) for kind in kinds])
    whole = rows.join(groups.where("copies > 1").select("h", "h2"), ["h", "h2"]).select("d", "h", all_of_it.alias("spans"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, h, heads = [], [], []
            for doc, key, text in _texts(batch):
                for kind in kinds:
                    data = kind.sequence(text)
                    x, _, _ = anchors(data, kind)
                    heads += [kind.head(data, i) for i in x.tolist()]
                d += [doc] * (len(heads) - len(d))
                h += [key] * (len(heads) - len(h))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (d, h, heads)], schema=FOUND[0])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def rows() -> Iterator[tuple]:
            for b in batches:
                for d, h, text, wanted in _texts(b, "wanted"):
                    wanted = set(wanted)
                    for kind in kinds:
                        data = kind.sequence(text)
                        for x, lo, hi in zip(*(v.tolist() for v in anchors(data, kind)), strict=True):
                            if (k := kind.head(data, x)) in wanted:
                                c = xxhash.xxh3_128_intdigest(kind.part(data, lo, hi + kind.length), kind.id << 32 | x - lo)
                                yield d, h, kind.id, x, lo, hi, k, signed(c >> 64), signed(c & (1 << 64) - 1)

        yield from _batches(rows(), MARKS[0])

    found = written(texts.select("d", "h", "text").mapInArrow(find, FOUND[1]).join(one_each.select("d", "h"), ["d", "h"], "left_semi"), "suffix-anchors")
    shared = written(found.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-heads")
    wanted = join_counted(found, shared, ["head"]).groupBy("d", "h").agg(F.collect_set("head").alias("wanted"))
    marks = written(texts.select("d", "h", "text").join(wanted, ["d", "h"]).mapInArrow(mark, MARKS[1]), "suffix-marks")

    pick = F.xxhash64("d", "h", "x")
    contexts = written(marks.groupBy("k", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(pick).alias("pick")), "suffix-contexts")
    heads = contexts.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    state = F.when(F.col("m") == 1, 0).when(F.col("m") <= hot, COLD).otherwise(WARM)
    told = written(contexts.join(heads, "k").select("k", "c1", "c2", "n", "pick", state.alias("state")).where("n > 1 OR state > 0"), "suffix-told")
    marked = written(join_counted(marks, told, ["k", "c1", "c2"]).select("d", "h", "kind", "x", "lo", "hi", "k", "state", (F.col("n") == 1).alias("single"), (pick == F.col("pick")).alias("picked")), "suffix-marked")
    alike = marked.where(~F.col("single")).select("d", "h", "kind", F.col("lo").alias("s"), (F.col("hi") + _length_of(kinds)).alias("e"))
    reps = marked.where("picked AND state > 0")
    sums = reps.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()  # two numbers
    size_of = {r["state"]: r["n"] for r in sums}
    listed = reps.groupBy("d", "h").agg(F.collect_list(F.struct("kind", "x", "lo", "hi", "k", "state", "single")).alias("reps"))
    chosen = texts.select("d", "h", "text").join(listed, ["d", "h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for d, h, text, reps in _texts(b, "reps"):
                    data = {}
                    for r in reps:
                        if r["state"] == COLD:
                            kind, x, lo, hi = by_id[r["kind"]], r["x"], r["lo"], r["hi"]
                            if kind.id not in data:
                                data[kind.id] = kind.sequence(text)
                            mine = data[kind.id]
                            yield kind.id, d, h, x, lo, hi, r["k"], r["single"], mine[x * kind.size : x * kind.size + SPLITTER_BYTES], kind.part(mine, lo, hi + kind.length)

        yield from _batches(rows(), SUFFIXES[0])

    suffixes = written(chosen.mapInArrow(cut, SUFFIXES[1]), "suffixes", "zstd")
    buckets = ranged(suffixes, max(1, -(-size_of.get(COLD, 0) // bucket_rows))).sortWithinPartitions("kind", "k")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            kinds_here = table.column("kind").to_numpy()
            for i in np.unique(kinds_here).tolist():
                kind, part = by_id[i], table.filter(pa.array(kinds_here == i))
                x, first, last = (part.column(c).to_numpy().astype(np.int64) for c in ("x", "lo", "hi"))
                starts = repeated_starts(x, first, last, part.column("bytes").to_pylist(), kind)
                starts[~part.column("single").to_numpy()] = False
                row, s, e = _spans(starts, x, kind.length)
                d, h = (part.column(c).to_numpy()[row] for c in ("d", "h"))
                columns = [pa.array(d), pa.array(h), pa.array(np.full(len(row), i), pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, schema=SPANS[0])

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= bucket_rows:  # whole heads, about bucket_rows at a time
                table = pa.Table.from_batches(held)
                k = table.column("k").to_numpy()
                if len(before := np.flatnonzero(k != k[-1])):
                    edge = int(before[-1]) + 1
                    yield from work(table.slice(0, edge))
                    held = table.slice(edge).to_batches()
                    count -= edge
        if count:
            yield from work(pa.Table.from_batches(held))

    spans = alike.unionAll(buckets.select("kind", "d", "h", "x", "lo", "hi", "k", "single", "bytes").mapInArrow(compare, SPANS[1]))
    if size_of.get(WARM):
        spans = spans.unionAll(_hot_spans(chosen.where(F.exists("reps", lambda r: r["state"] == WARM)), kinds))
    single = spans.groupBy("d", "h").agg(F.collect_list(F.struct("kind", "s", "e")).alias("spans")).join(one_each.where("copies = 1").select("d", "h"), ["d", "h"], "left_semi")
    return written(single.unionAll(whole.dropDuplicates(["d", "h"])), "suffix-spans")


def _union(spans: list[tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """The spans, none beyond `end`, as runs that don't touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        e = min(e, end)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, words: int = PASSAGE_WORDS, word_window: int = WORD_WINDOW, **options: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_passage_words): kept is binary, as a cut may fall inside a character.

    n_passage_words: the words covered by a passage of `words` words that also starts anywhere else, at
    whatever length in bytes.
    """
    byte_kind, word_kind = Kind(0, 1, length, window), Kind(1, 8, words, word_window)
    spans = repeated_spans(docs.select("doc_id", "text"), [byte_kind, word_kind], **options)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept, n_words = [], [], [], [], []
            for text, cuts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                both: dict[int, list] = {0: [], 1: []}
                for c in cuts or ():
                    both[c["kind"]].append((c["s"], c["e"]))
                runs = _union(both[0], len(text)) if len(text) >= length else []
                parts, at = [], 0
                for s, e in runs:
                    parts.append(text[at:s])
                    at = e
                parts.append(text[at:])
                left = b"".join(parts)
                count = len(text.split()) if any(e == WHOLE for _, e in both[1]) else WHOLE
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(left))
                n_spans.append(len(runs))
                kept.append(left)
                n_words.append(sum(e - s for s, e in _union(both[1], count)) if count >= words else 0)
            columns = [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary()), pa.array(n_words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words"])

    joined = keyed.join(spans, ["d", "h"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")


def suffix_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage_words of each document."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
