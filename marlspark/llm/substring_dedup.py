"""Removal of word passages that an earlier document holds, by super-k-mers.

A window is `window` consecutive words. Its minimiser is the `gram` words in it with the smallest hash, the
same wherever the window stands. Consecutive windows of one minimiser, a super-k-mer, travel as one packed
string, so a word is sent about three times, not once for each of the windows that cover it.

1. The minimisers of all texts are counted; those of one place only can't have an equal and end here.
   Texts equal to an earlier document's are removed as a whole and take no further part.
2. Super-k-mers of the others are counted by minimiser and a hash of their words, with map-side sums. One
   of each content goes on, with the smallest doc_id that holds it, and only if its minimiser has others.
3. The packed strings are dealt to buckets by minimiser. A bucket streams whole minimisers, sorts their
   windows as byte strings, and so finds the smallest doc_id of each, exactly.
4. A minimiser of more than `hot` contents would make a bucket too large. Its windows are named by 128-bit
   hashes and counted by a shuffle with map-side sums instead.
5. Each occurrence of a content is held against the smallest doc_ids of its windows.

Texts are shuffled once: they are written in buckets by a row id, and what is found of a row comes to its
bucket, so no later join moves a text.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows of one
doc_id never remove each other's words; a null doc_id comes after all others; very long texts are taken
whole, in slices that share a window less a word; an empty table gives an empty result; extra columns
don't matter.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspark.llm.common import BASE, join_counted, mixed, powers, scratch, shuffle_partitions, written

WINDOW, GRAM = 13, 4
#: Different contents of one minimiser that a bucket takes at most.
HOT = 20_000
BUCKET_ROWS = 50_000
#: Bytes of text that are worked on at once; a longer word is hashed by itself.
SLICE = 1 << 18
LAST = (1 << 63) - 1
WHOLE = (1 << 31) - 1
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Values of bytes and odd multipliers of places, from rules.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def slices(text: bytes, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first word, words) of parts of a text; any window lies in one part."""
    first, tail, at = 0, [], 0
    while True:
        cut = SPACE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        found = tail + text[at:end].split()
        yield first, found
        if end == len(text):
            return
        keep = min(window - 1, len(found))
        first, tail, at = first + len(found) - keep, found[len(found) - keep :], end


def units(rows: Iterator[tuple[tuple, bytes]], window: int) -> Iterator[list[tuple[tuple, int, list[bytes]]]]:
    """Parts of one or many texts, about SLICE bytes together."""
    held, size = [], 0
    for key, text in rows:
        for first, found in slices(text, window):
            if len(found) >= window:
                held.append((key, first, found))
                size += sum(map(len, found))
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def codes(flat: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    joined = b" ".join(flat)
    if len(joined) > 8 * SLICE:  # some word is very long
        joined = b" ".join(w if len(w) <= SLICE else xxhash.xxh3_128_hexdigest(w).encode() for w in flat)
    data = np.frombuffer(joined, dtype=np.uint8)
    space = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], space + 1]), np.concatenate([space, [len(data)]])
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def runs(unit: list[tuple[tuple, int, list[bytes]]], window: int, gram: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all words, part, first window, last window, minimiser, content) of each super-k-mer; windows count through all words."""
    flat = [w for _, _, found in unit for w in found]
    part = np.repeat(np.arange(len(unit)), [len(found) for _, _, found in unit])
    code = codes(flat)
    m = len(code) - gram + 1
    value = np.zeros(m, dtype=np.uint64)
    for k in range(gram):
        value = (value + code[k : k + m]) * np.uint64(BASE)
    value = mixed(value)
    low = (value >> np.uint64(32) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
    step, span = 1, window - gram + 1
    while step * 2 <= span:  # the smallest of the next 2, 4, 8, ... positions, leftmost of equals
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < span:
        low = np.minimum(low[: step - span], low[span - step :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    here = np.flatnonzero(part[: len(at)] == part[window - 1 :])
    cut = np.flatnonzero((np.diff(at[here]) != 0) | (np.diff(here) != 1)) + 1
    lo, hi = here[np.concatenate([[0], cut])], here[np.concatenate([cut - 1, [len(here) - 1]])]
    up, down = powers(len(code))
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(code * up[: len(code)], out=total[1:])
    content = mixed((total[hi + window] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    return flat, part[lo], lo, hi, value[at[lo]].view(np.int64), content.view(np.int64)


def _rows(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[tuple, bytes]]:
    columns = [batch.column(k).to_pylist() for k in keys]
    yield from zip(zip(*columns, strict=True), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)


def _before(unit: list[tuple[tuple, int, list[bytes]]], part: np.ndarray) -> np.ndarray:
    """What to take off a super-k-mer's window so that it counts from its text's first word."""
    begins = np.cumsum([0, *[len(found) for _, _, found in unit[:-1]]])
    return (begins - np.array([first for _, first, _ in unit]))[part]


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Written in buckets by `key` and read again, so that joins on it leave the rows where they are; the files stay when the table's name goes."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = shuffle_partitions(spark)
    df.repartition(n, key).write.bucketBy(n, key).option("path", scratch(spark, name)).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def texts_by_row(docs: DataFrame) -> DataFrame:
    """(doc_id, d, r, text): d is the doc_id (nulls as the largest long), r a number of its own for each row."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), d.alias("d"), F.monotonically_increasing_id().alias("r"), F.coalesce("text", F.lit("")).alias("text")), "r", "window_texts")


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(r, spans): the spans (s, e) of words of each row that an earlier doc_id holds; spans may overlap. texts: as `texts_by_row` gives them.

    e is WHOLE for a text that an earlier document has as a whole.
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram is a part of a window")
    texts = texts.where(F.octet_length("text") >= 2 * window - 1)
    rows = written(texts.select("r", "d", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2")), "window-rows")
    groups = written(rows.groupBy("h", "h2").agg(F.min("d").alias("d0"), F.count(F.lit(1)).alias("n")).where("n > 1"), "window-groups")
    copies = written(join_counted(rows, groups, ["h", "h2"]).where("d > d0").select("r"), "window-copies")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in units(_rows(batch, "r"), window):
                _, part, _, _, g, _ = runs(unit, window, gram)
                r = np.array([key[0] for key, _, _ in unit], dtype=np.int64)[part]
                order = np.lexsort((g, r))  # a text's repeats of its own count once
                order = order[np.concatenate([[True], (np.diff(r[order]) != 0) | (np.diff(g[order]) != 0)])]
                yield pa.RecordBatch.from_arrays([pa.array(g[order]), pa.array(r[order])], ["g", "r"])

    found = written(texts.select("r", "text").mapInArrow(find, "g long, r long"), "window-found")
    shared = written(found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "window-shared")
    wanted = join_counted(found, shared, ["g"]).groupBy("r").agg(F.collect_set("g").alias("wanted")).join(copies, "r", "left_anti")
    chosen = texts.select("r", "d", "text").join(wanted, "r").select("r", "d", "text", "wanted")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in units(_rows(batch, "r", "d", "wanted"), window):
                _, part, lo, hi, g, content = runs(unit, window, gram)
                kept = np.isin(g, np.unique(np.concatenate([key[2] for key, _, _ in unit])))
                part, lo, hi, g, content = (v[kept] for v in (part, lo, hi, g, content))
                r, d = (np.array([key[i] for key, _, _ in unit], dtype=np.int64)[part] for i in (0, 1))
                lo_in_text = (lo - _before(unit, part)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (g, content, r, d, lo_in_text, (hi - lo + 1).astype(np.int32))], ["g", "c", "r", "d", "lo", "size"])

    marks = written(chosen.mapInArrow(mark, "g long, c long, r long, d long, lo int, size int"), "window-marks")
    pick = F.xxhash64("r", "lo")
    contents = written(marks.groupBy("g", "c").agg(F.count(F.lit(1)).alias("held"), F.min("d").alias("d0"), F.max("d").alias("d1"), F.min(pick).alias("pick")), "window-contents")
    heads = contents.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("d0").alias("g0"), F.max("d1").alias("g1")).where("g0 < g1")
    told = written(join_counted(contents, heads.select("g", "n"), ["g"]).select("g", "c", "d0", "d1", "pick", F.col("n").alias("k"), F.col("held").alias("n")), "window-told")
    marked = written(join_counted(marks, told, ["g", "c"]).select("g", "c", "r", "d", "lo", "size", "k", "d0", "d1", "n", (pick == F.col("pick")).alias("picked")), "window-marked")
    plain = marked.where("k = 1 AND d > d0").select("r", F.col("lo").alias("s"), (F.col("lo") + F.col("size") + window - 1).alias("e"))

    reps = marked.where("picked AND k > 1")
    sums = {r["hot"]: r["n"] for r in reps.groupBy((F.col("k") > hot).alias("hot")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two numbers
    listed = reps.groupBy("r").agg(F.collect_list(F.struct("g", "c", "lo", "size", "d0", "d1", "n", (F.col("k") > hot).alias("hot"))).alias("reps"))
    asked_for = texts.select("r", "text").join(listed, "r").select("text", "reps")

    def packed(batches: Iterator[pa.RecordBatch], wants: bool) -> Iterator[tuple[dict, list[bytes]]]:
        """Each representative that is wanted, and its words."""
        for batch in batches:
            for (reps,), text in _rows(batch, "reps"):
                mine = sorted((r for r in reps if r["hot"] == wants), key=lambda r: r["lo"])
                at = 0
                for first, found in slices(text, window) if mine else ():
                    # A super-k-mer that a slice ends lies in that slice.
                    while at < len(mine) and mine[at]["lo"] + mine[at]["size"] + window - 1 <= first + len(found):
                        lo = mine[at]["lo"] - first
                        yield mine[at], found[lo : lo + mine[at]["size"] + window - 1]
                        at += 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for rep, found in packed(batches, False):
            rows.append((rep["g"], rep["c"], rep["d0"], rep["d1"], rep["n"], b" ".join(found)))
            if len(rows) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["g", "c", "d0", "d1", "n", "packed"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["g", "c", "d0", "d1", "n", "packed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> pa.RecordBatch:
            windows, sizes = [], []
            for line in table.column("packed").to_pylist():
                words = line.split(b" ")
                ends = np.cumsum([len(w) + 1 for w in words]).tolist()
                begins = [0, *ends[:-1]]
                sizes.append(len(words) - window + 1)
                windows += [line[begins[i] : ends[i + window - 1] - 1] for i in range(sizes[-1])]
            rank = pc.rank(pa.array(windows, pa.binary()), "ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1
            sizes = np.array(sizes)
            least = np.full(int(rank.max()) + 1, LAST)
            np.minimum.at(least, rank, np.repeat(table.column("d0").to_numpy(), sizes))
            least = least[rank]
            begins = np.cumsum(sizes) - sizes
            told = np.flatnonzero(np.minimum.reduceat(least, begins) < table.column("d1").to_numpy())
            g, c, n = (table.column(name).to_numpy()[told] for name in ("g", "c", "n"))
            offsets = np.concatenate([[0], np.cumsum(sizes[told])]).astype(np.int32)
            inner = least[np.repeat(np.isin(np.arange(len(sizes)), told), sizes)]
            mins = pa.ListArray.from_arrays(pa.array(offsets), pa.array(inner))
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), pa.array(n), pa.array(np.zeros(len(told), dtype=np.int32)), mins], ["g", "c", "n", "i", "mins"])

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= bucket_rows:  # whole minimisers, about bucket_rows at a time
                table = pa.Table.from_batches(held)
                g = table.column("g").to_numpy()
                if len(before := np.flatnonzero(g != g[-1])):
                    edge = int(before[-1]) + 1
                    yield work(table.slice(0, edge))
                    held = table.slice(edge).to_batches()
                    count -= edge
        if count:
            yield work(pa.Table.from_batches(held))

    verdicts = []
    kinds = "g long, c long, n long, i int, mins array<long>"
    if sums.get(False):
        strings = written(asked_for.mapInArrow(cut, "g long, c long, d0 long, d1 long, n long, packed binary"), "window-strings", "zstd")
        buckets = strings.repartition(-(-sums[False] // bucket_rows), "g").sortWithinPartitions("g")
        verdicts.append(buckets.mapInArrow(compare, kinds))
    if sums.get(True):

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            rows = []
            for rep, found in packed(batches, True):
                for i in range(rep["size"]):
                    name = xxhash.xxh3_128_digest(b" ".join(found[i : i + window]))
                    rows.append((rep["g"], rep["c"], rep["n"], i, rep["d0"], rep["d1"], int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)))
                if len(rows) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        names, types = ["g", "c", "n", "i", "d0", "d1", "k1", "k2"], [*[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 4]
        single = written(asked_for.mapInArrow(each, "g long, c long, n long, i int, d0 long, d1 long, k1 long, k2 long"), "window-hot")
        least = written(single.groupBy("k1", "k2").agg(F.min("d0").alias("least"), F.count(F.lit(1)).alias("n")), "window-least")
        verdicts.append(join_counted(single.withColumnRenamed("n", "held"), least, ["k1", "k2"]).where("least < d1").select("g", "c", F.col("held").alias("n"), "i", F.array("least").alias("mins")))

    def held_against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of an occurrence's windows that a smaller doc_id holds."""
        for batch in batches:
            mins = batch.column("mins")
            size = np.diff(mins.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            gone = np.flatnonzero(mins.flatten().to_numpy() < batch.column("d").to_numpy()[owner])
            if not len(gone):
                continue
            cut = np.flatnonzero((np.diff(gone) != 1) | (np.diff(owner[gone]) != 0)) + 1
            a, b = gone[np.concatenate([[0], cut])], gone[np.concatenate([cut - 1, [len(gone) - 1]])]
            row = owner[a]
            begin = batch.column("lo").to_numpy()[row] + batch.column("i").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("r").to_numpy()[row]), pa.array((begin + place[a]).astype(np.int32)), pa.array((begin + place[b] + window).astype(np.int32))], ["r", "s", "e"])

    spans = plain
    occurring = marked.where("k > 1").select("g", "c", "r", "d", "lo")
    for verdict in verdicts:
        met = join_counted(occurring, written(verdict, "window-verdicts"), ["g", "c"])
        spans = spans.unionAll(met.select("r", "d", "lo", "i", "mins").mapInArrow(held_against, "r long, s int, e int"))
    whole = copies.select("r", F.lit(0).alias("s"), F.lit(WHOLE).alias("e"))
    return written(spans.unionAll(whole).groupBy("r").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "window-spans")


def remove_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **options: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept has the words that stay, joined by one space."""
    texts = texts_by_row(docs)
    spans = repeated_spans(texts, window, gram, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                found = text.split()
                left, at = [], 0
                for s, e in sorted((r["s"], r["e"]) for r in spans or () if len(found) >= window):
                    left += found[at:s]
                    at = max(at, e)
                left += found[at:]
                n_words.append(len(found))
                n_removed.append(len(found) - len(left))
                kept.append(b" ".join(left))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return texts.join(spans, "r", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def substring_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    return remove_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, d, i, array_to_string(w[i:i + 12], ' ') AS key FROM doc, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) x),
least AS (SELECT key, min(d) AS d FROM win GROUP BY key HAVING min(d) < max(d)),
gone AS (SELECT DISTINCT win.r, win.i + k AS i FROM win JOIN least ON least.key = win.key AND least.d < win.d, (SELECT unnest(range(13)) AS k) o),
kept AS (
    SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS text FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM doc) u
    WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = u.r AND gone.i = u.i) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM doc LEFT JOIN kept ON kept.r = doc.r
"""
