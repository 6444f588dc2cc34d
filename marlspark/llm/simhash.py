"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius r share a variant that lies within r/2 of both. A ball of radius 2 in 64
bits has 2,081 members, so the fingerprint is first halved: of at most four differing bits, at most two
are in one of the two halves, and there it is enough that each fingerprint emits all variants of that
half within radius 1 (33 a half, 66 in all). Variants are the shuffle key; fingerprints that meet are
compared on all 64 bits, and links become components.

Equal fingerprints are one node, so copies never multiply. Inside a variant's bucket a breadth-first
walk over the true links gives a spanning tree of each cluster, not its pairs: a cluster of n costs n
links. Each node leaves the walk when reached.

Four bits are strict: of pairs that share 0.8 of their shingles few are as near. So `keep_one_of_each` links
texts of a Jaccard similarity of at least 0.8 in five-word shingles besides, all of them. Most meet in bands of
least shingle hashes; a walk over a bucket's sketches gives a spanning tree, whose links count if the exact
similarity of the two texts says so. What the bands miss is found by prefixes: of two such texts, the shingles
that come first in one common order, a fifth of each text's, share one at least. Only texts that the bands have
not connected are compared there, so copies don't multiply.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of fewer than
four words have one shingle; a row without a doc_id links to nothing and has no component;
very long texts are taken whole; repeated rows share their fingerprint; rows with one doc_id and unlike texts are
linked each by its own text; an empty table gives an empty result; extra columns pass through
`keep_one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspark.llm.common import mixed, shuffle_partitions, written
from marlspark.llm.graph import components

SHINGLE = 4
RADIUS = 4
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    import xxhash

    # bytes.lower and bytes.split know ASCII only, which is what the definition asks for.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, hash) of each document; fp is the unsigned value's bits as a long, hash one of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64)), batch.column("hash")], ["doc_id", "fp", "hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "doc_id long, fp long, hash long")


def _tree(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning links of the clusters of one bucket."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            node, front = front[0], front[1:]
            near = np.bitwise_count(rest ^ node) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), node))
                right.append(found)
                front = np.concatenate([front, found])
    return left, right


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between different fingerprints, enough of them to connect all that are within `radius`.

    nodes: one column fp, distinct.
    """
    if radius // 2 // 2 != 1:
        raise ValueError("the halves' ball has radius 1, which suits a radius of 4 or 5")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(32)])
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    keys = F.concat(F.transform(flips, lambda m: low.bitwiseXOR(m)), F.transform(flips, lambda m: high.bitwiseXOR(m).bitwiseOR(F.lit(1 << 32))))
    variants = nodes.select(F.explode(keys).alias("key"), "fp")
    dealt = variants.repartition(max(shuffle_partitions(nodes.sparkSession), 12), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            a, b = [], []
            pairs = starts[ends - starts == 2]  # most buckets with company hold two
            near = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= radius]
            a.append(fps[near])
            b.append(fps[near + 1])
            more = ends - starts > 2
            for s, e in zip(starts[more], ends[more], strict=True):
                x, y = _tree(fps[s:e], radius)
                a += x
                b += y
            a, b = np.concatenate(a), np.concatenate(b)
            if not len(a):
                return None
            one = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(one[:, 0].view(np.int64)), pa.array(one[:, 1].view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if cut:
                done = [*held, (keys[:cut], fps[:cut])]
                if out := found(*map(np.concatenate, zip(*done, strict=True))):
                    yield out
                held = []
            held.append((keys[cut:], fps[cut:]))
        if held and (out := found(*map(np.concatenate, zip(*held, strict=True)))):
            yield out

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, hash, cluster, component_id) of each document.

    Clusters are of fingerprints, so that unlike texts with one doc_id don't link what is like either;
    cluster is one of its fingerprints, component_id its smallest doc_id.
    """
    fps = written(fingerprints(docs), "simhash")
    nodes = written(fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges = links(nodes.select("fp"), radius).select(F.col("a").alias("u"), F.col("b").alias("v"))
    placed = nodes.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("cluster"))
    smallest = placed.groupBy("cluster").agg(F.min("least").alias("component_id"))
    found = placed.join(smallest, "cluster").select("fp", "cluster", "component_id")
    known = F.col("doc_id").isNotNull()
    return fps.join(found, "fp", "left").select("doc_id", "fp", "hash", F.when(known, F.col("cluster")).alias("cluster"), F.when(known, F.col("component_id")).alias("component_id"))


SIMILAR, WORDS = 0.8, 5
#: Bands of least hashes, each of so many; and one-byte samples of least hashes that a bucket compares.
BANDS, BAND_SIZE, SKETCH = 12, 3, 96
#: Texts may look so much less alike in their sketches than they are; the exact check follows.
SKETCH_MARGIN = 0.15
#: Rows of a bucket that are held at once.
WALK_ROWS = 8192
#: One text in so many tells which shingles are frequent: those found in so many of these, so many shingles at most.
ORDER_SAMPLE, ORDER_LEAST, ORDER_SIZE = 16, 4, 1 << 18
#: Pairs that a task holds before it hands them on.
PAIR_ROWS = 100_000
MULTIPLIER = mixed(np.arange(1, max(BANDS * BAND_SIZE, SKETCH) + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles of so many words, A-Z as a-z; a text of fewer words is one shingle."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    grams = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), dtype=np.uint64))


def _least(hashes: np.ndarray) -> np.ndarray:
    """The least of all hashes under each multiplier, worked out in blocks."""
    out = np.full(len(MULTIPLIER), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * MULTIPLIER
        np.minimum(out, (x ^ (x >> np.uint64(29))).min(axis=0), out=out)
    return out


def banded_pairs(texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(u, v): texts (h, text; h distinct) that meet in a band and look alike in their sketches, enough to connect most that are alike."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            names, keys, sketches = [], [], []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text"), strict=True):
                hashes = shingle_hashes(text.as_py())
                if len(hashes):
                    found = _least(hashes)
                    sketch = (found[:SKETCH] >> np.uint64(40)).astype(np.uint8).tobytes()
                    for i in range(BANDS):
                        names.append(h)
                        keys.append(xxhash.xxh3_64_intdigest(found[i * BAND_SIZE : (i + 1) * BAND_SIZE].tobytes(), i) >> 1)
                        sketches.append(sketch)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, pa.binary())], ["key", "h", "sketch"])

    bands = written(texts.mapInArrow(banded, "key long, h long, sketch binary"), "bands")
    shared = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands-shared")
    meeting = bands.join(shared.select("key"), "key", "left_semi")
    dealt = meeting.repartition(max(shuffle_partitions(texts.sparkSession), 12), "key").sortWithinPartitions("key", "h")
    alike = int(SKETCH * (least - SKETCH_MARGIN))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(names: list[int], sketches: list[bytes], out: list[tuple[int, int]]) -> list[int]:
            """Add the links of a walk to `out`; the rows that a walk began at."""
            table = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(names), SKETCH)
            rest, roots = np.arange(len(names)), []
            while len(rest):
                front, rest = [int(rest[0])], rest[1:]
                roots.append(front[0])
                while front and len(rest):
                    node = front.pop()
                    near = (table[rest] == table[node]).sum(axis=1) >= alike
                    out += [(names[node], names[i]) for i in rest[near].tolist()]
                    front += rest[near].tolist()
                    rest = rest[~near]
            return roots

        key, names, sketches, out = None, [], [], []
        for batch in batches:
            for k, h, sketch in zip(*(batch.column(c).to_pylist() for c in ("key", "h", "sketch")), strict=True):
                if k != key or len(names) >= WALK_ROWS:
                    roots = tree(names, sketches, out) if len(names) > 1 else []
                    # A bucket too large to hold goes on with one text of each cluster so far.
                    names, sketches = ([], []) if k != key else ([names[i] for i in roots], [sketches[i] for i in roots])
                    key = k
                names.append(h)
                sketches.append(sketch)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])
                out = []
        if len(names) > 1:
            tree(names, sketches, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

    return written(dealt.mapInArrow(walk, "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "band-pairs")


def judged_pairs(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose texts are as alike."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = shingle_hashes(a.as_py()), shingle_hashes(b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    paired = pairs.join(texts.select(F.col("h").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("h").alias("v"), F.col("text").alias("b")), "v")
    return paired.select("u", "v", "a", "b").mapInArrow(judged, "u long, v long")


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles found often in one text of `ORDER_SAMPLE`, sorted: at most `ORDER_SIZE`. They come last in the order; which they are costs time only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(_ranks(shingle_hashes(text.as_py())).view(np.int64))], ["s"])

    seen = texts.where(F.pmod("h", F.lit(ORDER_SAMPLE)) == 0).select("text").mapInArrow(run, "s long")
    often = seen.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ORDER_LEAST).orderBy(F.desc("n"), "s").limit(ORDER_SIZE)
    return np.sort(np.array([r.s for r in often.select("s").collect()], dtype=np.int64).view(np.uint64))


def _ranks(hashes: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
    """Places of shingles in the common order: by hash, the frequent ones behind all others."""
    found = hashes >> np.uint64(1)
    if often is not None and len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        found = found | ((often[at] == found).astype(np.uint64) << np.uint64(63))
    return np.sort(found)


def prefix_size(size: int, least: float) -> int:
    """So many shingles of a text suffice to meet any text as alike, in a common order."""
    return size - math.ceil(least * size - 1e-9) + 1


def prefix_pairs(prefixes: DataFrame, least: float) -> DataFrame:
    """(u, v): texts of different clusters that may be as alike, by a shared shingle of their prefixes: all that are, and some that aren't.

    prefixes: h, c (the cluster), size, prefix.
    """
    rows = prefixes.select("h", "c", "size", F.posexplode("prefix").alias("pos", "s"))
    dealt = rows.repartition(max(shuffle_partitions(prefixes.sparkSession), 12), "s").sortWithinPartitions("s", "size")
    share = least / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def may(size: np.ndarray, pos: np.ndarray, c: np.ndarray, i: np.ndarray | int, j: np.ndarray | slice) -> np.ndarray:
            """Whether the texts can be as alike if this is the first shingle that they share."""
            most = np.minimum(size[i] - pos[i], size[j] - pos[j])
            return (c[i] != c[j]) & (size[j] * least <= size[i] + 1e-6) & (most >= share * (size[i] + size[j]) - 1e-6)

        def found(s: np.ndarray, h: np.ndarray, c: np.ndarray, size: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1])
            ends = np.append(starts[1:], len(s))
            two = starts[ends - starts == 2]
            two = two[may(size, pos, c, two, two + 1)]
            out, n = [(h[two], h[two + 1])], len(two)
            more = (ends - starts > 2) & (np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts))
            for a, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
                for i in range(a, e - 1):
                    stop = i + 1 + int(np.searchsorted(size[i + 1 : e], size[i] / least + 1e-6, "right"))
                    near = np.flatnonzero(may(size, pos, c, i, slice(i + 1, stop))) + i + 1
                    if len(near):
                        out.append((np.full(len(near), h[i]), h[near]))
                        n += len(near)
                    if n >= PAIR_ROWS:
                        yield told(out)
                        out, n = [], 0
            if n:
                yield told(out)

        def told(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            u, v = map(np.concatenate, zip(*out, strict=True))
            one = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(one[:, 0]), pa.array(one[:, 1])], ["u", "v"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(x).to_numpy() for x in ("s", "h", "c", "size", "pos")]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last shingle may go on in the next batch
            if cut:
                yield from found(*map(np.concatenate, zip(*held, [x[:cut] for x in columns], strict=True)))
                held = []
            held.append([x[cut:] for x in columns])
        if held:
            yield from found(*map(np.concatenate, zip(*held, strict=True)))

    return dealt.mapInArrow(run, "u long, v long").distinct()


def similar_links(texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(u, v): links between texts (h, text; h distinct) of at least this Jaccard similarity of shingles, enough to connect all that are as alike."""
    first = written(judged_pairs(banded_pairs(texts, least), texts, least), "band-links")
    often = frequent_shingles(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, prefixes = [], [], []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text"), strict=True):
                ranks = _ranks(shingle_hashes(text.as_py()), often)
                if len(ranks):
                    names.append(h)
                    sizes.append(len(ranks))
                    prefixes.append(ranks[: prefix_size(len(ranks), least)].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["h", "size", "prefix"])

    told = texts.select("h", "text").mapInArrow(run, "h long, size long, prefix array<long>")
    clusters = components(first).select(F.col("node").alias("h"), "component")
    prefixes = written(told.join(clusters, "h", "left").select("h", F.coalesce("component", "h").alias("c"), "size", "prefix"), "prefixes")
    pairs = written(prefix_pairs(prefixes, least), "prefix-pairs")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Up to the nearer end of two prefixes both texts are known, so what they share there bounds what they can share."""
        for batch in batches:
            kept = []
            for a, b, x, y in zip(batch.column("a"), batch.column("b"), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = (np.asarray(z.values).view(np.uint64) for z in (a, b))
                end = min(a[-1], b[-1])
                a, b = a[a <= end], b[b <= end]
                both = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(both + min(x - len(a), y - len(b)) >= least / (1 + least) * (x + y) - 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    side = lambda h, p, n: prefixes.select(F.col("h").alias(h), F.col("prefix").alias(p), F.col("size").alias(n))
    near = pairs.join(side("u", "a", "x"), "u").join(side("v", "b", "y"), "v").select("u", "v", "a", "b", "x", "y").mapInArrow(possible, "u long, v long")
    return first.unionAll(judged_pairs(written(near, "prefix-near"), texts, least))


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS, similarity: float | None = SIMILAR) -> DataFrame:
    """`docs` with one row of each cluster, that of the smallest doc_id; rows without a doc_id stay.

    Clusters are of fingerprints within `radius` and, unless `similarity` is None, of texts at least as alike.
    Where rows of the cluster share that doc_id, the text with the smallest hash stays, and one of rows that
    repeat doc_id and text. Unlike texts under one doc_id are of different clusters and all stay.
    """
    told = docs.withColumn("_simhash_text", F.xxhash64("text"))
    found = near_duplicates(docs.where(F.col("doc_id").isNotNull()), radius).select("doc_id", "hash", F.col("cluster").alias("group"))
    if similarity is not None:
        found = written(found, "simhash-found")
        texts = written(told.where(F.col("doc_id").isNotNull() & (F.trim("text") != "")).select(F.col("_simhash_text").alias("h"), "text").dropDuplicates(["h"]), "simhash-texts", "zstd")
        edges = written(similar_links(texts, similarity), "simhash-similar")
        # Texts and fingerprints are nodes of one graph: a text hangs on its fingerprint's cluster.
        cluster_of = written(found.groupBy(F.col("hash").alias("h")).agg(F.min("group").alias("group")), "simhash-groups")
        sides = edges.join(cluster_of.select(F.col("h").alias("u"), F.col("group").alias("a")), "u").join(cluster_of.select(F.col("h").alias("v"), F.col("group").alias("b")), "v")
        joined = components(sides.select(F.col("a").alias("u"), F.col("b").alias("v")))
        found = found.join(joined.withColumnRenamed("node", "group"), "group", "left").select("doc_id", "hash", F.coalesce("component", "group").alias("group"))
    stay = found.groupBy("group").agg(F.min(F.struct("doc_id", "hash")).alias("best")).select(F.col("best.doc_id").alias("doc_id"), F.col("best.hash").alias("_simhash_text")).distinct()
    kept = told.join(stay, ["doc_id", "_simhash_text"], "left_semi").dropDuplicates(["doc_id", "_simhash_text"]).drop("_simhash_text")
    return kept.unionAll(docs.where(F.col("doc_id").isNull()))


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of each document."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
