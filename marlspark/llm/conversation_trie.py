"""The prefix trie of rebuilt conversations, with subtree totals by tree contraction.

1. Turns are dealt by range of (conversation, turn), so that a conversation however long spreads over
   partitions; ranks within a partition and counts of those before give every turn its position.
2. A prefix is named by its depth and 128 bits: the exclusive or of hashes of (position, role, text). A
   running exclusive or over blocks of a conversation, and over the blocks' totals, gives all prefixes.
3. Nodes are an aggregate over equal prefixes, with map-side sums. A node's own id is its depth and its
   smallest member; a join by the parent's prefix gives the parent's. Parents of very many children (the
   root above all) go to every task instead.
4. `contraction.subtree_totals` sums leaves and saved tokens over every subtree.
5. The ids that end at a node are dealt by range, joined in pieces, and hashed piece by piece in one
   stream, so a group of any size is never held.

Defined results: turns that tie are ordered by role, then by the SHA-256 of the text; rows that repeat are
turns of their own; null role and text are empty; a row without a conv_id belongs to no conversation; a
conversation may be rebuilt to no turns and then ends at the root; an empty table gives no node; extra
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspark.llm.common import join_counted, words, written
from marlspark.llm.contraction import subtree_totals

FAMILY, LEADS = 20, 4
#: Rows a partition ranks.
RANGE_ROWS = 100_000
#: Turns whose prefixes one window runs over.
BLOCK_TURNS = 4096
#: Ids of one piece.
PIECE_IDS = 4096
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
NODE = ["depth", "x1", "x2"]


def _parts(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def leads(c: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(c.cast("string")) % LEADS


def rebuilt(conversations: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(c, size, depth, t1, t2, n_words) of each turn of the rebuilt conversations, and (c, size) of each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashes = [F.xxhash64(F.lit(i), role, text).alias(f"t{i}") for i in (1, 2)]
    turns = written(
        conversations.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), *hashes,
            F.size(words(text)).cast("long").alias("n_words"), F.monotonically_increasing_id().alias("salt"),
        ),
        "trie-turns",
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("salt")]
    dealt = turns.repartitionByRange(_parts(turns, range_rows), F.col("c"), *order).withColumn("p", F.spark_partition_id())
    ranked = written(dealt.select("c", "p", F.row_number().over(Window.partitionBy("p", "c").orderBy(*order)).alias("i"), "t1", "t2", "n_words"), "trie-ranked")
    counts = ranked.groupBy("c", "p").agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("c")
    before = F.coalesce(F.sum("m").over(whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select("c", "p", before.alias("before"), F.sum("m").over(whole).alias("n")), "trie-offsets")

    one_each = offsets.where("before = 0")
    firsts = one_each.where(f"c % {FAMILY} = 0").select(F.col("c").alias("base"), F.col("n").alias("there"))
    told = one_each.select("c", "n", leads(F.col("c")).alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("base")).join(firsts, "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    sizes = written(told.select("c", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "trie-sizes")
    placed = written(ranked.join(offsets.join(sizes, "c").select("c", "p", "before", "h", "taken", "size"), ["c", "p"]).select("c", "size", "h", "taken", (F.col("before") + F.col("i")).alias("pos"), "t1", "t2", "n_words"), "trie-placed")
    own = placed.where("pos > h").select("c", "size", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "t1", "t2", "n_words")
    heads = placed.where(f"c % {FAMILY} = 0 AND pos < {LEADS}").select(F.col("c").alias("base"), "pos", "t1", "t2", "n_words")
    led = sizes.where("taken > 0").join(heads, "base").where("pos <= taken").select("c", "size", F.col("pos").alias("depth"), "t1", "t2", "n_words")
    return own.unionAll(led), sizes.select("c", "size")


def prefixes(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(c, size, depth, x1, x2, px1, px2, n_words): the name of each prefix and of the one before it."""
    turns = written(turns.select("c", "size", "depth", "n_words", F.expr(f"(depth - 1) div {block_turns}").alias("block"), F.xxhash64("depth", "t1", "t2").alias("z1"), F.xxhash64("t2", "depth", "t1").alias("z2")), "trie-rebuilt")
    blocks = turns.where(F.col("size") > block_turns).groupBy("c", "block").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"))
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("c", "block", *[F.bit_xor(f"z{i}").over(earlier).alias(f"o{i}") for i in (1, 2)])
    running = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    here = turns.select("c", "size", "depth", "block", "n_words", "z1", "z2", *[F.bit_xor(f"z{i}").over(running).alias(f"y{i}") for i in (1, 2)]).join(offsets, ["c", "block"], "left")
    x = [F.col(f"y{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0).cast("long"))) for i in (1, 2)]
    return here.select("c", "size", "depth", *[x[i].alias(f"x{i + 1}") for i in (0, 1)], *[x[i].bitwiseXOR(F.col(f"z{i + 1}")).alias(f"px{i + 1}") for i in (0, 1)], "n_words")


def joined_digests(ends: DataFrame, range_rows: int = RANGE_ROWS, piece_ids: int = PIECE_IDS) -> DataFrame:
    """(depth, x1, x2, ends_sha256): the SHA-256 of each node's ids in decimal, ascending and joined by commas; ends: a table of (depth, x1, x2, c)."""

    def runs(batch: pa.RecordBatch) -> Iterator[tuple]:
        """(node, first row, row after the last) of each run of one node."""
        keys = [batch.column(k).to_numpy() for k in NODE]
        same = (keys[0][1:] == keys[0][:-1]) & (keys[1][1:] == keys[1][:-1]) & (keys[2][1:] == keys[2][:-1])
        cuts = [0, *((~same).nonzero()[0] + 1).tolist(), batch.num_rows]
        yield from ((tuple(int(k[a]) for k in keys), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, a, b in runs(batch):
                ids = batch.column("c").slice(a, b - a).to_pylist()
                rows += [(*key, ids[i], ",".join(map(str, ids[i : i + piece_ids]))) for i in range(0, len(ids), piece_ids)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*NODE, "c", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        key, state, rows = None, hashlib.sha256(), []
        for batch in batches:
            pieces = batch.column("piece")
            for node, a, b in runs(batch):
                if node != key:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(pieces.slice(a, b - a).to_pylist()).encode())
            if len(rows) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*NODE, "ends_sha256"])
                rows = []
        if key is not None:
            rows.append((*key, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*NODE, "ends_sha256"])

    kinds = "depth long, x1 long, x2 long"
    dealt = ends.repartitionByRange(_parts(ends, range_rows), *NODE, "c").sortWithinPartitions(*NODE, "c")
    pieces = dealt.select(*NODE, "c").mapInArrow(join, f"{kinds}, c long, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "c").mapInArrow(digest, f"{kinds}, ends_sha256 string")


def conversation_trie(conversations: DataFrame, range_rows: int = RANGE_ROWS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, sizes = rebuilt(conversations, range_rows)
    zero = F.lit(0).cast("long")
    named = written(prefixes(turns, block_turns), "trie-prefixes")
    grouped = named.groupBy("depth", "x1", "x2").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_words").alias("n_words"), F.min("px1").alias("px1"), F.min("px2").alias("px2"))
    root = sizes.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", zero.alias("n_words"), F.lit(None).cast("long").alias("px1"), F.lit(None).cast("long").alias("px2"))
    nodes = written(grouped.unionByName(root).withColumn("pd", F.when(F.col("depth") > 0, F.col("depth") - 1)), "trie-nodes")
    kids = nodes.where("pd IS NOT NULL").groupBy(F.col("pd").alias("depth"), F.col("px1").alias("x1"), F.col("px2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-nodes")
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("pd"), F.col("x1").alias("px1"), F.col("x2").alias("px2"), F.col("conv_id").alias("pc"), F.col("n_children").alias("n"))
    below = join_counted(nodes.where("pd IS NOT NULL"), parents, ["pd", "px1", "px2"]).drop("n")
    full = written(below.unionByName(nodes.where("pd IS NULL").withColumn("pc", F.lit(None).cast("long"))), "trie-full")

    leaf = F.col("n_children") == 0
    tree = full.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "pc", "pd", leaf.alias("leaf"), leaf.cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"]).withColumnsRenamed({"c": "conv_id", "d": "depth"})
    ends = written(named.where("depth = size").select(*NODE, "c").unionByName(sizes.where("size = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "c")), "trie-ends")
    digests = joined_digests(ends, range_rows)
    out = full.join(totals, ["conv_id", "depth"]).join(digests, NODE, "left")
    return out.select("conv_id", "depth", F.col("pc").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


SQL = """
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
    SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
                           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
    FROM turns GROUP BY conv_id
), whole AS (
    SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM conv c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.role, t.text FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN conv b ON b.conv_id = c.base
), prefix AS (
    SELECT conv_id, 0 AS depth, '' AS text, '' AS path FROM conv
    UNION ALL
    SELECT conv_id, depth, text, string_agg(sha256(role) || sha256(text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) FROM whole
), last AS (SELECT conv_id, max(depth) AS depth FROM prefix GROUP BY conv_id),
node AS (
    SELECT p.depth, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(p.text), '[^\x20\x09-\x0D]+')) AS saved,
           string_agg(l.conv_id::VARCHAR, ',' ORDER BY l.conv_id) AS ends
    FROM prefix p LEFT JOIN last l ON l.conv_id = p.conv_id AND l.depth = p.depth GROUP BY p.depth, p.path
), kids AS (SELECT depth - 1 AS depth, left(path, length(path) - 128) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
up AS (SELECT n.saved, k.n IS NULL AS leaf, a.k AS depth, left(n.path, 128 * a.k) AS path FROM node n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path, LATERAL (SELECT unnest(range(n.depth + 1)) AS k) a),
total AS (SELECT depth, path, sum(leaf::INT) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY depth, path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM node n JOIN total t ON t.depth = n.depth AND t.path = n.path LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path
LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = left(n.path, length(n.path) - 128)
"""
