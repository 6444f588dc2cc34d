import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlspark.llm import contraction, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, c string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    plain = {c: [(r, t) for _, r, _, t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = plain.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in kids[path])
    out = []
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(path))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    got = conversation_trie.conversation_trie(df, **options)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [(0, 0, "user", "a b"), (0, 1, "bot", "c"), (1, 0, "user", "x"), (2, None, None, None), (2, 0, "user", None), (2, 0, "user", "b"), (2, 0, "user", "b"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(25, 3, "user", "alone"), (27, 1, "", ""), (-3, 0, "user", "a b"), (-3, 1, "bot", "c"), (-25, 9, "u", "neg"), (41, 0, "user", "only one, may be cut"), (42, 0, "user", "x"), (43, 0, "user", "x"), (44, 0, "user", "\x0b   y")]
    assert trie(spark, rows, range_rows=3, block_turns=2) == by_hand(rows)


def test_random_families(spark):
    deal = random.Random(5)
    rows = [(c, t, deal.choice(["user", "bot"]), deal.choice(["a", "a b", "c  d e", ""])) for c in range(120) for t in range(deal.randrange(9))]
    deal.shuffle(rows)
    assert trie(spark, rows) == by_hand(rows)


def test_one_long_chain_and_a_hot_group(spark):
    rows = [(0, t, "user", f"t{t}") for t in range(700)] + [(c, t, "user", "same") for c in range(20, 320) for t in range(4)] + [(c, t, "user", f"t{t}") for c in (1, 2) for t in range(650)]
    assert trie(spark, rows, range_rows=200, block_turns=64) == by_hand(rows)


def test_empty_table(spark):
    assert trie(spark, []) == []


def test_given_rows_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001/conversations.parquet"
    got = conversation_trie.conversation_trie(spark.read.parquet(path)).select(*COLUMNS).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    assert sorted(map(tuple, got), key=str) == sorted(duck.execute(conversation_trie.SQL).fetchall(), key=str)


def test_contraction_of_a_random_tree(spark):
    deal = random.Random(3)
    parent = {0: None} | {i: (i - 1 if deal.random() < 0.7 else deal.randrange(i)) for i in range(1, 400)}
    value = {i: deal.randrange(-5, 9) for i in parent}
    total = dict(value)
    for i in range(399, 0, -1):
        total[parent[i]] += total[i]
    inner = set(parent.values())
    nodes = spark.createDataFrame([(i, 0, p, None if p is None else 0, i not in inner, value[i]) for i, p in parent.items()], "c long, d long, pc long, pd long, leaf boolean, v long")
    got = contraction.subtree_totals(nodes, ["v"])
    assert {r.c: r.v for r in got.collect()} == total and got.count() == 400
    one = nodes.where("c = 0").withColumn("leaf", F.lit(True))
    assert [r.v for r in contraction.subtree_totals(one, ["v"]).collect()] == [value[0]]
