import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspark.llm import suffix_dedup as sd
from marlspark.llm.common import table


def expected(rows, length):
    count = Counter()
    data = [(doc, (text or "").encode()) for doc, text in rows]
    for _, b in data:
        count.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = Counter()
    for doc, b in data:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j + 1 : j + 1 + length] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone[1:-1]])
        out[doc, len(b), len(b) - len(kept), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def expected_words(rows, length):
    """(doc, words in repeated passages), by comparing all passages."""
    count = Counter()
    data = [(doc, (text or "").encode().split()) for doc, text in rows]
    for _, w in data:
        count.update(tuple(w[j : j + length]) for j in range(len(w) - length + 1))
    out = Counter()
    for doc, w in data:
        covered = {i for j in range(len(w) - length + 1) if count[tuple(w[j : j + length])] > 1 for i in range(j, j + length)}
        out[doc, len(covered)] += 1
    return out


def got_words(docs, **options):
    return Counter((r.doc_id, r.n_passage_words) for r in sd.remove_repeats(docs, **options).collect())


def got(docs, **options):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.remove_repeats(docs, **options).collect())


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("bucket_rows", [20_000, 5])
def test_against_brute_force(make, hot, bucket_rows):
    draw = random.Random(hot + bucket_rows)
    shared = ["".join(draw.choice("abcdé ") for _ in range(draw.randint(30, 160))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [draw.choice(shared) if draw.random() < 0.5 else "".join(draw.choice("abcdefgh ") for _ in range(draw.randint(1, 90))) for _ in range(draw.randint(1, 6))]
        rows.append((i, "".join(parts)))
    rows += [(100, "aaaa" * 100), (101, "a" * 37), (102, None), (103, ""), (104, rows[0][1]), (105, rows[0][1]), (105, rows[0][1]), (None, rows[3][1]), (106, "ab" * 200)]
    assert got(make(rows), length=40, window=16, hot=hot, bucket_rows=bucket_rows) == expected(rows, 40)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_passages_against_brute_force(make, hot):
    draw = random.Random(hot)
    word = lambda n: " ".join("".join(draw.choice("abé") for _ in range(draw.randint(1, 3))) for _ in range(n))
    shared = [word(draw.randint(5, 40)) for _ in range(8)]
    rows = [(i, draw.choice([" ", "\n", " \t "]).join(draw.choice(shared) if draw.random() < 0.5 else word(draw.randint(1, 30)) for _ in range(draw.randint(1, 6)))) for i in range(80)]
    rows += [(100, "a " * 300), (101, "a b " * 11), (102, None), (103, " "), (104, rows[0][1]), (104, rows[0][1]), (None, rows[3][1]), (105, "x " * 15), (106, "x " * 15), (107, "x y " * 3), (108, "x y " * 3)]
    docs = make(rows)
    assert got_words(docs, length=40, window=16, words=12, word_window=4, hot=hot, bucket_rows=5) == expected_words(rows, 12)
    assert got(docs, length=40, window=16, words=12, word_window=4, hot=hot) == expected(rows, 40)


def test_texts_in_blocks(make, monkeypatch):
    """Anchors are found in blocks; a block's end changes nothing."""
    draw = np.random.default_rng(7)
    data = draw.integers(97, 101, 3000, dtype=np.uint8).tobytes()
    whole = {j: a for a, s, e in zip(*sd.anchors(data), strict=True) for j in range(s, e + 1)}
    monkeypatch.setattr(sd, "BLOCK", 70)
    assert whole == {j: a for a, s, e in zip(*sd.anchors(data), strict=True) for j in range(s, e + 1)}


def test_word_codes():
    text = "a bb\x0b\x0ca\ta\r\n  bb \u00a0x é " + "w" * 300_000 + " a"
    codes = np.frombuffer(sd.word_codes(text.encode()), dtype=">u8").tolist()
    words = text.encode().split()
    assert len(codes) == len(words) and len(set(codes)) == len(set(words))
    assert all((codes[i] == codes[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    assert sd.word_codes(b"") == sd.word_codes(b" \n") == b""


def test_heads_of_one_prefix_spread_over_buckets(spark):
    """4,000 heads of one 24-byte prefix, held by 5 rows each."""
    rows = spark.range(20_000).selectExpr("cast(concat('-----------------------------', id % 4000) AS binary) AS head", "id % 4000 AS k").withColumn("k", F.xxhash64("k"))
    placed = sd.ranged(rows, 20).withColumn("bucket", F.spark_partition_id())
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 5_000
    assert placed.select("head", "bucket").distinct().count() == 4000


def test_texts_that_start_alike(make):
    draw = random.Random(5)
    tails = ["".join(draw.choice("abcdef ") for _ in range(60)) for _ in range(40)]
    rows = [(i, "".join(draw.choice("ghijk") for _ in range(8)) + "-" * 40 + tails[i % 40]) for i in range(120)]
    assert got(make(rows), length=40, window=16, bucket_rows=5) == expected(rows, 40)


def test_documents(spark, edge):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == expected(rows, sd.LENGTH)
    assert got_words(docs) == expected_words(rows, sd.PASSAGE_WORDS)
    assert sd.suffix_report(edge.where("false")).count() == 0
    done = {r.doc_id: r for r in sd.suffix_report(edge).collect()}
    assert done[9].n_removed == done[9].n_bytes and done[12].n_removed == done[12].n_bytes


def test_anchors_belong_to_contents():
    draw = np.random.default_rng(2)
    data = draw.integers(97, 101, 3000, dtype=np.uint8).tobytes()
    x, lo, hi = sd.anchors(data)
    assert lo[0] == 0 and hi[-1] == len(data) - sd.LENGTH and (lo[1:] == hi[:-1] + 1).all()
    assert ((x >= hi) & (x < lo + sd.WINDOW)).all()
    shifted, lo2, hi2 = sd.anchors(b"zz" + data)
    by_start = {j: a - j for a, s, e in zip(x, lo, hi, strict=True) for j in range(s, e + 1)}
    assert all(by_start[j - 2] == a - j for a, s, e in zip(shifted, lo2, hi2, strict=True) for j in range(max(s, 2), e + 1))


def test_multikey_order():
    draw = np.random.default_rng(4)
    words = draw.integers(0, 3, (500, 4)).astype(np.uint64)
    order = sd.multikey_order(words)
    rows = [tuple(words[i]) for i in order]
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(500))
