import hashlib
import random

import pytest

from marlspark.llm import substring_dedup

LAST = substring_dedup.LAST


def by_hand(rows, window=13):
    split = [((LAST if i is None else i), (t or "").encode().split()) for i, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for (doc_id, _), (d, w) in zip(rows, split, strict=True):
        gone = {i + k for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for k in range(window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs, window=13, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = substring_dedup.remove_passages(docs, window, **options) if options or window != 13 else None
    if got is None:
        got = substring_dedup.substring_report(docs)
        assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
        result = sorted(map(tuple, got.collect()), key=str)
    else:
        result = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()), key=str)
    assert result == by_hand(rows, window)


def corpus(n=60, vocabulary=6, seed=1):
    """Texts of few words, so that windows repeat within and across texts, with copies and shared passages."""
    deal = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(n):
        text = [deal.choice(words) for _ in range(deal.randrange(60))]
        if i % 3 == 0:
            at = deal.randrange(len(text) + 1)
            text[at:at] = passage.split()[deal.randrange(8) : 22 + deal.randrange(9)]
        rows.append((n - i, deal.choice([" ", "\n", " \t "]).join(text)))
    rows += [(n + k, rows[k][1]) for k in range(0, n, 7)] + [rows[4], (None, rows[5][1]), (None, rows[5][1]), (5, rows[9][1] + " and more")]
    return rows


def test_edge_cases(edge):
    check(edge)


def test_few_words_and_shared_passages(make):
    check(make(corpus()))


def test_hot_minimisers_and_small_buckets(make):
    check(make(corpus()), window=5, gram=2, hot=2, bucket_rows=3)


def test_slices_of_long_texts(make, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 64)
    unit = list(substring_dedup.units(iter([((1,), b"x" * 700 + b" " + b" ".join(b"%d" % i for i in range(100)))]), 13))
    covered = {first + i for part in unit for _, first, words in part for i in range(len(words) - 12)}
    assert covered == set(range(101 - 12))
    flat, part, lo, hi, g, c = substring_dedup.runs(unit[0], 13, 4)
    assert sum(hi - lo + 1) == len(flat) - 12


def test_long_text_against_its_parts(make):
    deal = random.Random(7)
    words = [f"{deal.choice('abcdef')}{deal.randrange(3000)}" for _ in range(120_000)]
    rows = [(9, " ".join(words)), (3, " ".join(words[40_000:40_030])), (4, " ".join(words[59_990:60_300])), (12, "\n".join(words[100_000:])), (13, "y" * 300_000 + " " + " ".join(words[:50]))]
    check(make(rows))


def test_empty_table(edge):
    assert substring_dedup.substring_report(edge.where("false")).count() == 0


def test_given_rows_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001/documents.parquet"
    got = substring_dedup.substring_report(spark.read.parquet(path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert sorted(map(tuple, got), key=str) == sorted(duck.execute(substring_dedup.SQL).fetchall(), key=str)
