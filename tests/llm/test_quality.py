import re
from collections import Counter

from pyspark.sql import functions as F

from marlspark.llm import quality


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_counts_against_brute_force(spark, edge):
    got = quality.quality_report(edge)
    texts = Counter((r.doc_id, expected(r.text)) for r in edge.select("doc_id", "text").collect())
    assert Counter((r.doc_id, tuple(r)[1:7]) for r in got.collect()) == texts
    assert all(not r.kept for r in got.where("base_failed").collect())


def test_order_changes_no_verdict(edge):
    kept = sorted(r.doc_id or 0 for r in quality.quality_filter(edge).collect())
    back = sorted(r.doc_id or 0 for r in quality.quality_filter(edge, tuple(reversed(quality.RULES))).collect())
    assert kept == back
    assert quality.quality_filter(edge).columns == edge.columns


def test_costly_rules_that_reject_little_come_late(make):
    docs = make([(i, f"one two three {i} five six seven eight nine ten eleven") for i in range(300)])
    rules = (quality.Rule("never", lambda t, w, k: quality.n_repeat_words(w) < 0), quality.Rule("dear", lambda t, w, k: F.length(t) % 2 == 0, lambda t, w: F.size(w) * 100), quality.Rule("half", lambda t, w, k: F.length(t) % 2 == 0))
    assert [x.rule.name for x in quality.measure(docs, rules)] == ["half", "dear", "never"]


def test_the_order_is_the_same_each_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    orders = [[x.rule.name for x in quality.measure(docs)] for _ in range(10)]
    assert all(order == orders[0] for order in orders)


def test_each_rule(make):
    plain = " ".join(f"word{i}" for i in range(40))
    bad = {
        "symbols": " | ".join(f"word{i}" for i in range(40)),
        "capitals": plain.upper(),
        "stutter": " ".join(f"w{i // 4}xyz" for i in range(40)),
        "dups": "\n".join(f"line {i % 3} of words" for i in range(12)),
        "long": " ".join("x" * 50 + str(i) for i in range(20)),
    }
    docs = make([(0, plain), *enumerate(bad.values(), 1)])
    assert [r.doc_id for r in quality.quality_filter(docs).collect()] == [0]


def test_empty_table(edge):
    none = edge.where("false")
    assert quality.quality_report(none).count() == 0 and quality.quality_filter(none).count() == 0
