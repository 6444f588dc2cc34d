import hashlib
from collections import Counter, defaultdict

from marlspark.llm import line_dedup

LAST = line_dedup.LAST


def expected(rows, least=10):
    space = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(space))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(LAST if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == (LAST if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_against_brute_force(edge):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    for options in ({}, {"batches": 1}, {"batches": 9, "fanout": 3}):
        assert Counter(tuple(r) for r in line_dedup.line_dedup_report(edge, **options).collect()) == expected(rows)


def test_levels_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for i in range(4):
        batch = spark.createDataFrame([(k, 0, i) for k in range(i, i + 3)], "h1 long, h2 long, id long")
        known = {r.h1: r.known for r in runs.add(batch).collect()}
        assert known == {k: i > 0 and k < i + 2 for k in range(i, i + 3)}
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert runs.levels[2][0].count() == 6


def test_filter_keeps_columns(make):
    docs = make([(2, "the same long line\nown words of two"), (1, "the same long line"), (3, "The Same Long Line"), (4, "a\nthe same long line  \n")])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: "the same long line", 2: "own words of two", 4: "a\n"}
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_empty_table(edge):
    assert line_dedup.line_dedup_report(edge.where("false")).count() == 0
