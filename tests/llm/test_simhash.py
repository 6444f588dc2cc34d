from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marlspark.llm import simhash
from marlspark.llm.common import table
from marlspark.llm.graph import components


def reach(fps, radius=4):
    """Smallest position reachable, by comparing all pairs."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, fp in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fp) <= radius).tolist():
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(fps))]


def check(docs):
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL").orderBy("doc_id").collect()
    fps = np.array([simhash.fingerprint(r.text) for r in rows], dtype=np.uint64)
    want = Counter((r.doc_id, f"{int(fp):016x}", rows[c].doc_id) for r, fp, c in zip(rows, fps, reach(fps), strict=True))
    assert Counter(tuple(r) for r in simhash.simhash_report(docs).where("doc_id IS NOT NULL").collect()) == want


def test_documents(spark):
    check(table(spark, "/root/testdata/sf0.01", "documents"))


def test_edge_cases(edge):
    check(edge)
    got = {r.doc_id: r for r in simhash.simhash_report(edge).collect()}
    assert got[1].fingerprint == "0" * 16 and got[3].component_id == 1 and got[None].component_id is None
    assert simhash.simhash_report(edge.where("false")).count() == 0
    left = simhash.keep_one_of_each(edge)
    assert left.columns == edge.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {1, 8, None} <= set(ids) and not {2, 3, 9} & set(ids)


def test_unlike_texts_of_one_id_all_stay(make):
    other = "quite another text with words of its own that nobody else has written anywhere before today"
    near = "the first of all texts about a brown fox that jumps over every lazy dog it meets on its way"
    rows = [(5, near), (5, other), (5, other), (6, other), (7, near), (4, near + " home"), (None, near)]
    left = simhash.keep_one_of_each(make(rows))
    texts = sorted((r.doc_id or 0, r.text) for r in left.collect())
    fps = {t: simhash.fingerprint(t) for _, t in rows}
    close = int(fps[near] ^ fps[near + " home"]).bit_count() <= 4
    want = [(0, near), (5, other)] + ([(4, near + " home")] if close else [(4, near + " home"), (5, near)])
    assert texts == sorted(want)
    ids = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_report(make(rows)).collect()}
    assert ids[6, f"{fps[other]:016x}"] == 5 and ids[7, f"{fps[near]:016x}"] == (4 if close else 5)


def test_links_of_planted_neighbours(spark):
    draw = np.random.default_rng(5)
    seeds = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(40):
            bits = draw.choice(64, draw.integers(1, 6), replace=False)
            fps.add(s ^ int(np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))))
    fps = np.array(sorted(fps), dtype=np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    pairs = simhash.links(nodes).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64).tolist())}
    assert all(int(np.bitwise_count(fps[at[r.a]] ^ fps[at[r.b]])) <= 4 for r in pairs)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in pairs:
        a, b = sorted((root(at[r.a]), root(at[r.b])))
        parent[b] = a
    assert [root(i) for i in range(len(fps))] == reach(fps)


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionAll(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "u long, v long"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_definition():
    import xxhash

    words = "The QUICK brown fox jumps over".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint("The QUICK\tbrown  fox\njumps over") == want
    assert simhash.fingerprint("one") == xxhash.xxh64_intdigest("one", 42) and simhash.fingerprint(" \n") == 0


def jaccard(a, b):
    x, y = set(simhash.shingle_hashes(a).tolist()), set(simhash.shingle_hashes(b).tolist())
    return len(x & y) / max(1, len(x | y))


def planted(draw, changes, n):
    """Texts of about 200 words, each with a copy in which so many words are others."""
    rows = []
    for i in range(n):
        words = [f"w{x}" for x in draw.integers(0, 4000, 200)]
        other = list(words)
        for k in range(changes):
            other[(k + 1) * 190 // changes] = f"changed{i}x{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    return rows


def test_recall_of_planted_near_copies(spark, make):
    """One of each pair stays, at a similarity of about 0.8 and 0.9; others stay all."""
    draw = np.random.default_rng(2)
    for changes, low, high in ((4, 0.8, 0.83), (2, 0.89, 0.92)):
        rows = planted(draw, changes, 60)
        assert all(low <= jaccard(rows[i][1], rows[i + 1][1]) <= high for i in range(0, 120, 2))
        left = {r.doc_id for r in simhash.keep_one_of_each(make(rows)).collect()}
        assert left >= set(range(0, 120, 2))
        assert sum(i not in left for i in range(1, 120, 2)) >= 0.95 * 60
    apart = planted(draw, 6, 40)  # about 0.73
    assert max(jaccard(apart[i][1], apart[i + 1][1]) for i in range(0, 80, 2)) < 0.8
    alone = {r.doc_id for r in simhash.keep_one_of_each(make(apart), similarity=None).collect()}
    assert {r.doc_id for r in simhash.keep_one_of_each(make(apart)).collect()} == alone


def test_large_buckets_and_edge_cases(spark, make, edge, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[: 3 * (i % 90)], f"x{i}", *words[3 * (i % 90) :]])) for i in range(120)]
    assert [r.doc_id for r in simhash.keep_one_of_each(make(rows)).collect()] == [0]
    left = simhash.keep_one_of_each(edge)
    assert left.columns == edge.columns and {r.doc_id for r in left.collect()} >= {1, None, 5, 8, 11, 12, 13, 14}
    assert simhash.keep_one_of_each(edge.where("false")).count() == 0


def test_no_similar_texts_stay_among_the_given(spark):
    """Of the given documents no two that stay are as alike as 0.8, all pairs compared."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = [r.text for r in simhash.keep_one_of_each(docs).collect() if r.text and r.text.strip()]
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in left]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert not near and len(left) > 100


def test_no_link_is_lost(spark):
    """Links connect just what all pairs do, where texts lie around the similarity of 0.8 and a band's walk begins at one that is less like the others."""
    draw = np.random.default_rng(7)
    texts = ["one two", "One  two", "a b c d e", "a b c d e f"]
    for k in range(40):
        words = [f"w{x}" for x in draw.integers(0, 3000, int(draw.integers(20, 160)))]
        for _ in range(8):
            other = list(words)
            for at in draw.integers(0, len(words), int(draw.integers(1, max(2, len(words) // 35)))):
                other[at] = f"c{k}x{draw.integers(0, 40)}"
            texts.append(" ".join(other))
    rows = spark.createDataFrame([(t,) for t in sorted(set(texts))], "text string").select(F.xxhash64("text").alias("h"), "text").collect()
    names, sets = [r.h for r in rows], [set(simhash.shingle_hashes(r.text).tolist()) for r in rows]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]

    def classes(pairs):
        root = {h: h for h in names}

        def top(h):
            while root[h] != h:
                h = root[h]
            return h

        for u, v in pairs:
            a, b = sorted((top(u), top(v)))
            root[b] = a
        return {h: top(h) for h in names}

    got = simhash.similar_links(spark.createDataFrame(rows, "h long, text string")).collect()
    assert {(r.u, r.v) for r in got} <= {tuple(sorted((names[i], names[j]))) for i, j in alike}
    assert classes((r.u, r.v) for r in got) == classes((names[i], names[j]) for i, j in alike)
    assert len(set(classes((names[i], names[j]) for i, j in alike).values())) < len(names) - 100
