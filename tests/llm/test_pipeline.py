import random

import corpus_pipeline
import numpy as np

from marlspark.llm import simhash
from marlspark.llm.common import table

DATA = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = table(spark, DATA, "documents")
    bench = [r.text for r in table(spark, DATA, "benchmark").collect()]
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DATA).persist()
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        assert set(seen[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
    fps = np.array([simhash.fingerprint(t) for t in seen["simhash_near_dedup"].values()], dtype=np.uint64)
    assert all((np.bitwise_count(fps ^ fp) <= 4).sum() == 1 for fp in fps)
    lines = [x.strip().lower() for t in seen["line_dedup"].values() for x in set(t.split("\n")) if len(x.strip()) >= 10]
    assert len(lines) - len(set(lines)) < 3  # a line may be in one document in two spellings
    assert not any(b in t for t in seen["benchmark_decontamination"].values() for b in bench)
    assert len(seen["benchmark_decontamination"]) > 0.9 * len(seen["simhash_near_dedup"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == len(seen["benchmark_decontamination"])
    assert last.where("n_tokens < 2").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_edge_cases(spark, make, edge, tmp_path):
    """Nulls, empty texts, repeated ids with equal and unlike texts, clashing extra columns, an empty table."""
    spark.createDataFrame([(1, "a benchmark question that none of these texts holds in any form whatever")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("aeioubcdlmnrst") for _ in range(draw.randint(2, 8)))
    one, two = ("\n".join(" ".join(word() for _ in range(12)) for _ in range(6)) for _ in range(2))
    unlike = "some other words stand in this text, which shares its number with an older one but nothing else\nand its second line is short"
    docs = make([(1, one), (1, unlike), (1, one), (2, one), (3, two), (None, two + "with an end"), (4, None), (5, ""), (6, " \n\t")]).unionAll(edge)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == before.columns
        if "n_chars" in docs.columns and name == "line_dedup":
            assert docs.where("n_chars <> length(text)").count() == 0
        rows = docs.collect()
        assert stage(spark, before.where("false"), str(tmp_path)).count() == 0, name
    kept = {(r.doc_id, r.text) for r in rows}
    assert {unlike} < {t for d, t in kept if d == 1} and len([t for d, t in kept if d == 1]) == 2
    assert not {2, 4, 5, 6} & {d for d, _ in kept} and {r.kept for r in rows} == {"extra"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
