import itertools

import numpy as np
import pytest

from marlspark.llm import language
from marlspark.llm.common import table

DATA = "/root/testdata/sf0.01"


def brute(emit, transitions):
    """Posteriors by summing over all labellings."""
    n, k = emit.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        # A uniform label stands before the first word.
        weight = sum(np.exp(transitions[p, path[0]]) for p in range(k)) * np.prod([np.exp(transitions[a, b]) for a, b in itertools.pairwise(path)]) * np.prod([np.exp(emit[i, c]) for i, c in enumerate(path)])
        for i, c in enumerate(path):
            out[i, c] += weight
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward(monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 3)
    draw = np.random.default_rng(1)
    lengths = np.array([7, 1, 3, 6])
    emit, transitions = draw.normal(size=(lengths.sum(), 2)), draw.normal(size=(2, 2))
    got = language.posteriors(emit, lengths, transitions)
    at = 0
    for n in lengths:
        assert np.allclose(got[at : at + n], brute(emit[at : at + n], transitions))
        at += n


def test_held_out_accuracy(spark):
    docs = table(spark, DATA, "documents")
    got = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switching(spark):
    rows = [(r.text, r.lang) for r in table(spark, DATA, "documents").where("lang in ('en', 'de') and n_chars > 500").collect()]
    model = language.train(rows)
    en, de = (next(t for t, lang in rows if lang == x).split()[:30] for x in ("en", "de"))
    words = [w for part in (en, de) for w in language.WORD.findall(" ".join(part).lower())]
    emissions = np.stack([model.emission(w) for w in words])
    found = language.posteriors(emissions, np.array([len(words)]), model.transitions).argmax(axis=1)
    half = len(language.WORD.findall(" ".join(en)))
    truth = np.array([model.labels.index("en")] * half + [model.labels.index("de")] * (len(words) - half))
    assert (found == truth).mean() > 0.9


def test_edge_cases(edge, make):
    got = {r.doc_id: r for r in language.language_report(edge).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert got[12].lang_pred == "en"
    assert language.language_report(edge.where("false")).count() == 0
    odd = language.language_report(edge.unionByName(make([(50, "² ½ 123 _"), (51, "é")]))).where("doc_id >= 50").orderBy("doc_id").collect()
    assert odd[0].lang_pred == "und" and odd[1].lang_pred == "en"
    unlabelled = make([(1, "some words", None)])
    assert language.language_report(unlabelled).first().lang_pred == "und"


def test_only_the_other_folds_are_learned_from(spark):
    import zlib

    ids = spark.range(200).selectExpr("id AS doc_id")
    got = {r.doc_id: r.t for r in ids.select("doc_id", language.in_training(ids.doc_id).alias("t")).collect()}
    assert all(t == (zlib.crc32(str(i).encode()) % 4 != 2) for i, t in got.items())


@pytest.mark.parametrize("word", ["a", "ab", "straße"])
def test_features(word):
    assert "w" + word in language.features(word) and len(set(language.features(word))) > 2
