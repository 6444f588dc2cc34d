"""Language of texts by a linear-chain conditional random field over their words.

Each word has affix, character n-gram and lexicon features; transitions between the labels of
neighbouring words are learned too, on sequences put together from passages of different languages, so
that code-switched text is labelled word by word. Forward-backward gives every word's posterior; a
text's language is the label of the highest mean posterior, and its score that mean.

The model is fitted by the driver on a bounded sample of labelled rows (`TRAIN_ROWS`), and its size is
bounded by that sample. Prediction takes whole texts: blocks of words are multiplied into transfer
matrices side by side and chained, so long texts don't make long Python loops.

Defined results: a null text, or one without a letter, gives `und` and score 0; rows without a label
aren't learned from; repeated rows get equal results; an empty table, or one without labels, gives `und`
for all; extra columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 1200
SEQUENCES, LENGTH, EPOCHS, BATCH = 6000, 48, 3, 256
BLOCK = 64
KEEP_WORDS = 200_000
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """Lexicon entry, affixes and character trigrams of a lower-case word."""
    out = ["w" + word]
    for n in (1, 2, 3):
        if len(word) >= n:
            out += [f"p{word[:n]}", f"s{word[-n:]}"]
    edged = f"<{word}>"
    return out + ["g" + edged[i : i + 3] for i in range(len(edged) - 2)]


class Model:
    """Labels, feature weights (features x labels) and transitions (labels x labels)."""

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, transitions: np.ndarray) -> None:
        self.labels, self.index, self.weights, self.transitions = labels, index, weights, transitions

    def emission(self, word: str) -> np.ndarray:
        ids = [i for f in features(word) if (i := self.index.get(f)) is not None]
        return self.weights[ids].sum(axis=0) if ids else np.zeros(len(self.labels), dtype=np.float32)


def _normal(x: np.ndarray, axis: int | tuple[int, ...]) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axis, keepdims=True), 1e-300)


def train(rows: list[tuple[str, str]], seed: int = 3) -> Model | None:
    """Fit a model to (text, label) rows by gradient ascent on the likelihood (Adagrad)."""
    labels = sorted({label for _, label in rows})
    texts: dict[int, list[list[str]]] = {k: [] for k in range(len(labels))}
    for text, label in rows:
        if found := WORD.findall(text.lower()):
            texts[labels.index(label)].append(found)
    texts = {k: v for k, v in texts.items() if v}
    if not texts:
        return None
    draw = np.random.default_rng(seed)
    words, targets = [], []
    for _ in range(SEQUENCES):
        sequence, target = [], []
        while len(sequence) < LENGTH:
            k = list(texts)[draw.integers(len(texts))]
            source = texts[k][draw.integers(len(texts[k]))]
            at, n = int(draw.integers(len(source))), int(draw.integers(4, LENGTH + 1))
            part = source[at : at + n]
            sequence += part
            target += [k] * len(part)
        words.append(sequence[:LENGTH])
        targets.append(target[:LENGTH])
    known = {w: i for i, w in enumerate(dict.fromkeys(w for s in words for w in s))}
    by_word = [features(w) for w in known]
    seen = Counter(f for fs in by_word for f in set(fs))
    uses = Counter(w for s in words for w in s)
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3 or (f[0] == "w" and uses[f[1:]] >= 5)))}
    lists = [np.array([index[f] for f in fs if f in index], dtype=np.int64) for fs in by_word]
    x = np.array([[known[w] for w in s] for s in words])
    y = np.array(targets)
    n_labels = len(labels)
    weights, squares = np.zeros((len(index), n_labels)), np.full((len(index), n_labels), 1e-2)
    trans, trans_squares = np.zeros((n_labels, n_labels)), np.full((n_labels, n_labels), 1e-2)
    for _ in range(EPOCHS):
        order = draw.permutation(len(x))
        for start in range(0, len(x), BATCH):
            xb, yb = x[order[start : start + BATCH]], y[order[start : start + BATCH]]
            used, at = np.unique(xb, return_inverse=True)
            flat = np.concatenate([lists[w] for w in used])
            owner = np.repeat(np.arange(len(used)), [len(lists[w]) for w in used])
            emit = np.stack([np.bincount(owner, weights[flat, k], len(used)) for k in range(n_labels)], axis=1)[at.reshape(xb.shape)]
            e = np.exp(emit - emit.max(axis=2, keepdims=True))
            a = np.exp(trans - trans.max())
            forward, backward = np.zeros_like(e), np.ones_like(e)
            forward[:, 0] = _normal(e[:, 0], 1)
            for t in range(1, LENGTH):
                forward[:, t] = _normal((forward[:, t - 1] @ a) * e[:, t], 1)
            for t in range(LENGTH - 2, -1, -1):
                backward[:, t] = _normal((backward[:, t + 1] * e[:, t + 1]) @ a.T, 1)
            truth = np.eye(n_labels)[yb]
            gradient = truth - _normal(forward * backward, 2)
            both = np.einsum("bti,ij,btj->btij", forward[:, :-1], a, e[:, 1:] * backward[:, 1:])
            trans_gradient = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:]) - _normal(both, (2, 3)).sum(axis=(0, 1))
            word_gradient = np.stack([np.bincount(at.ravel(), gradient[..., k].ravel(), len(used)) for k in range(n_labels)], axis=1)
            full = np.stack([np.bincount(flat, word_gradient[owner, k], len(index)) for k in range(n_labels)], axis=1) / len(xb)
            squares += full**2
            weights += 0.5 * full / np.sqrt(squares)
            trans_gradient /= len(xb)
            trans_squares += trans_gradient**2
            trans += 0.5 * trans_gradient / np.sqrt(trans_squares)
    return Model(labels, index, weights.astype(np.float32), trans.astype(np.float32))


def posteriors(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Every word's posterior over labels; texts lie one after another in `emit`, `lengths` words each.

    Texts are cut into blocks. All blocks run side by side: first their transfer matrices, then messages
    along each text's blocks, then the words inside. Padding leaves a message as it is.
    """
    n_labels = emit.shape[1]
    e_flat = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.exp(transitions - transitions.max()).astype(np.float64)
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    number = np.arange(len(owner)) - first[owner]
    begin = offset[owner] + number * BLOCK
    size = np.minimum(BLOCK, lengths[owner] - number * BLOCK)
    live = np.arange(BLOCK) < size[:, None]
    at = np.where(live, begin[:, None] + np.arange(BLOCK), 0)
    e = e_flat[at]
    eye = np.eye(n_labels)
    transfer = np.broadcast_to(eye, (len(owner), n_labels, n_labels)).copy()
    for t in range(BLOCK):
        step = _normal((transfer @ a) * e[:, t, None, :], (1, 2))
        transfer = np.where(live[:, t, None, None], step, transfer)
    # Before a text's first word the message is uniform; A spreads it evenly enough to be no evidence.
    left, right = np.full((len(owner), n_labels), 1 / n_labels), np.full((len(owner), n_labels), 1 / n_labels)
    for k in range(1, int(blocks.max())):
        rows = first[blocks > k] + k
        left[rows] = _normal(np.einsum("bi,bij->bj", left[rows - 1], transfer[rows - 1]), 1)
    for k in range(int(blocks.max()) - 2, -1, -1):
        rows = first[blocks > k + 1] + k
        right[rows] = _normal(np.einsum("bij,bj->bi", transfer[rows + 1], right[rows + 1]), 1)
    forward = np.empty_like(e)
    message = left
    for t in range(BLOCK):
        message = np.where(live[:, t, None], _normal((message @ a) * e[:, t], 1), message)
        forward[:, t] = message
    out = np.empty_like(e_flat)
    message = right
    for t in range(BLOCK - 1, -1, -1):
        here = live[:, t]
        out[at[here, t]] = (forward[:, t] * message)[here]
        message = np.where(here[:, None], _normal((message * e[:, t]) @ a.T, 1), message)
    return _normal(out, 1)


class _Emissions(dict):
    """Rows of `table` by word, worked out when first asked for."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.table = np.zeros((1024, len(model.labels)), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.model.emission(word)
        self[word] = at
        return at


def in_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) != 2


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of about `rows` labelled documents outside the held-out fold, twice as many at most.

    Rows are chosen by a hash of doc_id under a cut that the number of labelled rows gives, so each task
    sends only its share of the sample to the driver.
    """
    labelled = docs.where(in_training(F.col("doc_id")) & F.col("lang").isNotNull())
    total = labelled.count()
    if not total:
        return None
    cut = min(1 << 31, -(-rows * (1 << 31) // total))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < cut).where(F.col("text").isNotNull())
    return train([(r["text"], r["lang"]) for r in sample.select("text", "lang").limit(2 * rows).collect()])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each document."""
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = _Emissions(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                if len(known) > KEEP_WORDS:
                    known = _Emissions(model)
                get = known.__getitem__
                # A text of figures like ² alone, which the word pattern takes in, has no letter.
                texts = [t if t and any(map(str.isalpha, t)) else "" for t in part.column("text").to_pylist()]
                rows = [np.fromiter(map(get, WORD.findall(t.lower())), dtype=np.int64) for t in texts]
                lengths = np.array([len(r) for r in rows])
                label, score = np.full(len(rows), -1), np.zeros(len(rows))
                if (has := np.flatnonzero(lengths)).size:
                    found = posteriors(known.table[np.concatenate([rows[i] for i in has])], lengths[has], model.transitions)
                    edges = np.concatenate([[0], np.cumsum(lengths[has])[:-1]])
                    mean = np.add.reduceat(found, edges, axis=0) / lengths[has][:, None]
                    label[has], score[has] = mean.argmax(axis=1), mean.max(axis=1)
                names = [model.labels[k] if k >= 0 else "und" for k in label]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    found = predict(docs, fit(docs, rows))
    return found.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
