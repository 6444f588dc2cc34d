import random
import re
from collections import Counter, defaultdict

import pytest

from marlspark.llm import decontamination as dec

ITEM = "A train leaves Boston at 9 pm and travels 120 miles in 3 hours . How fast does the train from Boston go on average ?"
OTHER = "Maria has 12 apples and gives 5 apples to her brother Tom before dinner , how many apples are left for Maria now ?"


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, ITEM, "x"), (2, OTHER, "x"), (3, None, "x"), (None, ITEM, "x"), (4, "1 2 3 4 5 6 7 8 9", "x"), (5, "two words", "x"), (6, "", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, pos string")


def found(docs, bench, **options):
    return {(r.doc_id, r.item_id): r.kind for r in dec.contaminated(docs, bench, **options).collect()}


def test_copies_and_new_parameters(make, bench):
    changed = ITEM.replace("Boston", "Denver").replace("120", "340").replace("9", "7").replace("3 hours", "5 hours")
    mixed = ITEM.replace("Boston at", "Denver at").replace("from Boston", "from Paris").replace("12 ", "13 ")
    docs = make(
        [
            (1, f"Some words before it. {ITEM} And some behind."),
            (2, changed),
            (3, "A train leaves the station and nothing else here is like the question at all, so it is clean text."),
            (4, OTHER.lower()),
            (5, "7 8 9 10 11 12 13 14 15"),
            (6, "two words"),
            (7, None),
            (8, ""),
            (None, ITEM),
            (9, ITEM),
            (9, ITEM),
            (10, "half of it: " + " ".join(ITEM.split()[:20])),
            (11, mixed),
        ]
    )
    got = found(docs, bench)
    assert got[1, 1] == "copy" and got[9, 1] == "copy" and got[2, 1] == "template" and got[6, 5] == "copy" and (10, 1) in got
    assert not {k for k in got if k[0] in (3, 5, 7, 8, None) or k[1] in (3, 4, 6, None)}
    assert (11, 1) not in found(docs, bench, consistency=0.95)
    left = dec.clean(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} >= {3, 5, 7, 8, None} and not {r.doc_id for r in left.collect()} & {1, 2, 6, 9}


CHANGED = ITEM.replace("Boston", "Denver").replace("120", "340").replace("9", "7").replace("3 hours", "5 hours")


def test_each_occurrence_is_judged(make, bench):
    """Two parameterisations in one document, and a copy in a long text of stray windows with other values."""
    stray = " ".join(f"it was said that a van leaves Oslo at {k} pm and travels {k + 1} miles in {k + 2} hours ." for k in range(30, 330))
    docs = make(
        [
            (1, f"{ITEM} {CHANGED}"),
            (2, f"{ITEM} {CHANGED} {CHANGED.replace('Denver', 'Rome').replace('340', '99')}"),
            (3, f"{CHANGED} {CHANGED.replace('Denver', 'Rome').replace('340', '99').replace('7', '6')}"),
            (4, f"{stray} {ITEM} {stray}"),
            (5, stray),
            (6, ITEM),
            (6, CHANGED),
            (7, ITEM.replace("miles in", "whole long miles of road in")),
        ]
    )
    got = found(docs, bench)
    assert got == {(1, 1): "copy", (2, 1): "copy", (3, 1): "template", (4, 1): "copy", (6, 1): "copy", (7, 1): "copy"}
    assert {r.doc_id for r in dec.clean(docs, bench).collect()} == {5}


def test_scattered_windows_are_no_hit(make, bench):
    words, filler = ITEM.split(), " ".join(f"filler{k}" for k in range(400))
    pieces = [" ".join(words[k : k + 7]) for k in range(0, len(words), 4)]
    assert found(make([(1, f" {filler} ".join(pieces)), (2, ITEM)]), bench) == {(2, 1): "copy"}


def plain_template(text):
    """[(template token, what it said, is a slot)], word by word with string methods only."""
    number = re.compile(r"[+-]?[$€£]?\d[\d.,:/-]*(?:st|nd|rd|th|%|€|[a-z]{1,3})?", re.I)
    out, opening, after_number = [], True, False
    for line in text.split("\n"):
        opening = True
        for raw in line.split():
            word = re.sub(r"^[^\w$€£%+-]+|[^\w%€]+$", "", raw)
            if word:
                is_number = bool(number.fullmatch(word))
                is_unit = not is_number and after_number and word.lower() in dec.UNITS
                is_name = not (is_number or is_unit or opening) and len(word) > 1 and word[0].isupper() and word[1:].islower()
                kind = "<num>" if is_number else "<unit>" if is_unit else "<name>" if is_name else word.lower()
                out.append((kind, word.lower(), kind[0] == "<" and kind != word.lower()))
                after_number = is_number
            opening = raw.rstrip("\"')]}»”").endswith((".", "!", "?", ":"))
    return out


def plain_windows(tokens):
    size = min(5, len(tokens))
    for i in range(len(tokens) - size + 1) if size else ():
        part = tokens[i : i + size]
        if sum(not slot for *_, slot in part) >= min(2, size):
            yield i, ("template", *(k for k, *_ in part)), [said for _, said, slot in part if slot]
        yield i, ("words", *(said for _, said, _ in part)), []


def item_rows(tokens):
    """An item's template windows, and its others where they are more."""
    every = list(plain_windows(tokens))
    templated = [w for w in every if w[1][0] == "template"]
    others = [w for w in every if w[1][0] == "words" and w[0] not in {at for at, *_ in templated}]
    return [rows for rows in (templated, others if len(others) > len(templated) else []) if rows]


def brute_force(texts, items, coverage=0.5, consistency=0.8):
    found = {}
    for d, text in texts:
        mine = list(plain_windows(plain_template(text)))
        for k, theirs, size in ((k, rows, len(tokens)) for k, tokens in ((k, plain_template(item)) for k, item in items) for rows in item_rows(tokens)):
            places = defaultdict(list)
            for pos, window, said in mine:
                for at, other, values in theirs:
                    if window == other:
                        start = pos - at
                        for place in ((0, start), (1, start // size), (2, (start + size / 2) // size), (3, start // (4 * size)), (4, (start + 2 * size) // (4 * size))):
                            places[place].append((at, list(zip(values, said, strict=True))))
            best = []
            for hits in places.values():
                share = len({at for at, _ in hits}) / len(theirs)
                pairs = Counter(p for _, pairs in hits for p in pairs)
                most = {v: max(c for (x, _), c in pairs.items() if x == v) for v, _ in pairs}
                agree = sum(most.values()) / sum(pairs.values()) if pairs else 1.0
                if share >= coverage and agree >= consistency:
                    best.append((round(share, 9), round(agree, 9), -sum(c for (x, y), c in pairs.items() if x != y)))
            if best:
                found[d, k] = max(found.get((d, k), (0, 0, 0)), max(best))
    return found


def test_against_brute_force(spark, make):
    """Templates, coverage and slot consistency worked out anew from the words, all pairs."""
    draw = random.Random(3)
    nouns = ["apples", "Boston", "Maria", "km", "hours", "12", "7.5", "$30", "the", "of", "gives", "train", "end.", "(So)", "“Why?”", "…", "Ünïcode", "3rd", "😀", "İstanbul"]
    items = [(k, " ".join(draw.choice(nouns) for _ in range(draw.choice([2, 4, 8, 20, 40])))) for k in range(12)]
    texts = []
    for d in range(60):
        parts = []
        for _ in range(draw.randrange(4)):
            words = draw.choice(items)[1].split()
            cut = draw.randrange(len(words))
            words = words[cut // 3 :] + words[: draw.randrange(3)]
            swap = {w: draw.choice(["4", "99", "Paris", "Tom", "km", "miles"]) for w in draw.sample(nouns, 3)}
            parts.append(" ".join(swap.get(w, w) if draw.random() < 0.9 else w for w in words))
            parts.append(draw.choice([" ", "\n", " stray words here . "]))
        texts.append((d, "".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.coverage, 9), round(r.consistency, 9), r.kind) for r in dec.contaminated(make(texts), bench).collect()}
    want = {k: (share, agree, "template" if same < 0 else "copy") for k, (share, agree, same) in brute_force(texts, items).items()}
    assert got == want and len(want) > 20


def test_copies_of_numbers_and_names(spark, make):
    """Items without a window of two plain words are found in their own words, and only so."""
    items = [(1, "17 23 42 99 108 12 77"), (2, "12 + 30 = 42"), (3, "Anna Paris London Rome Berlin Madrid"), (4, "Boston"), (5, "Sum : 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 gives what total ?")]
    texts = [(k, text) for k, text in items] + [(11, f"the list was {items[0][1]} as it says"), (13, f"we met anna paris london rome berlin madrid there")]
    texts += [(21, "18 24 43 100 109 13 78"), (22, "13 + 31 = 44"), (23, "Tom Oslo Bern Wien Prag Bonn"), (24, "Denver"), (25, "1 2 3 4 and nothing else but a clean text of plain words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in dec.contaminated(make(texts), bench).collect()}
    assert got == {(k, k): "copy" for k, _ in items} | {(11, 1): "copy", (13, 3): "copy"}
    assert set(got) == set(brute_force(texts, items))
    assert {r.doc_id for r in dec.clean(make(texts), bench).collect()} == {21, 22, 23, 24, 25}


def test_templates_in_pieces(monkeypatch):
    """Cut into pieces of a few characters, texts keep their templates."""
    texts = ["We saw John run 12.5 km in May.\nThen he won $5", "", "x", "Then (he) said: Hello Tom. \n\n Bob \t met Ann 7\nkm  off ", "😀 Ünï 😀😀 Éa 1st"]
    whole = [x.tolist() for x in dec.templates(texts)]
    for size in (1, 2, 5, 17):
        monkeypatch.setattr(dec, "PIECE", size)
        assert [x.tolist() for x in dec.templates(texts)] == whole
    doc, _, slots, start, end, _ = whole
    got = [(d, texts[d][s:e].lower(), slot) for d, slot, s, e in zip(doc, slots, start, end, strict=True)]
    want = [(d, said, slot) for d, t in enumerate(texts) for _, said, slot in plain_template(t)]
    assert got == want
    assert [said for d, said, slot in got if slot and d == 0] == ["john", "12.5", "km", "may", "$5"]


def test_a_phrase_of_all_items(spark, make):
    """Items that share most of their windows are told apart, and none is lost by asking for rare windows first."""
    phrase = "which of the following statements about this matter is true and why do you think so"
    items = [(k, f"{phrase} when a{k} b{k} c{k} d{k}") for k in range(30)]
    texts = [(k, f"{phrase} when a{k} b{k} c{k} d{k} indeed") for k in range(10)] + [(99, phrase)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(make(texts), bench).collect()}
    assert got == set(brute_force(texts, items)) and len(got) == 11 * 30


def test_empty_tables(edge, bench):
    assert dec.contaminated(edge.where("false"), bench).count() == 0
    assert dec.contaminated(edge, bench.where("false")).count() == 0
    assert dec.clean(edge, bench.where("false")).count() == edge.count()
