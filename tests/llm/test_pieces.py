import hashlib
import random
import struct
from collections import Counter

import pytest

from marlspark.llm import pieces
from marlspark.llm.registry import model_path

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(open(model_path(), "rb").read())


def test_like_the_library(library, own):
    draw = random.Random(3)
    alphabet = "abcdeéñßü XY.,;:!?'\"()[]0123456789\n\t  ▁\x00\u3000中文かな😀<>|#-_=+e\u0301ाहि"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += [" " * k + tail for k in range(1, 70) for tail in ("", "the", "5", "\n")] + ["<s>hi</s>", "<0x0A>", "the quick brown fox"]
    for t in texts:
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert own.encode_text(t) == ids, repr(t)
        assert own.decode_ids(ids) == library.decode(ids), repr(t)


def test_documents(edge, library):
    want = Counter()
    for r in edge.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in pieces.token_digests(edge, model_path()).collect()) == want


def test_round_trip_and_columns(make, library):
    docs = make([(1, "Ein Text mit  zwei Wörtern.")])
    done = pieces.encode_documents(docs, model_path())
    assert done.columns == [c for c in docs.columns if c != "text"] + ["ids", "decoded"]
    r = done.select(pieces.unpacked(done["ids"]).alias("ids"), "decoded").first()
    assert r.ids == library.encode("Ein Text mit  zwei Wörtern.", add_bos=True, add_eos=True) and r.decoded == "Ein Text mit  zwei Wörtern."


def test_empty_table(edge):
    assert pieces.token_digests(edge.where("false"), model_path()).count() == 0
