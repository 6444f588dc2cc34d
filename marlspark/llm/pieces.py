"""SentencePiece encoding and decoding of BPE models with a merge-type prefix table.

For every prefix of a chunk the table holds the last token of that prefix's encoding. It is unique: of
the vocabulary pieces that end there (all found by one pass of an automaton), exactly one is compatible
with the token before it, meaning that the two side by side would not merge otherwise. The ids are then
read backwards from the last prefix. The work is linear in the text, without merge queues.

A text is cut into chunks where no merge can cross (checked against the vocabulary when a model is
loaded) and results are kept in a bounded table by chunk. Characters outside the vocabulary fall back to
byte tokens. Runs of the white-space mark merge last, all at one priority and leftmost first.

Defined results: null and empty texts give just the begin and end ids and decode to an empty text; long
texts are taken whole; extra columns are kept by `encode_documents` unless their names clash with its
own (`ids`, `decoded`), which replace them; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
LETTER = r"[^\W\d_]"
#: Chunks that a process keeps; beyond that the table starts anew.
KEEP_CHUNKS = 400_000


class Pieces:
    """The tables of one model: automaton, scores, byte ids and pair compatibility."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("this encoder takes BPE models with byte fallback, a dummy prefix and no other normalisation")
        self.text = [p.piece for p in proto.pieces]
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.CONTROL}
        self.begin, self.end = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.score = [p.score for p in proto.pieces]
        self.ids = normal
        self.mark = normal[MARK]
        self.runs = {len(p): i for p, i in normal.items() if not p.strip(MARK)}
        words = [p for p in normal if p.strip(MARK)]
        highest_run = max((self.score[i] for n, i in self.runs.items() if n > 1), default=float("-inf"))
        if any(MARK in p[1:] for p in words) or any(len(p) > 1 and self.score[normal[p]] <= highest_run for p in words):
            raise ValueError("pieces of this model cross white space")
        self.automaton = ahocorasick.Automaton()
        for p in words:
            self.automaton.add_word(p, (normal[p], len(p)))
        if MARK not in words:
            self.automaton.add_word(MARK, (self.mark, 1))
        self.automaton.make_automaton()
        # A chunk ends after a letter, except before a mark that follows a letter in some piece.
        joined = "".join(re.escape(x) for x in sorted({c for p in words for a, c in zip(p, p[1:]) if a.isalpha() and not re.match(LETTER, c)}))
        other, letters = f"(?:(?!{LETTER})[^{MARK}])*", f"{LETTER}*"
        self.chunk = re.compile(f"{MARK}*{other}{letters}" + (f"(?:[{joined}]{other}{letters})*" if joined else ""))
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[int]:
        """The ids of a short text of known characters, by the definition: merge the best pair, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return [self.ids[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merged(self.text[left] + self.text[right]) == [left, right]
        return known

    def prefix_table(self, text: str) -> list[int]:
        """The ids of a text of known characters with at most a leading mark."""
        last = [-1] * (len(text) + 1)
        pairs = self.pairs
        for end, (piece, size) in self.automaton.iter(text):
            if last[end + 1] < 0:
                start = end + 1 - size
                if start:
                    before = last[start]
                    fits = pairs.get(before << 20 | piece)
                    if fits is None:
                        fits = self.compatible(before, piece)
                    if not fits:
                        continue
                last[end + 1] = piece
        out, at = [], len(text)
        while at:
            piece = last[at]
            out.append(piece)
            at -= len(self.text[piece])
        out.reverse()
        return out

    def run(self, n: int) -> list[int]:
        """n marks: leftmost pair first, all at one priority."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in self.runs:
                stack[-2:] = [stack[-1] + stack[-2]]
        return [self.runs[k] for k in stack]

    def encode_chunk(self, chunk: str) -> list[int]:
        rest = chunk.lstrip(MARK)
        marks = len(chunk) - len(rest)
        out, known = [], MARK if marks else ""
        for c in rest:
            if c in self.ids:
                known += c
                continue
            if known:
                out += self.prefix_table(known)
                known = ""
            out += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
        if known:
            out += self.prefix_table(known)
        if marks > 1:
            out = self.run(marks) + out[1:] if out[0] == self.mark else self.run(marks - 1) + out
        return out

    def encode_text(self, text: str) -> list[int]:
        """All ids of a text, with begin and end."""
        out = [self.begin]
        for c in self.chunk.findall(MARK + text.replace(" ", MARK)) if text else ():
            out += self.encode_chunk(c)
        return [*out, self.end]

    def pieces_text(self, ids: list[int]) -> str:
        """The text that ids stand for, before a leading dummy space is taken off."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.silent:
                out.append(self.text[i].replace(MARK, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode_ids(self, ids: list[int]) -> str:
        return self.pieces_text(ids).removeprefix(" ")


class _Chunks(dict):
    """Packed ids and text by chunk, worked out when first asked for."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces = pieces

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        if len(self) >= KEEP_CHUNKS:
            self.clear()
        ids = self.pieces.encode_chunk(chunk)
        self[chunk] = found = (struct.pack(f"<{len(ids)}I", *ids), self.pieces.pieces_text(ids))
        return found


_LOADED: dict[int, _Chunks] = {}


def _chunks(model: bytes) -> _Chunks:
    """One table in each Python worker, kept between tasks."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = _Chunks(Pieces(model))
    return _LOADED[key]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """`docs` without its text, with `ids` (binary: little-endian unsigned 32-bit) and `decoded`.

    The model file, half a megabyte, is read on the driver and sent to the tasks.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    keep = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(model.value)
        pieces, find, get = chunks.pieces, chunks.pieces.chunk.findall, chunks.__getitem__
        begin, end = struct.pack("<I", pieces.begin), struct.pack("<I", pieces.end)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, decoded = [], []
                for t in part.column("_text").to_pylist():
                    found = list(map(get, find(MARK + t.replace(" ", MARK)))) if t else []
                    ids.append(b"".join([begin, *[x[0] for x in found], end]))
                    decoded.append("".join([x[1] for x in found]).removeprefix(" "))
                columns = [part.column(c) for c in keep] + [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "decoded"])

    return source.mapInArrow(encode, schema)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of int."""
    digits = F.hex(ids)
    one = lambda i: F.conv(F.concat(*[F.substring(digits, i * 8 + 7 - 2 * k, 2) for k in range(4)]), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), n_tokens(ids).cast("int") - 1), one)


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text."""
    done = encode_documents(docs.select("doc_id", "text"), model_path)
    return done.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
