"""Fill-in-the-middle examples, cut at token boundaries through a learned rank index.

A cut "after k units" needs the offset of the k-th boundary of a text. Offsets grow almost linearly with
their rank, so the index of a text is a list of linear segments, each off by at most `error`, and one byte
of residual for each boundary. It is fitted block by block to all boundaries of the whole text; a cut is
predicted by its segment and corrected by its residual, exactly. A text's index takes a byte a unit, where
the offsets would take eight, and serves any number of cuts.

Defined results: null and empty texts are empty plain examples; a text that holds a sentinel stays plain;
a null doc_id counts as the empty string in the hash; rows that repeat stay, each with the same cuts; very
long texts are taken whole, in blocks; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred examples so many are cut, and so many of these have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: Segments are off by at most so many code points, so that a residual fits a signed byte.
ERROR = 127
#: Code points whose boundaries are held at once.
BLOCK = 1 << 20
#: Code points of output that a batch gathers.
BATCH_CHARS = 1 << 22


def boundaries(text: str) -> np.ndarray:
    """Offsets in code points of 0 and of the end of each token `[A-Za-z]+|[^A-Za-z]`."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = (points | 32) - np.uint32(97) < 26
    inner = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, dtype=np.int64)


def _reach(offsets: np.ndarray, start: int, error: int) -> tuple[int, float]:
    """How far one line from the point at `start` stays within `error` of all points, and its slope."""
    low, high, size, at = 0.0, np.inf, 128, start + 1
    while at < len(offsets):
        stop = min(at + size, len(offsets))
        run = np.arange(at - start, stop - start)
        rise = (offsets[at:stop] - offsets[start]).astype(np.float64)
        lows = np.maximum.accumulate(np.maximum((rise - error) / run, low))
        highs = np.minimum.accumulate(np.minimum((rise + error) / run, high))
        if (crossed := lows > highs).any():
            k = int(crossed.argmax())
            if k:
                low, high = float(lows[k - 1]), float(highs[k - 1])
            return at + k, (low + high) / 2 if np.isfinite(high) else low
        low, high, at, size = float(lows[-1]), float(highs[-1]), stop, size * 2
    return len(offsets), (low + high) / 2 if np.isfinite(high) else low


@dataclass
class RankIndex:
    """Offsets of boundaries by rank: segments (first rank, base, slope) and what each prediction misses."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, text: str, error: int = ERROR, block: int = BLOCK) -> RankIndex:
        """Greedy segments over all boundaries of the text, each as long as one line holds."""
        first, base, slope, residual, rank, begin = [], [], [], [], 0, 0
        while begin < len(text) or not first:
            end = min(begin + block, len(text))
            while begin < end < len(text) and text[end - 1].isascii() and text[end].isascii() and text[end - 1].isalpha() and text[end].isalpha():
                end += 1  # a block ends with a token
            offsets = boundaries(text[begin:end])[1 if begin else 0 :] + begin
            start = 0
            while start < len(offsets):
                stop, a = _reach(offsets, start, error)
                predicted = np.rint(offsets[start] + a * np.arange(stop - start)).astype(np.int64)
                first.append(rank + start)
                base.append(int(offsets[start]))
                slope.append(a)
                residual.append((offsets[start:stop] - predicted).astype(np.int16 if error > 126 else np.int8))
                start = stop
            rank, begin = rank + len(offsets), end
        return cls(np.array(first), np.array(base), np.array(slope), _narrow(np.concatenate(residual)))

    @property
    def units(self) -> int:
        return len(self.residual) - 1

    def offset(self, rank: int) -> int:
        """Where the first `rank` units end: the prediction and its residual."""
        at = int(np.searchsorted(self.first, rank, side="right")) - 1
        return int(np.rint(self.base[at] + self.slope[at] * (rank - self.first[at]))) + int(self.residual[rank])


def _narrow(residual: np.ndarray) -> np.ndarray:
    return residual.astype(np.int8) if len(residual) and -128 <= residual.min() and residual.max() <= 127 else residual


def _hashes(doc_id: Column, salt: str) -> list[Column]:
    """The first four 8-digit groups of the salted doc_id's SHA-256 as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, salt: str = "1", cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, error: int = ERROR) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document.

    n counts the units; form is plain, psm (prefix, suffix, middle) or spm. Another salt gives other cuts
    of the same documents.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, held, since = batch.column("doc_id"), [], 0, 0
            hashes = [batch.column(f"h{i}").to_pylist() for i in range(1, 5)]
            for i, (value, h1, h2, h3, h4) in enumerate(zip(batch.column("text"), *hashes, strict=True)):
                text = value.as_py() or ""
                index = RankIndex.fit(text, error)
                if not text or h3 % 100 >= cut_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((index.units, "plain", None, None, text))
                else:
                    a, b = (index.offset(k) for k in sorted(h % (index.units + 1) for h in (h1, h2)))
                    first = h4 % 100 < suffix_first_percent
                    output = f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}" if first else f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
                    rows.append((index.units, "spm" if first else "psm", a, b - a, output))
                held += len(text)
                if held >= BATCH_CHARS or i == len(ids) - 1:
                    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(since, len(rows)), *columns], names)
                    since, held, rows = i + 1, 0, []

    given = docs.select("doc_id", "text", *[h.alias(f"h{i}") for i, h in enumerate(_hashes(F.col("doc_id"), salt), 1)])
    return given.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _parted(body: Column, mark: str) -> tuple[Column, Column]:
    """What comes before the first `mark`, and what after it."""
    before = F.substring_index(body, mark, 1)
    return before, F.substr(body, F.length(before) + len(mark) + 1)


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of. No sentinel occurs in a cut text, and none can overlap another."""
    body = F.substr(output, F.lit(4))
    head, rest = _parted(body, SUFFIX)
    tail, middle = _parted(rest, MIDDLE)
    psm = F.concat(head, middle, tail)
    head, rest = _parted(body, PREFIX)
    begin, middle = _parted(rest, MIDDLE)
    spm = F.concat(begin, middle, head)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_middle_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of each example and of the text rebuilt from it."""
    done = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = """
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit
    FROM documents
), dealt AS (
    SELECT *, len(unit) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (len(unit) + 1) AS k1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (len(unit) + 1) AS k2,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                WHEN CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM units
), cut AS (
    SELECT doc_id, n, form, text, array_to_string(unit[1:least(k1, k2)], '') AS prefix, array_to_string(unit[least(k1, k2) + 1:greatest(k1, k2)], '') AS middle,
           array_to_string(unit[greatest(k1, k2) + 1:], '') AS suffix
    FROM dealt
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
