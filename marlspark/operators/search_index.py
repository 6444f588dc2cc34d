"""A stored, versioned BM25 index with block bounds.

Documents are dealt to ranges of about RANGE_DOCS of like length. A block holds one term's postings of one
range, and the few (tf, length) pairs that no other posting of the block beats; the largest part score of
the block follows from these, whatever the corpus' mean length is by then. All blocks of a range are written by
one task, in the order of their terms, so few terms read few pages of each file. A search

1. sums the bounds of a query's terms over each range (only this directory is read, no postings);
2. scores the few ranges with the greatest sums, which gives a threshold: the k-th best score so far;
3. scores those of the other ranges whose sum reaches it. All others can't hold a better document.

The blocks of the terms that are asked for are brought together by range, each once however many queries ask for it. A
range's documents meet its queries as one matrix product, and a task hands on what may be among its best only.

The result is that of scoring everything. An index is a list of levels. A change writes a level of its own
(postings, document lengths, signed changes of document frequencies, and the ids it replaces or removes),
folded into the one before it while that isn't several times as large. A manifest, written last, names the
levels; a search reads one manifest and only what that names.

Defined results: null and empty texts count as documents of no terms; doc_ids are unique and not null; a
changed id that is given twice in one change keeps both rows, as two documents would; an index without
documents finds nothing; queries without known terms find nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspark.functions import numeric, text
from marlspark.operators.search import B, K1, SCORED_ROWS, SEARCH_BATCH, stored, top_per_query
from marlspark.sources.manifest import Manifests, Revision
from marlspark.sources.shared import scratch

RANGE_DOCS = 64
#: Ranges of each query that are scored first.
FIRST_RANGES = 4
#: A level is folded into the one before it unless that has so many times its documents.
FAN_OUT = 4
#: Scores are rounded to 6 digits, so bounds are held against the threshold less this.
MARGIN = 2e-6
#: Postings that a task holds at once, if that isn't less than a range has.
HELD = 500_000
#: Of these a task makes rows at once.
BLOCK_ROWS = 10_000
BLOCKS = "term string, range string, best array<struct<tf: int, dl: int>>, entries array<struct<doc_id: bigint, tf: int, dl: int>>"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _band(dl: Column) -> Column:
    """The length class of a document."""
    return F.floor(F.log2(dl + 1) * 2).cast("int")


def _placed(docs: DataFrame, slots: dict[str, int]) -> DataFrame:
    """`docs` with the range of each; slots: how many ranges each length class has."""
    band = _band(F.col("dl")).cast("string")
    dealt = F.create_map(*[F.lit(x) for pair in slots.items() for x in pair]) if slots else F.create_map().cast("map<string,int>")
    return docs.withColumn("range", F.concat_ws("-", band, F.pmod(F.xxhash64("doc_id"), F.element_at(dealt, band))))


def _counted(docs: DataFrame) -> DataFrame:
    """Documents (..., terms) with dl, their number of terms, and each term once, with its count (tfs)."""
    kept = [c for c in docs.columns if c != "terms"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "dl int, terms array<string>, tfs array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SCORED_ROWS):
                batch = whole.slice(start, SCORED_ROWS)
                length = pc.list_value_length(batch.column("terms"))
                row = np.repeat(np.arange(batch.num_rows), length.to_numpy())
                told = batch.column("terms").flatten().dictionary_encode()
                wide = max(1, len(told.dictionary))
                both, tf = np.unique(row * wide + told.indices.to_numpy(), return_counts=True)
                cuts = pa.array(np.searchsorted(both // wide, np.arange(batch.num_rows + 1)), pa.int32())
                terms = pa.ListArray.from_arrays(cuts, told.dictionary.take(pa.array(both % wide)))
                tfs = pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), length.cast(pa.int32()), terms, tfs], [*kept, "dl", "terms", "tfs"])

    return docs.select(*kept, "terms").mapInArrow(run, schema)


def _whole_ranges(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], int]) -> Iterator[pa.Table]:
    """Rows that lie in order of their range, in parts of whole ranges and about HELD postings."""
    held, n = [], 0
    for whole in batches:
        for start in range(0, whole.num_rows, SCORED_ROWS):
            batch = whole.slice(start, SCORED_ROWS)
            held.append(batch)
            n += size(batch)
            if n >= HELD:
                table = pa.Table.from_batches(held).combine_chunks()
                last = pc.not_equal(table.column("range"), table.column("range")[-1]).to_numpy()
                cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if cut:
                    yield table.slice(0, cut).combine_chunks()
                    rest = table.slice(cut).combine_chunks()
                    held = rest.to_batches()
                    n = sum(size(b) for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks) if chunks else pa.array([], table.schema.field(name).type)


def _numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (range, doc_id, dl, terms, tfs), range by range, to blocks as BLOCKS has them."""
    for table in _whole_ranges(batches, lambda b: len(b.column("terms").flatten())):
        terms = _column(table, "terms")
        row = np.repeat(np.arange(table.num_rows), _numbers(pc.list_value_length(terms)))
        told, ranges = terms.flatten().dictionary_encode(), _column(table, "range").dictionary_encode()
        if not len(row):
            continue
        place = np.empty(len(told.dictionary), dtype=np.int64)
        place[_numbers(pc.sort_indices(told.dictionary))] = np.arange(len(told.dictionary))
        code, at = place[_numbers(told.indices)], _numbers(ranges.indices).astype(np.int64)[row]
        doc, dl, tf = _numbers(_column(table, "doc_id"))[row], _numbers(_column(table, "dl"))[row].astype(np.int64), _numbers(_column(table, "tfs").flatten()).astype(np.int64)
        key = code * len(ranges.dictionary) + at

        order = np.lexsort((tf, doc, key))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        struct = lambda **columns: pa.StructArray.from_arrays([pa.array(x, pa.int64() if c == "doc_id" else pa.int32()) for c, x in columns.items()], list(columns))
        entries = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), struct(doc_id=doc[order], tf=tf[order], dl=dl[order]))
        # Of each tf the shortest document; a posting with no more and no longer than another's is never the best.
        best = np.lexsort((dl, -tf, key))
        block = np.cumsum(np.concatenate([[0], np.diff(key[best]) != 0]))
        falling = np.minimum.accumulate(dl[best] - (block << 32))  # starts anew with each block
        stays = np.concatenate([[True], (dl[best] - (block << 32))[1:] < falling[:-1]])
        best, block = best[stays], block[stays]
        bests = pa.ListArray.from_arrays(pa.array(np.searchsorted(block, np.arange(len(starts) + 1)), pa.int32()), struct(tf=tf[best], dl=dl[best]))
        names = told.dictionary.take(pa.array(_numbers(told.indices)[order[starts]]))
        found = pa.RecordBatch.from_arrays([names, ranges.dictionary.take(pa.array(at[order[starts]])), bests, entries], ["term", "range", "best", "entries"])
        for start in range(0, found.num_rows, BLOCK_ROWS):
            yield found.slice(start, BLOCK_ROWS)


@dataclass
class Found:
    """hits: query_id, doc_id, score, rank; touched: query_id, blocks (of its terms), read."""

    hits: DataFrame
    touched: DataFrame


class Snapshot:
    """One version of an index."""

    def __init__(self, spark: SparkSession, content: dict) -> None:
        self.spark, self.content, self.levels = spark, content, content["levels"]

    @property
    def revision(self) -> int:
        return self.content["revision"]

    def _table(self, name: str, level: int) -> DataFrame:
        reader = self.spark.read.schema(BLOCKS) if name == "blocks" else self.spark.read
        return reader.parquet(f"{self.levels[level]['path']}/{name}").withColumn("level", F.lit(level))

    def _all(self, name: str) -> DataFrame:
        return _union([self._table(name, i) for i in range(len(self.levels))])

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, level, ...) that no later level replaces."""
        later = [self._table("changed", i) for i in range(1, len(self.levels))]
        if not later:
            return rows
        last = _union(later).groupBy("doc_id").agg(F.max("level").alias("last"))
        return rows.join(last, "doc_id", "left").where("last IS NULL OR last <= level").drop("last")

    def documents(self) -> DataFrame:
        """The live documents: doc_id, dl, terms and whatever came with them."""
        return self._live(self._all("docs"))

    def search(self, queries: DataFrame, k: int, keep: Column | None = None) -> Found:
        """The `k` best documents of each query (query_id, query); `keep` filters by columns that came with the documents."""
        blocks = -(-queries.count() // SEARCH_BATCH) or 1
        found = []
        for i in range(blocks):
            block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
            part = self._block(block, k, keep)
            if part is not None:
                found.append(part)
        if not found:
            none = self.spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
            return Found(none, self.spark.createDataFrame([], "query_id long, blocks long, read long"))
        return Found(_union([x.hits for x in found]), _union([x.touched for x in found]))

    def _left_out(self, keep: Column | None) -> DataFrame | None:
        """(level, range, doc_id) of documents that don't count: replaced by a later level, or not kept."""
        later = [self._table("changed", i) for i in range(1, len(self.levels))]
        if keep is None and not later:
            return None
        docs = _union([_placed(self._table("docs", i), level["slots"]) for i, level in enumerate(self.levels)]).where("dl > 0")
        out = F.lit(False) if keep is None else ~F.coalesce(keep, F.lit(False))
        rows = docs.select("level", "range", F.col("doc_id").cast("long").alias("doc_id"), out.alias("out"))
        if later:
            last = _union(later).groupBy("doc_id").agg(F.max("level").alias("last"))
            rows = rows.join(last, "doc_id", "left").withColumn("out", F.col("out") | F.coalesce(F.col("last") > F.col("level"), F.lit(False)))
        return rows.where("out").select("level", "range", "doc_id")

    def _block(self, queries: DataFrame, k: int, keep: Column | None) -> Found | None:
        """The search of SEARCH_BATCH queries at most; None if they hold no known term."""
        if not self.levels:
            return None
        asked = queries.select("query_id", F.array_distinct(text.tokens(F.col("query"))).alias("terms")).collect()
        spoken = sorted({t for r in asked for t in r.terms})
        known = self._all("terms").where(F.col("term").isin(spoken)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = {r.term: r.weight for r in known.select("term", numeric.idf(F.lit(float(self.content["docs"])), F.col("df")).alias("weight")).collect()}
        asked = [r for r in asked if any(t in idf for t in r.terms)]
        if not asked:
            return None
        vocabulary = sorted(idf)
        at = {t: i for i, t in enumerate(vocabulary)}
        weights = np.zeros((len(vocabulary), len(asked)))
        for q, r in enumerate(asked):
            for t in r.terms:
                if t in at:
                    weights[at[t], q] = idf[t]
        shared, mean = self.spark.sparkContext.broadcast((vocabulary, weights)), self.content["length"] / max(1, self.content["docs"])
        part = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
        blocks = self._all("blocks").where(F.col("term").isin(vocabulary))
        out = self._left_out(keep)
        out = None if out is None else stored(out.groupBy("level", "range").agg(F.collect_list("doc_id").alias("out")), "index-out")

        def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What the bounds of a task's blocks add up to."""
            names, told = pa.array(shared.value[0], pa.string()), shared.value[1]
            number: dict[tuple, int] = {}
            bounds, counts = np.zeros((0, told.shape[1])), np.zeros((0, told.shape[1]))
            for batch in batches:
                if not batch.num_rows:
                    continue
                pairs = batch.column("best").flatten()
                lengths = _numbers(pc.list_value_length(batch.column("best")))
                most = np.maximum.reduceat(part(_numbers(pairs.field("tf")).astype(float), _numbers(pairs.field("dl"))), np.cumsum(lengths) - lengths)
                term = _numbers(pc.index_in(batch.column("term"), value_set=names.cast(batch.column("term").type)))
                row = np.array([number.setdefault(x, len(number)) for x in zip(batch.column("level").to_pylist(), batch.column("range").to_pylist(), strict=True)])
                if len(number) > len(bounds):
                    more = max(len(number), 2 * len(bounds)) - len(bounds)
                    bounds, counts = (np.concatenate([x, np.zeros((more, told.shape[1]))]) for x in (bounds, counts))
                rows, r = np.unique(row, return_inverse=True)
                terms, t = np.unique(term, return_inverse=True)
                here = np.zeros((len(rows), len(terms)))
                here[r, t] = most
                bounds[rows] += here @ told[terms]
                counts[rows] += (here > 0).astype(float) @ (told[terms] > 0).astype(float)
            ranges = list(number)
            for start in range(0, len(ranges), 64):
                r, q = np.nonzero(counts[start : min(start + 64, len(ranges))])
                chosen = [ranges[start + i] for i in r.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([x[0] for x in chosen], pa.int32()), pa.array([x[1] for x in chosen], pa.string()), pa.array(bounds[start + r, q]), pa.array(counts[start + r, q].astype(np.int64))], ["q", "level", "range", "bound", "blocks"])

        parts = blocks.select("term", "level", "range", "best").mapInArrow(directory, "q int, level int, range string, bound double, blocks long")
        sums = stored(parts.groupBy("q", "level", "range").agg(F.sum("bound").alias("bound"), F.sum("blocks").alias("blocks")), "index-bounds")
        named = F.element_at(F.array(*[F.lit(r.query_id) for r in asked]), F.col("q") + 1).cast(queries.schema["query_id"].dataType).alias("query_id")

        def scored(ranges: DataFrame, least: dict[int, float]) -> DataFrame:
            """(query_id, doc_id, score): what may be among the best `k` in the wanted ranges (q, level, range), each task's best at least."""
            key = ["level", "range"]
            wanted = ranges.groupBy(*key).agg(F.collect_set("q").alias("asking"))
            met = blocks.select(*key, "term", "entries").join(wanted.select(*key), key, "left_semi")
            rows = met.unionByName(wanted, allowMissingColumns=True)
            rows = rows.withColumn("out", F.lit(None).cast("array<bigint>")) if out is None else rows.unionByName(out.join(wanted.select(*key), key, "left_semi"), allowMissingColumns=True)
            rows = rows.select(F.concat_ws(":", *key).alias("range"), "term", "entries", "asking", "out")

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names, told = pa.array(shared.value[0], pa.string()), shared.value[1]
                best = np.full((told.shape[1], k), -np.inf)  # the k best scores of each query so far, ascending
                floor = np.array([least.get(q, -np.inf) for q in range(told.shape[1])])
                for table in _whole_ranges(batches, lambda b: len(b.column("entries").flatten())):
                    at = _column(table, "range").dictionary_encode()
                    at, ranges = _numbers(at.indices).astype(np.int64), len(at.dictionary)
                    lists = {c: (np.repeat(at, _numbers(pc.fill_null(pc.list_value_length(_column(table, c)), 0))), _column(table, c).flatten()) for c in ("entries", "asking", "out")}
                    asks = np.zeros((ranges, told.shape[1]), dtype=bool)
                    asks[lists["asking"][0], _numbers(lists["asking"][1])] = True
                    there, entries = lists["entries"]
                    if not len(there):
                        continue
                    place = pc.fill_null(pc.index_in(_column(table, "term"), value_set=names.cast(table.schema.field("term").type)), 0)
                    terms, t = np.unique(np.repeat(_numbers(place), _numbers(pc.fill_null(pc.list_value_length(_column(table, "entries")), 0))), return_inverse=True)
                    ids = _numbers(entries.field("doc_id"))
                    told_ids, code = np.unique(ids, return_inverse=True)
                    docs, row = np.unique(there * len(told_ids) + code, return_inverse=True)
                    names_of, lies = told_ids[docs % len(told_ids)], docs // len(told_ids)
                    gone = lists["out"]
                    dead = np.zeros(len(docs), dtype=bool)
                    if len(gone[0]):
                        where = np.minimum(np.searchsorted(told_ids, _numbers(gone[1])), len(told_ids) - 1)
                        here = told_ids[where] == _numbers(gone[1])
                        dead = np.isin(docs, gone[0][here] * len(told_ids) + where[here])
                    value = part(_numbers(entries.field("tf")).astype(float), _numbers(entries.field("dl")))
                    order = np.argsort(row, kind="stable")
                    row, t, value = row[order], t[order], value[order]
                    for start in range(0, len(docs), SCORED_ROWS):
                        end = min(start + SCORED_ROWS, len(docs))
                        a, b = np.searchsorted(row, [start, end])
                        matrix = np.zeros((end - start, len(terms)))
                        np.add.at(matrix, (row[a:b] - start, t[a:b]), value[a:b])
                        scores = matrix @ told[terms]
                        rounded = np.round(scores, 6)
                        # Python and Spark may round a half unlike; such rows are left for Spark to rank.
                        half = np.abs(scores * 1e6 % 1 - 0.5) < 1e-4
                        may = (scores > 0) & (rounded >= np.maximum(best[:, 0], floor) - MARGIN) & asks[lies[start:end]] & ~dead[start:end, None]
                        for q in np.flatnonzero(may.any(axis=0)).tolist():
                            near = np.flatnonzero(may[:, q])
                            if len(near) > k:
                                near = near[np.lexsort((names_of[start + near], -rounded[near, q]))]
                                near = np.concatenate([near[:k], near[k:][half[near[k:], q]]])
                            best[q] = np.sort(np.concatenate([best[q], rounded[near[:k], q]]))[-k:]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q), pa.int32()), pa.array(names_of[start + near], pa.int64()), pa.array(scores[near, q])], ["q", "doc_id", "score"])

            told = rows.repartition("range").sortWithinPartitions("range").mapInArrow(run, "q int, doc_id long, score double")
            return told.select("q", named, "doc_id", F.round("score", 6).alias("score"))

        best = Window.partitionBy("q").orderBy(F.desc("bound"), "level", "range")
        ranked = sums.withColumn("n", F.row_number().over(best))
        first = stored(ranked.where(F.col("n") <= FIRST_RANGES).drop("n"), "index-first")
        early = stored(top_per_query(scored(first, {}), k, "score", "doc_id").drop("rank"), "index-early")
        full = early.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        least = {r.q: r.least for r in full.collect()}  # SEARCH_BATCH rows at most
        threshold = self.spark.createDataFrame(list(least.items()), "q int, least double")
        others = sums.join(first, ["q", "level", "range"], "left_anti").join(F.broadcast(threshold), "q", "left")
        second = stored(others.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - MARGIN)).drop("least"), "index-second")
        hits = top_per_query(early.unionByName(scored(second, least)), k, "score", "doc_id").drop("q")
        read = first.unionByName(second).groupBy("q").agg(F.sum("blocks").alias("read"))
        touched = sums.groupBy("q").agg(F.sum("blocks").alias("blocks")).join(read, "q").select(named, "blocks", "read")
        return Found(hits, touched)


class SearchIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, range_docs: int = RANGE_DOCS) -> None:
        self.spark, self.path, self.range_docs = spark, path or scratch(spark, "search-index"), range_docs
        self._kept = Manifests(spark, f"{self.path}/manifests")

    def snapshot(self) -> Snapshot:
        found = self._kept.latest()
        return Snapshot(self.spark, found[1] if found else {"revision": 0, "levels": [], "docs": 0, "length": 0})

    def _blocks(self, path: str) -> dict[str, int]:
        """Write the blocks of the documents that are written under the path; how many ranges each length class has."""
        docs = self.spark.read.parquet(f"{path}/docs").where("dl > 0")
        counts = docs.groupBy(_band(F.col("dl")).alias("band")).agg(F.ceil(F.count(F.lit(1)) / self.range_docs).cast("int").alias("slots"))
        slots = {str(r.band): r.slots for r in counts.collect()}  # a row for each length class
        rows = _placed(docs, slots).select("range", F.col("doc_id").cast("long").alias("doc_id"), "dl", "terms", "tfs")
        rows.repartition("range").sortWithinPartitions("range").mapInArrow(_block_batches, BLOCKS).write.parquet(f"{path}/blocks")
        return slots

    def _level(self, docs: DataFrame) -> str:
        """Write documents (doc_id, text, ...) as a level of their own, yet without blocks; its path."""
        path = f"{self.path}/level-{uuid.uuid4().hex}"
        extra = [c for c in docs.columns if c not in ("doc_id", "text", "level")]
        _counted(docs.select("doc_id", *extra, text.tokens(F.col("text")).alias("terms"))).write.parquet(f"{path}/docs")
        return path

    def _publish(self, number: int, content: dict) -> None:
        if not self._kept.publish(number, content):
            raise RuntimeError("the index was changed by another writer meanwhile; nothing is lost, start again")

    def rebuild(self, load: Callable[[], DataFrame], revision: Revision | None = None, attempts: int = 3) -> int:
        """Index all documents that `load` gives, beside what is there, and swap; the revision that it holds.

        The corpus' revision is read before and after. If it has moved meanwhile, the new postings may mix two
        states, so they are left aside and built again.
        """
        for _ in range(attempts):
            before = revision.now() if revision else 0
            number = self._kept.latest()[0] + 1 if self._kept.numbers() else 1
            path = self._level(load())
            docs = self.spark.read.parquet(f"{path}/docs")
            docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/terms")
            docs.select("doc_id").limit(0).write.parquet(f"{path}/changed")
            sums = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
            if revision is None or revision.now() == before:
                self._publish(number, {"revision": before, "docs": sums["n"], "length": sums["length"], "levels": [{"path": path, "docs": sums["n"], "slots": self._blocks(path)}]})
                return before
        raise RuntimeError(f"the corpus changed during each of {attempts} builds")

    def apply(self, changed: DataFrame, removed: DataFrame | None = None, revision: int | None = None) -> int:
        """Put documents in or in place of those with their ids, and take `removed` (doc_id) out; the number of levels then."""
        found = self._kept.latest()
        if found is None:
            raise RuntimeError("build the index first")
        number, content = found
        now = Snapshot(self.spark, content)
        path = self._level(changed)
        docs = self.spark.read.parquet(f"{path}/docs")
        ids = docs.select("doc_id") if removed is None else docs.select("doc_id").unionByName(removed.select("doc_id"))
        ids.distinct().write.parquet(f"{path}/changed")
        ids = self.spark.read.parquet(f"{path}/changed")
        gone = stored(now.documents().join(ids, "doc_id", "left_semi").select("dl", "terms"), "index-gone")
        signed = docs.select("dl", "terms", F.lit(1).alias("sign")).unionByName(gone.withColumn("sign", F.lit(-1)))
        terms = signed.select("sign", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("sign").alias("df"))
        terms.where("df <> 0").write.parquet(f"{path}/terms")
        sums = signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("length")).first()
        levels = [*content["levels"], {"path": path, "docs": ids.count()}]
        while len(levels) > 1 and levels[-2]["docs"] <= FAN_OUT * levels[-1]["docs"]:
            levels[-2:] = [self._merged(levels[-2]["path"], levels[-1]["path"])]
        levels[-1]["slots"] = self._blocks(levels[-1]["path"])
        self._publish(number + 1, {"revision": content["revision"] if revision is None else revision, "docs": content["docs"] + sums["n"], "length": content["length"] + sums["length"], "levels": levels})
        return len(levels)

    def _merged(self, older: str, newer: str) -> dict:
        """Two neighbouring levels as one, yet without blocks; what the newer replaces goes."""
        path, read = f"{self.path}/level-{uuid.uuid4().hex}", self.spark.read.parquet
        replaced = read(f"{newer}/changed")
        read(f"{older}/docs").join(replaced, "doc_id", "left_anti").unionByName(read(f"{newer}/docs"), allowMissingColumns=True).write.parquet(f"{path}/docs")
        replaced.unionByName(read(f"{older}/changed")).distinct().write.parquet(f"{path}/changed")
        read(f"{older}/terms").unionByName(read(f"{newer}/terms")).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").write.parquet(f"{path}/terms")
        return {"path": path, "docs": read(f"{path}/docs").count()}
