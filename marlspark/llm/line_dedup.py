"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id. The line keys seen so far are kept as runs: tables of
128-bit key hashes, bucketed and sorted by hash. Each batch merge-joins the runs, keeps what is new and
adds it as a run of level 0; when a level holds `fanout` runs they are merged into one of the next
level, so a batch meets a logarithmic number of runs and no run is rewritten more than once a level.

A key (the line without white space at its ends, A-Z lower-cased) of at least `min_chars` code points
that is in two documents or more keeps its lines in the smallest doc_id only.

Defined results: a null or empty text is one empty line; very long texts and lines are taken whole; a null doc_id ranks after all others; rows
that repeat a doc_id count as one document; short keys are never dropped; an empty table gives an empty
result; extra columns pass through `dedup_lines` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.llm.common import ASCII_SPACE, let, lower_ascii, scratch, shuffle_partitions, written

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """Sorted runs of the keys seen so far, by level."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.buckets = shuffle_partitions(spark)
        self.tables: list[str] = []

    def _run(self, keys: DataFrame) -> DataFrame:
        """Write keys as a run: each bucket is one file, sorted by hash."""
        name = f"line_run_{uuid.uuid4().hex}"
        (
            keys.repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", scratch(self.spark, "line-run"))
            .format("parquet")
            .saveAsTable(name)
        )
        self.tables.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Take the runs off the catalog; nothing read from them may be in use."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables, self.levels = [], []

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch of (h1, h2, id); gives its keys with `owner`, `last` and `known` (in an earlier batch)."""
        keys = batch.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
        keys = keys.withColumn("known", F.lit(False))
        for run in (r for level in self.levels for r in level):
            seen = run.select("h1", "h2", F.lit(True).alias("seen"))
            keys = keys.join(seen, ["h1", "h2"], "left").select("h1", "h2", "owner", "last", (F.col("known") | F.col("seen").isNotNull()).alias("known"))
        found = self._run(keys)
        self._push(0, found.where(~F.col("known")).select("h1", "h2"))
        return found

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionAll(other)
            self.levels[level] = []
            self._push(level + 1, self._run(merged))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(id, text_hash, drops): the positions of the lines that go, for documents that lose any."""
    spark = docs.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    shares = [i / batches for i in range(1, batches)]
    found = docs.select(doc.alias("id")).approxQuantile("id", shares, 0.01) if shares else []
    cuts = sorted({min(int(cut), LAST) for cut in found})  # as a double, the largest long is one too large
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("id") > F.lit(cut)).cast("int")
    exploded = docs.select(doc.alias("id"), F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = exploded.select("id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    # The second hash starts from another seed, so the pair is a 128-bit hash of the key.
    hashed = keyed.select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), batch.alias("batch"))
    path = scratch(spark, "line-hashes")
    hashed.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(hashed.schema).parquet(path)
    runs, found = LineRuns(spark, fanout), []
    for i in range(len(cuts) + 1):
        decided = runs.add(lines.where(F.col("batch") == i))
        found.append(decided.where(F.col("known") | (F.col("last") > F.col("owner"))).select("h1", "h2", F.when(F.col("known"), F.lit(None)).otherwise(F.col("owner")).alias("owner"), F.lit(i).alias("batch")))
    losing = found[0]
    for other in found[1:]:
        losing = losing.unionAll(other)
    losing = written(losing, "line-losing")
    runs.close()
    gone = lines.join(losing, ["batch", "h1", "h2"]).where(F.col("owner").isNull() | (F.col("id") > F.col("owner")))
    return gone.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("drops"))


def with_kept(docs: DataFrame, **options: int) -> DataFrame:
    """`docs` with `_dedup` = struct(n_lines, n_dropped, kept)."""
    drops = dropped_lines(docs, **options).select(F.col("id").alias("_dedup_id"), F.col("text_hash").alias("_dedup_hash"), F.col("drops").alias("_dedup_drops"))
    joined = docs.join(drops, (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == F.col("_dedup_id")) & (F.xxhash64(docs["text"]) == F.col("_dedup_hash")), "left")

    def result(x: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["drops"])
        kept = F.when(F.size(x["drops"]) == 0, x["whole"]).otherwise(F.array_join(F.transform(left, lambda i: F.get(x["lines"], i)), "\n"))
        return F.struct(F.size(x["lines"]).cast("long").alias("n_lines"), F.size(x["drops"]).cast("long").alias("n_dropped"), kept.alias("kept"), (F.size(left) == 0).alias("empty"))

    whole = F.coalesce(docs["text"], F.lit(""))
    state = F.struct(whole.alias("whole"), F.split(whole, "\n").alias("lines"), F.coalesce("_dedup_drops", F.array().cast("array<int>")).alias("drops"))
    return joined.select(*[docs[c] for c in docs.columns], let(state, result).alias("_dedup"))


def dedup_lines(docs: DataFrame, **options: int) -> DataFrame:
    """`docs` with each text less its dropped lines; documents that lose all their lines go."""
    done = with_kept(docs, **options)
    text = F.when(F.col("_dedup.n_dropped") > 0, F.col("_dedup.kept")).otherwise(F.col("text"))
    return done.where(~F.col("_dedup.empty")).select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def line_dedup_report(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and kept_sha256 of each document."""
    done = with_kept(docs.select("doc_id", "text"), **options)
    return done.select("doc_id", F.col("_dedup.n_lines").alias("n_lines"), F.col("_dedup.n_dropped").alias("n_dropped"), F.sha2(F.col("_dedup.kept"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.i, k.line, o.owner IS NOT NULL AND k.doc_id > o.owner AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
