"""Streaming queries over `events`, and the same results from batch SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.operators import files
from marlspark.plans import base
from marlspark.plans import files as intake
from marlspark.plans.base import query, read
from marlspark.sources.shared import scratch
from marlspark.streaming import changes, triggers
from marlspark.streaming import versions as version_state
from marlspark.streaming.checkpoints import Checkpoints, in_window
from marlspark.streaming.table import DurableTable, synchronise

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")


WINDOW = "ts > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 120 SECOND AND ts <= TIMESTAMP '2024-01-20 00:00:00'"


@query(f"SELECT event_id, user_id, event_type FROM events WHERE {WINDOW}")
def stream_delta_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of a window that begins two minutes before the checkpoint, read as a stream."""
    kept = Checkpoints(spark)
    kept.put("events", dt.datetime(2024, 1, 10))
    start, end = kept.window("events", dt.datetime(2024, 1, 20))
    path, write = changes.append_to(spark, "delta-window")
    changes.run_to_end(in_window(_events(spark, sf_dir), "ts", start, end).select("event_id", "user_id", "event_type"), write, "delta-window")
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{path}/batch=*")


@query("SELECT user_id, event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY user_id, event_type")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each (user, type), upserted from the stream; rows read twice change nothing."""
    table = DurableTable(spark, scratch(spark, "latest"), ["user_id", "event_type"], ["ts", "event_id"], "user_id long, event_type string, ts timestamp_ntz, event_id long, value double, digest string")
    stream = changes.fingerprinted(_events(spark, sf_dir), ["event_id", "value"])

    def twice(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number)
        table.upsert(batch, number, "overlap")  # the overlap of the next window

    changes.run_to_end(stream, twice, "latest")
    return table.read().select("user_id", "event_type", "value")


@query("SELECT user_id, event_type, value FROM (SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY user_id) WHERE event_type <> 'error'")
def sync_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run reads all events up to its cutoff, activates them as the baseline and catches up; a later one reads the rest. An error takes its user out."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id", (F.col("event_type") == "error").alias("gone"))
    rows = changes.fingerprinted(events, ["event_id", "event_type", "value"])
    table = DurableTable(spark, scratch(spark, "users"), ["user_id"], ["ts", "event_id"], "user_id long, event_type string, value double, ts timestamp_ntz, event_id long, gone boolean, digest string")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return table.read().select("user_id", "event_type", "value")
    times = iter([first + (last - first) / 3, first + (last - first) / 2, last])

    def up_to(end: dt.datetime) -> DataFrame:
        return in_window(rows, "ts", None, end)

    for _ in range(2):
        synchronise(table, up_to, lambda start, end: in_window(rows, "ts", start, end), lambda: next(times))
    return table.read().select("user_id", "event_type", "value")


@query("SELECT user_id AS product, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS code, count(*) AS changes FROM events GROUP BY user_id")
def stream_keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's last code and number of changes, from per-key state."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("product"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("event"), F.col("event_type").alias("code"))
    path, write = changes.append_to(spark, "codes")
    changes.run_to_end(changes.last_codes(rows), write, "codes", "update")
    found = spark.read.schema("product long, code string, changes long").parquet(f"{path}/batch=*")
    return found.groupBy("product").agg(F.max_by("code", "changes").alias("code"), F.max("changes").alias("changes"))


@query("SELECT product, code FROM (SELECT user_id AS product, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS code FROM events GROUP BY user_id) WHERE code <> 'error'")
def stream_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their last code; an error removes its product until it comes again."""
    code = F.when(F.col("event_type") != "error", F.col("event_type"))
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("product"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("event"), code.alias("code"))
    path, write = changes.append_to(spark, "current-codes")
    changes.run_to_end(changes.current_codes(rows), write, "current-codes", "update")
    found = spark.read.schema("product long, at long, event long, code string").parquet(f"{path}/batch=*")
    return found.groupBy("product").agg(F.max_by(F.struct("code"), F.struct("at", "event")).alias("last")).select("product", "last.code").where("code IS NOT NULL")


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query(base.SQL["version_decision"])
def stream_file_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files as a stream; each batch is judged as a whole against the versions that are done."""
    done = intake.versions(spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'"))
    path, write = changes.append_to(spark, "intake")

    def judge(batch: DataFrame, number: int) -> None:
        write(files.decide_versions(intake.versions(batch), done).select("file_id", "outcome"), number)

    stream = spark.readStream.schema(ORDERS).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/orders.parquet*")
    changes.run_to_end(stream.where("o_orderstatus <> 'F'"), judge, "intake")
    return spark.read.schema("file_id long, outcome string").parquet(f"{path}/batch=*")


@query(
    f"""WITH RECURSIVE {intake.VERSIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY source, document_code ORDER BY file_id) AS n FROM f),
    s AS (
      SELECT source, document_code, 0::BIGINT AS n, NULL::INTEGER AS latest, NULL::VARCHAR AS latest_slug, []::STRUCT(v INTEGER, c VARCHAR)[] AS seen, NULL::BIGINT AS file_id, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT source, document_code FROM o)
      UNION ALL
      SELECT source, document_code, n, CASE WHEN taken THEN version ELSE latest END, CASE WHEN taken THEN slug ELSE latest_slug END, CASE WHEN taken THEN list_append(seen, {{'v': version, 'c': checksum}}) ELSE seen END, file_id, outcome
      FROM (SELECT *, outcome IN ('CREATE', 'NEW_VERSION') AS taken FROM (
        SELECT o.source, o.document_code, o.n, s.latest, s.latest_slug, s.seen, o.version, o.slug, o.checksum, o.file_id,
          CASE WHEN s.latest IS NULL THEN CASE WHEN o.version = 1 THEN 'CREATE' ELSE 'INITIAL_VERSION_MUST_BE_ONE' END
               WHEN list_contains(list_transform(s.seen, lambda x: x.v), o.version) THEN CASE WHEN list_contains(s.seen, {{'v': o.version, 'c': o.checksum}}) THEN 'DUPLICATE' ELSE 'VERSION_CONTENT_CONFLICT' END
               WHEN o.version < s.latest THEN 'OLDER_VERSION' WHEN o.slug <> s.latest_slug THEN 'DOCUMENT_NAME_MISMATCH' ELSE 'NEW_VERSION' END AS outcome
        FROM s JOIN o ON o.source = s.source AND o.document_code = s.document_code AND o.n = s.n + 1)))
    SELECT file_id, outcome FROM s WHERE file_id IS NOT NULL"""
)
def stream_version_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each new file against all that came before it in the stream, by state of each (source, code)."""
    stream = spark.readStream.schema(ORDERS).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/orders.parquet*")
    rows = intake.versions(stream).withColumn("seq", F.col("file_id"))
    path, write = changes.append_to(spark, "version-state")
    changes.run_to_end(version_state.judged(rows), write, "version-state", "update", settings=dict([version_state.STORE]))
    return spark.read.schema("file_id long, outcome string").parquet(f"{path}/batch=*")


@query(
    """WITH RECURSIVE o AS (
      SELECT user_id AS source, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
        CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'request' ELSE 'look' END WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'disable' ELSE 'enable' END ELSE 'look' END AS kind FROM events),
    s AS (
      SELECT source, 0::BIGINT AS n, NULL::BIGINT AS tm, NULL::BIGINT AS ls, NULL::BIGINT AS ra, false AS running, false AS requested, true AS enabled, NULL::VARCHAR AS trig FROM (SELECT DISTINCT source FROM o)
      UNION ALL
      SELECT source, n, tm, ls, ra, running OR trig IS NOT NULL, requested AND trig IS NULL, enabled, trig FROM (
        SELECT *, CASE WHEN running THEN NULL WHEN requested THEN 'manual' WHEN enabled AND (ls IS NULL OR tm >= ls + 43200000000) AND NOT coalesce(ra > tm, false) THEN 'scheduled' END AS trig FROM (
          SELECT o.source, o.n, o.tm, CASE WHEN s.running AND kind = 'done' THEN o.tm ELSE s.ls END AS ls, CASE WHEN s.running AND kind = 'done' THEN NULL WHEN s.running AND kind = 'failed' THEN o.tm + 86400000000 ELSE s.ra END AS ra,
            s.running AND kind NOT IN ('done', 'failed') AS running, s.requested OR kind = 'request' AS requested, CASE kind WHEN 'enable' THEN true WHEN 'disable' THEN false ELSE s.enabled END AS enabled
          FROM s JOIN o ON o.source = s.source AND o.n = s.n + 1)))
    SELECT source, tm AS began, trig AS trigger FROM s WHERE trig IS NOT NULL"""
)
def trigger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When runs of each source begin, replayed over events that request, finish, fail and switch them."""
    i, kind = F.col("event_id"), F.col("event_type")
    named = F.when(kind == "purchase", "done").when(kind == "error", "failed").when((kind == "click") & (i % 3 == 0), "request").when(kind == "signup", F.when(i % 4 == 0, "disable").otherwise("enable")).otherwise("look")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), i.alias("seq"), named.alias("kind"))
    path, write = changes.append_to(spark, "triggers")
    changes.run_to_end(triggers.runs(rows, 12, 1440), write, "triggers", "update", settings=dict([version_state.STORE]))
    return spark.read.schema("source long, at long, trigger string").parquet(f"{path}/batch=*").withColumnRenamed("at", "began")
