"""Queries that run streams over the events: windows, sessions, alarms in silence, the life of alarms and cases checked again, with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.operators import metrics
from wharfline.plans.ops_queries import derived, plain
from wharfline.streaming import conditions, keyed

#: How far the clock stands after the last event.
AFTER = "3 days"


def _folder(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "/tmp/wharfline-checkpoints"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str]:
    """The events as a stream with a clock that stands some days after the last of them, and a folder for the run."""
    folder = _folder(spark, name)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = F.col("ts").cast("timestamp")
    events.agg((F.max(stamp) + F.expr(f"INTERVAL {AFTER}")).alias("ts")).where("ts is not null").write.parquet(f"{folder}/clock")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", stamp)  # a stream reads folders or patterns
    return keyed.with_clock(stream, spark.readStream.schema("ts timestamp").parquet(f"{folder}/clock")), folder


def _text(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def error_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, folder = _events(spark, sf_dir, "error-stream")
    found = conditions.finished(conditions.errors_in_window(events, F.col("event_type") == "error", 1, "1 hour", "15 minutes"), folder)
    return found.select(_text("von"), "fehler", "alarm")


def reread_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, folder = _events(spark, sf_dir, "reread-stream")
    status = F.when(F.col("event_id") % 4 == 0, "re_extraction_required").otherwise("ok")
    found = conditions.finished(conditions.reread_share(events.withColumn("status", status), 0.25, "1 hour", "30 minutes"), folder)
    return found.select(_text("von"), "nachzulesen", F.round("anteil", 6).alias("anteil"), "alarm")


def used_override_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, folder = _events(spark, sf_dir, "override-stream")
    found = conditions.finished(conditions.used_up_overrides(events.withColumn("gewirkt", F.col("event_id") % 3 > 0), 3, "1 hour", None), folder)
    return found.select(_text("von"), "verbraucht", "alarm")


def slow_run_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, folder = _events(spark, sf_dir, "slow-stream")
    found = conditions.finished(conditions.slow_runs(events.withColumn("dauer", F.when(F.col("event_id") % 16 == 0, 100.0).otherwise(0.0)), 60.0, "1 hour", None), folder)
    return found.select(_text("von"), "p95", "alarm")


def quiet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each kind of event that ten minutes without one close."""
    events, folder = _events(spark, sf_dir, "quiet-stream")
    return conditions.finished(conditions.quiet_sessions(events, "600 seconds", key=F.col("event_type")), folder).select(_text("von"), "key", "pruefungen")


def sustained_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of high values of a kind of event with less than ten minutes between two of them."""
    events, folder = _events(spark, sf_dir, "sustained-stream")
    return conditions.finished(conditions.sustained_runs(events, F.col("value") >= 50, 300, "event_type", gap="600 seconds"), folder).select(_text("von"), "event_type", "proben", "alarm")


def silent_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead-man alarms of kinds of events that haven't been seen for two hours: while others come, and after all have stopped."""
    events, folder = _events(spark, sf_dir, "silent-stream")
    found = conditions.finished(keyed.watched(events, F.col("event_type"), F.lit(False), 0, 7200), folder)
    return found.select("key", _text("seit"), _text("alarm_am"), _text("beendet_am"))


def absence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events that have been high, or without a value for an hour and a half, for half an hour."""
    events, folder = _events(spark, sf_dir, "absence-stream")
    found = conditions.finished(keyed.watched(events, F.col("event_type"), F.col("value") >= 100, 1800, 5400), folder)
    return found.select("key", _text("seit"), _text("alarm_am"), _text("beendet_am"))


# messages on alarms: those of odd events end it
ALERTS = """SELECT ts, 'f' || CAST(user_id % 50 AS STRING) AS fingerprint, TIMESTAMP '2024-01-01 00:00:00' AS begonnen_am, CASE WHEN user_id % 50 < 45 THEN 'Alarm' || CAST(user_id % 5 AS STRING) END AS name, CASE WHEN event_id % 3 = 1 THEN ts END AS beendet_am FROM {events}"""


def alarm_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms from their messages, each once, when it hasn't been heard of for twelve hours."""
    events, folder = _events(spark, sf_dir, "alarm-stream")
    alerts = events.select("ts", F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("fingerprint"), F.lit("2024-01-01").cast("timestamp").alias("begonnen_am"),
        F.when(F.col("user_id") % 50 < 45, F.concat(F.lit("Alarm"), (F.col("user_id") % 5).cast("string"))).alias("name"), F.when(F.col("event_id") % 3 == 1, F.col("ts")).alias("beendet_am"))
    found = conditions.finished(keyed.alarm_life(alerts, 12 * 3600), folder)
    return found.select("fingerprint", "name", _text("beendet_am"), _text("zuletzt_am"), "zustand")


# new documents of cases, in three deliveries: the third is the second again
REPLIES = "SELECT l_orderkey AS akte_id, 'h' || CAST(l_partkey % 7 AS STRING) AS hash, l_linenumber * 1000 + l_suppkey % 1000 AS ord, CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END AS lieferung FROM {lineitem}"


def _checked(documents: DataFrame) -> DataFrame:
    n = F.count("*")
    return documents.groupBy("akte_id").agg(n.alias("dokumente"), F.when(n >= 3, "freigabereif").otherwise("blockiert").alias("freigabe"))


def rechecked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases checked again as their documents arrive in three batches, one of them twice."""
    folder = _folder(spark, "rechecked")
    replies = derived(spark, sf_dir, REPLIES, "lineitem")
    take = conditions.recheck(f"{folder}/documents", f"{folder}/results", _checked)
    # a delivery is a batch of as many files as tasks wrote: the stream goes on from its state each time one has come
    for n, delivery in enumerate((0, 1, 1)):
        replies.where(F.col("lieferung") == delivery).drop("lieferung").write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(replies.drop("lieferung").schema).parquet(f"{folder}/in/*")
        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/results").select("akte_id", "dokumente", "freigabe")


# documents of orders that arrive one after the other, against stored ones: unique by document and by content
ARRIVED = "SELECT l_orderkey AS akte_id, 'd' || CAST(l_partkey % 4 AS STRING) AS dokument_id, CASE WHEN l_suppkey % 9 > 0 THEN 'h' || CAST(l_suppkey % 5 AS STRING) END AS hash, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS ord FROM {lineitem}"


def unique_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append adds that is unique by document id and by content within a case; the first line of every third order is stored already."""
    rows = derived(spark, sf_dir, ARRIVED, "lineitem")
    old = (F.col("ord") == 1) & (F.col("akte_id") % 3 == 0)
    return metrics.append_unique(rows.where(~old), rows.where(old), [["akte_id", "dokument_id"], ["akte_id", "hash"]], ["akte_id", "ord"], _folder(spark, "unique-documents"))


UNIQUE_SQL = f"""WITH RECURSIVE a AS ({plain(ARRIVED, "lineitem")}), s(akte_id, ord, docs, hashes, went, dokument_id, hash) AS (
  SELECT akte_id, 1::BIGINT, [dokument_id], CASE WHEN hash IS NULL THEN []::VARCHAR[] ELSE [hash] END, TRUE, dokument_id, hash FROM a WHERE ord = 1
  UNION ALL SELECT a.akte_id, a.ord, CASE WHEN f THEN list_append(docs, a.dokument_id) ELSE docs END, CASE WHEN f AND a.hash IS NOT NULL THEN list_append(hashes, a.hash) ELSE hashes END, f, a.dokument_id, a.hash
  FROM (SELECT s.akte_id, s.ord, s.docs, s.hashes, n.dokument_id AS nd, n.hash AS nh, NOT list_contains(s.docs, n.dokument_id) AND (n.hash IS NULL OR NOT list_contains(s.hashes, n.hash)) AS f FROM s JOIN a n ON n.akte_id = s.akte_id AND n.ord = s.ord + 1) x
  JOIN a ON a.akte_id = x.akte_id AND a.ord = x.ord + 1
) SELECT akte_id, dokument_id, hash, ord FROM s WHERE went AND NOT (ord = 1 AND akte_id % 3 = 0)"""

QUERIES = {
    "error_stream": error_stream, "reread_stream": reread_stream, "used_override_stream": used_override_stream, "slow_run_stream": slow_run_stream, "quiet_stream": quiet_stream, "sustained_stream": sustained_stream,
    "silent_stream": silent_stream, "absence_stream": absence_stream, "alarm_stream": alarm_stream, "rechecked_cases": rechecked_cases, "unique_documents": unique_documents,
}

_T = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
SESSION_SQL = """WITH g AS (SELECT {0} AS key, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 600 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS neu FROM events {1} WINDOW w AS (PARTITION BY {0} ORDER BY ts)),
s AS (SELECT *, sum(neu) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g)"""
STREAM_SQL = f"SELECT {_T.format('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS von, {{0}} FROM events GROUP BY 1"
SLIDING_SQL = f"SELECT {_T.format('von')} AS von, {{2}} FROM (SELECT *, time_bucket(INTERVAL {{0}} MINUTE, ts) - i * INTERVAL {{0}} MINUTE AS von FROM events, range({{1}}) r(i)) w GROUP BY w.von"
_GAPS = "SELECT event_type AS key, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events"
_ALARM = f"SELECT key, {_T.format('seit')} AS seit, {_T.format('am')} AS alarm_am, NULL AS beendet_am FROM a UNION ALL SELECT key, {_T.format('seit')}, {_T.format('am')}, {_T.format('ende')} FROM a WHERE ende IS NOT NULL"
ORACLES = {
    "error_stream": SLIDING_SQL.format(15, 4, "count(*) FILTER (event_type = 'error') AS fehler, count(*) FILTER (event_type = 'error') > 1 AS alarm"),
    "reread_stream": SLIDING_SQL.format(30, 2, "count(*) FILTER (event_id % 4 = 0) AS nachzulesen, round(count(*) FILTER (event_id % 4 = 0) / count(*), 6) AS anteil, count(*) FILTER (event_id % 4 = 0) / count(*) > 0.25 AS alarm"),
    "used_override_stream": STREAM_SQL.format("count(*) FILTER (event_id % 3 = 0) AS verbraucht, count(*) FILTER (event_id % 3 = 0) > 3 AS alarm"),
    "slow_run_stream": STREAM_SQL.format("quantile_disc(CASE WHEN event_id % 16 = 0 THEN 100.0 ELSE 0.0 END::DOUBLE, 0.95) AS p95, quantile_disc(CASE WHEN event_id % 16 = 0 THEN 100.0 ELSE 0.0 END::DOUBLE, 0.95) > 60 AS alarm"),
    "quiet_stream": SESSION_SQL.format("event_type", "") + f" SELECT {_T.format('min(ts)')} AS von, key, count(*) AS pruefungen FROM s GROUP BY key, nr",
    "sustained_stream": SESSION_SQL.format("event_type", "WHERE value >= 50") + f" SELECT {_T.format('min(ts)')} AS von, key AS event_type, count(*) AS proben, floor(epoch(max(ts))) - floor(epoch(min(ts))) >= 300 AS alarm FROM s GROUP BY key, nr",
    "silent_stream": f"WITH a AS (SELECT key, ts + INTERVAL 7200 SECOND AS seit, ts + INTERVAL 7200 SECOND AS am, n AS ende FROM ({_GAPS}) g WHERE n IS NULL OR n > ts + INTERVAL 7200 SECOND) {_ALARM}",
    "absence_stream": f"""WITH p AS (SELECT event_type AS key, ts AS t, coalesce(value >= 100, FALSE) AS bad FROM events UNION ALL SELECT key, ts + INTERVAL 5400 SECOND, TRUE FROM ({_GAPS}) g WHERE n IS NULL OR n > ts + INTERVAL 5400 SECOND),
      q AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY t, bad ROWS UNBOUNDED PRECEDING) AS nr FROM p),
      i AS (SELECT key, nr, min(t) FILTER (bad) AS seit, lead(min(t)) OVER (PARTITION BY key ORDER BY nr) AS ende FROM q GROUP BY key, nr),
      a AS (SELECT key, seit, seit + INTERVAL 1800 SECOND AS am, ende FROM i WHERE seit IS NOT NULL AND (ende IS NULL OR ende > seit + INTERVAL 1800 SECOND)) {_ALARM}""",
    "alarm_stream": f"""WITH m AS ({plain(ALERTS, "events")}), g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS neu FROM m WINDOW w AS (PARTITION BY fingerprint ORDER BY ts)),
      s AS (SELECT *, sum(neu) OVER (PARTITION BY fingerprint ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g)
      SELECT fingerprint, max(name) AS name, {_T.format("max(beendet_am)")} AS beendet_am, {_T.format("max(ts)")} AS zuletzt_am, CASE WHEN max(beendet_am) IS NULL THEN 'firing' ELSE 'resolved' END AS zustand FROM s GROUP BY fingerprint, nr""",
    "rechecked_cases": f"SELECT akte_id, count(DISTINCT hash) AS dokumente, CASE WHEN count(DISTINCT hash) >= 3 THEN 'freigabereif' ELSE 'blockiert' END AS freigabe FROM ({plain(REPLIES, 'lineitem')}) r GROUP BY 1",
    "unique_documents": UNIQUE_SQL,
}
