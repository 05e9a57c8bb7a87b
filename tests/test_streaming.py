from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wharfline.operators import metrics
from wharfline.streaming import conditions, keyed

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def stream(spark, tmp_path, rows, schema, folder="in"):
    """A stream of batches; a batch is a file."""
    folder = str(tmp_path / folder)
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def clocked(spark, tmp_path, rows, schema, *times):
    """A stream with a clock that shows some times, one in each batch."""
    return keyed.with_clock(stream(spark, tmp_path, rows, schema), stream(spark, tmp_path, [[(t,)] for t in times], "ts timestamp", "clock"))


def collect(found, tmp_path):
    return conditions.finished(found, str(tmp_path / "run")).collect()


def test_error_windows(spark, tmp_path):
    rows = [[(at(1), True), (at(2), True), (at(3), False)], [(at(20), False), (at(40), True)]]
    events = clocked(spark, tmp_path, rows, "ts timestamp, error boolean", at(500))
    got = collect(conditions.errors_in_window(events, F.col("error"), 1, slide="15 minutes"), tmp_path)
    assert {(r.von, r.fehler, r.alarm) for r in got} == {(at(0), 2, True), (at(15), 0, False), (at(30), 1, False)}


def test_windows_stay_open_until_time_has_passed(spark, tmp_path):
    events = clocked(spark, tmp_path, [[(at(1), True)]], "ts timestamp, error boolean", at(24))
    assert collect(conditions.errors_in_window(events, F.col("error"), slide="15 minutes"), tmp_path) == []  # the watermark is at 14


def test_windows_slide(spark, tmp_path):
    events = clocked(spark, tmp_path, [[(at(62), True), (at(31), True)]], "ts timestamp, error boolean", at(500))
    got = collect(conditions.errors_in_window(events, F.col("error"), 1, "1 hour", "30 minutes"), tmp_path)
    assert {(r.von, r.fehler, r.alarm) for r in got} == {(at(0), 1, False), (at(30), 2, True), (at(60), 1, False)}


def test_reread_share(spark, tmp_path):
    rows = [(at(k), "re_extraction_required" if k < 3 else "ok") for k in range(10)]
    got = collect(conditions.reread_share(clocked(spark, tmp_path, [rows], "ts timestamp, status string", at(500)), slide="1 hour"), tmp_path)
    assert [(r.nachzulesen, r.anteil, r.alarm) for r in got] == [(3, 0.3, True)]


def alarms(spark, tmp_path, batches, hold, silent, *times):
    events = clocked(spark, tmp_path, [[(at(m), k, bad) for m, k, bad in b] for b in batches], "ts timestamp, key string, bad boolean", *map(at, times))
    minute = lambda t: None if t is None else (t - START).total_seconds() / 60
    got = collect(keyed.watched(events, F.col("key"), F.col("bad"), hold * 60, silent * 60), tmp_path)
    return sorted((r.key, minute(r.seit), minute(r.alarm_am), minute(r.beendet_am)) for r in got if r.beendet_am is None), sorted((r.key, minute(r.seit), minute(r.beendet_am)) for r in got if r.beendet_am is not None)


@pytest.mark.parametrize("split", [1, 2, 7])
def test_dead_man_fires_without_a_later_event(spark, tmp_path, split):
    rows = [(0, "a", False), (5, "b", False), (8, "a", False), (30, "a", False), (40, "a", False), (41, "b", False)]
    batches = [rows[k::split] for k in range(split) if rows[k::split]] if split == 1 else [rows[k : k + (len(rows) + split - 1) // split] for k in range(0, len(rows), (len(rows) + split - 1) // split)]
    begun, ended = alarms(spark, tmp_path, batches, 0, 10, *[1] * (len(batches) - 1), 500)
    assert begun == [("a", 18.0, 18.0, None), ("a", 50.0, 50.0, None), ("b", 15.0, 15.0, None), ("b", 51.0, 51.0, None)]
    assert ended == [("a", 18.0, 30.0), ("b", 15.0, 41.0)]


def test_conditions_hold_through_silence(spark, tmp_path):
    rows = [[(0, "a", True), (4, "a", True), (5, "b", True), (9, "b", False)], [(20, "b", False), (31, "c", False), (32, "b", True), (42, "b", False)]]
    begun, ended = alarms(spark, tmp_path, rows, 10, 15, 1, 60)
    # a: bad from 0; b: 5 to 9 is too short, and what ends at the very moment fires no alarm; c: silent from 46, so due at 56
    assert begun == [("a", 0.0, 10.0, None), ("c", 46.0, 56.0, None)] and ended == []


def test_alarms_live_until_they_are_forgotten(spark, tmp_path):
    schema = "ts timestamp, fingerprint string, begonnen_am timestamp, name string, beendet_am timestamp"
    batches = [[(at(0), "f", at(0), None, None), (at(1), "g", at(1), "n", None)], [(at(9), "f", at(0), "late", at(8))], [(at(100), "f", at(0), "again", None)]]
    events = clocked(spark, tmp_path, batches, schema, at(0), at(9), at(100), at(500))
    found = keyed.alarm_life(events, 1800)
    got = {(r.fingerprint, r.name, r.beendet_am, r.zustand) for r in collect(found, tmp_path)}
    assert got == {("f", "late", at(8), "resolved"), ("g", "n", None, "firing"), ("f", "again", None, "firing")}
    state = spark.read.format("statestore").option("path", str(tmp_path / "run" / "state")).option("stateVarName", "life").load()
    assert state.where("key.fingerprint is not null").count() == 0


def test_cases_are_checked_again_as_documents_come(spark, tmp_path):
    seen = []

    def evaluate(documents):
        seen.append(sorted(r.akte_id for r in documents.select("akte_id").distinct().collect()))
        return documents.groupBy("akte_id").agg(F.count("*").alias("n"))

    take = conditions.recheck(str(tmp_path / "documents"), str(tmp_path / "results"), evaluate)
    batch = lambda *rows: spark.createDataFrame(rows, "akte_id string, hash string, ord int")
    first = [(f"c{k}", "h0", k) for k in range(200)]
    take(batch(*first), 0)
    second = batch(("c7", "h1", 1), ("c7", "h1", 2), ("c9", "h0", 3), ("new", "x", 1), (None, "y", 1))
    for n in (1, 1, 2):
        take(second, n)
    assert seen[1:] == [["c7", "c9", "new"]] * 3  # of 201 cases
    got = {r.akte_id: r.n for r in spark.read.parquet(str(tmp_path / "results")).collect()}
    assert got == {f"c{k}": 1 for k in range(200)} | {"c7": 2, "new": 1}
    assert spark.read.parquet(str(tmp_path / "documents")).count() == 202
    take(batch(), 3)


def test_overrides_durations_and_quiet_times(spark):
    o = spark.createDataFrame([(at(1), True), (at(2), False)], "ts timestamp, gewirkt boolean")
    assert conditions.used_up_overrides(o, slide="1 hour").first().verbraucht == 1
    d = spark.createDataFrame([(at(k / 10), float(k)) for k in range(100)], "ts timestamp, dauer double")
    first = conditions.slow_runs(d, slide="10 minutes").first()
    assert first.p95 == 94.0 and first.alarm
    c = spark.createDataFrame([(at(0),), (at(60),), (at(60 * 50),)], "ts timestamp")
    assert sorted(r.pruefungen for r in conditions.quiet_sessions(c).collect()) == [1, 2]


def test_intake_is_idempotent(spark, tmp_path):
    put = conditions.idempotent_append(str(tmp_path / "stored"), ["akte_id", "hash"], "ord")
    batch = spark.createDataFrame([("a", "h1", 1), ("a", "h1", 2), ("a", "h2", 3)], "akte_id string, hash string, ord int")
    put(batch, 0)
    put(batch, 0)
    assert sorted(r.ord for r in spark.read.parquet(str(tmp_path / "stored")).collect()) == [1, 3]


def test_sustained_conditions_and_alarms(spark):
    rows = [(at(k), "db", 0.9 if 5 <= k <= 12 or k == 20 else 0.1) for k in range(30)]
    found = metrics.sustained(spark.createDataFrame(rows, "ts timestamp, name string, v double"), F.col("v") > 0.8, 300, "name").collect()
    assert [(r.beginn, r.ende, r.proben) for r in found] == [(at(5), at(12), 8)]
    alarms = spark.createDataFrame([("f", "n", at(0), None), ("f", "n", at(0), at(9)), ("g", "n", at(1), None)], "fingerprint string, name string, begonnen_am timestamp, beendet_am timestamp")
    assert {(r.fingerprint, r.zustand) for r in metrics.alarm_spans(alarms).collect()} == {("f", "resolved"), ("g", "firing")}
