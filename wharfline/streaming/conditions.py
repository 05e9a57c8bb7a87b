"""Windowed conditions over event streams. Each takes and returns a streaming (or batch) DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "10 minutes"


def _windowed(events: DataFrame, length: str, slide: str | None, when: str, lateness: str) -> DataFrame:
    window = F.window(when, length, slide) if slide else F.window(when, length)
    return events.withWatermark(when, lateness).groupBy(window)


def _flat(grouped: DataFrame) -> DataFrame:
    rest = [c for c in grouped.columns if c != "window"]
    return grouped.select(F.col("window.start").alias("von"), F.col("window.end").alias("bis"), *rest)


def errors_in_window(events: DataFrame, is_error: Column, limit: int = 0, length: str = "15 minutes", slide: str | None = "1 minute", when: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Errors of each window with events; `alarm` where there are more than `limit`."""
    return _flat(_windowed(events, length, slide, when, lateness).agg(F.count_if(is_error).alias("fehler"))).withColumn("alarm", F.col("fehler") > limit)


def reread_share(findings: DataFrame, limit: float = 0.2, length: str = "1 hour", slide: str | None = "5 minutes", when: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Share of findings that ask for reading again; at least one row counts below the line."""
    hit = F.count_if(F.col("status") == "re_extraction_required")
    out = _windowed(findings, length, slide, when, lateness).agg(hit.alias("nachzulesen"), (hit / F.greatest(F.count("*"), F.lit(1))).alias("anteil"))
    return _flat(out).withColumn("alarm", F.col("anteil") > limit)


def used_up_overrides(overrides: DataFrame, limit: int = 0, length: str = "1 hour", slide: str | None = "5 minutes", when: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Overrides without effect in each window with overrides."""
    return _flat(_windowed(overrides, length, slide, when, lateness).agg(F.count_if(~F.col("gewirkt")).alias("verbraucht"))).withColumn("alarm", F.col("verbraucht") > limit)


def slow_runs(runs: DataFrame, limit_seconds: float = 60.0, length: str = "10 minutes", slide: str | None = "1 minute", when: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """95th percentile of durations."""
    out = _windowed(runs, length, slide, when, lateness).agg(F.percentile_approx("dauer", 0.95, 10_000).alias("p95"))
    return _flat(out).withColumn("alarm", F.col("p95") > limit_seconds)


def quiet_sessions(checks: DataFrame, gap: str = "86400 seconds", when: str = "ts", key: Column | None = None, lateness: str = LATENESS) -> DataFrame:
    """Sessions of checks: one that is closed has been followed by `gap` without a check."""
    keys = [] if key is None else [key.alias("key")]
    out = checks.withWatermark(when, lateness).groupBy(F.session_window(when, gap).alias("window"), *keys).agg(F.count("*").alias("pruefungen"))
    return _flat(out)


def idempotent_append(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends only rows whose key isn't stored yet, so a repeated batch adds nothing."""
    from wharfline.operators.metrics import append_new

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.schema(batch.schema).parquet(path) if exists(spark, path) else batch.where("false")
        append_new(batch, stored, keys, order).write.mode("append").parquet(path)

    return put


#: Keeps the state of keyed operators on disk instead of in memory, and has their timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def finished(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that its source has and returns the sink's table. Rows are added when they are final, so state goes as the
    watermark passes; what it hasn't passed at the end stays for the next run. State and offsets are kept below the folder, which has to be
    shared by all executors, so a stopped run goes on where it was, and a batch that runs again writes the same folder again."""
    spark, table = stream.sparkSession, f"{folder}/table"
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{table}/batch={n}")
        stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(*(STATE_STORE[0], before)) if before else spark.conf.unset(STATE_STORE[0])
    return spark.read.schema(stream.schema).parquet(f"{table}/batch=*")


def sustained_runs(samples: DataFrame, condition: Column, at_least_seconds: int, key: str, when: str = "ts", gap: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Sessions of true samples of a key with no more than `gap` between two of them: `alarm` where one lasts long enough."""
    # rows without a key, a clock's, move the watermark; as filters are done before it, they have to pass, and go as sessions without a sample
    on = F.coalesce(condition, F.lit(False))
    held = samples.withWatermark(when, lateness).where(on | F.col(key).isNull())
    out = held.groupBy(F.session_window(when, gap).alias("window"), F.col(key)).agg(F.count_if(on).alias("proben"), F.min(when).alias("beginn"), F.max(when).alias("ende"))
    return _flat(out).where("proben > 0").withColumn("alarm", F.unix_timestamp("ende") - F.unix_timestamp("beginn") >= at_least_seconds)


BUCKETS = 64


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def replace_cases(store: str, rows: DataFrame, key: str = "akte_id") -> None:
    """Puts the rows of some cases in place of what a store holds of them. The store is partitioned by hash of the case: only those partitions are
    read and written anew, whole, so doing it twice changes nothing."""
    spark = rows.sparkSession
    new = rows.withColumn("bucket", bucket(key))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # 64 numbers at most
    if not touched:
        return
    if exists(spark, store):
        held = spark.read.schema(new.schema).parquet(store).where(F.col("bucket").isin(touched))
        new = held.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(store)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def recheck(documents: str, results: str, evaluate: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("akte_id", "hash"), order: str = "ord") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for new documents: each is stored once, and the cases they belong to, and no others, are evaluated again from all
    their stored documents; the results take the place of the old ones. A batch that is repeated, also after it stopped half-way, ends in the same stores.

    evaluate: documents of some cases -> result rows with their akte_id. Both stores are partitioned by hash of the case."""

    def take(batch: DataFrame, _: int) -> None:
        from wharfline.operators.metrics import append_new

        spark = batch.sparkSession
        batch = batch.withColumn("bucket", bucket("akte_id")).where("akte_id is not null")
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]
        if not touched:
            return
        there = exists(spark, documents)
        stored = spark.read.schema(batch.schema).parquet(documents).where(F.col("bucket").isin(touched)) if there else batch.where("false")
        append_new(batch, stored, list(keys), order).write.mode("append").partitionBy("bucket").parquet(documents)
        affected = batch.select("akte_id").distinct()
        now = spark.read.schema(batch.schema).parquet(documents).where(F.col("bucket").isin(touched)).join(affected, "akte_id", "left_semi")
        replace_cases(results, evaluate(now.drop("bucket")))

    return take


def intake(known: DataFrame, path: str, then: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for mails: each batch is routed to its cases and appended once, and what is to be checked again (a row
    for each case that got something) is handed on."""
    from wharfline.operators.requests import route_mail

    put = idempotent_append(path, ["mail_id"], "mail_id")

    def take(batch: DataFrame, n: int) -> None:
        routed = route_mail(batch, known)
        put(routed, n)
        then(routed.where("akte_id is not null").select("akte_id").distinct())

    return take
