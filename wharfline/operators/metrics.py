"""Operational aggregates, extraction quality and sustained conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0)


def checks_by_decision(checks: DataFrame) -> DataFrame:
    return checks.groupBy("freigabe", F.coalesce("freigabe_nach_override", "freigabe").alias("freigabe_nach_override")).agg(F.count("*").alias("anzahl"))


def count_by(rows: DataFrame, *keys: str, unknown: str | None = None) -> DataFrame:
    """Rows by keys; null keys count as `unknown` if one is given."""
    columns = [F.coalesce(k, F.lit(unknown)).alias(k) if unknown else F.col(k) for k in keys]
    return rows.groupBy(*columns).agg(F.count("*").alias("anzahl"))


def open_by_entrance(items: DataFrame) -> DataFrame:
    return count_by(items.where(F.col("status") == "offen"), "eingang")


def age_of_last(checks: DataFrame, as_of: Column, when: str = "geprueft_am") -> DataFrame:
    """Seconds since the last check; 0 where there is none."""
    return checks.agg(F.coalesce(F.unix_timestamp(as_of) - F.unix_timestamp(F.max(when)), F.lit(0)).alias("alter_sekunden"))


def latest_per(rows: DataFrame, key: str, when: str) -> DataFrame:
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), when).alias("_r")).select(key, "_r.*")


def overview(cases: DataFrame, documents: DataFrame, requests: DataFrame, checks: DataFrame) -> DataFrame:
    """A row for each case: documents, open requests, latest stage, last dispatch and last check; last checked first."""
    docs = documents.groupBy("akte_id").agg(F.count("*").alias("dokumente"))
    open_ = F.col("status") == "offen"
    reqs = requests.groupBy("akte_id").agg(
        F.count_if(open_).alias("offene_faelle"),
        F.max_by("stufe", F.when(open_ & F.col("stufe").isNotNull(), F.col("letzter_versand_am"))).alias("stufe"),
        F.max("letzter_versand_am").alias("letzter_versand"),
    )
    last = latest_per(checks.select("akte_id", "freigabe", "geprueft_am"), "akte_id", "geprueft_am")
    rows = cases.join(docs, "akte_id", "left").join(reqs, "akte_id", "left").join(last, "akte_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("dokumente", "offene_faelle")}
    return rows.withColumns(zero).orderBy(F.col("geprueft_am").desc_nulls_last(), "akte_id")


def newest_unassigned(mails: DataFrame, n: int = 50, when: str = "eingegangen_am") -> DataFrame:
    """The newest mails that no case was found for (a top-k report)."""
    return mails.where(F.col("ergebnis") != "zugeordnet").orderBy(F.col(when).desc_nulls_last(), "mail_id").limit(n)


def run_outcomes(runs: DataFrame, bounds: tuple[float, ...] = (0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)) -> DataFrame:
    """Extraction runs (ausgang, dauer in seconds) by outcome: their number, total duration and how many took up to each bound."""
    return runs.groupBy("ausgang").agg(F.count("*").alias("anzahl"), F.sum("dauer").alias("dauer_summe"), F.array(*[F.count_if(F.col("dauer") <= b) for b in bounds]).alias("bis"))


def totals(cases: DataFrame, mails: DataFrame | None = None) -> DataFrame:
    """One row over an overview, with the number of unassigned mails if mails are given."""
    if mails is not None:
        return totals(cases).crossJoin(mails.agg(F.count_if(F.col("ergebnis") != "zugeordnet").alias("mails_ohne_akte")))  # one row each
    return cases.agg(
        F.count("*").alias("akten"), F.count_if(F.col("freigabe") == "blockiert").alias("blockiert"), F.count_if(F.col("freigabe") == "freigabereif").alias("freigabereif"), F.sum("offene_faelle").alias("offene_faelle")
    )


def cumulated_histogram(rows: DataFrame, value: str, key: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Rows with a value up to each bound, by key."""
    sums = rows.groupBy(key).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{k}") for k, b in enumerate(bounds)])
    return sums.select(key, F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"le_{k}").alias("anzahl")) for k, b in enumerate(bounds)])).alias("b")).select(key, "b.*")


def field_status(expected: DataFrame, extracted: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """expected (akte_id, dokument, pfad, typ, wert) against extracted (…, wert): exakt, fehlend, abweichend, ueberzaehlig.
    An expected null is met where nothing, or null, was extracted. Values are text, compared as numbers where both are."""
    keys = ["akte_id", "dokument", "pfad"]
    e = expected.select(*keys, "typ", F.col("wert").alias("e"), F.lit(True).alias("_e"))
    x = extracted.select(*keys, F.col("typ").alias("x_typ"), F.col("wert").alias("x"), F.lit(True).alias("_x"))
    both = e.join(x, keys, "full_outer")
    a, b = F.col("e").try_cast("double"), F.col("x").try_cast("double")
    same = F.coalesce(F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tolerance).otherwise(F.col("e") == F.col("x")), F.lit(False))
    status = (
        F.when(F.col("_e").isNull(), "ueberzaehlig").when(F.col("e").isNull(), F.when(F.col("x").isNull(), "exakt").otherwise("abweichend")).when(F.col("_x").isNull(), "fehlend")
        .when(same, "exakt").otherwise("abweichend")
    )
    return both.select(*keys, F.coalesce("typ", "x_typ", F.lit("?")).alias("typ"), status.alias("status"))


def field_quality(status: DataFrame) -> DataFrame:
    """Counts and exact share by document type, with a total row."""
    n = lambda s: F.count_if(F.col("status") == s)
    expected = F.count_if(F.col("status") != "ueberzaehlig")
    sums = status.rollup("typ").agg(expected.alias("erwartet"), n("exakt").alias("exakt"), n("fehlend").alias("fehlend"), n("abweichend").alias("abweichend"), n("ueberzaehlig").alias("ueberzaehlig"))
    share = F.when(F.col("erwartet") == 0, 1.0).otherwise(F.round(F.try_divide("exakt", "erwartet"), 4))
    return sums.withColumns({"typ": F.coalesce("typ", F.lit("gesamt")), "quote": share})


def decision_quality(expected: DataFrame, decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """expected (akte_id, freigabe, regeln, pflicht) against what was decided: korrekt where all three are equal."""
    of = lambda kind: F.sort_array(F.collect_list(F.when((F.col("art") == kind) & (F.col("status") != "ok"), F.col("kennung"))))
    found = findings.groupBy("akte_id").agg(of("regel").alias("ist_regeln"), of("nachweis").alias("ist_pflicht"))
    both = expected.join(decisions.select("akte_id", F.col("freigabe").alias("ist")), "akte_id", "left").join(found, "akte_id", "left")
    none = F.array().cast("array<string>")
    equal = lambda a, b: F.sort_array(F.coalesce(a, none)) == F.coalesce(b, none)
    return both.withColumn("korrekt", F.coalesce((F.col("freigabe") == F.col("ist")) & equal("regeln", "ist_regeln") & equal("pflicht", "ist_pflicht"), F.lit(False)))


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Measures below their baseline, or gone."""
    both = baseline.join(current.withColumnRenamed("quote", "ist"), "typ", "left")
    return both.where(F.col("ist").isNull() | (F.col("ist") < F.col("quote"))).select("typ", "quote", "ist", F.when(F.col("ist").isNull(), "verschwunden").otherwise("gesunken").alias("grund"))


def sustained(samples: DataFrame, condition: Column, at_least_seconds: int, key: str, when: str = "ts") -> DataFrame:
    """Runs of consecutive true samples that last `at_least_seconds`: key, beginn, ende, proben."""
    turn = Window.partitionBy(key).orderBy(when)
    flagged = samples.withColumn("_on", F.coalesce(condition, F.lit(False))).withColumn("_run", F.sum(F.when(~F.col("_on"), 1).otherwise(0)).over(turn))
    runs = flagged.where("_on").groupBy(key, "_run").agg(F.min(when).alias("beginn"), F.max(when).alias("ende"), F.count("*").alias("proben"))
    return runs.where(F.unix_timestamp("ende") - F.unix_timestamp("beginn") >= at_least_seconds).drop("_run")


def alarm_spans(alarms: DataFrame) -> DataFrame:
    """One row for each alarm: begin, end and last state."""
    return alarms.groupBy("fingerprint", "begonnen_am").agg(F.max("name").alias("name"), F.max("beendet_am").alias("beendet_am"), F.when(F.max("beendet_am").isNull(), "firing").otherwise("resolved").alias("zustand"))


def share_in_window(events: DataFrame, is_hit: Column, length: str, slide: str | None = None, when: str = "ts") -> DataFrame:
    """Hits and their share of the rows in each window; a window without rows counts as one row."""
    return events.groupBy(F.window(when, length, slide) if slide else F.window(when, length)).agg(
        F.count_if(is_hit).alias("treffer"), (F.count_if(is_hit) / F.greatest(F.count("*"), F.lit(1))).alias("anteil")
    ).select(F.col("window.start").alias("von"), "treffer", "anteil")


def append_new(batch: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the batch whose key isn't stored yet, one for each key; rows with a null in the key are all new."""
    complete = F.lit(True)
    for k in keys:
        complete &= F.col(k).isNotNull()
    turn = Window.partitionBy(*keys).orderBy(order)
    fresh = batch.where(complete).join(stored.select(*keys).distinct(), keys, "left_anti").withColumn("_n", F.row_number().over(turn)).where("_n = 1").drop("_n")
    return fresh.unionByName(batch.where(~complete))


def append_unique(batch: DataFrame, stored: DataFrame, keys: list[list[str]], order: list[str], folder: str) -> DataFrame:
    """Rows of the batch that inserts one after the other, in the given order, would put into a table with several unique keys: a row goes in
    unless it shares a key with a stored row or one that has gone in before it. Nulls in a key share nothing.

    In each round the rows that come first by all their keys go in, and those that share a key with them go out; what is left waits for the next round.
    So a row that is only in the way of rows which stay out doesn't keep others out. Rounds are as many as such rows in a chain, and are written
    below the folder, which all executors have to share. Rows that are equal in the order go by chance."""
    spark = batch.sparkSession
    whole = lambda key: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])

    def without(rows: DataFrame, taken: DataFrame) -> DataFrame:
        for key in keys:
            rows = rows.join(taken.where(whole(key)).select(*key).distinct().hint("merge"), key, "left_anti")
        return rows.select(*columns)

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    place = F.struct(*order, "_id").alias("_place")
    columns = [*batch.columns, "_id"]
    left = written(without(batch.withColumn("_id", F.monotonically_increasing_id()), stored), "0")
    out, n = left.where("false"), 0
    while left.count():
        n += 1
        first = left.withColumn("_place", place)
        for k, key in enumerate(keys):
            least = left.where(whole(key)).groupBy(*key).agg(F.min(place).alias(f"_least{k}"))
            first = first.join(least.hint("merge"), key, "left").where(F.coalesce(F.col(f"_least{k}") == F.col("_place"), F.lit(True)))
        went = written(first.select(*columns), f"in-{n}")
        out = out.unionByName(went)
        left = written(without(left.join(went.select("_id").hint("merge"), "_id", "left_anti").select(*columns), went), str(n))
    return out.drop("_id")
