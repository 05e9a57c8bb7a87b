"""Conditions that need a state and a clock for each key: alarms that fire in silence, and the life of an alarm.

State is a few numbers a key and goes when it isn't needed any more. Timers are in event time, so results don't depend on how
events fall into batches: an alarm bears the time at which it was due, whether a timer finds it or a later event of its key. When
nothing arrives at all, time is moved on by `with_clock`. Events of a key have to come in order between batches, but for those
the watermark would drop too; inside a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

MICROS = 1_000_000


def with_clock(events: DataFrame, clock: DataFrame, when: str = "ts") -> DataFrame:
    """events and the rows of a stream of times (column `when`), all else null: they move the watermark and belong to no key."""
    return events.unionByName(clock.select(when), allowMissingColumns=True)


class Watch(StatefulProcessor):
    """Rows (t in microseconds, bad) of a key -> alarms (seit, alarm_am, beendet_am: null while it lasts).

    A key is bad from a bad row on until a good one, and from `silent` after its last row on; an alarm is due when it has been bad
    for `hold`. A good row at that very moment prevents it."""

    def __init__(self, hold: int, silent: int) -> None:
        self.hold, self.silent = hold, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "last long, since long, fired long")  # fired: 0 or when it was due

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if key[0] is None:
            return
        last, since, fired = self.state.get() if self.state.exists() else (None, None, 0)
        for t, bad in sorted((r.t, r.bad) for r in rows):
            if last is not None and t < last:
                continue  # too late for what has been said
            if since is None and last is not None and t > last + self.silent:
                since = last + self.silent
            due = since is not None and not fired and since + self.hold
            if due and (due < t or (due == t and bad)):
                fired = due
                yield Row(key=key[0], seit=since, alarm_am=fired, beendet_am=None)
            if bad:
                since = t if since is None else since
            else:
                if fired:
                    yield Row(key=key[0], seit=since, alarm_am=fired, beendet_am=t)
                since, fired = None, 0
            last = t
            if since is not None and not fired and since + self.hold <= t:
                fired = since + self.hold
                yield Row(key=key[0], seit=since, alarm_am=fired, beendet_am=None)
        self._keep(last, since, fired)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        last, since, fired = self.state.get()
        since = last + self.silent if since is None else since
        due = since + self.hold
        if not fired and due <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            fired = due
            yield Row(key=key[0], seit=since, alarm_am=due, beendet_am=None)
        self._keep(last, since, fired)

    def _keep(self, last: int, since: int | None, fired: int) -> None:
        self.state.update((last, since, fired))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not fired:
            self.handle.registerTimer(-(-((last + self.silent if since is None else since) + self.hold) // 1000))

    def close(self) -> None:
        pass


def _stamped(found: DataFrame, *names: str) -> DataFrame:
    return found.withColumns({n: F.timestamp_micros(n) for n in names})


def watched(events: DataFrame, key: Column, bad: Column, hold_seconds: int, silent_seconds: int, when: str = "ts", lateness: str = "0 seconds") -> DataFrame:
    """events with a clock -> key, seit, alarm_am, beendet_am: a row when an alarm is due and one when it ends. A dead-man alarm has no bad rows and doesn't hold."""
    rows = events.withWatermark(when, lateness).select(when, key.cast("string").alias("key"), F.unix_micros(when).alias("t"), F.coalesce(bad, F.lit(False)).alias("bad"))
    out = rows.groupBy("key").transformWithState(Watch(hold_seconds * MICROS, silent_seconds * MICROS), "key string, seit long, alarm_am long, beendet_am long", "Append", "EventTime")
    return _stamped(out, "seit", "alarm_am", "beendet_am")


class Life(StatefulProcessor):
    """Messages (t, name, begin, end) of an alarm -> its span, once, when nothing has come for `keep`; then its state is dropped."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("life", "name string, ended long, last long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if key[0] is None:
            return
        name, ended, last = self.state.get() if self.state.exists() else (None, None, None)
        for r in sorted(rows, key=lambda r: r.t):
            if last is not None and r.t > last + self.keep:
                yield self._span(key, name, ended, last)
                name, ended = None, None
            name = max((n for n in (name, r.name) if n is not None), default=None)
            ended = max((e for e in (ended, r.ended) if e is not None), default=None)
            last = r.t if last is None else max(last, r.t)
        self.state.update((name, ended, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(last + self.keep) // 1000))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        found = self.state.get()
        self.state.clear()
        yield self._span(key, *found)

    def _span(self, key: tuple, name: str | None, ended: int | None, last: int) -> Row:
        return Row(fingerprint=key[0], begonnen_am=key[1], name=name, beendet_am=ended, zuletzt_am=last, zustand="firing" if ended is None else "resolved")

    def close(self) -> None:
        pass


def alarm_life(alerts: DataFrame, keep_seconds: int, when: str = "ts", lateness: str = "0 seconds") -> DataFrame:
    """alerts (ts, fingerprint, name, begonnen_am, beendet_am) with a clock -> a row for each alarm, when it hasn't been heard of for `keep_seconds`: fingerprint,
    begonnen_am, name, beendet_am, zuletzt_am, zustand. A late end joins its alarm until then."""
    rows = alerts.withWatermark(when, lateness).select(
        when, "fingerprint", F.unix_micros("begonnen_am").alias("begonnen_am"), F.unix_micros(when).alias("t"), "name", F.unix_micros("beendet_am").alias("ended"),
    )
    out = rows.groupBy("fingerprint", "begonnen_am").transformWithState(Life(keep_seconds * MICROS), "fingerprint string, begonnen_am long, name string, beendet_am long, zuletzt_am long, zustand string", "Append", "EventTime")
    return _stamped(out, "begonnen_am", "beendet_am", "zuletzt_am")
