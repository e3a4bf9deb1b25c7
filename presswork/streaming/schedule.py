"""State of sites over time: when their runs start, and when a weak run makes a new profile.

Both are folds in which each step depends on the one before, so a site's state is kept by Spark's state store, in a value for
each site, whether rows come in a stream or from a table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Generator, Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from presswork.functions import dates
from presswork.operators.quality import COOLDOWN_HOURS

DEFAULT_SCHEDULE = "*/15 * * * *"
#: The state store that keeps timers and several values of a key.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1)


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, set up for state with timers. Spark begins to coordinate its state stores when its streams are first asked for."""
    _ = spark.streams.active
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def _ms(moment: datetime) -> int:
    return round((moment - EPOCH).total_seconds() * 1000)


def _moment(ms: int) -> datetime:
    return EPOCH + timedelta(milliseconds=ms)


def jitter(site: object, base: datetime, spread: int) -> int:
    """Seconds after a scheduled minute, 0 to `spread`, by a hash of the site and the minute: sites are spread, and a tick that is tried again is the same."""
    return int(hashlib.md5(f"{site}@{_ms(base) // 1000}".encode()).hexdigest()[:8], 16) % (spread + 1)


def next_tick(site: object, schedule: str, after: datetime, spread: int) -> datetime:
    base = dates.next_run(schedule, after)
    return base + timedelta(seconds=jitter(site, base, spread))


class Ticks(StatefulProcessor):
    """A site's ticks: a tick starts a run unless one is in flight, in which case it is dropped; then the next tick is set.

    State: the next tick, when the last run began, and what is known of runs that have ended. How long a run took is told by a
    report with the run's number. While the run in flight has no report yet, ticks wait for it: by then it is known which
    of them fell into the run. Only reports that come before their run's turn are kept. Timers go by the clock; ticks that are
    due when rows come are done at once. Each question to the store costs a message, so it isn't asked what a new site can't have.
    """

    def __init__(self, spread: int):
        self.spread = spread

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "schedule string, tick long, began long, runs long, dropped long")
        self.reports = handle.getMapState("reports", "no long", "seconds long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        site, now = key[0], timerValues.getCurrentProcessingTimeInMs()
        state = self.state.get() if self.state.exists() else None
        new, self.kept = state is None, state is not None
        for row in rows:
            if state is None:
                schedule = row.schedule if row.schedule and dates.is_cron(row.schedule) else DEFAULT_SCHEDULE
                state = (schedule, _ms(next_tick(site, schedule, row.since, self.spread)), None, 0, 0)
                state = yield from self._go_on(site, state, now)
            if row.no is None or row.no < state[3]:
                continue
            if row.no == state[3]:
                state = yield from self._go_on(site, state, now, max(0, row.seconds or 0))
            else:
                self._keep_report(row.no, max(0, row.seconds or 0))
        self._keep(state, now, new)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, self.kept = timerValues.getCurrentProcessingTimeInMs(), True
        state = yield from self._go_on(key[0], self.state.get(), now)
        self._keep(state, now)

    def _keep_report(self, run: int, seconds: int) -> None:
        self.kept = True
        self.reports.updateValue((run,), (seconds,))

    def _report(self, run: int) -> int | None:
        if not self.kept or not self.reports.exists() or not self.reports.containsKey((run,)):
            return None
        seconds = self.reports.getValue((run,))[0]
        self.reports.removeKey((run,))
        return seconds

    def _go_on(self, site: object, state: tuple, now: int, seconds: int | None = None) -> Generator[Row, None, tuple]:
        """Gives the runs that start up to now, and returns the state then. `seconds`: how long the run in flight took, if a row tells it."""
        schedule, tick, began, runs, dropped = state
        while tick <= now:
            if began is not None:
                seconds = self._report(runs) if seconds is None else seconds
                if seconds is None:
                    break
                if began + 1000 * seconds > tick:
                    dropped += 1
                    tick = _ms(next_tick(site, schedule, _moment(tick), self.spread))
                    continue
            runs += 1
            yield Row(site=site, run=runs, at=_moment(tick), dropped=dropped)
            began, dropped, seconds = tick, 0, None
            tick = _ms(next_tick(site, schedule, _moment(tick), self.spread))
        else:
            if seconds is not None:
                self._keep_report(runs, seconds)
        return schedule, tick, began, runs, dropped

    def _keep(self, state: tuple, now: int, new: bool = False) -> None:
        self.state.update(state)
        for timer in () if new else list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[1] > now:
            self.handle.registerTimer(state[1])

    def close(self) -> None:
        pass


def run_starts(reports: DataFrame, spread: int = 600) -> DataFrame:
    """(site, run, at, dropped): when each site's runs start, and how many ticks before that fell into the run before it.

    reports: site, schedule (a cron expression; one that can't be read is the default), since (a timestamp from which ticks count), and no
    and seconds of a run that has ended, or nulls for a site that is only made known. A stream or a table; a row without a site is left out.
    """
    kind = reports.schema["site"].dataType.simpleString()
    known = reports.where("site IS NOT NULL AND since IS NOT NULL").select("site", "schedule", F.col("since").cast("timestamp_ntz").alias("since"), F.col("no").cast("long").alias("no"), F.col("seconds").cast("long").alias("seconds"))
    if not known.isStreaming:
        known = known.repartition("site").sortWithinPartitions("site", "no")
    out = known.groupBy("site").transformWithState(Ticks(spread), f"site {kind}, run long, at timestamp_ntz, dropped long", "append", "processingTime")
    return out.withColumn("at", F.col("at").cast("timestamp"))


class Reprofiles(StatefulProcessor):
    """A site's weak runs that start a new profile: none within the cooldown after another that did. State: the last one that did."""

    def __init__(self, ordered: bool):
        self.ordered = ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp_ntz")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        moments = (row.at for row in rows)
        for at in moments if self.ordered else sorted(moments):
            if last is None or at - last > timedelta(hours=COOLDOWN_HOURS):
                last = at
                yield Row(site=key[0], at=at)
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def reprofile_times(runs: DataFrame) -> DataFrame:
    """(site, at) of the weak runs that start a new profile. runs: site, at, weak. Rows without a site or a time are left out.

    Of a table, Spark sorts each site's runs, so a site is read once and held nowhere. Of a stream, a batch's runs are sorted by site,
    and batches have to come in the order of time; a run that comes late counts as within the cooldown.
    """
    kind = runs.schema["site"].dataType.simpleString()
    weak = runs.where("weak AND site IS NOT NULL AND at IS NOT NULL").select("site", F.col("at").cast("timestamp_ntz").alias("at"))
    if not weak.isStreaming:
        weak = weak.repartition("site").sortWithinPartitions("site", "at")
    out = weak.groupBy("site").transformWithState(Reprofiles(not weak.isStreaming), f"site {kind}, at timestamp_ntz", "append", "none")
    return out.withColumn("at", F.col("at").cast("timestamp"))
