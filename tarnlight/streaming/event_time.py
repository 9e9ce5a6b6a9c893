"""Event-time streams: the calendar policy and weekly counts under a watermark.

The policy must see a series' rows in the order of their dates, however they arrive.  A row waits in the state until the
watermark passes its date; then no earlier row can come any more, and it is decided.  So results are those of the batch policy,
whatever the batches.  What a series has sent is dropped once a candidate could not be kept from being sent by it.

Defined results: a row whose date the watermark has passed already (it comes later than the allowed ``delay`` behind the
newest row of all series) is late, and has no result; of rows that repeat a (key, date) the last one to come counts; a null candidate isn't one;
rows without a date are dropped.  The last rows of a stream are decided when newer ones move the watermark past them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnlight.functions.frames import DATE, KEY
from tarnlight.session import scratch_folder

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.date(1970, 1, 1).toordinal()
DAY_MS = 86_400_000


class CalendarPolicy(StatefulProcessor):
    """At most ``weekly_limit`` a calendar week, each more than ``cooldown_days`` after the last sent."""

    def __init__(self, cooldown_days: int, weekly_limit: int):
        self.cooldown_days, self.weekly_limit = cooldown_days, weekly_limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "day int, candidate boolean")
        self.sent = handle.getValueState("sent", "last int, week int, used int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        fresh = []
        for batch in rows:
            numbers = (pd.to_datetime(batch[DATE]) - pd.Timestamp(1970, 1, 1)).dt.days
            fresh += [(int(n), bool(w)) for n, w in zip(numbers, batch["candidate"].eq(True)) if n * DAY_MS > passed]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(fresh)[0] * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // DAY_MS
        waiting = dict(self.waiting.get()) if self.waiting.exists() else {}
        state = self.sent.get() if self.sent.exists() else None
        days, signals = sorted(n for n in waiting if n <= passed), []
        for number in days:
            state, signal = self._decide(state, number, waiting.pop(number))
            signals.append(signal)
        if days:
            self.waiting.put(list(waiting.items())) if waiting else self.waiting.clear()
        if state is not None and passed >= self._forgotten(state[0]):
            self.sent.clear()
        elif state is not None:
            self.sent.update(state)
            self.handle.registerTimer(self._forgotten(state[0]) * DAY_MS)
        if waiting:
            self.handle.registerTimer(min(waiting) * DAY_MS)
        if days:
            yield pd.DataFrame({KEY: key[0], DATE: [dt.date.fromordinal(n + EPOCH) for n in days], "policy_signal": signals})

    def _forgotten(self, last: int) -> int:
        """The day from which on what was sent on the day ``last`` matters no more."""
        return last + max(self.cooldown_days + 1, 7)

    def _decide(self, state: tuple | None, number: int, wanted: bool) -> tuple[tuple | None, bool]:
        last, week, used = state or (None, None, 0)
        monday = number - (number + 3) % 7  # the first day of the epoch was a Thursday
        used = used if monday == week else 0
        if not wanted or used >= self.weekly_limit or (last is not None and number - last <= self.cooldown_days):
            return state, False
        return (number, monday, used + 1), True

    def close(self) -> None:
        pass


def event_time_policy(candidates: DataFrame, cooldown_days: int = 3, weekly_limit: int = 2, delay_days: int = 7) -> DataFrame:
    """(currency, effective_date, policy_signal) of a streaming frame (currency, effective_date, candidate); see the module on late rows.

    State is kept by RocksDB: see :func:`run_available` for the setting.
    """
    timed = candidates.filter(F.col(DATE).isNotNull()).select(KEY, DATE, "candidate", F.col(DATE).cast("timestamp").alias("_at")).withWatermark("_at", f"{delay_days} days")
    kind = candidates.schema[KEY].dataType.simpleString()
    return timed.groupBy(KEY).transformWithStateInPandas(CalendarPolicy(cooldown_days, weekly_limit), f"{KEY} {kind}, {DATE} date, policy_signal boolean", "Append", "EventTime")


def weekly_sends(sends: DataFrame, signal: str, delay_days: int = 7) -> DataFrame:
    """(currency, week, pushes) of a streaming frame: rows that hold ``signal``, by week of event time, once the watermark has passed the week."""
    timed = sends.filter(F.col(DATE).isNotNull()).withColumn("_at", F.col(DATE).cast("timestamp")).withWatermark("_at", f"{delay_days} days")
    counts = timed.groupBy(KEY, F.window("_at", "7 days", "7 days", "4 days").alias("_w")).agg(F.count_if(F.coalesce(signal, F.lit(False))).alias("pushes"))
    return counts.select(KEY, F.col("_w.start").cast("date").alias("week"), "pushes")


def run_available(spark: SparkSession, stream: Callable[[], DataFrame], name: str, folder: str | None = None) -> DataFrame:
    """What a stream makes of all that is there now, as a table; ``folder`` keeps progress and results between runs, so a stopped stream goes on where it was."""
    folder = folder or scratch_folder(spark, name)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        made = stream()
        made.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    return spark.read.schema(made.schema).parquet(f"{folder}/rows")
