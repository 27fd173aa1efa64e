"""Operators whose state ends by the clock of the data: a feed's lag, and counts of the last hour.

Both use timers of event time and states kept by Spark (RocksDB on executors' disks, checkpoints in the shared folder), so
that state follows keys, survives lost executors and ends when the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .live import LAG_BUCKET, LAG_BUCKETS, LAG_SAMPLES, LAG_SHARE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Minutes that live spots are kept, and seconds that they may be out of order.
RETENTION_MINUTES, ORDER_SLACK = 60, 300


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and maps need this state store; the setting holds for streams started afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


# The lag of a feed -----------------------------------------------------------------------------------------------------


def _partial_ages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A batch's arrivals in a task as counts by minute and age; ticks (without t) as a count of none."""
    for rows in parts:
        rows = rows[(rows["arrival"] > 0) & ~(rows["t"] <= 0)]
        age = (rows["arrival"] - rows["t"]).clip(lower=0) // LAG_BUCKET
        rows = rows.assign(minute=rows["arrival"] // 60, bucket=age.clip(upper=LAG_BUCKETS - 1).fillna(-1).astype("int32"))
        rows = rows.groupby(["feed", "minute", "bucket"], as_index=False).agg(n=("arrival", "size"), last=("arrival", "max"))
        rows.loc[rows["bucket"] < 0, "n"] = 0
        yield rows[["feed", "minute", "bucket", "n", "last"]]


class _Lag(StatefulProcessor):
    """Of each minute that isn't closed yet, and of the last closed one of either parity: its counts by age."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute long", "last long, n long, ages array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            for minute, own in part.groupby("minute"):
                at = (int(minute),)
                last, n, ages = self.minutes.getValue(at) if self.minutes.containsKey(at) else (0, 0, [0] * LAG_BUCKETS)
                ages = list(ages)
                for bucket, count in zip(own["bucket"], own["n"], strict=True):
                    if bucket >= 0:
                        ages[int(bucket)] += int(count)
                arrived = own[own["bucket"] >= 0]
                last = max([int(last), *map(int, arrived["last"])])
                self.minutes.updateValue(at, (last, int(n) + int(arrived["n"].sum()), ages))
                self.handle.registerTimer((int(minute) + 1) * 60_000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        minute = expiredTimerInfo.getExpiryTimeInMs() // 60_000 - 1
        known = {k[0]: v for k, v in self.minutes.iterator() if k[0] <= minute and v[1] > 0}
        # Of minutes with arrivals, the last one of each parity is remembered.
        slots = {m % 2: m for m in sorted(known)}
        near = [known[m] for m in slots.values() if m in (minute, minute - 1)]
        total, now = sum(int(v[1]) for v in near), minute * 60 + 59
        lag, fresh = 0, total >= LAG_SAMPLES
        if fresh:
            lag = _young_edge([sum(x) for x in zip(*(v[2] for v in near), strict=True)], total)
        else:
            stale = [m for m in slots.values() if m < minute - 1 and known[m][1] >= LAG_SAMPLES]
            if stale:
                last, n, ages = known[max(stale)]
                head = int(last) - _young_edge(list(ages), int(n))
                lag = now - head if 0 < head <= now else 0
        for m, in [k for k, _ in self.minutes.iterator()]:
            if m <= minute and m not in slots.values():
                self.minutes.removeKey((m,))
        yield pd.DataFrame({"feed": [key[0]], "now": [now], "lag": [int(lag)], "fresh": [fresh]})

    def close(self) -> None:
        pass


def _young_edge(ages: list[int], n: int) -> int:
    """The age that a tenth of the arrivals stay below, as the lower bound of its bucket."""
    want, upto = max(1, int(n * LAG_SHARE + 0.5)), 0
    for bucket, count in enumerate(ages):
        upto += int(count)
        if upto >= want:
            return bucket * LAG_BUCKET
    return 0


def feed_lag_stream(arrivals: DataFrame, slack: str = "60 seconds") -> DataFrame:
    """A stream of (feed, now, lag, fresh), a row for each minute in which anything came once it is over, from arrivals (feed, t, arrival).

    The rules are feed_lag()'s. A row without t is a tick of the clock: it counts for nothing and lets minutes end, so that
    a feed that stalls is told of. Arrivals are counted by age where they are read; a feed's state is what these counts
    are of the minutes that the watermark hasn't passed and of two more.
    """
    use_rocksdb(arrivals.sparkSession)
    counts = arrivals.select("feed", "t", "arrival").mapInPandas(_partial_ages, "feed string, minute long, bucket int, n long, last long")
    timed = counts.withColumn("event_time", F.timestamp_seconds("last")).withWatermark("event_time", slack)
    return timed.groupBy("feed").transformWithStateInPandas(_Lag(), "feed string, now long, lag long, fresh boolean", "append", "eventTime")


# Counts of the last hour -----------------------------------------------------------------------------------------------


def _partial_minutes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in parts:
        rows = rows.assign(minute=rows["t"] // 60)
        yield rows.groupby(["square", "band", "minute"], as_index=False).agg(n=("t", "size"), newest=("t", "max"))[["square", "band", "minute", "n", "newest"]]


class _LastHour(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute long", "n long, newest long")

    def _total(self, key: tuple) -> pd.DataFrame:
        held = [v for _, v in self.minutes.iterator()]
        return pd.DataFrame({"square": [key[0]], "band": [key[1]], "n": [sum(int(v[0]) for v in held)], "newest": [max((int(v[1]) for v in held), default=0)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            part = part[part["newest"] * 1000 >= watermark]
            for minute, n, newest in zip(part["minute"], part["n"], part["newest"], strict=True):
                at = (int(minute),)
                before = self.minutes.getValue(at) if self.minutes.containsKey(at) else (0, 0)
                self.minutes.updateValue(at, (int(before[0]) + int(n), max(int(before[1]), int(newest))))
                self.handle.registerTimer((int(minute) + 1 + RETENTION_MINUTES) * 60_000)
        yield self._total(key)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        minute = expiredTimerInfo.getExpiryTimeInMs() // 60_000 - 1 - RETENTION_MINUTES
        if self.minutes.containsKey((minute,)):
            self.minutes.removeKey((minute,))
        yield self._total(key)

    def close(self) -> None:
        pass


def recent_spots(spots: DataFrame, now: int) -> DataFrame:
    """(square, band, n, newest): placed ends of the last hour's spots at a second of the data's clock; the batch form of the stream.

    Minutes are kept whole: the oldest is the one that reaches into the hour.
    """
    ends = spot_ends(spots).where((F.floor(F.col("t") / 60) + 1 + RETENTION_MINUTES) * 60 > now)
    return ends.where(F.col("t") <= now + ORDER_SLACK).groupBy("square", "band").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("newest"))


def spot_ends(spots: DataFrame) -> DataFrame:
    """A row for each end of a prepared spot that has a square, one if both lie in the same."""
    return spots.where("band <> ''").select("t", "band", F.explode(F.array_distinct(F.array_compact(F.array("s4", "r4")))).alias("square"))


def recent_spots_stream(spots: DataFrame) -> DataFrame:
    """Updates of recent_spots() from a stream of prepared spots: a square and band's counts whenever they change, down to 0.

    Spots may be 300 seconds out of order; later ones are dropped (of those of one minute that come together, the newest
    tells). State is a number a minute of the last hour, for squares
    and bands that had a spot in it: a minute goes when the watermark (300 seconds behind the newest spot) is an hour past it.
    """
    use_rocksdb(spots.sparkSession)
    ends = spot_ends(spots).select("square", "band", "t").mapInPandas(_partial_minutes, "square string, band string, minute long, n long, newest long")
    timed = ends.withColumn("event_time", F.timestamp_seconds("newest")).withWatermark("event_time", f"{ORDER_SLACK} seconds")
    return timed.groupBy("square", "band").transformWithStateInPandas(_LastHour(), "square string, band string, n long, newest long", "update", "eventTime")
