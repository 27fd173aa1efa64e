"""Incremental and backfill jobs over a store of tables.

A job replaces the partitions that it touches, of all its tables, in one commit: a rerun gives the same, and a job that
dies leaves everything as it was. The store's tables are season and activity (the seasonal record), ingest, lost (days),
region_daily and cluster_baseline; its marks are watermark (the last folded day), snr_start and first_observed.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands, geo, grid, times
from ..operators import baselines
from .snapshots import Change, Store, days_covered

e = F.expr


# Days that one run folds at most, and seconds after a day's end that a flush must have followed.
MOST_FOLD_DAYS, FLUSH_LAG = 64, 3600


def final_days(daily: DataFrame, watermark: int | None, today: int, most: int = MOST_FOLD_DAYS, flushed_at: int | None = None, pending_day: int | None = None) -> tuple[int, int] | None:
    """First and last day to fold: after the watermark (else the oldest day there is), up to two days back, at most ``most``.

    A day is final once the tables were flushed (``flushed_at``, null: they are) more than an hour after its end, and no
    counts of it or an earlier day are pending (``pending_day``, the earliest of them).
    """
    first = watermark + 1 if watermark is not None else daily.agg(F.min("day")).first()[0]
    if first is None:
        return None
    last = min(today - 2, first + most - 1)
    if flushed_at is not None:
        last = min(last, (flushed_at - FLUSH_LAG - 1) // 86400 - 1)
    if pending_day is not None:
        last = min(last, pending_day - 1)
    return (first, last) if first <= last else None


def seed_ingest(ingest: DataFrame, daily: DataFrame, first: int, last: int) -> DataFrame:
    """``ingest`` (day, slot, layer, spot_total) with the folded days' sums of the daily table where these are larger or it has none."""
    sums = baselines.ingest_slot_totals(daily.where(F.col("day").between(first, last))).select("day", "slot", F.lit("pskr").alias("layer"), "spot_total")
    return ingest.select(sums.columns).unionByName(sums).groupBy("day", "slot", "layer").agg(F.max("spot_total").alias("spot_total"))


def lost_days(spark: SparkSession, days: list[int], reason: str, recorded_at: int) -> DataFrame:
    return spark.createDataFrame([(d, reason, recorded_at) for d in days], "day_index int, reason string, recorded_at long")


# Jobs that commit ------------------------------------------------------------------------------------------------------

EPOCH = datetime.date(1970, 1, 1)
SEASON_BY, ACTIVITY_BY, INGEST_BY = ("layer", "year_month", "dom"), ("layer", "year_month"), ("layer", "day")


def day_of(part: dict[str, str]) -> int:
    """The day index of a partition of the seasonal record."""
    ym = int(part["year_month"])
    return (datetime.date(ym // 100, ym % 100, int(part["dom"])) - EPOCH).days


def month_of(day: int) -> int:
    date = EPOCH + datetime.timedelta(days=day)
    return date.year * 100 + date.month


def merged_activity(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Both tables' activity bits."""
    if old is None:
        return new
    key = ["grid4", "band", "year_month", "layer"]
    return old.select(*key, "day_mask").unionByName(new.select(*key, "day_mask")).groupBy(*key).agg(F.expr("bit_or(day_mask)").alias("day_mask"))


def _put_season(change: Change, season: DataFrame, layer: str, first: int, last: int) -> None:
    """The layer's days from first to last in the seasonal record are what ``season`` has of them, which may be nothing; their activity bits are added."""
    change.replace("season", season, SEASON_BY, days_covered(first, last, day_of, layer=layer))
    months = {month_of(d) for d in range(first, last + 1)}
    touched = lambda part: part["layer"] == layer and int(part["year_month"]) in months
    new = baselines.area_activity(change.read("season", days_covered(first, last, day_of, layer=layer)))
    change.replace("activity", merged_activity(change.read("activity", touched), new), ACTIVITY_BY, touched)


def _put_ingest(change: Change, sums: DataFrame, layer: str, first: int, last: int, raise_only: bool) -> None:
    """The layer's ingest of the days from first to last: ``sums`` (day, slot, spot_total), or the larger of both with ``raise_only``."""
    covers = lambda part: part["layer"] == layer and first <= int(part["day"]) <= last
    rows = sums.where(F.col("day").between(first, last)).select("day", "slot", F.lit(layer).alias("layer"), F.col("spot_total").cast("long").alias("spot_total"))
    old = change.read("ingest", covers) if raise_only else None
    if old is not None:
        rows = old.select(rows.columns).unionByName(rows).groupBy("day", "slot", "layer").agg(F.max("spot_total").alias("spot_total"))
    change.replace("ingest", rows, INGEST_BY, covers)


def _fold(change: Change, daily: DataFrame, first: int, last: int) -> None:
    days = daily.where(F.col("day").between(first, last))
    _put_season(change, baselines.season_counts(days), "pskr", first, last)
    _put_ingest(change, baselines.ingest_slot_totals(days), "pskr", first, last, raise_only=True)


def fold_run(store: Store, daily: DataFrame, today: int, forced_to: int | None = None, flushed_at: int | None = None, pending_day: int | None = None, recorded_at: int = 0, most: int = MOST_FOLD_DAYS) -> list[int]:
    """Folds all final days after the watermark into season, activity and ingest and moves the watermark, which never goes back.

    Days that a forced advance skips are written to lost, and returned. All of it is one commit; without anything to do
    there is none.
    """
    change = store.begin()
    mark = change.marks.get("watermark")
    span = final_days(daily, mark, today, most, flushed_at, pending_day)
    if span is not None:
        _fold(change, daily, *span)
        mark = span[1]
    lost: list[int] = []
    if forced_to is not None and mark is not None and forced_to > mark:
        lost = list(range(mark + 1, forced_to + 1))
        change.append("lost", lost_days(store.spark, lost, "forced", recorded_at))
        mark = forced_to
    if span is not None or lost:
        change.marks["watermark"] = mark
        change.commit()
    return lost


def refold_days(store: Store, daily: DataFrame, first: int, last: int) -> None:
    """Folds days again, whatever stood there; days after the watermark are left to the fold."""
    change = store.begin()
    last = min(last, change.marks.get("watermark", first - 1))
    if first <= last:
        _fold(change, daily, first, last)
        change.commit()


def add_part_day_run(store: Store, daily: DataFrame, day: int, layer: str = "pskr") -> None:
    """Adds the counts of a part of one day to the seasonal record and its activity."""
    change = store.begin()
    covers = days_covered(day, day, day_of, layer=layer)
    part = baselines.season_counts(daily.where(F.col("day") == day), layer)
    old = change.read("season", covers)
    _put_season(change, part if old is None else add_part_day(old, part), layer, day, day)
    change.commit()


def wspr_backfill_run(store: Store, archive: DataFrame, totals: DataFrame, ring: DataFrame, year_month: int) -> None:
    """The beacon archive's month takes the place of the seasonal record's, with its activity and ingest."""
    first = (datetime.date(year_month // 100, year_month % 100, 1) - EPOCH).days
    last = (datetime.date(year_month // 100 + year_month % 100 // 12, year_month % 100 % 12 + 1, 1) - EPOCH).days - 1
    season, _, ingest = wspr_backfill_month(archive, totals, ring, year_month)
    change = store.begin()
    change.replace("season", season, SEASON_BY, days_covered(first, last, day_of, layer="wspr"))
    month = lambda part: part["layer"] == "wspr" and int(part["year_month"]) == year_month
    change.replace("activity", baselines.area_activity(change.read("season", month)), ACTIVITY_BY, month)
    _put_ingest(change, ingest, "wspr", first, last, raise_only=False)
    change.commit()


def snr_backfill_run(store: Store, raw: DataFrame, snr_start: int, part_day: bool = False) -> None:
    """Recounts the SNR counters of region_daily, and folds the days that it touched again.

    The complete days right before ``snr_start`` are set; with ``part_day``, the raw spots of ``snr_start`` itself, from
    before counting began, are added.
    """
    change = store.begin()
    daily = change.read("region_daily")
    if daily is None:
        raise ValueError("there is no region_daily to fill")
    again = snr_backfill(daily, raw.where(F.col("day") < snr_start), snr_start)
    if part_day:
        again = snr_add(again, raw.where(F.col("day") == snr_start), snr_start)
    first, last = raw.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return
    covers = lambda part: first <= int(part["day"]) <= last
    change.replace("region_daily", again.where(F.col("day").between(first, last)).select(daily.columns), ("day",), covers)
    mark = change.marks.get("watermark")
    if mark is not None and first <= mark:
        _fold(change, change.read("region_daily", covers), first, min(last, mark))
    change.marks["snr_start"] = min(first, change.marks.get("snr_start", first))
    change.commit()


def snr_add(daily: DataFrame, raw: DataFrame, day: int) -> DataFrame:
    """region_daily with the SNR counters of a part of one day's raw spots added, each counter at most the row's spot_count."""
    counters = ["snr_spots", *[baselines.floor_name(f) for f in baselines.FLOORS]]
    key = ["target4", "band", "slot", "region", "day"]
    new = baselines.region_daily(raw.where((F.col("source") == "mqtt") & (F.col("day") == day))).select(*key, *[F.col(c).alias(f"new_{c}") for c in counters])
    sums = [F.least(F.col(c) + F.coalesce(f"new_{c}", F.lit(0)), "spot_count").alias(c) for c in counters]
    return daily.join(new, key, "left").select(*key, "spot_count", *sums)


def _by_days(store: Store, staging: str, raw: DataFrame, build, days_each: int) -> list[int]:
    """Builds a table for some days at a time, each time in a commit of its own, leaving out the days that are there; returns all days."""
    first, last = raw.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return []
    days = list(range(first, last + 1))
    done = set(store.manifest()["marks"].get(staging, []))
    todo = [d for d in days if d not in done]
    for k in range(0, len(todo), days_each):
        some = todo[k : k + days_each]
        change = store.begin()
        rows = build(raw.where(F.col("day").between(some[0], some[-1]) & F.col("day").isin(some)))
        change.replace(staging, rows, ("day",), lambda part, some=some: int(part["day"]) in some, folder=staging.removesuffix(".next"))
        change.marks[staging] = sorted({*change.marks.get(staging, []), *some})
        change.commit()
    return days


def rebuild_region_daily_run(store: Store, raw: DataFrame, days_each: int = 7) -> None:
    """region_daily anew from prepared raw spots, whatever their age.

    Days are counted beside the table that readers see, and remembered: a rebuild that broke off goes on where it was. The
    new table takes the old one's place in one commit.
    """
    staging = "region_daily.next"
    if _by_days(store, staging, raw, rebuild_region_daily, days_each):
        change = store.begin()
        change.rename(staging, "region_daily")
        change.marks.pop(staging)
        change.commit()


def rebuild_cluster_baseline_run(store: Store, raw: DataFrame, days_each: int = 7) -> None:
    """cluster_baseline anew from prepared raw spots, and the mark of the first one; by days as above, then summed."""
    staging = "cluster_baseline_days.next"

    def build(rows: DataFrame) -> DataFrame:
        return baselines.cluster_baseline_daily(rows.where("source = 'mqtt'"))

    if _by_days(store, staging, raw, build, days_each):
        change = store.begin()
        days = change.read(staging)
        key = [c for c in days.columns if c not in ("day", "count", "first_t")]
        change.replace("cluster_baseline", days.groupBy(*key).agg(F.sum("count").alias("count")))
        change.marks["first_observed"] = days.agg(F.min("first_t")).first()[0]
        change.drop(staging)
        change.marks.pop(staging)
        change.commit()


# What the jobs compute -------------------------------------------------------------------------------------------------


def rebuild_region_daily(raw: DataFrame) -> DataFrame:
    """region_daily from prepared raw spots, whatever their age."""
    return baselines.region_daily(raw.where("source = 'mqtt'"))


def backfill_source_daily(raw: DataFrame, present: DataFrame) -> DataFrame:
    """The per-source table with raw spots' counts for keys that it lacks; counts that it has stay."""
    key = ["band", "source", "slot", "region", "day"]
    new = baselines.source_daily(raw).select(*key, "spot_count").join(present.select(key), key, "left_anti")
    return present.select(*key, "spot_count").unionByName(new)


def snr_backfill(daily: DataFrame, raw: DataFrame, snr_start: int) -> DataFrame:
    """region_daily with SNR counters recounted from raw spots for the complete days right before ``snr_start``.

    Only days in one run up to the start count, each counter at most the row's spot_count; other rows stay.
    """
    counters = ["snr_spots", *[baselines.floor_name(f) for f in baselines.FLOORS]]
    key = ["target4", "band", "slot", "region", "day"]
    digital = raw.where((F.col("source") == "mqtt") & (F.col("day") < snr_start))
    there = {r["day"] for r in baselines.region_ends(digital).select("day").distinct().collect()}  # one number a day
    fit = []
    while snr_start - 1 - len(fit) in there:
        fit.append(snr_start - 1 - len(fit))
    inside = F.col("day").isin(fit)
    new = baselines.region_daily(digital.where(inside)).select(*key, *[F.col(c).alias(f"new_{c}") for c in counters])
    # Only the days that are recounted meet in a join.
    merged = daily.where(inside).join(new, key, "left")
    merged = merged.select(*key, "spot_count", *[F.when(F.col(f"new_{c}").isNotNull(), F.least(f"new_{c}", "spot_count")).otherwise(F.col(c)).alias(c) for c in counters])
    return merged.unionByName(daily.where(~F.coalesce(inside, F.lit(False))).select(merged.columns))


def add_part_day(season: DataFrame, part: DataFrame) -> DataFrame:
    """A seasonal table with the counts of a day's part that it lacks added, each cell and SNR bin to 255 at most."""
    key = ["grid4", "band", "region", "year_month", "layer", "dom", "slot"]
    both = season.select(*key, "count", "snr_bins").unionByName(part.select(*key, "count", "snr_bins"))
    sums = both.groupBy(*key).agg(F.sum("count").alias("count"), *[F.sum(F.col("snr_bins")[k]).alias(f"bin{k}") for k in range(6)])
    return sums.select(*key, e("cast(least(count, 255) as int)").alias("count"), F.array(*[e(f"cast(least(bin{k}, 255) as int)") for k in range(6)]).alias("snr_bins"))


def refold_month(season: DataFrame, month: DataFrame, year_month: int, layer: str) -> DataFrame:
    """A seasonal table in which a layer's month is what ``month`` has, whatever stood there."""
    old = season.where(~((F.col("year_month") == year_month) & (F.col("layer") == layer)))
    return old.unionByName(month.where((F.col("year_month") == year_month) & (F.col("layer") == layer)).select(old.columns))


def wspr_backfill_month(archive: DataFrame, totals: DataFrame, ring: DataFrame, year_month: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seasonal rows, activity and ingest of one month from the beacon archive (wspr_archive and its totals).

    Each pair counts for both ends in the ring, by the region of the other end; ingest counts each spot twice.
    """
    month = archive.withColumn("ym", e(times.year_month("day"))).where(F.col("ym") == year_month)
    # Each square's region is found once, and joined.
    squares = month.select(F.explode(F.array("rx4", "tx4")).alias("other4")).distinct()
    placed = squares.select("other4", F.inline(F.array(F.struct(e(grid.latitude("other4")).alias("lat"), e(grid.longitude("other4")).alias("lon")))))
    regions = placed.select("other4", F.inline(F.array(F.struct(e(geo.region_of("lat", "lon")).alias("region")))))
    sides = [month.select(F.col(a).alias("grid4"), F.col(b).alias("other4"), "band", "day", "slot", "n", *[f"bin{k}" for k in range(6)]) for a, b in (("rx4", "tx4"), ("tx4", "rx4"))]
    both = sides[0].unionByName(sides[1]).join(regions, "other4").join(ring.select("grid4").distinct(), "grid4", "left_semi").where(f"region <> '??' and band in ({bands.listed(bands.ALMANAC_BANDS)})")
    sums = both.groupBy("grid4", "band", "region", "day", "slot").agg(F.sum("n").alias("n"), *[F.sum(f"bin{k}").alias(f"bin{k}") for k in range(6)])
    season = sums.select("grid4", "band", "region", F.lit(year_month).alias("year_month"), F.lit("wspr").alias("layer"), e(times.day_of_month("day")).alias("dom"), "slot", e("cast(least(n, 255) as int)").alias("count"), F.array(*[e(f"cast(least(bin{k}, 255) as int)") for k in range(6)]).alias("snr_bins"))
    ingest = totals.where(e(times.year_month("day")) == year_month).select("day", "slot", F.lit("wspr").alias("layer"), (F.col("n") * 2).alias("spot_total"))
    return season, baselines.area_activity(season), ingest


def ingest_report(seen: DataFrame, parsed: DataFrame, kept: DataFrame) -> DataFrame:
    """(source, seen, parsed, duplicate, kept, live_usable, no_locator) of one batch: rows before parsing (source), spots, and spots after dedup."""
    usable = bands.usable_live("source", "sl", "rl")
    a = seen.groupBy("source").agg(F.count(F.lit(1)).alias("seen"))
    b = parsed.groupBy("source").agg(F.count(F.lit(1)).alias("parsed"))
    c = kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.count_if(e(usable)).alias("live_usable"), F.count_if(~e(usable)).alias("no_locator"))
    out = a.join(b, "source", "left").join(c, "source", "left").na.fill(0)
    return out.withColumn("duplicate", F.col("parsed") - F.col("kept"))
