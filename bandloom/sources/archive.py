"""The raw archive: Parquet by day and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands, classify, grid, times

e = F.expr

# Days that raw spots and day tables are kept, and days more for those that wait for the fold.
RAW_DAYS, DAY_TABLE_DAYS, FOLD_GRACE_DAYS = 4, 35, 7


def raw_rows(spots: DataFrame) -> DataFrame:
    """Spots as the archive has them: day_index, the cleaned source, the sender's square (---- without one), band and calls in capitals."""
    return spots.withColumns({"day_index": e(times.day_index("t")), "source": e(bands.source_type("source")), "band": e(bands.normalize_band("band")), "source_grid4": e(f"coalesce({grid.square('trim(sl)')}, case when length(trim(sl)) >= 4 then upper(substr(trim(sl), 1, 4)) else '----' end)"), "sc": F.upper(F.trim("sc")), "rc": F.upper(F.trim("rc")), "sl": F.upper(F.trim("sl")), "rl": F.upper(F.trim("rl"))})


def write_raw(spots: DataFrame, path: str, mode: str = "append", by_time: bool = False) -> None:
    """One shuffle puts each day's rows of a source in a few files, sorted by time, so that scans prune by day and time.

    Spots that lie ``by_time`` already, each task with a range of it, are sorted where they are.
    """
    rows = raw_rows(spots)
    rows = rows if by_time else rows.repartition("day_index", "source", F.floor(F.col("t") / 3600) % 24)
    rows.sortWithinPartitions("day_index", "source", "t").write.mode(mode).partitionBy("day_index", "source").parquet(path)


def scan_raw(spark: SparkSession, path: str, t0: int, t1: int, ordered: bool = True) -> DataFrame:
    """Rows from t0 to t1, by time; partitions of other days and cluster relays are not read."""
    rows = spark.read.parquet(path).where(F.col("day_index").between(t0 // 86400, t1 // 86400) & F.col("t").between(t0, t1) & (F.col("source") != "dxcluster"))
    return rows.orderBy("t", "spot_id") if ordered else rows


def scan_raw_for_targets(spark: SparkSession, path: str, t0: int, t1: int, targets: list[str]) -> DataFrame:
    """Rows from t0 to t1 of which an end has one of the locators (as a prefix) or calls."""
    return for_targets(scan_raw(spark, path, t0, t1, ordered=False), targets)


def for_targets(rows: DataFrame, targets: list[str]) -> DataFrame:
    """Locators of 4, 6, 8 or 10 characters match as prefixes, everything else as a call.

    The filter is made of prefixes and equalities, which Parquet's readers evaluate.
    """
    found = F.lit(False)
    for x in (t.strip().upper() for t in targets):
        locator = classify.is_target_locator(x)
        found = found | (F.col("sl").startswith(x) | F.col("rl").startswith(x) if locator else (F.col("sc") == x) | (F.col("rc") == x))
    return rows.where(found)


def count_raw(spark: SparkSession, path: str, t0: int, t1: int) -> int:
    return scan_raw(spark, path, t0, t1, ordered=False).count()


def live_window(spots: DataFrame, now: int, minutes: int) -> DataFrame:
    """The last minutes' spots that can be placed."""
    return spots.where(F.col("t").between(now - minutes * 60, now)).where(e(bands.usable_live("source", "sl", "rl")))


def retained(table: DataFrame, today: int, days: int, day: str = "day_index", watermark: int | None = None) -> DataFrame:
    """The rows that are kept: ``days`` back from today; days after the fold's ``watermark`` for a week more."""
    keep = F.col(day) > today - days
    if watermark is not None:
        keep = keep | ((F.col(day) > watermark) & (F.col(day) > today - days - FOLD_GRACE_DAYS))
    return table.where(keep)


def apply_retention(spark: SparkSession, path: str, today: int, days: int = RAW_DAYS, enough_disk: bool = True) -> list[int]:
    """Drops the day partitions that have run out (a day sooner without disk); returns the days dropped.

    Only directory names are listed; whole partitions go, so nothing is rewritten.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system, gone = root.getFileSystem(conf), []
    for status in system.listStatus(root) if system.exists(root) else []:
        name = status.getPath().getName()
        if name.startswith("day_index=") and int(name.split("=")[1]) <= today - (days if enough_disk else days - 1):
            system.delete(status.getPath(), True)
            gone.append(int(name.split("=")[1]))
    return sorted(gone)


def wspr_archive(rows: DataFrame, ring: DataFrame) -> DataFrame:
    """(slot, day, band, rx4, tx4): counts and six SNR bins of beacon spots with an end in the ring (grid4)."""
    from ..functions.classify import ALMANAC_FLOORS

    r = rows.where("source = 'wspr'").select("band", "snr", e(grid.square("sl")).alias("rx4"), e(grid.square("rl")).alias("tx4"), e(times.slot_of_day("t")).alias("slot"), e(times.day_index("t")).alias("day")).where("rx4 is not null and tx4 is not null")
    g = ring.select("grid4").distinct()
    near = r.join(g.withColumnRenamed("grid4", "rx4").withColumn("a", F.lit(True)), "rx4", "left").join(g.withColumnRenamed("grid4", "tx4").withColumn("b", F.lit(True)), "tx4", "left").where("a or b")
    edges = [None, *ALMANAC_FLOORS, None]
    inside = lambda lo, hi: (F.lit(True) if lo is None else F.col("snr") >= lo) & (F.lit(True) if hi is None else F.col("snr") < hi)
    return near.groupBy("day", "slot", "band", "rx4", "tx4").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(inside(lo, hi)).alias(f"bin{k}") for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])


def wspr_archive_totals(rows: DataFrame) -> DataFrame:
    """(day, slot): beacon spots with four characters of locator at both ends."""
    return rows.where("source = 'wspr' and length(sl) >= 4 and length(rl) >= 4").groupBy(e(times.day_index("t")).alias("day"), e(times.slot_of_day("t")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
