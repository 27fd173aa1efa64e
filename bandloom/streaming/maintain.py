"""Keeping the archive and the tables of counts up to date from streams of spots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import grid
from ..operators import baselines
from ..plans.spots import locators, prepared
from ..sources.archive import raw_rows

e = F.expr

# Seconds that a spot may be late or early to count for a region's day.
LATE, EARLY = 24 * 3600, 10 * 60


def is_timely() -> Column:
    """Whether a spot's time lies within a day before and ten minutes after its arrival."""
    return (F.col("t") >= F.col("arrival") - LATE) & (F.col("t") <= F.col("arrival") + EARLY)


def timely(spots: DataFrame) -> DataFrame:
    return spots.where(is_timely())


def untimely_counts(spots: DataFrame) -> DataFrame:
    """(day, late, early): what timely() drops, by day of arrival."""
    lag = F.col("arrival") - F.col("t")
    return spots.groupBy(F.floor(F.col("arrival") / 86400).cast("int").alias("day")).agg(F.count_if(lag > LATE).alias("late"), F.count_if(lag < -EARLY).alias("early"))


#: Tables that each batch adds to: their keys.
TABLES: dict[str, tuple[str, ...]] = {
    "global_baseline": ("band", "slot", "distance_tier", "snr_tier"),
    "cluster_baseline": ("cluster_anchor", "band", "slot", "distance_tier", "snr_tier"),
    "region_daily": ("target4", "band", "slot", "region", "day"),
    "wspr_daily": ("band", "slot", "region", "day"),
    "source_daily": ("band", "source", "slot", "region", "day"),
}


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch's spots and counts, in partitions of its own number: a batch that is run again replaces what it wrote.

    The batch is read once, to write its spots; these files are counted, so that nothing of it is held in memory.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = raw_rows(batch).withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day_index", "source").parquet(f"{path}/raw")
        spots = _written(rows, path, batch_id)
        if spots is None:
            return
        # A row a locator, and counts of which two tables are made each.
        known = locators(spots).withColumn("anchor", e(f"case when square is not null then {grid.cluster_anchor('square')} end")).persist()
        ready = prepared(spots.withColumn("timely", F.coalesce(is_timely(), F.lit(False))), known, "timely", clean=True)
        ends, sources = baselines.baseline_ends(ready).persist(), baselines.source_daily(ready).persist()
        counts = {
            "global_baseline": ends.where("cluster_anchor = ''").drop("cluster_anchor"), "cluster_baseline": ends.where("cluster_anchor <> ''"),
            "region_daily": baselines.region_daily(ready.where("timely")),
            "source_daily": sources, "wspr_daily": sources.where("source = 'wspr'").drop("source"),
        }
        try:
            for name, table in counts.items():
                table.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")
        finally:
            for table in (known, ends, sources):
                table.unpersist()

    return run


def _written(rows: DataFrame, path: str, batch_id: int) -> DataFrame | None:
    """A batch's spots as they were written; None if it had none."""
    spark, folder = rows.sparkSession, f"{path}/raw/batch={batch_id}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(rows.schema).option("basePath", f"{path}/raw").parquet(folder)


def maintain(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs write_batch() on a stream of spots (with spot_id)."""
    return stream.writeStream.foreachBatch(write_batch(path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _current(table: DataFrame) -> DataFrame:
    """A table's rows without the batches that a compaction has summed: batch -(u + 1) holds all up to u."""
    least = table.agg(F.min("batch")).first()[0]
    return table if least is None or least >= 0 else table.where((F.col("batch") == least) | (F.col("batch") >= -least))


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of counts over all batches."""
    table = _current(spark.read.parquet(f"{path}/{name}")).drop("batch")
    key = TABLES[name]
    return table.groupBy(*key).agg(*[F.sum(c).alias(c) for c in table.columns if c not in key])


def compact(spark: SparkSession, path: str, name: str, upto: int) -> None:
    """Sums the batches up to a number into one, so that the table keeps few partitions.

    The sum is moved in first, under a number that tells readers which batches it holds; these are deleted afterwards.
    A crash in between leaves batches that nobody reads, and so does a batch that is run again.
    """
    number = -(upto + 1)
    table = spark.read.parquet(f"{path}/{name}")
    least = table.agg(F.min("batch")).first()[0]
    if least is not None and least < number:
        raise ValueError("batches beyond that number are summed already")
    rows = _current(table).where(F.col("batch") <= upto).drop("batch")
    key = TABLES[name]
    summed = rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in key]).withColumn("batch", F.lit(number))
    summed.write.mode("overwrite").partitionBy("batch").parquet(f"{path}/{name}.compact")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    system = root.getFileSystem(conf)
    system.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.compact/batch={number}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/batch={number}"))
    for status in system.listStatus(root):
        folder = status.getPath()
        if folder.getName().startswith("batch=") and number < int(folder.getName().split("=")[1]) <= upto:
            system.delete(folder, True)
