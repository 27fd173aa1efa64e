"""Stored tables that queries share: tables of counts, as the jobs write them, and the archive where a query reads its files.

Spots aren't stored: they are made from ``events`` where they are read, of a window's events alone where a window is asked
for. A table is written once for each state of ``events`` and each Spark application, below ``spark.checkpoint.dir``, and
read again by every query.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baselines
from ..sources import archive
from .spots import SORT_EVENTS, SPREAD, locators, names, prepared, spots, spots_by_half_hour, timed_events

_written: dict[tuple[str, str], str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode one of this machine where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='bandloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of a table's place, application, and files with their sizes and times: another state gets other tables."""
    conf = spark._jsc.hadoopConfiguration()
    files = []
    for name in sorted(spark.read.parquet(path).inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = p.getFileSystem(conf).getFileStatus(p)
        files.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join([spark.sparkContext.applicationId, path, *files]).encode()).hexdigest()[:24]


class Tables:
    """The stored tables over one ``events``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.state = state_of(spark, f"{sf_dir}/events.parquet")

    def _stored(self, name: str, write: Callable[[str], None]) -> str:
        key = (self.state, name)
        if key not in _written or not self._there(_written[key]):
            folder = f"{shared_root(self.spark)}/bandloom/tables/{self.state}/{name}"
            write(folder)
            _written[key] = folder
        return _written[key]

    def _there(self, folder: str) -> bool:
        """Whether a written table still is: a shared folder may be cleared while an application lives."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def counts(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that ``build`` makes, written when it is first asked for."""
        return self.spark.read.parquet(self._stored(name, lambda folder: build().write.mode("overwrite").parquet(folder)))

    @property
    def archive_path(self) -> str:
        """The archive's files, by day and source and sorted by time."""
        return self._stored("raw", lambda folder: archive.write_raw(spots(self.spark, self.sf_dir, most=SORT_EVENTS), folder, "overwrite", by_time=True))

    @property
    def raw(self) -> DataFrame:
        """What the archive's files have."""
        return archive.raw_rows(spots(self.spark, self.sf_dir))

    @property
    def spots(self) -> DataFrame:
        return prepared(spots(self.spark, self.sf_dir), self.locators)

    def between(self, first: int, last: int) -> DataFrame:
        """The prepared spots from one second to another; only their events are made into spots."""
        return prepared(spots(self.spark, self.sf_dir, first, last))

    @property
    def locators(self) -> DataFrame:
        return self.counts("locators", lambda: locators(spots(self.spark, self.sf_dir)))

    @property
    def names(self) -> DataFrame:
        return self.counts("names", lambda: names(spots(self.spark, self.sf_dir)))

    @property
    def timed_baseline(self) -> DataFrame:
        return self.counts("global_baseline", lambda: baselines.timed_baseline(self.spots))

    @property
    def everywhere(self) -> DataFrame:
        return self.timed_baseline.select(*baselines.BASELINE_KEY, "count")

    @property
    def clusters(self) -> DataFrame:
        return self.counts("cluster_baseline", lambda: baselines.cluster_baseline(self.spots))

    @property
    def daily(self) -> DataFrame:
        return self.counts("region_daily", self.region_daily)

    def region_daily(self) -> DataFrame:
        """region_daily of all spots: its cells are of a half hour, whose events are in one task, so that they aren't shuffled."""
        first, *rest = [prepared(x, self.locators, "half") for x in spots_by_half_hour(self.spark, self.sf_dir)]
        out = baselines.region_daily(first, "half")
        return out.unionByName(baselines.region_daily(rest[0])) if rest else out

    @property
    def source_daily(self) -> DataFrame:
        return self.counts("source_daily", lambda: baselines.source_daily(self.spots))

    @property
    def wspr_daily(self) -> DataFrame:
        return self.counts("wspr_daily", lambda: baselines.wspr_daily(self.spots))

    @property
    def span(self) -> DataFrame:
        return baselines.span_of(self.timed_baseline)

    @property
    def now(self) -> int:
        """The time of the last spot, which is one of the last events'."""

        def build() -> DataFrame:
            last = timed_events(self.spark, self.sf_dir).agg(F.max("t0")).first()[0] or 0  # no event need be dealt for it
            return spots(self.spark, self.sf_dir, last - SPREAD, last + SPREAD).agg(F.max("t").alias("now"))

        return self.counts("now", build).first()["now"] or 0
