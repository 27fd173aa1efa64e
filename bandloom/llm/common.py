"""Helpers that several corpus operators share: shared folders, stored tables, byte access to Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a helper table of a few longs a row may be broadcast (some 10 MB); beyond, it is shuffled.
BROADCAST_ROWS = 200_000

#: Bytes of text that a task turns into numpy arrays at once; a longer text is taken alone.
SLICE_BYTES = 512 << 10

#: Bytes of an Arrow batch that Spark sends to Python; each task has a few of them, on both sides.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, one of this machine in local mode; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='bandloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/bandloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage, survives lost executors and tells the planner its size."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES, so that whole texts don't fill a task's memory 10,000 at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; a bare path is local."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each, or one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column in a row, and the n + 1 offsets of the texts; null is empty."""
    array = pc.fill_null(column.cast(pa.large_string()), "")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores until it clashes with none of ``taken`` (letter case ignored, as Spark does)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and hash of the text stand in ``gone`` (gone_id, gone_hash), columns unchanged.

    Texts don't pass through Python for it; ``gone`` is broadcast if it is small.
    """
    gone = stored(gone.select("gone_id", "gone_hash").distinct(), shared_folder(docs.sparkSession, "gone"))
    a, b = fresh("gone_id", docs.columns), fresh("gone_hash", docs.columns)
    few = gone.select(F.col("gone_id").alias(a), F.col("gone_hash").alias(b))
    few = F.broadcast(few) if gone.count() <= BROADCAST_ROWS else few
    return docs.join(few, docs[id_column].eqNullSafe(few[a]) & (F.xxhash64(docs[text_column]) == few[b]), "left_anti")
