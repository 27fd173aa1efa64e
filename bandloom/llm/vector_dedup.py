"""Embedding near-duplicates through a pivot-permutation index, links verified by cosine in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, shared_folder, stored
from .graph import components

#: Nearest pivots that describe a vector, and how many two vectors must share to be compared.
NEAREST, SHARED = 8, 2

#: Pivots for n vectors: PIVOTS_BY_ROOT * sqrt(n), but no fewer than LEAST_PIVOTS, nor more than fill PIVOT_BYTES, which
#: each task holds; they are picked from a sample of at most SAMPLE_BY_PIVOT times as many vectors.
PIVOTS_BY_ROOT, LEAST_PIVOTS, PIVOT_BYTES, SAMPLE_BY_PIVOT = 2.0, 16, 32 << 20, 4

#: Pivots are no nearer to each other than this cosine, so that a dense group has one of them and not many alike.
APART = 0.85

#: Vectors of one block of an inverted list, and blocks beyond which a list is dealt to lists of two pivots.
BLOCK, LONG_BLOCKS = 1024, 4


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim and the vector as bytes of doubles; null for vectors that link with nothing."""
    for batch in batches:
        out = []
        for x in batch.column("embedding").to_pylist():
            v = np.array(x, np.float64) if x and None not in x else None
            out.append(v.tobytes() if v is not None and np.isfinite(v).all() and np.isfinite(n := np.sqrt(v @ v)) and n > 0 else None)
        dims = pa.array([len(x) // 8 if x else None for x in out], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), dims, pa.array(out, pa.binary())], ["vec_id", "dim", "vector"])


def _matrix(vectors: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    # Scaling by the largest component first keeps the squares of very small and very large ones in range.
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def pick_pivots(sample: list[bytes], count: int, apart: float = APART) -> np.ndarray:
    """Up to ``count`` unit vectors of a sample, none nearer to another than ``apart``."""
    m = _matrix(sample)
    taken = np.zeros_like(m[:count])
    n = 0
    for v in m:
        if n < len(taken) and (n == 0 or (taken[:n] @ v).max() < apart):
            taken[n] = v
            n += 1
    return taken[:n]


def permutation(m: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row of unit vectors, nearest first; ties by number."""
    near = m @ pivots.T
    k = min(nearest, len(pivots))
    return np.argsort(-near, axis=1, kind="stable")[:, :k].astype(np.int32)


def _describe(shared, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                dims = batch.column("dim").to_numpy()
                vectors = batch.column("vector").to_pylist()
                lists: list = [None] * len(dims)
                for dim in set(dims.tolist()):
                    rows = np.flatnonzero(dims == dim)
                    if dim in pivots:
                        found = permutation(_matrix([vectors[i] for i in rows]), pivots[dim], nearest)
                    else:  # a dimension that the sample lacks: one list holds all its vectors
                        found = np.zeros((len(rows), 1), np.int32)
                    for i, x in zip(rows.tolist(), found.tolist(), strict=True):
                        lists[i] = x
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "nearest"])

    return run


def _bits(nearest: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each row the set of its pivots among ``places`` (sorted), in words of 64 bits."""
    words = np.zeros((max(1, -(-len(places) // 64)), len(nearest)), np.uint64)
    if len(places):
        for column in nearest.T:
            at = np.minimum(np.searchsorted(places, column), len(places) - 1)
            rows = np.flatnonzero(places[at] == column)
            np.bitwise_or.at(words, (at[rows] // 64, rows), np.uint64(1) << (at[rows] % 64).astype(np.uint64))
    return words


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of one side shares with each of the other."""
    total = np.zeros((a.shape[1], b.shape[1]), np.uint8)
    for x, y in zip(a, b, strict=True):
        total += np.bitwise_count(x[:, None] & y[None, :])
    return total


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold together what the links of a symmetric matrix hold together."""
    todo = np.ones(len(linked), bool)
    edges = []
    for start in range(len(linked)):
        if not todo[start]:
            continue
        todo[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(linked[i] & todo)
            todo[new] = False
            stack += new.tolist()
            edges += [(i, j) for j in new.tolist()]
    return edges


def _compare(threshold: float, shared: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        """Links between two blocks of a pivot's list, or within one.

        A pair that shares several pivots is compared in the list of the first of them alone; in a list of two pivots,
        if they are the first two that it shares.
        """
        pivot, second, low, high = (x.as_py() for x in key[1:5])
        block = group["block"].to_numpy()
        rows = np.flatnonzero(block == low), np.flatnonzero(block == high)
        nearest = np.array(group["nearest"].to_pylist(), np.int32)
        need = min(shared, nearest.shape[1])
        places = np.unique(nearest)
        m = _matrix(group["vector"].to_pylist())
        before = places[places < pivot] if second < 0 else places[(places < second) & (places != pivot)]
        sides = [(_bits(nearest[r], places), _bits(nearest[r], before)) for r in rows]
        candidates = (_common(sides[0][0], sides[1][0]) >= need) & (_common(sides[0][1], sides[1][1]) == 0)
        if low == high:
            np.fill_diagonal(candidates, False)
        linked = candidates & (m[rows[0]] @ m[rows[1]].T >= threshold) if candidates.any() else candidates
        copies = group["copies"].to_numpy()
        counts = np.zeros(len(block), np.int64)
        counts[rows[0]] += linked @ copies[rows[1]]
        if low != high:
            counts[rows[1]] += linked.T @ copies[rows[0]]
        both = np.zeros((len(block), len(block)), bool)
        both[np.ix_(rows[0], rows[1])] = linked
        edges = _spanning(both | both.T) if linked.any() else []
        ids, nodes = group["rep"].to_numpy(), group["node"].to_numpy()
        full = np.flatnonzero(counts)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({
            "node": pa.array(nodes[full].tolist() + [None] * len(ends), pa.string()),
            "n": pa.array(np.concatenate((counts[full], np.zeros(len(ends), np.int64)))),
            "a": pa.array([None] * len(full) + ids[ends[:, 0]].tolist(), pa.int64()),
            "b": pa.array([None] * len(full) + ids[ends[:, 1]].tolist(), pa.int64()),
        })

    return run


def index_vectors(vectors: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """``vectors`` (dim, vector and more) with ``nearest``, the ordered numbers of each one's nearest pivots."""
    n, dim = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    count = int(min(max(LEAST_PIVOTS, PIVOT_BYTES // (8 * dim)), max(LEAST_PIVOTS, PIVOTS_BY_ROOT * n**0.5)))
    sample = vectors.select("dim", "vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE_BY_PIVOT * count).collect()
    by_dim: dict[int, list[bytes]] = {}
    for row in sample:
        by_dim.setdefault(row["dim"], []).append(bytes(row["vector"]))
    pivots = {dim: pick_pivots(rows, count) for dim, rows in by_dim.items()}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(_describe(vectors.sparkSession.sparkContext.broadcast(pivots), nearest), f"{schema}, nearest array<int>")


def _lists(described: DataFrame, shared: int, block: int, long_blocks: int) -> DataFrame:
    """(node, dim, pivot, second, blocks, block): the inverted lists that a row enters, and its block in each.

    second is -1 in a list of one pivot. Lists of one row are left out.
    """
    spark = described.sparkSession

    def sized(rows: DataFrame) -> DataFrame:
        key = ["dim", "pivot", "second"]
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        sizes = stored(sizes.select(*key, F.ceil(F.col("c") / block).cast("int").alias("blocks")), shared_folder(spark, "list-sizes"))
        own = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
        return rows.join(own, key).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))

    ones = sized(described.select("node", "dim", "nearest", F.explode("nearest").alias("pivot"), F.lit(-1).alias("second")))
    columns = ["node", "dim", "pivot", "second", "blocks", "block"]
    long = (F.col("blocks") > long_blocks) & (F.size("nearest") > 1)
    if shared < 2 or not ones.where(long).limit(1).count():
        return ones.select(*columns)
    # Of the two pivots that name a list, the first has the smaller number.
    twos = ones.where(long).select("node", "dim", "pivot", F.explode(F.filter("nearest", lambda x: x > F.col("pivot"))).alias("second"))
    return ones.where(~long).select(*columns).unionByName(sized(twos).select(*columns))


def vector_duplicates(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.95, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK, long_blocks: int = LONG_BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors are linked if their cosine is at least ``threshold``. Equal vectors are one class, known by 128 bits of a digest. Each class is described by
    its nearest pivots in order; it enters the inverted list of each of them. A list of more than LONG_BLOCKS blocks is
    dealt to lists of two pivots, for ``shared`` of 2 or more, so that a row meets those alone with which it shares both.
    A list is compared in blocks of ``block`` rows, whatever its length; two rows that share at least ``shared`` pivots
    are verified by their cosine. Links are counted where they are found, and only those that hold a component together leave the task. All rows are indexed;
    the pivots come from a bounded sample. A link between vectors that share fewer pivots is missed (README: recall).

    Null, empty or zero vectors and those with null or non-finite components link with nothing; vectors of different
    length aren't compared. Repeated rows are other vectors that link with each other. Rows with a null id link with
    nothing: their component_id is null and kept is true. Rows with one id and different vectors count their own links
    and share a component. An empty table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = embeddings.sparkSession
    bound_batches(spark)
    slim = embeddings.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("embedding"))
    rows = stored(slim.mapInArrow(_vectors, "vec_id long, dim int, vector binary").withColumn("node", F.when(F.col("vec_id").isNotNull() & F.col("vector").isNotNull(), F.md5("vector"))), shared_folder(spark, "vectors"))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    classes = stored(classes, shared_folder(spark, "vector-classes"))
    described = stored(index_vectors(classes, nearest), shared_folder(spark, "pivot-index"))

    places = stored(_lists(described.select("node", "dim", "nearest"), shared, block, long_blocks), shared_folder(spark, "pivot-lists"))
    lists = described.select("node", "rep", "copies", "vector", "nearest").join(places, "node")
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = lists.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    found = lists.groupBy("dim", "pivot", "second", "low", "high").applyInArrow(_compare(threshold, shared), "node string, n long, a long, b long")
    found = stored(found, shared_folder(spark, "vector-links"))
    counts = found.where("a is null").groupBy("node").agg(F.sum("n").alias("others"))
    labels = components(found.where("a is not null").select("a", "b")).withColumnRenamed("node", "rep")
    answer = classes.select("node", "rep", "copies").join(counts, "node", "left").join(labels, "rep", "left")
    answer = answer.select("node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.select("vec_id", "node").join(answer, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
