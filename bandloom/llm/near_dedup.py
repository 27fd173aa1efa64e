"""MinHash near-duplicate detection with tensored banding, links confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, mix64, shared_folder, stored, text_bytes, text_slices, without_rows
from .graph import components
from .shingles import digests, minhashes, shingle_sets

#: Half keys in each of the two collections, and MinHash values in a half key. HALVES**2 = 576 tables of 8 values each
#: take 192 MinHash values instead of 4608; a pair shares no table with probability 2e-4 at similarity 0.75, and some with
#: 3% at 0.3 and 0.1% at 0.2, so that shared boilerplate alone makes few candidates.
HALVES, ROWS = 24, 4

#: Share of equal MinHash values from which a candidate pair is taken further: 6 standard errors below 0.75.
LEAST_EQUAL = 0.56

#: Shingles of one block of a large cluster (4 MB of hashes), and members of a small bucket.
BLOCK_SHINGLES, SMALL_BUCKET = 500_000, 32


def _signatures(text_column: str, halves: int, rows: int):
    schema = "doc_id long, text_hash long, n long, d1 long, d2 long, a array<long>, b array<long>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, text_column):
                sets, bounds = shingle_sets(*text_bytes(batch.column(text_column)))
                d1, d2 = digests(sets, bounds)
                values = minhashes(sets, bounds, 2 * halves * rows)
                keys = np.zeros((2 * halves, batch.num_rows), np.uint64)
                for k in range(rows):
                    keys = mix64(keys * np.uint64(31) + values[k::rows])
                flat = np.ascontiguousarray(keys.T).view(np.int64)
                lists = [pa.ListArray.from_arrays(np.arange(0, batch.num_rows * halves + 1, halves, dtype=np.int32), pa.array(part.reshape(-1))) for part in (flat[:, :halves], flat[:, halves:])]
                sketch = pa.array([x.tobytes() for x in np.ascontiguousarray((values >> np.uint64(8)).astype(np.uint8).T)], pa.binary())
                columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(bounds)), pa.array(d1), pa.array(d2), *lists, sketch]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "d1", "d2", "a", "b", "sketch"])

    return run, schema


def _sets(text_column: str):
    """Sets of the representatives; a row whose text has another set than its class (a repeated id) gives none."""
    schema = "cluster long, blocks int, block int, node long, hashes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, text_column):
                sets, bounds = shingle_sets(*text_bytes(batch.column(text_column)))
                d1, d2 = digests(sets, bounds)
                same = np.flatnonzero((d1 == batch.column("d1").to_numpy()) & (d2 == batch.column("d2").to_numpy()))
                rest = batch.select(["cluster", "blocks", "block", "node"]).take(pa.array(same))
                hashes = pa.array([sets[bounds[i] : bounds[i + 1]].tobytes() for i in same], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest.columns, hashes], ["cluster", "blocks", "block", "node", "hashes"])

    return run, schema


class SetIndex:
    """Shingle sets of one block with an inverted list for each shingle that two of them share."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        hashes, self.owners = hashes[order], owners[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        self.keys, self.first = hashes[first], first
        self.lengths = np.diff(np.append(first, len(hashes)))

    def overlaps(self, one: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of a sorted set with each set of the block."""
        at = np.searchsorted(self.keys, one)
        inside = at < len(self.keys)
        at, one = at[inside], one[inside]
        at = at[self.keys[at] == one]
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        where = np.repeat(self.first[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.owners[where], minlength=len(self.sizes))

    def linked(self, one: np.ndarray, percent: int) -> np.ndarray:
        """Positions of the sets whose similarity to ``one`` is at least ``percent`` hundredths."""
        both = self.overlaps(one)
        return np.flatnonzero((100 * both >= percent * (len(one) + self.sizes - both)) & (both > 0))


def _roots(n: int):
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: int, y: int) -> bool:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
        return x != y

    return find, join


def forest(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect what the links within ``left`` (right None) or between left and right connect.

    Within one block, sets linked with a central one need no comparison among themselves: each of the others is
    compared with the whole block. Positions in ``right`` follow those in ``left``.
    """
    index = SetIndex(left if right is None else right)
    shift = 0 if right is None else len(left)
    find, join = _roots(shift + len(index.sizes))
    edges = []

    def tie(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if join(i, shift + j):
                edges.append((i, shift + j))

    if right is not None:
        for i, one in enumerate(left):
            tie(i, index.linked(one, percent))
        return edges
    if len(left) < 2:
        return edges
    weight = np.bincount(index.owners, weights=np.repeat(index.lengths, index.lengths), minlength=len(left))
    centre = int(np.argmax(weight))
    near = index.linked(left[centre], percent)
    tie(centre, near)
    for i in np.setdiff1d(np.arange(len(left)), near).tolist():
        if len(edges) == len(left) - 1:
            break
        tie(i, index.linked(left[i], percent))
    return edges


def _unpack(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _edges(ids: list[int], pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([ids[i] for i, _ in pairs], pa.int64()), "b": pa.array([ids[j] for _, j in pairs], pa.int64())})


def _within(percent: int):
    def run(group: pa.Table) -> pa.Table:
        return _edges(group["node"].to_pylist(), forest(_unpack(group["hashes"]), None, percent))

    return run


def _to_centre(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """For each member of a block: is it linked with the cluster's centre, which comes along?"""
        centre = group["is_centre"].to_numpy()
        one = _unpack(group.filter(pa.array(centre))["hashes"])[0]
        members = group.filter(pa.array(~centre))
        index = SetIndex(_unpack(members["hashes"]))
        near = np.zeros(members.num_rows, bool)
        near[index.linked(one, percent)] = True
        return pa.table({"node": members["node"], "near": pa.array(near)})

    return run


def _between(percent: int):
    def run(group: pa.Table) -> pa.Table:
        far = group["is_far"].to_numpy()
        left, right = group.filter(pa.array(far)), group.filter(pa.array(~far))
        ids = left["node"].to_pylist() + right["node"].to_pylist()
        if not left.num_rows or not right.num_rows:
            return _edges(ids, [])
        return _edges(ids, forest(_unpack(left["hashes"]), _unpack(right["hashes"]), percent))

    return run


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, near): whether enough MinHash values of a pair are equal, from a byte of each."""
    for batch in batches:
        x, y = _sketches(batch.column("x")), _sketches(batch.column("y"))
        near = (x == y).mean(axis=1) >= LEAST_EQUAL if batch.num_rows else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], ["a", "b", "near"])


def _alike_in_bucket(group: pa.Table) -> pa.Table:
    """Pairs of a small bucket with enough equal values, as few as connect what all of them do."""
    nodes, x = group["node"].to_pylist(), _sketches(group["sketch"])
    _, join = _roots(len(nodes))
    near = (x[:, None, :] == x[None, :, :]).mean(axis=2) >= LEAST_EQUAL
    return _edges(nodes, [(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True) if join(i, j)])


def _candidates(classes: DataFrame, small: int) -> DataFrame:
    """(a, b): pairs of table buckets, as many as connect what all pairs of a bucket with enough equal MinHash values do.

    Table (i, j) is keyed by half key i of the first collection and half key j of the second. Only documents that share
    half key i with another get the keys of row i, so that most documents emit HALVES keys and no more. Each member of a
    bucket is held against the bucket's smallest member. One that is unlike it, and isn't tied to it through another
    bucket, meets no one else in a bucket of two; in one of up to ``small`` members all pairs are held against each other;
    in a larger one, which only much alike texts make, it stays a candidate and is judged by its whole set.
    """
    spark = classes.sparkSession
    halves = stored(classes.select("node", F.posexplode("a").alias("i", "value")).select("node", F.xxhash64("i", "value").alias("half")), shared_folder(spark, "halves"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    rows = halves.join(shared, "half").join(classes.select("node", "b"), "node")
    tables = rows.select("node", "half", F.posexplode("b").alias("j", "other")).select("node", F.xxhash64("half", "j", "other").alias("key"))
    tables = stored(tables, shared_folder(spark, "tables"))
    # Buckets with the same members need only one of them.
    buckets = tables.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c"), F.expr("bit_xor(xxhash64(node))").alias("members")).where("c > 1")
    buckets = buckets.groupBy("b", "c", "members").agg(F.min("key").alias("key"))
    members = stored(tables.join(buckets.select("key", "b", "c"), "key"), shared_folder(spark, "buckets"))
    sketches = classes.select("node", "sketch")
    pairs = members.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    pairs = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    judged = stored(pairs.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long, near boolean"), shared_folder(spark, "judged"))
    near = judged.where("near").select("a", "b")
    # Rows that other buckets tie to the same smallest members grow together anyway.
    tied = stored(components(near), shared_folder(spark, "tied"))
    ties = [tied.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b")]
    unlike = judged.where("not near").select("a", "b").join(ties[0], "a", "left").join(ties[1], "b", "left").where("coalesce(a_root, a) <> coalesce(b_root, b)")
    unlike = stored(unlike.select(F.col("a").alias("node"), "b"), shared_folder(spark, "unlike"))
    if not unlike.limit(1).count():
        return near
    far = stored(members.where("c > 2").join(unlike, ["node", "b"], "left_semi"), shared_folder(spark, "far-members"))
    large = far.where(F.col("c") > small).select(F.col("node").alias("a"), "b").distinct()
    keys = far.where(F.col("c") <= small).select("key").distinct()
    mixed = members.where(F.col("c").between(3, small)).join(keys, "key", "left_semi").join(sketches, "node").select("key", "node", "sketch")
    return near.unionByName(large).unionByName(mixed.groupBy("key").applyInArrow(_alike_in_bucket, "a long, b long")).distinct()


def _links(docs: DataFrame, classes: DataFrame, id_column: str, text_column: str, percent: int, block_shingles: int, small: int) -> DataFrame:
    """(node, label) for every class that is linked with another one."""
    spark = docs.sparkSession
    clusters = components(_candidates(classes, small)).withColumnRenamed("root", "cluster")
    members = stored(clusters.join(classes.select("node", "rep", "n", "d1", "d2"), "node"), shared_folder(spark, "clusters"))
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    members = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = stored(members.select("node", "rep", "d1", "d2", "cluster", "blocks", "block"), shared_folder(spark, "members"))
    n_members = members.count()
    few = F.broadcast(members) if n_members <= BROADCAST_ROWS else members
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("rep"), F.col(f"`{text_column}`").alias("text")).join(few, "rep")
    run, schema = _sets("text")
    # Rows that repeat an id and text give a set each.
    sets = stored(texts.mapInArrow(run, schema).dropDuplicates(["node"]), shared_folder(spark, "sets"))

    links = sets.where("blocks = 1").groupBy("cluster").applyInArrow(_within(percent), "a long, b long")
    large = sets.where("blocks > 1")
    if members.where("blocks > 1").limit(1).count():
        spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        centre = large.where("node = cluster").withColumn("block", spread).withColumn("is_centre", F.lit(True))
        blocks = large.withColumn("is_centre", F.lit(False)).unionByName(centre)
        near = stored(blocks.groupBy("cluster", "block").applyInArrow(_to_centre(percent), "node long, near boolean"), shared_folder(spark, "near"))
        far = large.join(near.where("not near").select("node").distinct(), "node", "left_semi")
        rest = stored(far.groupBy("cluster").agg(F.ceil(F.sum(F.length("hashes") / 8) / block_shingles).cast("int").alias("far_blocks")), shared_folder(spark, "far"))
        left = far.join(rest, "cluster").withColumn("far_block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("far_blocks")).cast("int")).withColumn("block", spread).withColumn("is_far", F.lit(True))
        right = large.join(rest, "cluster").withColumn("far_block", F.explode(F.sequence(F.lit(0), F.col("far_blocks") - 1))).withColumn("is_far", F.lit(False))
        pairs = left.unionByName(right).groupBy("cluster", "block", "far_block").applyInArrow(_between(percent), "a long, b long")
        star = large.select("node", "cluster").join(near.where("near").select("node").distinct(), "node").where("node <> cluster").select(F.col("node").alias("a"), F.col("cluster").alias("b"))
        links = links.unionByName(pairs).unionByName(star)
    return components(links).select("node", F.col("root").alias("label"))


def _numbered(classes: DataFrame) -> DataFrame:
    """``classes`` with a number each: its smallest doc_id, or one beyond all ids where another class has that too."""
    spark = classes.sparkSession
    shared = stored(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d1", "d2")).alias("first")).where("c > 1").select(F.col("rep").alias("s_rep"), "first"), shared_folder(spark, "shared-ids"))
    if not shared.limit(1).count():
        return classes.withColumn("node", F.col("rep"))
    most = classes.agg(F.max("rep")).first()[0]
    joined = classes.join(shared, F.col("rep") == F.col("s_rep"), "left")
    other = F.col("first").isNotNull() & (F.struct("d1", "d2") != F.col("first"))
    joined = joined.withColumn("node", F.when(other, F.lit(most + 1) + F.monotonically_increasing_id()).otherwise(F.col("rep"))).drop("s_rep", "first")
    return stored(joined, shared_folder(spark, "numbered-classes"))


def _labelled(docs: DataFrame, id_column: str, text_column: str, percent: int, halves: int, rows: int, block_shingles: int, small: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row."""
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    run, schema = _signatures("text", halves, rows)
    text = F.col(f"`{text_column}`")
    slim = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signatures = stored(slim.mapInArrow(run, schema), shared_folder(spark, "signatures"))
    named = signatures.where("n > 0 and doc_id is not null")
    key = ["n", "d1", "d2"]
    classes = stored(named.groupBy(*key).agg(F.min("doc_id").alias("rep"), *[F.first(x).alias(x) for x in ("a", "b", "sketch")]), shared_folder(spark, "classes"))
    classes = _numbered(classes)
    labels = _links(docs, classes, id_column, text_column, percent, block_shingles, small)
    labelled = stored(classes.select(*key, "rep", "node").join(labels, "node", "left").select(*key, "rep", F.coalesce("label", "node").alias("label")), shared_folder(spark, "labelled"))
    # A component's smallest document; its label is the smallest number, which is that but where ids repeat.
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("c")).where("c > 1 or component_id <> label").drop("c")
    labelled = labelled.join(least, "label", "left").select(*key, F.coalesce("component_id", "rep").alias("component_id"))
    out = signatures.select("doc_id", "text_hash", *key).join(labelled, key, "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 75, halves: int = HALVES, rows: int = ROWS, block_shingles: int = BLOCK_SHINGLES, small: int = SMALL_BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least ``percent``
    hundredths; component_id is the smallest doc_id that links reach, kept whether that is the document itself.

    Texts with equal sets form a class at once (an aggregation by digest). Classes that share a bucket of the tensored
    MinHash index are candidates; those of which at least LEAST_EQUAL of all MinHash values are equal form clusters (and,
    in buckets of more than ``small`` classes, those that aren't too), so that texts which share some boilerplate don't
    grow together. Each cluster's sets meet in one task, or in blocks if they hold more than
    ``block_shingles`` shingles: all members are compared with the cluster's centre, and those that aren't linked with
    it with all members. No pair is emitted other than the links that hold a component together.

    Null, empty and all-space texts have no shingle, link with nothing and are their own component. Rows that share
    doc_id and text are the same node and get the same answer. A row with a null doc_id is linked with nothing: its
    component_id is null and kept is true. Rows with the same doc_id and different texts are separate nodes unless links
    join them, and each gets the component of its own text. Other columns are ignored. An empty table gives an empty result. Memory: a task holds one text or 2 MB of
    texts with 10 times as many bytes of arrays, or two blocks of a cluster.
    """
    return _labelled(docs, id_column, text_column, percent, halves, rows, block_shingles, small).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with one document of each component, its columns unchanged; of equal ids the rows with texts that stay, stay."""
    found = _labelled(docs, id_column, text_column, percent, HALVES, ROWS, BLOCK_SHINGLES, SMALL_BUCKET)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    return without_rows(docs, gone, id_column, text_column)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
