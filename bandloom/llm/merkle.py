"""A Merkle manifest of a table: one tree a group, kept as aligned blocks of digests in van Emde Boas order.

Every eight consecutive nodes of a level make one of the next, also where the last run is shorter; the subroots of all
groups make one more tree. A block is an aligned subtree of ``height`` levels of edges, so of up to 8 ** height leaves. Its
digests lie in van Emde Boas order: the upper half of its levels first, then each subtree below, each split in halves
again, so that a path from leaf to root touches few neighbourhoods whatever the cache's size. A node's place follows from
its level and index by arithmetic. The roots of a group's blocks are the leaves of its next level of blocks, and so on.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, shared_folder, stored

FAN, FAN_BITS = 8, 3

#: Levels of edges of a block: 4,096 leaves, 150 kB of digests.
BLOCK_HEIGHT = 4

#: Bytes of a digest, and of its hexadecimal text.
RAW, HEX = 32, 64


def digest(*fields: Column) -> Column:
    """SHA-256 of fields, each ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    parts = []
    for x in (f.cast("string") for f in fields):
        parts.append(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


# Places of nodes ------------------------------------------------------------------------------------------------------


def size_of(levels: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes in a whole tree of ``levels`` levels; ``depth`` counts from the root, ``index`` from the left."""
    place = np.zeros(len(index), np.int64)
    index = np.asarray(index, np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = FAN_BITS * (depth - top)
        place += size_of(top) + (index >> below) * size_of(levels - top)
        index, depth, levels = index & ((1 << below) - 1), depth - top, levels - top
    return place


@functools.lru_cache(maxsize=256)
def layout(leaves: int, height: int) -> list[np.ndarray]:
    """For each level, from the leaves up, the places of its nodes; places without a node close up, in the same order."""
    counts = [-(-leaves // FAN**k) for k in range(height + 1)]
    places = np.concatenate([address(height + 1, height - k, np.arange(n)) for k, n in enumerate(counts)])
    closed = np.empty(len(places), np.int64)
    closed[np.argsort(places, kind="stable")] = np.arange(len(places))
    return np.split(closed, np.cumsum(counts)[:-1])


def runs_of(text: str) -> Iterator[str]:
    """The text of a level's digests, cut into runs of eight."""
    return (text[k : k + FAN * HEX] for k in range(0, len(text), FAN * HEX))


def build(leaves: bytes, height: int) -> bytes:
    """The digests of a block over ``leaves``, in van Emde Boas order."""
    places = layout(len(leaves) // RAW, height)
    nodes = np.empty((sum(map(len, places)), RAW), np.uint8)
    nodes[places[0]] = np.frombuffer(leaves, np.uint8).reshape(-1, RAW)
    for below, above in zip(places, places[1:], strict=False):
        text = nodes[below].tobytes().hex()
        nodes[above] = np.frombuffer(b"".join(hashlib.sha256(run.encode()).digest() for run in runs_of(text)), np.uint8).reshape(-1, RAW)
    return nodes.tobytes()


def level_texts(nodes: bytes, leaves: int, height: int) -> list[str]:
    """The digests of each level below the block's root, as text from left to right."""
    table = np.frombuffer(nodes, np.uint8).reshape(-1, RAW)
    return [table[place].tobytes().hex() for place in layout(leaves, height)[:height]]


def siblings(texts: list[str], leaf: int) -> tuple[list[str], list[str]]:
    """For each level what stands to the left and to the right of the leaf's ancestor in its run."""
    left, right = [], []
    for k, text in enumerate(texts):
        at = leaf >> (FAN_BITS * k)
        first = at & ~(FAN - 1)
        left.append(text[HEX * first : HEX * at])
        right.append(text[HEX * (at + 1) : HEX * (first + FAN)])
    return left, right


def in_order(left: list[str], right: list[str]) -> str:
    """All siblings, level by level, from left to right."""
    return "".join(x for pair in zip(left, right, strict=True) for x in pair)


def fold(leaf: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for a, b in zip(left, right, strict=True):
        leaf = hashlib.sha256(f"{a}{leaf}{b}".encode()).hexdigest()
    return leaf


# Forests --------------------------------------------------------------------------------------------------------------


def numbered(rows: DataFrame, tree: str, order: list[Column], folder: str) -> DataFrame:
    """``rows`` with rank (from 0 in the tree, by ``order``) and total (rows of the tree).

    Rows are dealt by ranges of tree and order, and counted in each; a range's first rank is a sum over the ranges before
    it. Equal rows are told apart by where they were read, so that a key with many rows spreads over ranges.
    """
    keys = [F.col(tree).asc(), *order, F.col("_read").asc()]
    placed = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(placed.drop("_read").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), f"{folder}/placed")
    ranges = placed.groupBy(tree, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(tree).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(tree)))
    ranges = stored(ranges.drop("n"), f"{folder}/ranges")
    small = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
    return placed.join(small, [tree, "_range"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before", "_range")


BLOCK_SCHEMA = "tree long, block long, blocks long, n int, height int, nodes binary, root binary"


def _build_blocks(block_height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                leaves = batch.column("leaves")[k].as_py()
                total, raw = batch.column("total")[k].as_py(), b"".join(leaves)
                height = block_height
                if total <= FAN**block_height:
                    height = next(h for h in range(block_height + 1) if FAN**h >= total)
                nodes = build(raw, height)
                root = nodes[:RAW]  # the root is first in this order, in a block of one leaf too
                yield pa.RecordBatch.from_pydict(
                    {"tree": batch.column("tree").slice(k, 1), "block": batch.column("block").slice(k, 1), "blocks": pa.array([-(-total // FAN**block_height)], pa.int64()), "n": pa.array([len(leaves)], pa.int32()),
                     "height": pa.array([height], pa.int32()), "nodes": pa.array([nodes], pa.binary()), "root": pa.array([root], pa.binary())}
                )

    return run


def forest(nodes: DataFrame, folder: str, height: int = BLOCK_HEIGHT) -> list[DataFrame]:
    """Writes the blocks over ``nodes`` (tree, rank, total, leaf) level by level; the last holds the roots of the largest trees."""
    bound_batches(nodes.sparkSession)
    levels: list[DataFrame] = []
    while True:
        in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "leaf"))), lambda x: x["leaf"])
        grouped = nodes.withColumn("block", F.floor(F.col("rank") / FAN**height)).groupBy("tree", "block").agg(F.first("total").alias("total"), in_order.alias("leaves"))
        blocks = stored(grouped.mapInArrow(_build_blocks(height), BLOCK_SCHEMA), f"{folder}/level={len(levels)}")
        levels.append(blocks)
        more = blocks.where("blocks > 1")
        if more.isEmpty():
            return levels
        nodes = more.select("tree", F.col("block").alias("rank"), F.col("blocks").alias("total"), F.col("root").alias("leaf"))


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """(tree, root) of all trees of a forest: each ends in the level in which it has one block."""
    out = [blocks.where("blocks = 1").select("tree", "root") for blocks in levels]
    return functools.reduce(DataFrame.unionByName, out)


PATHS = "left array<string>, right array<string>, subroot string"


def _leaf_paths(block_height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = level_texts(row["nodes"], row["n"], row["height"])
                own = [siblings(texts, k) for k in range(row["n"])]
                first = row["block"] * FAN**block_height
                yield pa.RecordBatch.from_pydict(
                    {"tree": pa.array([row["tree"]] * row["n"], pa.int64()), "rank": pa.array(range(first, first + row["n"]), pa.int64()),
                     "left": pa.array([a + row["left"] for a, _ in own], pa.list_(pa.string())), "right": pa.array([b + row["right"] for _, b in own], pa.list_(pa.string())),
                     "subroot": pa.array([row["subroot"]] * row["n"], pa.string())}
                )

    return run


def block_paths(levels: list[DataFrame], roots: DataFrame, folder: str, height: int = BLOCK_HEIGHT) -> DataFrame:
    """Siblings on the way from the root of each block of the lowest level up: (tree, block, left, right, subroot).

    ``roots`` has them from each tree's root up: (tree, left, right, subroot). From the highest level down, a block hands
    its siblings and those above to the blocks that are its leaves.
    """
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        ends = levels[k].where("blocks = 1").select("tree", "block").join(roots, "tree")
        own = ends if paths is None else ends.unionByName(paths.withColumnRenamed("rank", "block"))
        own = stored(own, f"{folder}/paths={k}")
        if k:
            paths = levels[k].join(own, ["tree", "block"]).mapInArrow(_leaf_paths(height), f"tree long, rank long, {PATHS}")
    return own


@dataclass
class Manifest:
    """What write_manifest wrote: ``trees`` (group, tree, subroot), the root, and ``blocks`` of the lowest level with their paths."""

    trees: DataFrame
    root: str | None
    blocks: DataFrame
    paths: DataFrame
    height: int


def write_manifest(leaves: DataFrame, folder: str, height: int = BLOCK_HEIGHT) -> tuple[Manifest, DataFrame]:
    """Writes the manifest of ``leaves`` (group, key, leaf and more columns) to ``folder``; also returns the leaves with tree and rank.

    Groups come in the order of their UTF-8 bytes, null first; in a group, leaves by key, null first, rows of one key by
    their digests. Of the groups themselves only digests go on to the top tree. An empty table has no root.
    """
    spark: SparkSession = leaves.sparkSession
    groups = leaves.select("group").distinct().withColumn("forest", F.lit(0))
    groups = stored(numbered(groups, "forest", [F.col("group").asc_nulls_first()], f"{folder}/groups").select("group", F.col("rank").alias("tree"), F.col("total").alias("trees")), f"{folder}/group-numbers")
    g = groups.select(F.col("group").alias("_group"), "tree")
    g = F.broadcast(g) if groups.count() <= BROADCAST_ROWS else g
    placed = leaves.join(g, leaves["group"].eqNullSafe(g["_group"])).drop("_group")
    placed = stored(numbered(placed, "tree", [F.col("key").asc_nulls_first(), F.col("leaf").asc()], f"{folder}/leaves"), f"{folder}/ranked")

    levels = forest(placed, f"{folder}/blocks", height)
    subroots = stored(roots_of(levels).join(groups, "tree"), f"{folder}/subroots")
    top = forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("trees").alias("total"), F.col("root").alias("leaf")), f"{folder}/top", height)
    found = top[-1].where("blocks = 1").first()  # one row
    none = F.array().cast("array<string>")
    above = block_paths(top, spark.range(1).select(F.col("id").alias("tree"), none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot")), f"{folder}/top-paths", height)
    to_subroots = top[0].join(above, ["tree", "block"]).mapInArrow(_leaf_paths(height), f"tree long, rank long, {PATHS}")
    own = to_subroots.select(F.col("rank").alias("tree"), "left", "right").join(subroots.select("tree", F.lower(F.hex("root")).alias("subroot")), "tree")
    paths = block_paths(levels, stored(own, f"{folder}/subroot-paths"), f"{folder}/block-paths", height)
    trees = subroots.select("group", "tree", F.lower(F.hex("root")).alias("subroot"))
    return Manifest(trees, bytes(found["root"]).hex() if found else None, levels[0], paths, height), placed


def _audit_blocks(block_height: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("block", "n", "height", "nodes", "left", "right", "subroot")}
                texts = level_texts(row["nodes"], row["n"], row["height"])
                leaves = np.frombuffer(row["nodes"], np.uint8).reshape(-1, RAW)[layout(row["n"], row["height"])[0]].tobytes().hex()
                claims = batch.column("claims")[k].values
                ranks, claimed = claims.field("rank").to_pylist(), claims.field("claim").to_pylist()
                above = in_order(row["left"], row["right"])
                out: dict[str, list] = {name: [] for name in ("leaf", "proof", "folded", "lefts", "rights")}
                for rank, claim in zip(ranks, claimed, strict=True):
                    at = rank - row["block"] * FAN**block_height
                    left, right = siblings(texts, at)
                    out["leaf"].append(leaves[HEX * at : HEX * (at + 1)])
                    out["proof"].append(hashlib.sha256((in_order(left, right) + above).encode()).hexdigest())
                    out["folded"].append(fold(fold(claim.hex(), left, right), row["left"], row["right"]))
                    if whole:
                        out["lefts"].append(left + row["left"])
                        out["rights"].append(right + row["right"])
                columns = {"key": claims.field("key"), **{name: pa.array(out[name], pa.string()) for name in ("leaf", "proof", "folded")}, "subroot": pa.array([row["subroot"]] * len(ranks), pa.string())}
                if whole:
                    columns |= {"left": pa.array(out["lefts"], pa.list_(pa.string())), "right": pa.array(out["rights"], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def audit(manifest: Manifest, claims: DataFrame, whole: bool = False) -> DataFrame:
    """What the manifest says of ``claims`` (tree, rank, key, claim: the digest of the row as it is now).

    One row a claim: key, leaf (of the manifest), subroot, root, proof (SHA-256 of its siblings, level by level to the root,
    left to right), folded (the root that claim and siblings give) and verified (whether that is the root). With ``whole``,
    also the siblings themselves, as left and right. Claims meet their block's digests once; each folds its own path.
    """
    spark = claims.sparkSession
    bound_batches(spark)
    per_block = claims.withColumn("block", F.floor(F.col("rank") / FAN**manifest.height)).groupBy("tree", "block").agg(F.collect_list(F.struct("rank", "key", "claim")).alias("claims"))
    held = manifest.blocks.select("tree", "block", "n", "height", "nodes").join(manifest.paths, ["tree", "block"])
    schema = f"key long, leaf string, proof string, folded string, subroot string{', left array<string>, right array<string>' if whole else ''}"
    out = per_block.join(held, ["tree", "block"]).mapInArrow(_audit_blocks(manifest.height, whole), schema)
    return out.withColumn("root", F.lit(manifest.root)).withColumn("verified", F.col("folded") == F.col("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def document_leaves(docs: DataFrame) -> DataFrame:
    """(group, key, leaf, claim) of documents: the digest of a row, and of the row after tampering.

    Where 3 divides the CRC-32 of doc_id, tampering lower-cases A-Z in the text; rows without an id aren't tampered with.
    """
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)) & F.coalesce(F.col("text").rlike("[A-Z]"), F.lit(False))
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").cast("long").alias("key"), digest(*others, F.col("text")).alias("leaf"), F.when(tampered, digest(*others, F.translate("text", UPPER, LOWER))).alias("claim"))
    return rows.withColumn("claim", F.coalesce("claim", "leaf"))


def verified_documents(docs: DataFrame, height: int = BLOCK_HEIGHT) -> DataFrame:
    """The manifest of ``docs`` (doc_id, text, lang, source, n_chars), and the audit of its rows after tampering.

    Texts are read once, where they lie; from then on only digests move. Nulls in any column are part of the digest; rows
    of a null lang are a tree of their own, before all others; null ids come first in theirs. Repeated rows are leaves of
    their own, next to each other. Very long texts are hashed whole. Other columns are ignored. An empty table gives an
    empty result. Memory: a task holds some blocks of 4,096 digests, whatever a language's size.
    """
    folder = shared_folder(docs.sparkSession, "manifest")
    leaves = stored(document_leaves(docs), f"{folder}/digests")
    manifest, ranked = write_manifest(leaves, folder, height)
    return audit(manifest, ranked)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verified_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")
