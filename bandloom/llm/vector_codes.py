"""Product codes of vectors: k-means of each part, run over metric trees built by the anchors hierarchy.

Vectors become integers, so that every distance, sum and tie is exact and runs agree whatever the order of the rows. Each
task keeps its vectors in blocks; over each part of a block lies a tree of balls, built from the middle out: some sqrt(n)
anchors take their nearest points, are joined pairwise up to one root, and are split further below. A ball knows its
points' count and sum. A round hands the codebook down the tree: a ball inherits its parent's list of candidate entries
and strikes out those that no point of it can be nearest to; a ball with one candidate left is owned by it as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import BROADCAST_ROWS, bound_batches, shared_folder, stored

#: Parts of a vector, entries of a part's codebook, rounds before the last assignment, and integer steps of 1.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

#: Vectors of a block, and points that a ball isn't split below.
BLOCK, LEAF = 4096, 48

#: Components stop at this size, far beyond what a code can tell apart.
LARGEST = 1 << 62

LONG = (1 << 63) - 1


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(1024 * x) of each component; shorter vectors end in zeros."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lists), width), np.int64)
    scaled = np.floor(flat * SCALE)
    out[np.arange(width) < sizes[:, None]] = np.where(np.abs(scaled) >= LARGEST, 0, scaled).astype(np.int64) + np.where(np.abs(scaled) >= LARGEST, np.sign(scaled), 0).astype(np.int64) * LARGEST
    return out


# The tree of a block's part --------------------------------------------------------------------------------------------


def _anchors(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` by their nearest of some sqrt(n) anchors, each the farthest point of the widest anchor so far."""
    own, most = np.zeros(len(rows), np.int64), int(np.sqrt(len(rows))) + 1
    mine = points[rows]
    centres = [mine[0]]
    far = np.sqrt(((mine - mine[0]) ** 2).sum(1))
    while len(centres) < most:
        widest = int(far.argmax())
        if far[widest] == 0:
            break
        new = mine[widest]
        half = np.sqrt(((np.array(centres) - new) ** 2).sum(1)) / 2
        near = np.flatnonzero(far >= half[own])  # others are nearer to their own anchor, by the triangle inequality
        distance = np.sqrt(((mine[near] - new) ** 2).sum(1))
        taken = near[distance < far[near]]
        far[taken], own[taken] = distance[distance < far[near]], len(centres)
        centres.append(new)
    groups = np.split(rows[np.argsort(own, kind="stable")], np.cumsum(np.bincount(own, minlength=len(centres)))[:-1])
    return [g for g in groups if len(g)]


@dataclass
class Tree:
    """Balls over ``order``: each holds order[start:stop]; children are -1 where there are none."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    children: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    def to_bytes(self) -> bytes:
        counts = np.array([len(self.order), len(self.start), self.centre.shape[1]], np.int64)
        return b"".join([counts.tobytes(), *(x.astype(kind).tobytes() for x, kind in zip(self._arrays(), self.KINDS, strict=True))])

    def _arrays(self) -> tuple:
        return self.order, self.start, self.stop, self.children, self.centre, self.radius, self.sums

    KINDS = ("<i8", "<i8", "<i8", "<i8", "<f8", "<f8", "<i8")

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        n, balls, width = np.frombuffer(data, np.int64, 3).tolist()
        shapes, at, out = [(n,), (balls,), (balls,), (balls, 2), (balls, width), (balls,), (balls, width)], 24, []
        for shape, kind in zip(shapes, cls.KINDS, strict=True):
            out.append(np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape))
            at += 8 * int(np.prod(shape))
        return cls(*out)


def grow(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over integer ``points`` (as doubles that hold them exactly)."""
    nodes: list[tuple[int, int, np.ndarray]] = []  # left, right, rows

    def add(left: int, right: int, rows: np.ndarray) -> int:
        nodes.append((left, right, rows))
        return len(nodes) - 1

    def ball(rows: np.ndarray) -> tuple[np.ndarray, float]:
        centre = points[rows].mean(0)
        return centre, float(np.sqrt(((points[rows] - centre) ** 2).sum(1).max()))

    def split(rows: np.ndarray) -> int:
        groups = _anchors(points, rows) if len(rows) > leaf else [rows]
        if len(groups) == 1:
            return add(-1, -1, rows)
        ids = [split(g) for g in groups]
        # Upwards: the two balls whose common ball is smallest are joined, until one is left.
        shapes = [ball(nodes[i][2]) for i in ids]
        centres, radii = np.array([c for c, _ in shapes]), np.array([r for _, r in shapes])
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + radii[:, None] + radii[None]
        np.fill_diagonal(apart, np.inf)
        for _ in range(len(ids) - 1):
            a, b = divmod(int(apart.argmin()), len(ids))
            ids[a] = add(ids[a], ids[b], np.concatenate([nodes[ids[a]][2], nodes[ids[b]][2]]))
            centres[a], radii[a] = ball(nodes[ids[a]][2])
            gone = np.isinf(apart[a]) & (np.arange(len(ids)) != a)
            apart[a] = np.sqrt(((centres - centres[a]) ** 2).sum(1)) + radii + radii[a]
            apart[a, gone], apart[a, a], apart[a, b] = np.inf, np.inf, np.inf
            apart[:, a] = apart[a]
            apart[b], apart[:, b] = np.inf, np.inf
        return ids[a]

    root = split(np.arange(len(points)))
    # From the root down, so that a ball's points lie together in the order.
    order, start, stop, children, stack = [], [], [], [], [(root, 0, -1, 0)]
    while stack:
        node, first, parent, side = stack.pop()
        left, right, rows = nodes[node]
        me = len(start)
        if parent >= 0:
            children[parent][side] = me
        start.append(first)
        stop.append(first + len(rows))
        children.append([-1, -1])
        if left < 0:
            order.append((first, rows))
        else:
            stack += [(right, first + len(nodes[left][2]), me, 1), (left, first, me, 0)]
    every = np.concatenate([rows for _, rows in sorted(order, key=lambda x: x[0])])
    placed = points[every]
    upto = np.concatenate([np.zeros((1, points.shape[1])), np.cumsum(placed, 0)])
    start, stop = np.array(start), np.array(stop)
    sums = upto[stop] - upto[start]
    centre = sums / (stop - start)[:, None]
    radius = np.array([np.sqrt(((placed[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(start, stop, centre, strict=True)])
    return Tree(every, start, stop, np.array(children), centre, radius, sums.astype(np.int64))


@dataclass
class Book:
    """A part's distinct entries: of equal ones the first, as it wins every tie."""

    entries: list[list[int]]

    def __post_init__(self) -> None:
        first: dict[tuple, int] = {}
        for k, x in enumerate(self.entries):
            first.setdefault(tuple(x), k)
        self.index = np.array(list(first.values()), np.int64)
        self.exact = np.array(list(first), dtype=object).reshape(len(first), len(self.entries[0]) if self.entries else 0)
        self.largest = max((abs(v) for x in first for v in x), default=0)
        self.points = self.exact.astype(np.float64)
        self.squares = (self.points**2).sum(1)
        self.apart = np.sqrt(np.maximum(0, self.squares[:, None] + self.squares[None] - 2 * self.points @ self.points.T)) * (1 + 1e-6) + 1e-3


def owners(points: np.ndarray, tree: Tree, book: Book, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each point's nearest entry (its number in the codebook); adds to ``sums`` and ``counts`` by entry.

    An entry c goes from a ball's list if the plane between it and the entry b nearest to the centre lies beyond the ball:
    |centre - c|^2 - |centre - b|^2 > 2 * radius * |b - c|. Then every point is nearer to b, without a tie.
    """
    codes = np.empty(len(points), np.int64)
    front, lists = np.zeros(1, np.int64), np.ones((1, len(book.index)), bool)
    while len(front):
        centre = tree.centre[front]
        own = (centre**2).sum(1)[:, None]
        square = own + book.squares[None] - 2 * centre @ book.points.T
        # Rounding of the squares stays far below this.
        slack = 1e-9 * (own + np.where(lists, book.squares[None], 0).max(1)[:, None] + 1)
        square[~lists] = np.inf
        best = square.argmin(1)
        beyond = square - square[np.arange(len(front)), best][:, None] > 2 * tree.radius[front][:, None] * (1 + 1e-9) * book.apart[best] + slack
        lists &= ~beyond
        left = lists.sum(1)
        for k in np.flatnonzero(left == 1):
            node, entry = front[k], book.index[best[k]]
            codes[tree.order[tree.start[node] : tree.stop[node]]] = entry
            sums[entry] += tree.sums[node]
            counts[entry] += tree.stop[node] - tree.start[node]
        ends = (left > 1) & (tree.children[front, 0] < 0)
        for k in np.flatnonzero(ends):
            rows, entries = tree.order[tree.start[front[k]] : tree.stop[front[k]]], np.flatnonzero(lists[k])
            mine = points[rows]
            nearest = book.index[entries[(book.squares[entries][None] - 2 * mine @ book.points[entries].T).argmin(1)]]
            codes[rows] = nearest
            np.add.at(sums, nearest, mine.astype(np.int64))
            np.add.at(counts, nearest, 1)
        on = (left > 1) & ~ends
        front, lists = tree.children[front[on]].reshape(-1), np.repeat(lists[on], 2, axis=0)
    return codes


def owners_exact(points: np.ndarray, book: Book) -> np.ndarray:
    """The same with Python's integers, for components too large for doubles; one entry after the other."""
    rows = points.astype(object)
    best, codes = None, np.zeros(len(points), np.int64)
    for number, entry in zip(book.index, book.exact, strict=True):
        square = ((rows - entry) ** 2).sum(1)
        if best is None:
            best, codes = square, np.full(len(points), number)
        else:
            nearer = np.array(square < best, bool)
            best[nearer], codes[nearer] = square[nearer], number
    return codes


def _fits(largest: int, width: int) -> bool:
    """Whether sums of ``width`` squares of differences of such components are exact in doubles."""
    return 4 * largest * largest * max(1, width) < 1 << 53


# Jobs ------------------------------------------------------------------------------------------------------------------


def _block_rows(width: int, parts: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(rows: pa.Table) -> pa.RecordBatch:
            numbers = whole_numbers(rows.column("vector"), width)
            step, trees = width // parts, []
            if _fits(int(np.abs(numbers).max(initial=0)), step):
                trees = [grow(numbers[:, p * step : (p + 1) * step].astype(np.float64)).to_bytes() for p in range(parts)]
            ends = pa.array([0, rows.num_rows], pa.int32())
            columns = [pa.ListArray.from_arrays(ends, rows.column(name).combine_chunks()) for name in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*columns, pa.array([numbers.astype("<i8").tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], ["vec_ids", "labels", "numbers", "trees"])

        for batch in batches:
            held.append(batch)
            while sum(x.num_rows for x in held) >= block:
                table = pa.Table.from_batches(held)
                yield emit(table.slice(0, block))
                held = table.slice(block).to_batches()
        if sum(x.num_rows for x in held):
            yield emit(pa.Table.from_batches(held))

    return run


def _assigned(row: dict, books: list[Book], sums: list[np.ndarray] | None, counts: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """A block's integers and codes; sums and counts (by part) are added to where they are given, as Python's integers if need be."""
    n, width = row["n"], row["width"]
    numbers = np.frombuffer(row["numbers"], "<i8").reshape(n, width)
    step = width // len(books)
    codes = np.zeros((n, len(books)), np.int64)
    for p, book in enumerate(books):
        own = numbers[:, p * step : (p + 1) * step]
        into = sums[p] if sums is not None else np.zeros((ENTRIES, step), object)
        tally = counts[p] if counts is not None else np.zeros(ENTRIES, np.int64)
        if row["trees"] and _fits(book.largest, step):
            part = np.zeros((ENTRIES, step), np.int64)
            codes[:, p] = owners(own.astype(np.float64), Tree.from_bytes(row["trees"][p]), book, part, tally)
            into += part
        else:
            codes[:, p] = owners_exact(own, book)
            np.add.at(into, codes[:, p], own.astype(object))
            np.add.at(tally, codes[:, p], 1)
    return numbers, codes


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[dict]:
    for k in range(batch.num_rows):
        ids = batch.column("vec_ids")[k].values
        yield {"ids": ids, "labels": batch.column("labels")[k].values, "n": len(ids), "width": width, "numbers": batch.column("numbers")[k].as_py(), "trees": batch.column("trees")[k].as_py()}


def _count(codebooks: list[list[list[int]]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, step = [Book(x) for x in codebooks], width // len(codebooks)
        sums = [np.zeros((ENTRIES, step), object) for _ in books]
        counts = [np.zeros(ENTRIES, np.int64) for _ in books]
        for batch in batches:
            for row in _rows(batch, width):
                _assigned(row, books, sums, counts)
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([p] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()), "n": pa.array(counts[p][used], pa.int64()),
                 "sums": pa.array([[str(v) for v in sums[p][k]] for k in used], pa.list_(pa.string()))}
            )

    return run


def _encode(codebooks: list[list[list[int]]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, step = [Book(x) for x in codebooks], width // len(codebooks)
        for batch in batches:
            for row in _rows(batch, width):
                numbers, codes = _assigned(row, books, None, None)
                entries = np.concatenate([np.array(x, object).reshape(len(x), step)[codes[:, p]] for p, x in enumerate(codebooks)], 1)
                plain = row["trees"] and all(_fits(b.largest, step) for b in books)
                apart = numbers - entries.astype(np.int64) if plain else numbers.astype(object) - entries
                errors = [min(int(x), LONG) for x in (apart**2).sum(1)] if width else [0] * row["n"]
                text = codes.astype(np.uint8).tobytes().hex()
                size = 2 * len(books)
                yield pa.RecordBatch.from_arrays([row["ids"], row["labels"], pa.array([text[k * size : (k + 1) * size] for k in range(row["n"])], pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def quantise(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes and errors of all vectors, and the codebooks: (vec_id, label, code, error), entries by part.

    Rows whose vector is null or holds null or non-finite components go. A component x counts as floor(1024 * x), as far as
    2 ** 62 either way. A vector is cut into equal parts; shorter ones than the longest end in zeros, and so does the
    longest up to a multiple of ``parts``. A part's codebook starts as that part of the smallest ids' vectors (null ids last,
    equal ids by their vectors), and may have fewer than ``entries`` entries or equal ones; ties go to the first. Repeated
    rows each count; ids and labels may be null; other columns are ignored; an empty table gives an empty result. An error
    beyond a long is the largest long.

    The trees are built once and stored with their vectors. A round adds up counts and sums by part and entry, in a task
    and then over tasks: what comes to the driver and goes out with the next round is the size of the codebooks.
    """
    if entries > ENTRIES:
        raise ValueError(f"a code has one byte a part: at most {ENTRIES} entries")
    spark: SparkSession = vectors.sparkSession
    bound_batches(spark)
    kept = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{label_column}`").alias("label"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector")).where(sound(F.col("vector")))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    step = width // parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()  # as many rows as entries
    seeds = whole_numbers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width).tolist()
    codebooks = [[x[p * step : (p + 1) * step] for x in seeds] for p in range(parts)]
    label = kept.schema["label"].dataType
    schema = StructType([StructField("vec_ids", ArrayType(LongType())), StructField("labels", ArrayType(label)), StructField("numbers", BinaryType()), StructField("trees", ArrayType(BinaryType()))])
    blocks = stored(kept.mapInArrow(_block_rows(width, parts, block), schema), shared_folder(spark, "vector-trees"))
    for _ in range(rounds):
        counted = blocks.mapInArrow(_count(codebooks, width), "part int, entry int, n long, sums array<string>")
        totals = counted.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(step)]).cast("array<decimal(38,0)>").alias("sums"))
        for r in totals.collect():  # a row an entry
            codebooks[r.part][r.entry] = [int(x) // r.n for x in r.sums]
    out = StructType([StructField("vec_id", LongType()), StructField("label", label), StructField("code", StringType()), StructField("error", LongType())])
    return stored(blocks.mapInArrow(_encode(codebooks, width), out), shared_folder(spark, "vector-codes")), codebooks


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    text = ",".join(str(v) for part in codebooks for entry in part for v in entry)
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = stored(sums, shared_folder(spark, "label-errors"))
    small = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    out = codes.join(small, codes["label"].eqNullSafe(small["of"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
