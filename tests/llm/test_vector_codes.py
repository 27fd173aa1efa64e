"""Product codes against plain k-means in Python's integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.llm.vector_codes import Book, Tree, grow, owners, owners_exact, quantise


def plain(rows, parts=4, entries=256, rounds=4):
    """{(id, label): (code, error)} as a list, and the codebooks."""
    kept = [(i, label, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for *_, v in kept), default=0) // parts) * parts
    step = width // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    pad = lambda v: v + [0] * (width - len(v))
    books = [[pad(v)[p * step : (p + 1) * step] for *_, v in order[:entries]] for p in range(parts)]
    near = lambda p, x: min(range(len(books[p])), key=lambda e: sum((a - b) ** 2 for a, b in zip(x, books[p][e], strict=True)))
    cut = [[pad(v)[p * step : (p + 1) * step] for p in range(parts)] for *_, v in kept]
    for _ in range(rounds):
        codes = [[near(p, x[p]) for p in range(parts)] for x in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, c in zip(cut, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = []
    for (i, label, _), x in zip(kept, cut, strict=True):
        code = [near(p, x[p]) for p in range(parts)]
        error = sum((a - b) ** 2 for p in range(parts) for a, b in zip(x[p], books[p][code[p]], strict=True))
        out.append((i, label, "".join(f"{c:02x}" for c in code), min(error, (1 << 63) - 1)))
    return sorted(map(repr, out)), books


def compare(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    frame = frame.select("*", F.lit(1).alias("code"), F.lit(2).alias("vector"), F.lit(3).alias("error"))
    codes, books = quantise(frame, **options)
    want, want_books = plain(rows, entries=options.get("entries", 256))
    assert sorted(map(repr, map(tuple, codes.select("vec_id", "label", "code", "error").collect()))) == want
    assert books == want_books


def test_clustered_vectors_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16)) * 0.3
    rows = [(k, int(k % 5), (middles[k % 12] + rng.normal(size=16) * 0.05).tolist()) for k in range(900)]
    compare(spark, rows, entries=24, block=300)


def test_ties_and_repeated_rows(spark):
    """A grid of few values: many equal parts, equal entries and equal distances."""
    rng = np.random.default_rng(4)
    rows = [(k // 2, None if k % 7 == 0 else k % 3, (rng.integers(0, 3, size=8) / 1024).tolist()) for k in range(400)]
    compare(spark, rows + rows[:50], entries=16, block=130)


def test_nulls_short_vectors_and_large_values(spark):
    rows = [(1, 0, None), (2, 0, []), (3, None, [1.0]), (4, None, [None, 1.0]), (5, 1, [float("nan"), 1.0]), (6, 1, [float("inf")]), (None, 2, [0.5, -0.5, 0.25, 1.0, 2.0]), (None, 2, [0.5, -0.5, 0.25, 1.0, -2.0]), (7, 2, [1e6, -1e6, 3.0]), (8, 2, [1e9] * 6), (9, None, [-0.0003] * 5)]
    compare(spark, rows, entries=4)
    compare(spark, rows[:2])


def test_empty_table(spark):
    compare(spark, [])
    compare(spark, [(1, 0, None)])


@pytest.mark.parametrize("width", [1, 2, 16])
def test_tree_gives_nearest_entries_sums_and_counts(width):
    rng = np.random.default_rng(width)
    for spread in (4, 1000):
        points = rng.integers(-spread, spread, size=(1500, width)).astype(float)
        tree = Tree.from_bytes(grow(points).to_bytes())
        assert sorted(tree.order.tolist()) == list(range(1500)) and len(tree.start) > 10
        for node in range(len(tree.start)):
            mine = points[tree.order[tree.start[node] : tree.stop[node]]]
            assert (mine.sum(0) == tree.sums[node]).all() and np.sqrt(((mine - tree.centre[node]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9
            if tree.children[node, 0] >= 0:
                a, b = tree.children[node]
                assert (tree.start[a], tree.stop[a], tree.stop[b]) == (tree.start[node], tree.start[b], tree.stop[node])
        book = Book([[int(v) for v in points[k]] for k in range(60)])
        sums, counts = np.zeros((60, width), np.int64), np.zeros(60, np.int64)
        codes = owners(points, tree, book, sums, counts)
        square = ((points[:, None] - np.array(book.entries, float)[None]) ** 2).sum(2)
        assert (codes == square.argmin(1)).all() and (owners_exact(points.astype(np.int64), book) == codes).all()
        assert (counts == np.bincount(codes, minlength=60)).all() and (sums == [points[codes == k].sum(0) for k in range(60)]).all()


def test_tight_balls_are_owned_whole():
    """Far clusters: no point's own distance is computed for them."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-1000, 1000, size=(20, 8)) * 100
    points = (middles[rng.integers(0, 20, 2000)] + rng.integers(-3, 3, size=(2000, 8))).astype(float)

    class Watched(Book):
        def __post_init__(self):
            super().__post_init__()
            self.squares = self.squares.view(Counting)

    class Counting(np.ndarray):
        taken = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                Counting.taken += 1
            return super().__getitem__(key)

    book = Watched([list(map(int, m)) for m in middles])
    tree = grow(points)
    codes = owners(points, tree, book, np.zeros((20, 8), np.int64), np.zeros(20, np.int64))
    assert (codes == ((points[:, None] - middles[None]) ** 2).sum(2).argmin(1)).all()
    assert Counting.taken < (tree.children[:, 0] < 0).sum() / 2
