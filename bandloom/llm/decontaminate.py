"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, open_fs, shared_folder, stored, text_slices, without_rows

#: A-Z to a-z; the other ASCII characters than digits and letters to spaces; bytes from 0x80 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Words of a window.
WINDOW = 10

#: Bytes of benchmark text that one automaton takes (some 15 times as many bytes of memory); more make several.
AUTOMATON_BYTES = 16 << 20

#: Bytes of text that a task scans at once.
SCAN_BYTES = 1 << 20


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters and characters beyond ASCII, with A-Z lower-cased."""
    return (text or "").encode().translate(FOLD).split()


def in_order(ids: set[str | None]) -> list[str | None]:
    """Item ids sorted as strings, and at the end null if there are items without an id."""
    return [*sorted(x for x in ids if x is not None), *([None] if None in ids else [])]


class Index:
    """An Aho-Corasick automaton over the benchmark's words, and a table of its windows.

    Each run of ``width`` words holds one of the blocks of width // 2 words that begin at multiples of that in an item;
    the automaton finds these blocks (and whole items of fewer than ``width`` words) in one pass over a text's words,
    and the windows around a block are confirmed in the table.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW) -> None:
        import ahocorasick

        self.width, self.block = width, max(1, width // 2)
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        whole: dict[tuple, list[int]] = {}
        blocks: set[tuple] = set()
        self.flat, self.at = array("i"), array("q", [0])
        keys, owners, places = array("q"), array("i"), array("i")
        for k, (_, text) in enumerate(items):
            w = tuple([number(x, len(self.vocabulary) + 1) for x in words(text)])
            self.flat.extend(w)
            self.at.append(len(self.flat))
            if 0 < len(w) < width:
                whole.setdefault(w, []).append(k)
            for s in range(len(w) - width + 1):
                keys.append(hash(w[s : s + width]))
                owners.append(k)
                places.append(s)
            if len(w) >= width:
                blocks.update(w[s : s + self.block] for s in range(0, len(w) - self.block + 1, self.block))
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.owners, self.places = (array(t, np.array(x)[order].tobytes()) for t, x in (("q", keys), ("i", owners), ("i", places)))
        self.automaton = None
        if whole or blocks:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for w in blocks.union(whole):
                self.automaton.add_word(w, (len(w), tuple(whole.get(w, ())), w in blocks))
            self.automaton.make_automaton()

    def owners_of(self, window: tuple) -> list[int]:
        """Numbers of the items that have a window."""
        key, out = hash(window), []
        at = bisect_left(self.keys, key)
        while at < len(self.keys) and self.keys[at] == key:
            first = self.at[self.owners[at]] + self.places[at]
            if tuple(self.flat[first : first + self.width]) == window:
                out.append(self.owners[at])
            at += 1
        return out

    def scan(self, w: list[bytes]) -> tuple[np.ndarray, list[str | None]]:
        """Positions of the words that lie in windows, and the sorted ids of the items that have these."""
        if self.automaton is None or not w:
            return np.zeros(0, np.int64), []
        get = self.vocabulary.get
        numbers = tuple([get(x, 0) for x in w])
        spans, items, tried = [], set(), set()
        for last, (length, whole, is_block) in self.automaton.iter(numbers):
            if whole:
                spans.append((last + 1 - length, last + 1))
                items.update(whole)
            if is_block:
                for s in range(max(0, last + 1 - self.width), min(last + 1 - length, len(w) - self.width) + 1):
                    if s not in tried:
                        tried.add(s)
                        if owners := self.owners_of(numbers[s : s + self.width]):
                            spans.append((s, s + self.width))
                            items.update(owners)
        if not spans:
            return np.zeros(0, np.int64), []
        delta = np.zeros(len(w) + 1, np.int64)
        ends = np.array(spans)
        np.add.at(delta, ends[:, 0], 1)
        np.add.at(delta, ends[:, 1], -1)
        return np.flatnonzero(np.cumsum(delta[:-1])), in_order({self.ids[k] for k in items})


def char_spans(text: str, hits: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text that the hit words take, those of neighbouring words as one."""
    raw = text.encode()
    folded = np.frombuffer(raw.translate(FOLD), np.uint8)
    inside = np.concatenate(([False], folded != 32, [False]))
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    runs = np.split(hits, np.flatnonzero(np.diff(hits) != 1) + 1) if len(hits) else []
    return [(int(chars[start[r[0]]]), int(chars[end[r[-1]]])) for r in runs]


def _shards(benchmark: DataFrame, item_column: str, text_column: str, limit: int) -> list[str]:
    """Folders that hold the benchmark, each with some ``limit`` bytes of text at most; the tasks read them, the driver doesn't."""
    items = benchmark.select(F.col(f"`{item_column}`").cast("string").alias("item_id"), F.col(f"`{text_column}`").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-total // limit))
    folder = shared_folder(benchmark.sparkSession, "benchmark")
    items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(count))).repartition(count, "shard").write.partitionBy("shard").parquet(folder)
    return [f"{folder}/shard={k}" for k in range(count)]


@lru_cache(maxsize=1)
def _index(folder: str, width: int) -> Index:
    """The index of one folder, built once in each Python process."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, path = open_fs(folder)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return Index([], width)
    table = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["item_id", "text"])
    return Index(list(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)), width)


def _answer(batch: pa.RecordBatch, names: list[str], hits: list[np.ndarray], items: list[list[str]], counts: list[int]) -> pa.RecordBatch:
    spans = [char_spans(x, h) if len(h) else [] for x, h in zip(batch.column("scanned_text").to_pylist(), hits, strict=True)]
    columns = [batch.column(n) for n in names]
    columns += [pa.array(counts, pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array(items, pa.list_(pa.string()))]
    columns += [pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    return pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_hit", "items", "spans"])


def _scan_one(folder: str, width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(folder, width)
        for whole in batches:
            for batch in text_slices(whole, "scanned_text", SCAN_BYTES):
                texts = [words(x) for x in batch.column("scanned_text").to_pylist()]
                found = [index.scan(w) for w in texts]
                yield _answer(batch, names, [h for h, _ in found], [x for _, x in found], [len(w) for w in texts])

    return run


def _scan_shard(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(folder, width)
        for whole in batches:
            for batch in text_slices(whole, "scanned_text", SCAN_BYTES):
                found = [index.scan(words(x)) for x in batch.column("scanned_text").to_pylist()]
                rows = [i for i, (h, _) in enumerate(found) if len(h)]
                yield pa.RecordBatch.from_arrays([batch.column("scanned_row").take(pa.array(rows, pa.int64())), pa.array([found[i][0].tolist() for i in rows], pa.list_(pa.int64())), pa.array([found[i][1] for i in rows], pa.list_(pa.string()))], ["scanned_row", "hits", "found"])

    return run


def _gathered(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "scanned_text", SCAN_BYTES):
                hits = [np.unique(np.array(x or [], np.int64)) for x in batch.column("hits").to_pylist()]
                counts = [len(words(x)) for x in batch.column("scanned_text").to_pylist()]
                yield _answer(batch, names, hits, [in_order(set(x or [])) for x in batch.column("found").to_pylist()], counts)

    return run


def _scanned(docs: DataFrame, benchmark: DataFrame, keep: list[str], id_column: str, text_column: str, width: int, automaton_bytes: int) -> tuple[DataFrame, list]:
    """The scan's columns beside k0, k1, ... for the ``keep`` columns, and these under their own names."""
    spark = docs.sparkSession
    bound_batches(spark)
    folders = _shards(benchmark, id_column, text_column, automaton_bytes)
    names = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_column}`").alias("scanned_text"))
    kept = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    schema = f"{kept}n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    if len(folders) == 1:
        out = slim.mapInArrow(_scan_one(folders[0], width, names), schema)
    else:
        rows = stored(slim.withColumn("scanned_row", F.monotonically_increasing_id()), shared_folder(spark, "scanned"))
        parts = [rows.select("scanned_row", "scanned_text").mapInArrow(_scan_shard(x, width), "scanned_row long, hits array<long>, found array<string>") for x in folders]
        hits = reduce(DataFrame.unionByName, parts).groupBy("scanned_row").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
        out = rows.join(stored(hits, shared_folder(spark, "scanned-hits")), "scanned_row", "left").mapInArrow(_gathered(names), schema)
    return out, [F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], id_column: str = "item_id", text_column: str = "text", width: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The ``keep`` columns of every row of ``docs``, with n_words, n_hit, items (sorted), spans (start, end), contaminated.

    A document word is hit if it lies in an occurrence of a window of the benchmark: ``width`` words in a row of an item,
    or all words of a shorter one. spans are the character ranges of the hit words in the original text.

    Null texts have no words; items that are null or have no words have no windows; rows of one item id count as one item,
    and so do those without an id, which stand as null at the end of items. The benchmark is written to the shared folder, and each Python process builds
    its automaton once; the driver reads none of it. Each text is scanned once if the benchmark has at most
    ``automaton_bytes`` bytes; a larger one makes as many automata as it takes, each of which scans all texts in tasks of
    its own, and a text's hits are gathered by row. Empty tables and repeated rows need no special care.
    """
    out, kept = _scanned(docs, benchmark, keep, id_column, text_column, width, automaton_bytes)
    return out.select(*kept, "n_words", "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit word, all columns unchanged."""
    slim = docs.select(F.col("doc_id").alias("gone_id"), F.col("text"), F.xxhash64("text").alias("gone_hash"))
    return without_rows(docs, find_contamination(slim, benchmark, ["gone_id", "gone_hash"]).where("contaminated"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    found = find_contamination(docs, benchmark, ["doc_id"])
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")
