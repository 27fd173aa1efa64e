"""Token ids in fixed-width bit-packed files, with block offsets for random access.

A file: 8 bytes of magic, the blocks, their byte offsets (blocks + 1 numbers), for each document its id, whether that
is null, and the position of its first id; then 64 bytes of footer (magic, bits of an id, ids of a block, and the
numbers of ids, blocks and documents). All numbers are little-endian. Ids are packed from the lowest bit; each block
starts at a byte. A block's ids are found at its offset without reading others.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, open_fs, shared_folder, stored, text_slices
from .encoding import encoder

MAGIC = b"BLTOKENS"
FOOTER = struct.Struct("<8sIIQQQ24x")
#: Ids of a block, a multiple of 8, so that full blocks end at a byte for every width.
BLOCK_IDS = 1 << 16

#: Bytes of text that make one file, ids that one task reads back, and bytes of text whose pieces are made distinct together.
FILE_BYTES, READ_IDS, ENCODE_BYTES = 32 << 20, 16 << 20, 2 << 20

#: Characters of a text by which rows of the same id are dealt to files.
TIE = 64


def bits_of(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :bits] = spread
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1)


class TokenFileWriter:
    """Writes one file; holds one block of ids and 17 bytes a document."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS) -> None:
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.parts: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.ids: list[int | None] = []
        self.starts: list[int] = []
        self.offsets = [len(MAGIC)]
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            whole = np.concatenate(self.parts)
            full = len(whole) // self.block_ids * self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(whole[k : k + self.block_ids])
            self.parts, self.held = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        """Writes the last block, the index and the footer."""
        if self.held:
            self._block(np.concatenate(self.parts))
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        null = np.array([x is None for x in self.ids], np.uint8)
        self.out.write(np.array([x or 0 for x in self.ids], "<i8").tobytes() + null.tobytes() + np.array(self.starts, "<u8").tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.bits, self.block_ids, self.n_ids, len(self.offsets) - 1, len(self.ids)))


class TokenFileReader:
    """Random access to one file."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        magic, self.bits, self.block_ids, self.n_ids, self.n_blocks, self.n_docs = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        tail = 8 * (self.n_blocks + 1) + 17 * self.n_docs
        source.seek(size - FOOTER.size - tail)
        data = source.read(tail)
        cut = 8 * (self.n_blocks + 1)
        self.offsets = np.frombuffer(data[:cut], "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(data[cut : cut + 8 * self.n_docs], "<i8")
        self.null = np.frombuffer(data[cut + 8 * self.n_docs : cut + 9 * self.n_docs], np.uint8).astype(bool)
        starts = np.frombuffer(data[cut + 9 * self.n_docs :], "<u8").astype(np.int64)
        self.bounds = np.append(starts, self.n_ids)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from ``first`` up to, not including, ``last``."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        self.source.seek(a)
        data = self.source.read(b - a)
        count = min(self.n_ids, last * self.block_ids) - first * self.block_ids
        return unpack(data, self.bits, count)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from position ``start`` up to ``stop``, from the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, -(-stop // self.block_ids)
        return self.blocks(first, last)[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document in order, reading each block about once."""
        held, held_from = np.zeros(0, "<u4"), 0
        for k in range(self.n_docs):
            a, b = int(self.bounds[k]), int(self.bounds[k + 1])
            if b > held_from + len(held):
                first, last = a // self.block_ids, min(self.n_blocks, -(-b // self.block_ids) + 8)
                held, held_from = self.blocks(first, last), first * self.block_ids
            yield (None if self.null[k] else int(self.doc_ids[k])), a, held[a - held_from : b - held_from]


def _writer(folder: str, tokenizer: str, end_id: int, bits: int, block_ids: int):
    schema = "part int, file string, n_docs long, n_ids long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode_all = encoder(tokenizer).encode_all
        end = np.array([end_id], "<u4")
        system, root = open_fs(folder)
        part = TaskContext.get().partitionId()
        writer = out = None
        for whole in batches:
            for batch in text_slices(whole, "text", ENCODE_BYTES):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_all(batch.column("text").to_pylist()), strict=True):
                    if writer is None:
                        # A name of its own for each attempt: one that is lost leaves a file that no row names.
                        name = f"{part:06d}-{uuid.uuid4().hex}.tokens"
                        system.create_dir(root, recursive=True)
                        out = system.open_output_stream(f"{root}/{name}")
                        writer = TokenFileWriter(out, bits, block_ids)
                    writer.add(doc_id, np.concatenate((ids, end)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [len(writer.ids)], "n_ids": [writer.n_ids]})

    return run, schema


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes bit-packed files in ascending order of the id.

    Returns part, file, start, n_docs, n_ids for each file; start counts the ids of the files before. Rows are dealt to
    files by ranges of the id (Spark samples the bounds), each of which is sorted and streamed into one file. Null texts
    are empty, null ids come first, rows with the same id follow each other in order of the first TIE characters of their
    text, so that many rows of one id, or without one, make several files too; other columns are ignored. An empty table
    writes no file and gives an empty result. ids of ``vocabulary`` or more can't occur.
    """
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    folder = folder or shared_folder(spark, "tokens")
    run, schema = _writer(folder, tokenizer, end_id, bits_of(vocabulary), block_ids)
    slim = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-total // FILE_BYTES))
    # Rows of one id and beginning are told apart by their place, which orders nothing.
    ranged = slim.repartitionByRange(parts, "doc_id", F.substring("text", 1, TIE), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "text")
    files = stored(ranged.mapInArrow(run, schema), f"{folder}/_index")
    # One row a file, so that one task can sum what lies before.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            system, path = open_fs(file)
            with system.open_input_file(path) as source:
                rows = [(doc_id, start + at, len(ids), zlib.crc32(ids)) for doc_id, at, ids in TokenFileReader(source).documents()]
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files that write_token_files() returned."""
    sizes = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_ids"), F.lit(0)).alias("ids")).first()
    # Whole files, dealt in turn: not by hash, which would leave some tasks with several and others with none.
    parts = max(1, min(sizes["files"], max(files.sparkSession.sparkContext.defaultParallelism, -(-sizes["ids"] // READ_IDS))))
    return files.select("file", "start").repartition(parts).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame) -> DataFrame:
    """Writes ``docs`` with the 50,257 ids of byte_bpe_50k.json and end id 2, and reads the files back."""
    files = write_token_files(docs, "byte_bpe_50k.json", 2, 50_257)
    return read_token_files(files)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
