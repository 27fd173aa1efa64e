"""Conversations as token ids with a loss mask: segments encoded apart, reserved ids between them.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. The two marks are ids of their own, past the tokenizer's, and never come
from text: in roles and texts each ``<|`` gets a backslash in its middle, and one that has backslashes there already gets
one more, so that escaping can be undone and no control string of this form is left. In roles, backslashes and ends of
lines are escaped before that, as the first end of a line ends the role.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, shared_folder, stored, text_slices
from .encoding import ByteLevelEncoder, encoder, tokenizer_path

START, END = "<|im_start|>", "<|im_end|>"

#: Roles whose texts are learned.
LEARNED = ("assistant",)

#: Bytes of text that are encoded together, and ids from which a conversation goes on in another piece.
ENCODE_BYTES, PIECE_IDS = 2 << 20, 1 << 20

ESCAPED = re.compile(rb"<(\\*)\\\|")
ROLE_ESCAPES = {b"\\\\": b"\\", b"\\n": b"\n"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: bytes) -> bytes:
    return ESCAPED.sub(rb"<\1|", text) if b"<\\" in text else text


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\[\\n]", lambda m: ROLE_ESCAPES[m[0]], unescape(role))


@functools.lru_cache(maxsize=4)
def reserved_ids(tokenizer: str) -> tuple[int, int]:
    """The ids of the two marks: the first past the tokenizer's."""
    own = encoder(tokenizer)
    if not isinstance(own, ByteLevelEncoder) or not own.by_pieces:
        raise ValueError(f"{tokenizer} doesn't keep texts as they are: a byte-level tokenizer is needed")
    size = own.tokenizer.get_vocab_size(with_added_tokens=True)
    return size, size + 1


@functools.lru_cache(maxsize=4)
def token_bytes(tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, marks included, with each id's start and length."""
    start, end = reserved_ids(tokenizer)
    own = encoder(tokenizer)
    back = {chr(c): c for c in range(256) if c not in own.alphabet} | {chr(v): c for c, v in own.alphabet.items()}
    with open(tokenizer_path(tokenizer), encoding="utf-8") as f:
        added = {x["id"]: x["content"].encode() for x in json.load(f).get("added_tokens") or []}
    table = {start: START.encode(), end: END.encode(), **{i: bytes(back[c] for c in token) for token, i in own.tokenizer.get_vocab(with_added_tokens=False).items()}, **added}
    lengths = np.array([len(table.get(i, b"")) for i in range(end + 1)], np.int64)
    return np.frombuffer(b"".join(table.get(i, b"") for i in range(end + 1)), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode(ids: np.ndarray, tokenizer: str) -> tuple[bytes, np.ndarray]:
    """The text of ids as UTF-8, and where in it each id begins (one more at the end)."""
    flat, starts, lengths = token_bytes(tokenizer)
    own = lengths[ids]
    begins = np.concatenate(([0], np.cumsum(own)))
    return flat[np.repeat(starts[ids] - begins[:-1], own) + np.arange(begins[-1])].tobytes(), begins


def assemble(headers: list[np.ndarray], texts: list[np.ndarray], learned: np.ndarray, marks: tuple[int, int], line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of turns in a row, and where each turn begins (one more at the end).

    The mask is a running sum of +1 where a learned text begins and -1 where it ends.
    """
    start, end = (np.array([x], "<u4") for x in marks)
    before = 1 + np.fromiter(map(len, headers), np.int64, len(headers))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(before + sizes + 1 + len(line))))
    ids = np.concatenate([x for h, t in zip(headers, texts, strict=True) for x in (start, h, t, end, line)]) if headers else np.zeros(0, "<u4")
    steps = np.zeros(len(ids) + 1, np.int8)
    first = (begins[:-1] + before)[learned]
    steps[first] += 1
    steps[first + sizes[learned]] -= 1
    return ids, np.cumsum(steps[:-1]).astype(np.uint8), begins


PIECE_SCHEMA = "conv_id long, place long, open boolean, count long, ids binary, mask binary"


def _pieces(tokenizer: str, piece_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, marks = encoder(tokenizer).encode_all, reserved_ids(tokenizer)
        line = encode_all(["\n"])[0]
        place, conv, begun, ids, mask = TaskContext.get().partitionId() << 33, None, False, [], []
        open_ = True  # the first conversation may have begun in another task

        def piece(may_go_on: bool) -> pa.RecordBatch:
            every = np.concatenate(ids)
            return pa.RecordBatch.from_pydict(
                {"conv_id": pa.array([conv], pa.int64()), "place": pa.array([place], pa.int64()), "open": pa.array([may_go_on]), "count": pa.array([len(every)], pa.int64()),
                 "ids": pa.array([every.astype("<u4").tobytes()], pa.binary()), "mask": pa.array([np.packbits(np.concatenate(mask), bitorder="little").tobytes()], pa.binary())}
            )

        for whole in batches:
            for batch in text_slices(whole, "text", ENCODE_BYTES):
                headers = encode_all([f"{x}\n" for x in batch.column("role").to_pylist()])
                learned = batch.column("learned").to_numpy(zero_copy_only=False).astype(bool)
                flat, flags, begins = assemble(headers, encode_all(batch.column("text").to_pylist()), learned, marks, line)
                convs, at = batch.column("conv_id").to_pylist(), 0
                while at < len(convs):
                    if begun and (conv != convs[at] or sum(map(len, ids)) >= piece_ids):
                        goes_on = conv == convs[at]
                        yield piece(open_ or goes_on)
                        place, ids, mask, open_ = place + 1, [], [], goes_on
                    begun, conv, stop = True, convs[at], at + 1
                    while stop < len(convs) and convs[stop] == conv and begins[stop] - begins[at] < piece_ids:
                        stop += 1
                    ids.append(flat[begins[at] : begins[stop]])
                    mask.append(flags[begins[at] : begins[stop]])
                    at = stop
        if begun:
            yield piece(True)

    return run


def format_conversations(rows: DataFrame, tokenizer: str = "byte_bpe_50k.json", learned: tuple[str, ...] = LEARNED, piece_ids: int = PIECE_IDS) -> DataFrame:
    """Pieces of formatted conversations: conv_id, place (their order), open, count, ids (32 bits each) and mask (a bit each).

    ``rows`` has conv_id, turn, role and text; other columns are ignored. Turns of a conversation come by turn (null
    first), then role, then MD5 of the text. Null roles and texts are empty; rows without conv_id are one conversation;
    repeated rows are turns of their own; an empty table gives no pieces. Very long texts stay whole.

    Rows are dealt by ranges of conversation and turn, so that a conversation of any length spreads over tasks. One that
    reaches a bound of its task's range, or ``piece_ids`` ids, goes on in further pieces; such pieces are ``open``.
    """
    bound_batches(rows.sparkSession)
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("plain"), F.md5(text).alias("tie"), F.monotonically_increasing_id().alias("read"), escape_role(role).alias("role"), escape(text).alias("text"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("plain").asc(), F.col("tie").asc(), F.col("read").asc()]
    dealt = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return dealt.select("conv_id", "role", "text", F.col("plain").isin(*learned).alias("learned")).mapInArrow(_pieces(tokenizer, piece_ids), PIECE_SCHEMA)


READ_SCHEMA = "conv_id long, place long, open boolean, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long"


def _characters(text: bytes | np.ndarray) -> int:
    """Code points of UTF-8: bytes that don't continue one."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def read_piece(ids: np.ndarray, mask: np.ndarray, tokenizer: str) -> tuple[list[tuple[bytes, bytes]], bytes, bytes]:
    """The turns (role, text) that ids hold, the text under the mask, and the whole formatted text."""
    start, end = reserved_ids(tokenizer)
    text, begins = decode(ids, tokenizer)
    turns = []
    for s, e in zip(np.flatnonzero(ids == start), np.flatnonzero(ids == end), strict=True):
        role, _, said = text[begins[s + 1] : begins[e]].partition(b"\n")
        turns.append((unescape_role(role), unescape(said)))
    steps = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    runs = zip(np.flatnonzero(steps > 0), np.flatnonzero(steps < 0), strict=True)
    return turns, b"".join(unescape(text[begins[a] : begins[b]]) for a, b in runs), text


def _read(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("n_turns", "turns", "loss", "loss_chars", "formatted_chars")}
            for count, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("count", "ids", "mask")), strict=True):
                bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=count, bitorder="little")
                turns, loss, text = read_piece(np.frombuffer(ids, "<u4"), bits, tokenizer)
                out["n_turns"].append(len(turns))
                out["turns"].append(b"".join(b"%s\n%s\n" % turn for turn in turns))
                out["loss"].append(loss)
                out["loss_chars"].append(_characters(loss))
                out["formatted_chars"].append(_characters(text))
            kept = {name: batch.column(name) for name in ("conv_id", "place", "open")}
            yield pa.RecordBatch.from_pydict(kept | {name: pa.array(x, pa.binary() if name in ("turns", "loss") else pa.int64()) for name, x in out.items()})

    return run


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in their order, one conversation after the other, with digests that run on from piece to piece."""
    names = ("n_turns", "loss_chars", "formatted_chars")
    state: tuple | None = None

    def row(conv, totals, digests) -> pa.RecordBatch:
        columns = {"conv_id": pa.array([conv], pa.int64()), **{n: pa.array([x], pa.int64()) for n, x in zip(names, totals, strict=True)}}
        return pa.RecordBatch.from_pydict(columns | {n: pa.array([d.hexdigest()]) for n, d in zip(("turns_sha256", "loss_sha256"), digests, strict=True)})

    for batch in batches:
        for k in range(batch.num_rows):
            conv = batch.column("conv_id")[k].as_py()
            if state is None or state[0] != conv:
                if state is not None:
                    yield row(*state)
                state = (conv, [0, 0, 0], (hashlib.sha256(), hashlib.sha256()))
            for i, name in enumerate(names):
                state[1][i] += batch.column(name)[k].as_py()
            for digest, name in zip(state[2], ("turns", "loss"), strict=True):
                digest.update(batch.column(name)[k].as_py())
    if state is not None:
        yield row(*state)


def conversation_digests(pieces: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from pieces.

    Conversations of one piece are digested where they lie. Those in several pieces meet in order: a digest runs from a
    text's start to its end, so one task reads such a conversation, piece by piece, and holds none of it.
    """
    bound_batches(pieces.sparkSession)
    found = stored(pieces.mapInArrow(_read(tokenizer), READ_SCHEMA), shared_folder(pieces.sparkSession, "chat-read"))
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    whole = found.where("not open").withColumn("turns_sha256", F.sha2("turns", 256)).withColumn("loss_sha256", F.sha2("loss", 256))
    parts = found.where("open").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    joined = parts.mapInArrow(_join_pieces, "conv_id long, n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string")
    return whole.select(columns).unionByName(joined.select(columns))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{END}{START}assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added)
    pieces = stored(format_conversations(rows), shared_folder(spark, "chat"))
    return conversation_digests(pieces)
