"""WARC archives of pages, and an index of their captures merged from locally sorted runs."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, open_fs, shared_folder, stored, text_slices

#: Bytes after which a task begins another archive, captures after which it begins another run, and bytes read at once.
ARCHIVE_BYTES, RUN_CAPTURES, READ_BYTES = 256 << 20, 200_000, 4 << 20

#: Name of a record: its page's id; pages without an id have a random one.
NAME = re.compile(r"<urn:page:(-?\d+)>")

#: Marks a revisit record whose payload is that of another record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Captures of one range of the merged index, and bytes of archives that one task reads back.
RANGE_CAPTURES, TASK_BYTES = 500_000, 64 << 20

INDEX_SCHEMA = "run string, seq long, url_key string, captured_at long, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """A sort-friendly form of a URL: host parts from the right, no scheme, default port or fragment; '' for null."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    return f"{host}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, url: str, date: str, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record as one gzip member; with ``refers_to`` a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    gzip = zlib.compressobj(3, zlib.DEFLATED, 31)
    return gzip.compress("\r\n".join([*lines, "", ""]).encode() + body + b"\r\n\r\n") + gzip.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (names in lower case) and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}, payload


class LoserTree:
    """Merges sorted runs: the winner leaves, and its run's next entry plays only the losers on its way to the top."""

    def __init__(self, runs: list[Iterable]) -> None:
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.size = n = len(runs)
        self.losers = [-1] * n
        winners = [0] * n + list(range(n))
        for k in range(n - 1, 0, -1):
            a, b = winners[2 * k], winners[2 * k + 1]
            winners[k], self.losers[k] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if n > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def __iter__(self) -> Iterator:
        while self.size and (best := self.heads[self.winner]) is not None:
            yield best
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            k = (at + self.size) // 2
            while k:
                if self._before(self.losers[k], at):
                    at, self.losers[k] = self.losers[k], at
                k //= 2
            self.winner = at


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        out = name = None
        at, entries = 0, []

        def sorted_run() -> pa.RecordBatch:
            entries.sort(key=_order)
            label = uuid.uuid4().hex
            columns = list(zip(*entries, strict=True))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            arrays = [pa.array([label] * len(entries)), pa.array(range(len(entries)), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            entries.clear()
            return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in INDEX_SCHEMA.split(", ")])

        for whole in batches:
            for batch in text_slices(whole, "payload", READ_BYTES):
                columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "captured_at", "date", "payload", "refers_to"))
                for page_id, url, captured_at, date, payload, refers_to in zip(*columns, strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        # A name of its own for each attempt: one that is lost leaves an archive that no index names.
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        system.create_dir(root, recursive=True)
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    label = f"<urn:page:{page_id if page_id is not None else uuid.uuid4().hex}>"
                    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
                    data = record(label, target, date, payload.encode(), refers_to)
                    out.write(data)
                    entries.append((url_key(url), captured_at, page_id, f"{folder}/{name}", at, len(data)))
                    at += len(data)
                    if len(entries) >= RUN_CAPTURES:
                        yield sorted_run()
        if out is not None:
            out.close()
        if entries:
            yield sorted_run()

    return run


def _order(entry: tuple) -> tuple:
    """By URL key, time and page; no page first; then by place."""
    key, captured_at, page_id, file, offset, _ = entry
    return key, captured_at, page_id is not None, page_id or 0, file, offset


MERGED_SCHEMA = INDEX_SCHEMA.replace("run string, seq long, ", "") + ", part int, place long, nth long, previous_at long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the index: the slices of all runs, each in its run's order, come one after the other.

    In the merged order each capture gets its place in the range, its number among the range's captures of its URL key,
    and the time of the one before.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")][2:]
    runs: dict[str, list[pa.RecordBatch]] = {}
    for batch in batches:
        labels = batch.column("run").to_pylist()
        cuts = [0, *(i for i in range(1, len(labels)) if labels[i] != labels[i - 1]), len(labels)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                runs.setdefault(labels[a], []).append(batch.slice(a, b - a))

    def entries(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for row in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                yield _order(row), row

    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [x.split()[0] for x in MERGED_SCHEMA.split(", ")])
        held.clear()
        return out

    last_key = last_at = None
    nth = 0
    for place, (_, row) in enumerate(LoserTree([entries(parts) for parts in runs.values()])):
        nth, before = (nth + 1, last_at) if row[0] == last_key else (1, None)
        last_key, last_at = row[0], row[1]
        held.append((*row, part, place, nth, before))
        if len(held) == 20_000:
            yield batch()
    if held:
        yield batch()


def write_archives(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", captured: Column | None = None) -> DataFrame:
    """Writes a gzipped WARC record for each row; returns the runs of the index, one entry a record.

    Of records with the same payload (null as empty), the one with the largest page_id is a response and the others
    revisit it; rows that repeat that page_id are responses too, and so are all if none has an id. ``captured`` is the
    second of the capture; without it all are of 1970. Each task writes its own archives and, for at most RUN_CAPTURES
    captures at a time, a run of index entries sorted by URL key, time and page. Only payloads that occur more than once
    are joined to their keeper, by broadcast if they are few.
    """
    spark: SparkSession = pages.sparkSession
    bound_batches(spark)
    folder = folder or shared_folder(spark, "warc")
    captured = F.lit(0) if captured is None else captured
    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("page_id"), F.col(f"`{url_column}`").alias("url"), F.coalesce(captured.cast("long"), F.lit(0).cast("long")).alias("captured_at"), F.coalesce(F.col(f"`{payload_column}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("payload", "utf-8"))))
    keepers = rows.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("c")).where("c > 1 and keeper is not null").select("sha", "keeper")
    keepers = stored(keepers, f"{folder}/_keepers")
    few = F.broadcast(keepers) if keepers.count() <= BROADCAST_ROWS else keepers
    rows = rows.join(few, "sha", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper")), F.col("keeper")))
    rows = rows.withColumn("date", F.date_format(F.timestamp_seconds("captured_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    written = rows.select("page_id", "url", "captured_at", "date", "payload", "refers_to").mapInArrow(_write(folder), INDEX_SCHEMA)
    return stored(written, f"{folder}/_runs")


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in order of URL key, time and page: url_key, captured_at, page_id, file, offset, length, and of that
    order position (from 1, over all), nth (from 1, among those of the URL key) and previous_at (null for the first).

    Spark deals the runs to ranges of some RANGE_CAPTURES captures (a URL with very many captures is split by time and
    page), and each range is merged from its runs' slices by a tree of losers and written in its order, range by range.
    What carries over from one range to the next comes from one row for each range's first and last URL key.
    """
    spark = runs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-runs.count() // RANGE_CAPTURES))
    ranged = runs.repartitionByRange(parts, "url_key", "captured_at", "page_id", "file", "offset").sortWithinPartitions("run", "seq")
    merged = stored(ranged.mapInArrow(_merge, MERGED_SCHEMA), shared_folder(spark, "merged-index"))
    counts = merged.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    starts = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # one row a range
    # The URL key that a range ends with, how many of it are there, and its last time; each range's first one goes on from there.
    ends = merged.groupBy("part").agg(F.min_by("url_key", "place").alias("first_key"), F.max_by("url_key", "place").alias("last_key"), F.max_by("nth", "place").alias("last_n"), F.max_by("captured_at", "place").alias("last_at"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sides = ends.select("part", F.col("last_key").alias("key"), F.col("last_n").alias("n"), F.col("last_at").alias("at"), F.lit(False).alias("asks"))
    sides = sides.unionByName(ends.where("first_key <> last_key").select("part", F.col("first_key").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("at"), F.lit(True).alias("asks")))
    carried = sides.select("part", "key", F.sum("n").over(before).alias("more"), F.last("at", ignorenulls=True).over(before).alias("carried_at"))
    carried = starts.join(carried, "part").join(ends.select("part", "first_key"), "part").where("key = first_key").select("part", "key", "start", "more", "carried_at")
    # Two rows a range at most.
    out = merged.join(F.broadcast(starts), "part").join(F.broadcast(carried.select("part", F.col("key").alias("url_key"), "more", "carried_at")), ["part", "url_key"], "left")
    first = F.col("nth") == 1
    return out.select(*[x.split()[0] for x in MERGED_SCHEMA.split(", ")[:6]], (F.col("start") + F.col("place") + 1).alias("position"), (F.col("nth") + F.coalesce("more", F.lit(0))).alias("nth"), F.when(first, F.col("carried_at")).otherwise(F.col("previous_at")).alias("previous_at"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened = source = None
    held, held_from = b"", 0
    for batch in batches:
        rows = []
        for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            if file != opened:
                if source is not None:
                    source.close()
                system, path = open_fs(file)
                opened, source, held, held_from = file, system.open_input_file(path), b"", 0
            if offset < held_from or offset + length > held_from + len(held):
                source.seek(offset)
                held, held_from = source.read(max(length, READ_BYTES)), offset
            fields, http, payload = parse(held[offset - held_from : offset - held_from + length])
            kind = fields["warc-type"]
            name, refers_to = NAME.fullmatch(fields["warc-record-id"]), NAME.fullmatch(fields.get("warc-refers-to", ""))
            size, sha = (len(payload), digest(payload)) if kind == "response" else (int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"))
            rows.append((int(name[1]) if name else None, size, sha, kind, int(refers_to[1]) if refers_to else None, fields["warc-target-uri"]))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *(batch.column(c) for c in ("url_key", "captured_at", "position", "nth", "previous_at"))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "url_key", "captured_at", "position", "nth", "previous_at"])
    if source is not None:
        source.close()


def read_captures(index: DataFrame) -> DataFrame:
    """The records that entries of a merged index name, with what the index says of their order.

    Archives are read from front to back, in stretches of READ_BYTES that some tasks share. A response's length and
    digest are those of the payload read; a revisit's stand in its header.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    placed = index.repartition(parts, "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured_at long, position long, nth long, previous_at long")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Writes archives, merges their index and reads all captures back.

    Null and empty payloads are equal payloads of 0 bytes; null URLs have the key ''. Repeated rows give repeated
    records; other columns are ignored; an empty table writes nothing and gives an empty result. Memory: a task holds
    one record or 4 MB of them, a run's entries, or the entries of one range of the index.
    """
    return read_captures(merge_runs(write_archives(pages, **options)))


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # The table has no time of capture: page n is taken n seconds into 2020.
    return archive_pages(pages, captured=F.lit(1577836800) + F.col("page_id"))
