"""Token counts through a cache of digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, open_fs, shared_folder, stored, text_slices
from .encoding import encoder, tokenizer_path

#: Bytes of text whose pieces are made distinct together.
ENCODE_BYTES = 2 << 20

CACHE_SCHEMA = "content binary, version string, n_tokens long"


def tokenizer_version(name: str) -> str:
    """A digest of the tokenizer file: counts of one version serve no other."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _exists(folder: str) -> bool:
    system, path = open_fs(folder)
    return any(x.path.endswith(".parquet") for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def _counter(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer).encode_all
        for whole in batches:
            for batch in text_slices(whole, "text", ENCODE_BYTES):
                counts = [len(x) for x in encode_all(batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return run


#: A digest that more than this share of the rows have is joined by broadcast: there are at most 1000 of them.
HOT_SHARE = 1000


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, id_column: str = "doc_id", text_column: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``cache`` is a folder of Parquet files (content digest, tokenizer version, count) below which earlier counts are
    found; it is made if missing. Texts are joined to it by SHA-256 of their UTF-8 bytes (null as the empty text; no
    other normalisation, since any would change counts). Of the texts without a count, the row with the smallest id of
    each digest is encoded where it lies, and the new counts are appended by Spark's writer, so that a failed task leaves
    none. Only digests and ids are shuffled, and rows to leave out are broadcast if they are few; beyond that texts are
    shuffled by digest and id. Two runs that append the same digest agree on its count; a digest is taken once when the
    cache is read.

    Repeated rows and null ids are kept as they are; an empty text has 0 tokens; other columns are ignored; an empty
    table gives an empty result and appends nothing. Memory: a task holds 2 MB of texts or one text, and its encoder's
    memory of pieces.
    """
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    cache = cache or shared_folder(spark, "token-counts")
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("content"))
    rows = stored(keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), shared_folder(spark, "digests"))
    contents = stored(rows.groupBy("content").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")), shared_folder(spark, "contents"))
    wanted = contents.select("content", "first_id")
    if _exists(cache):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version).select("content")
        wanted = wanted.join(known, "content", "left_anti")
    wanted = stored(wanted, shared_folder(spark, "wanted"))
    missing = _chosen(keyed, rows, wanted)
    counted = missing.mapInArrow(_counter(tokenizer), "content binary, n_tokens long").dropDuplicates(["content"])
    counted.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    hot = F.col("n_rows") * HOT_SHARE > rows.count()
    own = stored(contents.withColumn("hot", hot).join(counts, "content"), shared_folder(spark, "own-counts"))
    often = own.where("hot").select("content", "n_tokens")
    found = rows.join(F.broadcast(often), "content", "left")
    out = found.where("n_tokens is not null").unionByName(found.where("n_tokens is null").drop("n_tokens").join(own.where("not hot").select("content", "n_tokens"), "content"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _chosen(keyed: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (doc_id, text, content) that are wanted (content, first_id)."""
    spark = keyed.sparkSession
    w = wanted.select(F.col("content").alias("w_content"), F.col("first_id"))
    here = (rows["content"] == w["w_content"]) & rows["doc_id"].eqNullSafe(w["first_id"])
    skipped = stored(rows.join(w, here, "left_anti").select(F.col("content").alias("s_content"), F.col("doc_id").alias("s_id")).distinct(), shared_folder(spark, "skipped"))
    if skipped.count() <= BROADCAST_ROWS:
        skipped = F.broadcast(skipped)
    return keyed.join(skipped, (keyed["content"] == skipped["s_content"]) & keyed["doc_id"].eqNullSafe(skipped["s_id"]), "left_anti").select("content", "text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first pass counts the documents whose id is divisible by 100 and fills the cache; the second counts all and finds those there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cache = shared_folder(spark, "token-counts")
    token_counts(docs.where("doc_id % 100 = 0"), "piece_bpe_32k.model", cache)
    return token_counts(docs, "piece_bpe_32k.model", cache)
