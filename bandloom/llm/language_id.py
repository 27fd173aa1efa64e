"""Language identification with error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, shared_folder, stored, text_bytes, text_slices, without_rows

#: Buckets of hashed three-byte grams.
BUCKET_BITS = 15

#: Units of a stored weight, so that a text's sum is a whole number and doesn't depend on what lies beside it.
UNITS = 1 << 16

#: Below this difference between the two nearest codewords' losses a prediction is flagged as ambiguous.
AMBIGUOUS = 0.1

#: A-Z to a-z, ASCII other than letters to spaces; bytes from 0x80 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all three-byte grams, first and last-plus-one gram of each text, and whether it has a letter."""
    raw = data.tobytes().translate(FOLD)
    n = len(offsets) - 1
    parts = [raw[offsets[i] : offsets[i + 1]] for i in range(n)]
    # A space on both sides of each text, and one more, so that the last text's end is a place in the array.
    joined = np.frombuffer(b" " + b"  ".join(parts) + b"  ", np.uint8).astype(np.uint32)
    codes = (joined[:-2] << np.uint32(16)) | (joined[1:-1] << np.uint32(8)) | joined[2:]
    buckets = (codes * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    sizes = np.diff(offsets)
    first = offsets[:-1] + 2 * np.arange(n)
    return buckets.astype(np.int32), first, first + sizes, np.array([_has_letter(x) for x in parts], bool)


def _has_letter(part: bytes) -> bool:
    text = part.strip()
    if not text:
        return False
    return any(97 <= c <= 122 for c in text[:64]) or any(x.isalpha() for x in text.decode("utf-8", "ignore"))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1. All ways to split up to 7 languages in two; beyond, the best of some random codes."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        return np.array([(1, *x) for x in product((1, -1), repeat=n - 1) if -1 in x], np.int8).T
    rng = np.random.default_rng(seed)
    best, found = -1, None
    for _ in range(32):
        code = rng.choice(np.array([-1, 1], np.int8), (n, 10 * (n - 1).bit_length()))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code.astype(int) @ code.T) // 2
        least = int((apart + np.eye(n, dtype=int) * 10**6).min())
        if least > best:
            best, found = least, code
    return found


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, of +1 and -1
    weights: np.ndarray  # bits x buckets, in UNITS
    middle: np.ndarray  # of each bit, what lies between its two sides
    half: np.ndarray  # of each bit, from the middle to the nearer side
    trust: np.ndarray  # of each bit, its share of the loss

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language of each text (-1: no letter), its score, and the difference to the second loss."""
        buckets, first, stop, letters = grams(data, offsets)
        n = len(first)
        rows = np.flatnonzero(stop > first)
        margins = np.zeros((n, len(self.middle)))
        if len(rows) and len(self.middle):
            cuts = np.stack((first[rows], stop[rows]), 1).reshape(-1)
            for b in range(len(self.middle)):
                sums = np.add.reduceat(self.weights[b][buckets], cuts, dtype=np.int64)[::2]
                margins[rows, b] = (sums / (UNITS * (stop - first)[rows]) - self.middle[b]) / self.half[b]
        # Loss-weighted decoding: each bit's logistic loss against the codeword, by the trust in the bit.
        as_plus, as_minus = np.logaddexp(0, -2 * margins) * self.trust, np.logaddexp(0, 2 * margins) * self.trust
        loss = np.round(as_plus @ (self.code > 0).T.astype(float) + as_minus @ (self.code < 0).T.astype(float), 9)
        if not self.languages:
            return np.full(n, -1), np.zeros(n), np.zeros(n)
        best = np.argmin(loss, axis=1)
        odds = np.exp(-4 * (loss - loss[np.arange(n), best][:, None]))
        score = 1 / odds.sum(axis=1)
        gap = np.partition(loss, 1, axis=1)[:, 1] - loss[np.arange(n), best] if loss.shape[1] > 1 else np.ones(n)
        return np.where(letters, best, -1), np.where(letters, score, 0.0), np.where(letters, gap, 0.0)


def _weigh(languages: dict[str, int], code: np.ndarray, sizes: np.ndarray):
    """For each bucket of sorted (lang, bucket, n): the weights of the bits. Each language has the same say in a bit's two sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus, minus = (code > 0).astype(float), (code < 0).astype(float)
        share = 1 / (sizes + 0.5 * (1 << BUCKET_BITS))
        buckets, sums = [], []
        for batch in batches:
            rows = np.array([languages[x] for x in batch.column("lang").to_pylist()], np.int64)
            own = batch.column("n").to_numpy().astype(float) * share[rows]
            for bucket, row, x in zip(batch.column("bucket").to_pylist(), rows.tolist(), own.tolist(), strict=True):
                if not buckets or bucket != buckets[-1]:
                    buckets.append(bucket)
                    sums.append(np.stack((0.5 * share @ plus, 0.5 * share @ minus)))
                sums[-1] += x * np.stack((plus[row], minus[row]))
        if buckets:
            weights = [_weights(x, code) for x in sums]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int32()), "weights": pa.array([w.tolist() for w in weights], pa.list_(pa.int32()))})

    return run


def _weights(sums: np.ndarray, code: np.ndarray) -> np.ndarray:
    means = sums / np.stack(((code > 0).sum(axis=0), (code < 0).sum(axis=0)))
    return np.round((np.log(means[0]) - np.log(means[1])) * UNITS).astype(np.int32)


def _moments(shared):
    """For each language of sorted (lang, bucket, n): the sums over its grams of each bit's weights and of their squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            w = weights[:, batch.column("bucket").to_numpy()] / UNITS
            n = batch.column("n").to_numpy().astype(float)
            langs = np.array(batch.column("lang").to_pylist())
            for lang in np.unique(langs).tolist():
                own = np.flatnonzero(langs == lang)
                part = np.stack((w[:, own] @ n[own], w[:, own] ** 2 @ n[own]))
                sums[lang] = sums.get(lang, 0) + part
        for lang, x in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "first": pa.array([x[0].tolist()], pa.list_(pa.float64())), "second": pa.array([x[1].tolist()], pa.list_(pa.float64()))})

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in text_slices(whole, "text"):
            buckets, first, stop, _ = grams(*text_bytes(batch.column("text")))
            langs, index = np.unique(np.array(batch.column("lang").to_pylist()), return_inverse=True)
            owner = np.repeat(np.arange(len(first)), stop - first)
            own = buckets[np.arange(len(owner)) + 2 * owner]
            new = np.bincount((index[owner] << BUCKET_BITS) + own, minlength=len(langs) << BUCKET_BITS).reshape(len(langs), -1)
            for lang, counts in zip(langs.tolist(), new, strict=True):
                sums[lang] = sums.get(lang, 0) + counts
    for lang, counts in sums.items():
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(full), "bucket": pa.array(full, pa.int32()), "n": pa.array(counts[full], pa.int64())})


def train(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """A model from all rows whose text and language are not null: grams are counted and weighed in tasks.

    Any number of languages: the driver holds their names and codewords and the bits' weights, not their counts.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").alias("lang")).where("text is not null and lang is not null")
    spark = rows.sparkSession
    sums = stored(rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), shared_folder(spark, "gram-counts"))
    found = sorted((r["lang"], r["n"]) for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect())  # one row a language
    languages, sizes = [x for x, _ in found], np.array([n for _, n in found], float)
    code = codewords(len(languages))
    buckets = 1 << BUCKET_BITS
    bits = code.shape[1]
    if not bits:
        none = np.zeros(0)
        return LanguageModel(languages, code, np.zeros((0, buckets), np.int32), none, none, none)
    # A bucket's languages meet in one task, and so do a language's buckets; the driver gets a row for each, as wide as a
    # codeword, which grows with the logarithm of the number of languages.
    numbers = {x: k for k, x in enumerate(languages)}
    by_bucket = sums.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(_weigh(numbers, code, sizes), "bucket int, weights array<int>")
    share = 1 / (sizes + 0.5 * buckets)
    unseen = _weights(np.stack((0.5 * share @ (code > 0), 0.5 * share @ (code < 0))), code)
    weights = np.repeat(unseen[:, None], buckets, axis=1)
    for row in by_bucket.collect():
        weights[:, row["bucket"]] = row["weights"]
    by_lang = sums.repartition("lang").sortWithinPartitions("lang", "bucket").mapInArrow(_moments(spark.sparkContext.broadcast(weights)), "lang string, first array<double>, second array<double>")
    first, second = np.zeros((len(languages), bits)), np.zeros((len(languages), bits))
    for row in by_lang.collect():
        first[numbers[row["lang"]]], second[numbers[row["lang"]]] = row["first"], row["second"]
    w = weights / UNITS
    means = (first + 0.5 * w.sum(axis=1)) * share[:, None]
    spread = np.sqrt(np.maximum((second + 0.5 * (w**2).sum(axis=1)) * share[:, None] - means**2, 1e-12))
    low, high = np.where(code > 0, means, np.inf).min(axis=0), np.where(code < 0, means, -np.inf).max(axis=0)
    trust = np.maximum((low - high) / spread.max(axis=0), 1e-6)
    return LanguageModel(languages, code, weights, (low + high) / 2, np.maximum((low - high) / 2, 1e-6), trust / trust.sum())


def _identified(docs: DataFrame, model: LanguageModel, keep: list[str], text_column: str) -> tuple[DataFrame, list]:
    """lang_pred, score, ambiguous beside k0, k1, ... for the ``keep`` columns, and these under their own names."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_column}`").alias("read_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array([*shared.value.languages, "und"], object)
        for whole in batches:
            for batch in text_slices(whole, "read_text"):
                best, score, gap = shared.value.predict(*text_bytes(batch.column("read_text")))
                columns = [batch.column(n) for n in names]
                columns += [pa.array(languages[best], pa.string()), pa.array(score), pa.array((gap < AMBIGUOUS) & (best >= 0))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", "ambiguous"])

    kept = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    return slim.mapInArrow(run, f"{kept}, lang_pred string, score double, ambiguous boolean"), [F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text_column: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with lang_pred, score and ambiguous, from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0. score is the share of the nearest codeword among all,
    each weighted by the exponential of its loss; ambiguous says that the second codeword is about as near. A model
    without languages finds ``und`` alone, one with one language finds that or ``und``. Repeated rows get equal answers;
    an empty table gives an empty result.
    """
    out, kept = _identified(docs, model, keep, text_column)
    return out.select(*kept, "lang_pred", "score", "ambiguous")


def held_out(doc_id: Column) -> Column:
    """Rows that the queries never learn from: crc32 of the id as text, modulo 4, is 2; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> LanguageModel:
    return train(docs.where(~held_out(F.col("doc_id"))))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which a language is found (lang_pred is not ``und``), columns unchanged.

    Ambiguous texts stay: they are in some language.
    """
    slim = docs.select(F.col("doc_id").alias("gone_id"), F.col("text"), F.xxhash64("text").alias("gone_hash"))
    return without_rows(docs, identify(slim, train_on_documents(docs), ["gone_id", "gone_hash"]).where("lang_pred = 'und'"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train_on_documents(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
