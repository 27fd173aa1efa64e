"""Secret scanning: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, shared_folder, stored, text_slices

#: A whole run of key characters, a name with its equals signs at the beginning of one, and a shorter value that a naming
#: word assigns.
RUN = re.compile(r"[A-Za-z0-9_+/=.-]{15,}+")
NAME = re.compile(r"[0-9+/.-]*+[A-Za-z_][A-Za-z0-9_+/.-]*+=++")
SHORT = re.compile(r"(?:pass|pwd|secret|token|key|auth)[a-z]*[\"']?\s?(?:=>|[:=])\s?[\"'`]?([^\s\"'`,;:=]{6,14})(?![^\s\"'`,;])", re.IGNORECASE)

#: Words that name a secret when they stand before it, and words of placeholders, samples and tests.
NAMING = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential", "private")
PLACEHOLDER = ("example", "sample", "dummy", "test", "demo", "fake", "mock", "placeholder", "changeme", "your", "null", "none", "todo", "lorem", "default", "password", "secret", "token", "http", "https", "www", "com", "org", "net", "mail", "html", "index", "image")

#: Labelled findings that the forest is fitted on at most, more being thinned by a hash of the finding; where fewer than
#: LEAST_LABELLED are given, planted ones are added. Times that a value of each label is planted, about: one a document
#: where there are as many documents, else more.
MOST_LABELLED, LEAST_LABELLED, PLANTED_VALUES = 20_000, 40, 4_000

#: Words of the dictionary: those of 3 to 12 letters that stand in most documents of the corpus.
DICTIONARY_WORDS = 50_000

FEATURES = ("length", "entropy", "transitions", "digits", "upper", "hexadecimal", "symbols", "longest_run", "fixed_words", "dictionary", "naming_word", "placeholder_near", "assigned", "quoted", "path_depth", "path_sample", "left_bucket", "right_bucket")

SCHEMA = "doc_id long, start long, end long, left_word string, features array<double>, secret_sha256 string"


def _kind(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s"


def _covered(candidate: str, dictionary: frozenset[str]) -> float:
    """Share of a candidate's characters that lie in words of a dictionary, taken from left to right, longest first."""
    low, at, hit = candidate.lower(), 0, 0
    while at < len(low):
        size = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at : at + n] in dictionary), 0)
        hit += size
        at += size or 1
    return hit / len(low)


_FIXED = frozenset(PLACEHOLDER)


def features(text: str, start: int, end: int, path: str | None, dictionary: frozenset[str]) -> tuple[list[float], str]:
    """The features of a candidate and the word on its left."""
    x = text[start:end]
    n = len(x)
    kinds = [_kind(c) for c in x]
    counts = Counter(x)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    transitions = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    before, after = text[max(0, start - 48) : start], text[end : end + 48]
    left = (re.findall(r"\w+", before) or [""])[-1].lower()
    right = (re.findall(r"\w+", after) or [""])[0].lower()
    near = set(re.findall(r"[a-z]+", (before + " " + after).lower()))
    path = path or ""
    values = [
        n, entropy, transitions, kinds.count("d") / n, kinds.count("u") / n, sum(c in "0123456789abcdefABCDEF" for c in x) / n, kinds.count("s") / n,
        max(len(list(g)) for _, g in groupby(kinds)), _covered(x, _FIXED), _covered(x, dictionary),
        float(any(w in left for w in NAMING)), float(bool(near & _FIXED)), float(bool(re.search(r"[:=]>?\s*[\"'`]?$", before))), float(before[-1:] in "\"'`" and after[:1] in "\"'`" and before != ""),
        path.count("/"), float(any(w in path.lower() for w in PLACEHOLDER[:8])), int(hashlib.md5(left.encode()).hexdigest()[:2], 16) % 16, int(hashlib.md5(right.encode()).hexdigest()[:2], 16) % 16,
    ]
    return [float(v) for v in values], left


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Where candidates begin and end, in order: whole runs, or what follows ``NAME=`` in one; a name that is long and has
    digits is one too; and shorter values of 6 characters or more that a naming word assigns."""
    found = set()
    for m in RUN.finditer(text):
        start, end = m.start(), m.start() + len(m[0].rstrip("-=./+_") or m[0])
        plain = text[start].isalnum()
        while (name := NAME.match(text, start, end)) and end - name.end() >= 15:
            own = start + len(text[start : name.end()].rstrip("-=./+_"))
            if plain and own - start >= 15 and any(c.isdigit() for c in text[start:own]):
                found.add((start, own))
            start, plain = name.end(), True
        if plain and end - start >= 15:
            found.add((start, end))
    starts = {a for a, _ in found}
    found.update(m.span(1) for m in SHORT.finditer(text) if m.start(1) not in starts)
    yield from sorted(found)


def _rows(doc_id: int | None, path: str | None, text: str, dictionary: frozenset[str]) -> Iterator[tuple]:
    for start, end in spans(text):
        values, left = features(text, start, end, path, dictionary)
        yield doc_id, start, end, left, values, hashlib.sha256(text[start:end].encode()).hexdigest()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _candidates(dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", 4 << 20):
                columns = (batch.column(c).to_pylist() for c in ("doc_id", "path", "text"))
                yield _batch([row for i, path, text in zip(*columns, strict=True) for row in _rows(i, path, text or "", dictionary.value)], SCHEMA)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): documents of each word of 3 to 12 letters, in parts."""
    sums: dict[str, int] = {}

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
        sums.clear()
        return out

    for whole in batches:
        for part in text_slices(whole, "text", 2 << 20):
            lists = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(part.column("text").cast(pa.large_string()), "")), r"[^\p{L}]+", " "), " ")
            words = lists.values.dictionary_encode()
            offsets = lists.offsets.to_numpy()
            texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            codes = words.indices.to_numpy().astype(np.int64)
            pairs = np.unique(codes * len(offsets) + texts)
            counts = np.bincount(pairs // len(offsets), minlength=len(words.dictionary))
            for word, n in zip(words.dictionary.to_numpy(zero_copy_only=False).tolist(), counts.tolist(), strict=True):
                if 3 <= len(word) <= 12:
                    sums[word] = sums.get(word, 0) + n
            if len(sums) > 300_000:
                yield batch()
    if sums:
        yield batch()


def corpus_dictionary(docs: DataFrame, text_column: str = "text", most: int = DICTIONARY_WORDS) -> frozenset[str]:
    """The ``most`` words that stand in most documents, of at least two."""
    bound_batches(docs.sparkSession)
    counts = docs.select(F.col(f"`{text_column}`").alias("text")).mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Written first: each task's words meet in a task, and only those that are left come to the driver.
    top = stored(counts.where("n > 1").orderBy(F.desc("n"), "word").limit(most).select("word"), shared_folder(docs.sparkSession, "dictionary"))
    return frozenset(r["word"] for r in top.collect())


def find_candidates(docs: DataFrame, dictionary, id_column: str = "doc_id", path_column: str = "source", text_column: str = "text") -> DataFrame:
    """A row for each candidate: doc_id, start, end (characters), left_word, features, secret_sha256. ``dictionary`` is a broadcast set of words."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{path_column}`").cast("string").alias("path"), F.col(f"`{text_column}`").alias("text"))
    return slim.mapInArrow(_candidates(dictionary), SCHEMA)


#: How a planted value stands in a text, and names before it that do or don't name secrets.
CARRIERS = ('{name} = "{value}"', "{name}: {value}", "{upper}={value}", '"{name}": "{value}",', "{name}='{value}'", "{name} {value}", "export {upper}={value}", "({name}: {value})")
SECRET_NAMES = ("token", "api_key", "secret", "password", "auth_token", "private_key", "access_key", "client_secret")
OTHER_NAMES = ("id", "path", "file", "version", "commit", "checksum", "url", "name", "build", "ref", "see", "card", "host", "mail", "date")


def planted_value(rng: random.Random, secret: bool, words: list[str]) -> str:
    """A random key, or what only looks like one: words, paths, addresses, versions, numbers, identifiers, placeholders."""
    letters = string.ascii_letters + string.digits
    draw = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    word = lambda: rng.choice(words)
    if secret:
        return rng.choice([
            lambda: draw("0123456789abcdef", rng.choice((32, 40, 64))), lambda: draw(letters, rng.randrange(16, 48)), lambda: draw(letters + "+/", rng.randrange(20, 88)), lambda: draw(letters, 2) + "_" + draw(letters, rng.randrange(20, 40)),
            lambda: draw(string.ascii_uppercase + string.digits, rng.choice((16, 20))), lambda: word()[:4] + draw(letters + "_-", rng.randrange(4, 10)),
        ])()
    number = lambda n: draw("0123456789", n)
    return rng.choice([
        lambda: rng.choice("-_.").join(word() for _ in range(rng.randrange(2, 5))), lambda: "".join(word().capitalize() for _ in range(rng.randrange(2, 5))), lambda: word() + word() + word(), lambda: "/".join(word() for _ in range(rng.randrange(3, 6))) + "." + word()[:3],
        lambda: f"www.{word()}.example.com/{word()}", lambda: f"{word()}.{number(2)}-mail{number(1)}.example.com", lambda: ".".join(number(rng.randrange(2, 4)) for _ in range(4)), lambda: number(rng.randrange(15, 20)), lambda: f"20{number(2)}-{number(2)}-{number(2)}T{number(2)}.{number(2)}.{number(2)}",
        lambda: "-".join(draw("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: rng.choice(("your", "example", "dummy", "changeme", "xxxx")) + rng.choice("-_") + rng.choice(SECRET_NAMES) + rng.choice(("", "-here", "_value", "-1234")), lambda: rng.choice("x0*a") * rng.randrange(16, 40),
        lambda: word() + word()[:6],
    ])()


def plant(doc_id: int | None, text: str, secret: bool, words: list[str], seed: int) -> tuple[str, int, int]:
    """A text with a value planted between two of its words, and where the value stands. What stands around it doesn't give the label away."""
    rng = random.Random(f"{seed} {doc_id} {secret}")
    name = rng.choice(SECRET_NAMES if rng.random() < (0.85 if secret else 0.3) else OTHER_NAMES)
    value = planted_value(rng, secret, words or ["word", "other"])
    before, _, after = rng.choice(CARRIERS).partition("{value}")
    before, after = (x.format(name=name, upper=name.upper()) for x in (before, after))
    gap = re.compile(r"\s").search(text, rng.randrange(len(text) + 1))
    at = gap.start() if gap else len(text)
    start = at + 1 + len(before)
    return f"{text[:at]} {before}{value}{after} {text[at:]}", start, start + len(value)


def _planted(dictionary, seed: int, times: int):
    schema = SCHEMA + ", label int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sorted(w for w in dictionary.value if len(w) >= 4)
        for whole in batches:
            for batch in text_slices(whole, "text", 4 << 20):
                rows = []
                for doc_id, path, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "path", "text")), strict=True):
                    for secret, nth in product((True, False), range(times)):
                        more, start, end = plant(doc_id, text or "", secret, words, seed + nth * 1_000_003)
                        near = more[max(0, start - 200) : end + 200]
                        shift = max(0, start - 200)
                        for a, b in spans(near):
                            if a + shift < end and b + shift > start:
                                values, left = features(more, a + shift, b + shift, path, dictionary.value)
                                rows.append((doc_id, a + shift, b + shift, left, values, hashlib.sha256(near[a:b].encode()).hexdigest(), int(secret)))
                yield _batch(rows, schema)

    return run, schema


def planted_findings(docs: DataFrame, dictionary, most: int = PLANTED_VALUES, seed: int = 1, id_column: str = "doc_id", path_column: str = "source", text_column: str = "text") -> DataFrame:
    """Labelled findings (candidates with label) from about ``most`` documents, chosen by a hash of id and text, each with a
    random key planted in it and, apart from that, something that only looks like one. Fewer documents get as many values
    by turns, anywhere in them, so that the forest has its sample over any table that has a text. The label is known from
    what was planted; no feature is asked."""
    slim = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{path_column}`").cast("string").alias("path"), F.col(f"`{text_column}`").alias("text")).where("text is not null")
    n = max(1, slim.count())
    share = most / n
    run, schema = _planted(dictionary, seed, max(1, -(-most // n)))
    return slim.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).mapInArrow(run, schema)


def fit_forest(findings: DataFrame, most: int = MOST_LABELLED, trees: int = 24, depth: int = 7, seed: int = 3, least_labelled: int = LEAST_LABELLED):
    """A forest from labelled findings (features, label 0 or 1), or None if they lack one of the labels or are too few.

    At most about ``most`` findings are used, chosen by a hash, so that reruns agree. A label that is rarer than the other
    keeps up to half of them, and weights restore the shares; a label is missing only if no finding has it.
    """
    draw = F.pmod(F.xxhash64("secret_sha256", "doc_id", "start"), F.lit(1 << 30))
    findings = findings.where("label is not null").select("features", F.col("label").cast("double").alias("label"), draw.alias("draw"))
    totals = {r.label: (r["n"], r.least) for r in findings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()}
    if len(totals) < 2 or sum(t[0] for t in totals.values()) < least_labelled:
        return None
    n = sum(t[0] for t in totals.values())
    chosen = F.lit(False)
    for label, (own, least) in totals.items():
        share = min(1.0, max(most // 2, most - (n - own)) / own)
        chosen = chosen | ((F.col("label") == label) & (F.col("draw") < max(int(share * (1 << 30)), least + 1)))
    kept = stored(findings.where(chosen).select("features", "label"), shared_folder(findings.sparkSession, "labelled"))
    weight = F.lit(None)
    for r in kept.groupBy("label").count().collect():
        weight = F.when(F.col("label") == r.label, totals[r.label][0] / r["count"]).otherwise(weight)
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    return forest.fit(kept.select(array_to_vector("features").alias("vector"), "label", weight.alias("weight")))


def score_findings(findings: DataFrame, forest, cut: float = 0.5) -> DataFrame:
    """``findings`` with score and is_secret; without a forest nothing is removed and the score is 1."""
    if forest is None:
        return findings.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    scored = forest.transform(findings.withColumn("vector", array_to_vector("features")))
    scored = scored.withColumn("score", F.round(vector_to_array("probability")[1], 9))
    return scored.select(*findings.columns, "score").withColumn("is_secret", F.col("score") >= cut)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, **options) -> DataFrame:
    """doc_id, start, end, left_word, secret_sha256, score, is_secret for each candidate in the whole texts.

    ``labelled`` has doc_id, start and label (0 or 1) of known findings; the forest is fitted on those that are candidates
    here. Without it, the forest is fitted on findings that are planted in a sample of the documents; a few given ones are
    joined by planted ones. The dictionary of
    the corpus is counted over all texts. The secret itself is not returned, only its digest. Candidates that the forest
    rejects stay, with is_secret false.

    Null and empty texts have no candidates; null ids and paths are allowed; repeated rows give repeated findings; an
    empty table gives an empty result; other columns are ignored. Runs are candidates at any length from 15 characters,
    shorter values from 6 if a naming word assigns them, with digits or without. Memory: a task holds 4 MB of texts or one
    text, and the dictionary.
    """
    spark = docs.sparkSession
    dictionary = spark.sparkContext.broadcast(corpus_dictionary(docs, options.get("text_column", "text")))
    found = stored(find_candidates(docs, dictionary, **options), shared_folder(spark, "candidates"))
    if labelled is not None:
        known = stored(found.join(labelled.select("doc_id", "start", "label").where("label is not null").distinct(), ["doc_id", "start"]), shared_folder(spark, "known"))
        by_label = [r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()]
    if labelled is None or len(by_label) < 2 or sum(by_label) < LEAST_LABELLED:
        planted = planted_findings(docs, dictionary, **options)
        known = stored(planted if labelled is None else planted.unionByName(known.select(planted.columns)), shared_folder(spark, "planted"))
    scored = score_findings(found, fit_forest(known))
    return scored.select("doc_id", "start", "end", "left_word", "secret_sha256", "score", "is_secret")


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
