"""Secrets that are rare, long or assigned without quotes are found as in a small table of plain ones."""

import hashlib
import random

from pyspark.sql import functions as F

from bandloom.llm import secrets


def test_rare_label_survives_thinning(spark):
    # 3 findings of 4,000 are secrets; a bound of 200 findings by one share keeps none of them, or one or two.
    rows = [(k, 0, hashlib.sha256(str(k).encode()).hexdigest(), [float(k < 3)] + [float(k % 7)] * (len(secrets.FEATURES) - 1), int(k < 3)) for k in range(4000)]
    found = spark.createDataFrame(rows, "doc_id long, start long, secret_sha256 string, features array<double>, label int")
    forest = secrets.fit_forest(found, most=200)
    assert forest is not None
    scored = secrets.score_findings(found, forest).where(F.col("is_secret") | (F.col("label") == 1)).collect()
    assert sorted((r.doc_id, r.is_secret) for r in scored) == [(0, True), (1, True), (2, True)]
    assert secrets.fit_forest(found.where("label = 0"), most=200) is None


def test_candidates_are_whole(spark):
    token, value = "a1B2c3" * 100, "9f8e7d6c5b4a39281706"
    texts = [f'token = "{token}" end', f"{'Zz9' * 171}{value}", f"API_KEY={value}", f"export DB_PASSWORD={value}/x=y1", f"run --auth-token={value}", 'secret = "qWeRtYuIoPaSdFgHjKlZxCvBnM"', "QUJDREVGR0hJSktM1234==", f"deadbeef0123456789={value}", f"a=b={value}"]
    expected = [{token}, {"Zz9" * 171 + value}, {value}, {f"{value}/x=y1"}, {value}, {"qWeRtYuIoPaSdFgHjKlZxCvBnM"}, {"QUJDREVGR0hJSktM1234"}, {"deadbeef0123456789", value}, {value}]
    docs = spark.createDataFrame([(k, x, None) for k, x in enumerate(texts)], "doc_id long, text string, source string")
    rows = secrets.find_candidates(docs, spark.sparkContext.broadcast(frozenset())).collect()
    assert [{texts[k][r.start : r.end] for r in rows if r.doc_id == k} for k in range(len(texts))] == expected
    assert all(r.secret_sha256 == hashlib.sha256(texts[r.doc_id][r.start : r.end].encode()).hexdigest() for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].left_word == "api_key" and by[2].features[secrets.FEATURES.index("assigned")] == 1


def test_short_values_of_naming_words(spark):
    text = "password = hunter22, pwd: 'qwe!rty9' token=\"a1b2c3\" key=short passwort is hunter23 and id = hunter24"
    assert [text[a:b] for a, b in secrets.spans(text)] == ["hunter22", "qwe!rty9", "a1b2c3"]


def planted_set(n, seed, words):
    return [(k, secrets.plant(k, " ".join(words[(k * 7 + j) % len(words)] for j in range(60)), k % 2 == 0, words, seed)) for k in range(n)]


def test_precision_and_recall_on_findings_not_fitted_on(spark):
    """Other documents, other random values; and what the given documents have besides secrets isn't taken for one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").where("doc_id % 3 > 0")
    words = sorted(secrets.corpus_dictionary(docs))
    dictionary = spark.sparkContext.broadcast(frozenset(words))
    forest = secrets.fit_forest(secrets.planted_findings(docs, dictionary))
    planted = planted_set(600, 99, [w for w in words if len(w) > 3])
    asked = spark.createDataFrame([(k, x[0], None) for k, x in planted], "doc_id long, text string, source string")
    found = {}
    for r in secrets.score_findings(secrets.find_candidates(asked, dictionary), forest).collect():
        text, start, end = planted[r.doc_id][1]
        if r.start < end and r.end > start:
            found[r.doc_id] = found.get(r.doc_id, False) or r.is_secret
    hit = sum(found.get(k, False) for k in range(0, 600, 2))
    false = sum(found.get(k, False) for k in range(1, 600, 2))
    assert hit / 300 >= 0.9 and hit / (hit + false) >= 0.9, (hit, false)


def test_no_false_positives_in_the_given_documents(spark):
    path = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = secrets.op1_secret_forest(spark, path).collect()
    real = {(r.doc_id, r.start) for r in rows if docs[r.doc_id][max(0, r.start - 9) : r.start].lower() == 'token = "'}
    taken = {(r.doc_id, r.start) for r in rows if r.is_secret}
    assert real and real <= taken and len(taken - real) <= 0.01 * len(rows)


def test_few_documents_are_judged_as_many_are(spark):
    """The forest has its sample at any size: the same texts get the same answers in a table of 6 rows and in one of 200."""
    words = [a + b for a in ("river", "stone", "cloud", "market", "window") for b in ("side", "path", "land", "work", "light", "field")]
    rng = random.Random(11)
    prose = lambda: " ".join(rng.choices(words, k=80))
    few = [f'{prose()} token = "9f8Ab4c1Xe7d3K6z0b2A9Qw" {prose()}', f"{prose()} 192.168.100.200.14 {prose()}", f"{prose()} {'-'.join(words[:4])} {prose()}", f"{prose()} API_KEY=4fe1c2a09b7d4e6f8a1b3c5d7e9f0a2b {prose()}", f"{prose()} 2024-10-11T12.13.14 {prose()}", prose()]
    many = few + [prose() for _ in range(194)]

    def judged(texts):
        docs = spark.createDataFrame([(k, x, "web") for k, x in enumerate(texts)], "doc_id long, text string, source string")
        return {(r.doc_id, r.start): r.is_secret for r in secrets.scan_secrets(docs).collect() if r.doc_id < 6}

    found = judged(few)
    assert found == judged(many)
    assert {d for (d, _), secret in found.items() if secret} == {0, 3} and {d for (d, _), secret in found.items() if not secret} >= {1, 4}


def test_few_given_labels_are_joined_by_planted_ones(spark):
    docs = spark.createDataFrame([(k, f'the river side token = "{"9f8Ab4c1Xe7d3K6z0b2A" + str(k)}" and 192.168.100.200.{k}', "web") for k in range(8)], "doc_id long, text string, source string")
    known = spark.createDataFrame([(0, 24, 1), (1, 24, None)], "doc_id long, start long, label int")
    found = secrets.scan_secrets(docs, known).collect()
    assert {r.is_secret for r in found} == {True, False} and {r.score for r in found} != {1.0}
