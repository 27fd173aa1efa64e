"""The language model and its decoding against plain versions, and more languages than a byte counts."""

import numpy as np
import pytest

from bandloom.llm import language_id


def plain_counts(rows, languages):
    counts = np.zeros((len(languages), 1 << language_id.BUCKET_BITS))
    for text, lang in rows:
        raw = b" " + text.encode().translate(language_id.FOLD) + b" "
        for k in range(len(raw) - 2):
            code = raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]
            counts[languages.index(lang), (code * 2654435761 % 2**32) >> (32 - language_id.BUCKET_BITS)] += 1
    return counts


def plain_model(languages, counts):
    code = language_id.codewords(len(languages))
    p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    bits = []
    for bit in code.T:
        w = np.round((np.log(p[bit > 0].mean(axis=0)) - np.log(p[bit < 0].mean(axis=0))) * language_id.UNITS) / language_id.UNITS
        means = p @ w
        spread = np.sqrt(np.maximum(p @ w**2 - means**2, 1e-12))
        low, high = means[bit > 0].min(), means[bit < 0].max()
        bits.append((w, (low + high) / 2, max((low - high) / 2, 1e-6), max((low - high) / spread.max(), 1e-6)))
    return code, bits


def plain_decode(text, languages, code, bits):
    counts = plain_counts([(text, languages[0])], languages)[0]
    loss = np.zeros(len(languages))
    for (w, middle, half, trust), bit in zip(bits, code.T, strict=True):
        margin = ((counts @ w) / counts.sum() - middle) / half
        loss += np.log1p(np.exp(-2 * margin * bit)) * trust / sum(b[3] for b in bits)
    return languages[int(np.argmin(loss))], 1 / np.exp(-4 * (loss - loss.min())).sum()


def some_text(rng, lang, words):
    own = [f"{chr(97 + lang % 26)}{chr(97 + lang // 26 % 26)}{c}{'aeiou'[lang % 5]}" for c in "bdfgklmnprstvz"]
    return " ".join(rng.choice(own, words))


@pytest.mark.parametrize("n", [2, 4, 12])
def test_model_and_decoding_match_plain_versions(spark, n):
    rng = np.random.default_rng(n)
    rows = [(some_text(rng, k % n, 5 + k % 7), f"l{k % n:03}") for k in range(6 * n)]
    languages = sorted({x for _, x in rows})
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    code, bits = plain_model(languages, plain_counts(rows, languages))
    assert model.languages == languages and np.array_equal(model.code, code)
    for b, (w, middle, half, _) in enumerate(bits):
        assert np.abs(model.weights[b] / language_id.UNITS - w).max() <= 1.5 / language_id.UNITS
        assert abs(model.middle[b] - middle) < 1e-4 and abs(model.half[b] - half) < 1e-4
    asked = [some_text(rng, k % n, 4) for k in range(40)] + ["zzz qqq", "x"]
    found = language_id.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, ["doc_id"]).collect()
    for r in found:
        lang, score = plain_decode(asked[r.doc_id], languages, code, bits)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_300_languages(spark):
    rng = np.random.default_rng(1)
    rows = [(some_text(rng, k % 300, 60), f"l{k % 300:03}") for k in range(900)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    asked = [(k, some_text(rng, k, 40)) for k in range(300)]
    found = language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model, ["doc_id"]).collect()
    assert len(model.languages) == 300 and sum(r.lang_pred == f"l{r.doc_id:03}" for r in found) >= 285
