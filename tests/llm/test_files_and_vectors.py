"""Token files, token counts, WARC archives, vectors, secrets and the pipeline against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from bandloom.llm import encoding, secrets, token_counts, token_files, vector_dedup, warc
from bandloom.llm.common import open_fs, shared_folder

TEXTS = ["", " ", "  ", "a  b \n c  ", "don't, we'll... <|endoftext|> x", "tab\tand\x1cfs 　wide nbsp", "größe, «ça» 日本語 🙂", "▁mark ▁ x", "a\0b", "x" * 3000, "1,234.5 (a.b),c", "\r\n\r\n  end", "he said:\"no\",'yes'.", "word. Word,word .word ,word"]
MIXED = st.text(alphabet=st.sampled_from(list("abZé ,.'\n\t 　-\"1日▁<|>s")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(MIXED)
def test_pieces_give_the_ids_of_the_whole_text(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        own = encoding.encoder(name)
        assert own.encode_all([text])[0].tolist() == own.encode_whole(text)


def test_pieces_of_odd_and_given_texts(spark, data_dir):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").limit(40).collect()]
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, plain in (("byte_bpe_50k.json", lambda x: hf.encode(x, add_special_tokens=False).ids), ("piece_bpe_32k.model", sp.encode)):
        assert [x.tolist() for x in encoding.encoder(name).encode_all(texts)] == [plain(x) for x in texts]


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_packing_round_trip(bits, tmp_path):
    rng = np.random.default_rng(bits)
    system, path = open_fs(f"{tmp_path}/x.tokens")
    docs = [(k if k % 5 else None, rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")) for k, n in enumerate([0, 1, 7, 64, 200, 0, 3])]
    with system.open_output_stream(path) as out:
        writer = token_files.TokenFileWriter(out, bits, 64)
        for k, ids in docs:
            writer.add(k, ids)
        writer.close()
    with system.open_input_file(path) as source:
        reader = token_files.TokenFileReader(source)
        whole = np.concatenate([x for _, x in docs])
        assert [(k, x.tolist()) for k, _, x in reader.documents()] == [(k, x.tolist()) for k, x in docs]
        assert all(reader.ids(a, b).tolist() == whole[a:b].tolist() for a, b in ((0, 5), (60, 70), (10, 270), (274, 275), (9, 9)))
    assert token_files.bits_of(50_257) == 16 and token_files.bits_of(2) == 1


def tokens_expected(rows):
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*hf.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_given_documents(spark, data_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    found = token_files.op6_token_files(spark, data_dir).collect()
    assert sorted(map(tuple, found)) == tokens_expected(rows)


def test_token_files_edge_rows(spark):
    rows = [(k, x) for k, x in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id"), (99, None)]
    docs = spark.createDataFrame([(x, k, 1) for k, x in rows], "text string, doc_id long, start int")
    found = token_files.encode_documents(docs).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == tokens_expected(rows)
    assert token_files.encode_documents(docs.limit(0)).count() == 0


def test_counts_and_their_cache(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(k, x) for k, x in enumerate(TEXTS)] + [(50, TEXTS[3]), (50, TEXTS[3]), (None, None), (51, "long " * 5000)]
    docs = spark.createDataFrame([(k, x, 7) for k, x in rows], "doc_id long, text string, n_tokens int")
    expected = Counter((k, len((x or "").encode()), len(sp.encode(x or "")), len(sp.encode(x or "")) > 4096) for k, x in rows)
    cache = shared_folder(spark, "cache-test")
    first = token_counts.token_counts(docs, "piece_bpe_32k.model", cache)
    assert Counter(map(tuple, first.collect())) == expected
    stored = spark.read.parquet(cache).count()
    assert stored == len({x or "" for _, x in rows})
    assert Counter(map(tuple, token_counts.token_counts(docs, "piece_bpe_32k.model", cache).collect())) == expected
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded again
    token_counts.token_counts(docs, "byte_bpe_50k.json", cache).collect()
    assert spark.read.parquet(cache).count() == 2 * stored  # another version has its own counts
    assert token_counts.token_counts(docs.limit(0), "piece_bpe_32k.model").count() == 0


def test_counts_of_the_given_documents(spark, data_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    found = token_counts.op9_token_counts(spark, data_dir).collect()
    assert len(found) == len(texts) and all((r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(sp.encode(texts[r.doc_id]))) for r in found)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(n):
    rng = random.Random(n)
    runs = [sorted(rng.choices(range(50), k=rng.randrange(30))) for _ in range(n)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def captures_expected(rows):
    best = {}
    for page_id, html in rows:
        if page_id is not None:
            best[html or ""] = max(page_id, best.get(html or "", page_id))
    out = []
    for page_id, html in rows:
        raw, keeper = (html or "").encode(), best.get(html or "")
        same = keeper is None or page_id == keeper
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", None if same else keeper))
    return Counter(out)


def test_archives_round_trip(spark, monkeypatch):
    pages = [(k, f"http://{'www.' * (k % 2)}site{k % 3}.example.org:80/p?q={k % 4}#f", ["<p>ä</p>", None, "", f"own {k}", "x" * 30_000][k % 5]) for k in range(60)]
    pages += [(7, "http://a b/\n", "<p>ä</p>"), (59, None, "x" * 30_000), (59, None, "x" * 30_000), (None, "::bad[url", "own 3"), (None, "u", "lonely")]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, offset string").repartition(3)
    runs = warc.write_archives(frame, captured=F.lit(1_600_000_000) - F.col("page_id") % 5)
    index = warc.merge_runs(runs).orderBy("position").collect()
    order = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in index]
    assert order == sorted(order) and len(order) == len(pages)
    assert [r.position for r in index] == list(range(1, len(pages) + 1))
    seen = {}
    for r in index:
        assert (r.nth, r.previous_at) == ((n := seen.get(r.url_key, (0, None)))[0] + 1, n[1])
        seen[r.url_key] = (r.nth, r.captured_at)
    found = warc.read_captures(spark.createDataFrame(index, warc.merge_runs(runs).schema)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == captures_expected([(p[0], p[2]) for p in pages])
    assert warc.archive_pages(frame.limit(0)).count() == 0
    assert warc.url_key("HTTPS://www.Example.org/a?b=c#d") == "org,example,www)/a?b=c" and warc.url_key("http://h:8080") == "h:8080)/"


def test_archives_of_the_given_pages(spark, data_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect()]
    found = warc.op2_warc_index_merge(spark, data_dir).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == captures_expected(rows)


def links_expected(vectors):
    good = {i: np.array(v, float) for i, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = [i for i, _ in vectors]
    parent, n = {i: i for i in ids}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= 0.95:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (n[i], find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("block", "long_blocks"), [(vector_dedup.BLOCK, vector_dedup.LONG_BLOCKS), (16, 100), (16, 1)])
def test_vectors_match_all_pairs(spark, block, long_blocks):
    """Small blocks make lists of several blocks, and then lists of two pivots."""
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=24)) for k in range(300)]
    for k in range(300, 420):  # near copies at about the threshold, and chains of them
        base = rows[rng.integers(len(rows))][1]
        rows.append((k, base + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3]) * np.linalg.norm(base) / 5))
    centre = rng.normal(size=24)
    rows += [(k, centre + rng.normal(size=24) * 0.05) for k in range(420, 520)]
    rows += [(k, rows[3][1] * 2) for k in (520, 521)] + [(522, rows[3][1] * 2)]
    plain = [(k, [float(np.float32(x)) for x in v]) for k, v in rows]
    plain += [(600, None), (601, []), (602, [0.0] * 24), (603, [None] + [1.0] * 23), (604, [float("nan")] * 24), (605, [float("inf")] + [0.0] * 23), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (608, [1e-300] * 3), (609, [1e-300] * 3)]
    frame = spark.createDataFrame([(k, v, 1) for k, v in plain], "vec_id long, embedding array<float>, node int")
    plain = [(r.vec_id, r.embedding) for r in frame.collect()]
    expected = links_expected(plain)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_duplicates(frame, block=block, long_blocks=long_blocks).collect()}
    links = sum(x[0] for x in expected.values())
    assert found.keys() == expected.keys() and all(found[k][0] <= expected[k][0] for k in found)
    assert sum(x[0] for x in found.values()) >= 0.99 * links and sum(found[k] == expected[k] for k in found) >= 0.97 * len(found)
    assert all(found[k] == expected[k] for k in range(420, 523)) and all(found[k] == expected[k] for k in range(600, 610))
    assert vector_dedup.vector_duplicates(frame.limit(0)).count() == 0


def test_vectors_without_id_and_repeated(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1])]
    found = vector_dedup.vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in found) == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def labelled_texts(n, seed):
    rng, rows = random.Random(seed), []
    for k in range(n):
        value = "".join(rng.choices("0123456789abcdef", k=40)) if k % 2 else f"example-{rng.choice(['value', 'string', 'secret'])}-{k}-placeholder"
        rows.append((k, f"some words {rng.choice(['token', 'api_key', 'id'])} = \"{value}\" and more", "src/app.py" if k % 3 else "test/sample.py", k % 2))
    return rows


def test_forest_on_labelled_findings(spark):
    train, test = labelled_texts(160, 1), labelled_texts(80, 2)
    docs = spark.createDataFrame([(r[0], r[1], r[2], "c") for r in train] + [(1000 + r[0], r[1], r[2], "c") for r in test], "doc_id long, text string, source string, score string")
    found = secrets.find_candidates(docs, spark.sparkContext.broadcast(frozenset())).collect()
    at = {r.doc_id: r.start for r in found}
    assert len(at) == len(found) == 240
    known = spark.createDataFrame([(r[0], at[r[0]], r[3]) for r in train], "doc_id long, start long, label int")
    scored = {r.doc_id: r.is_secret for r in secrets.scan_secrets(docs, known).collect()}
    assert sum(scored[1000 + r[0]] == bool(r[3]) for r in test) >= 0.95 * len(test)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(hashlib.sha256(texts[r.doc_id][r.start : r.end].encode()).hexdigest() == r.secret_sha256 for r in found)


def test_secrets_of_the_given_documents(spark, data_dir):
    path = data_dir.replace("0.001", "0.01")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    planted = {(i, m.start(1)) for i, x in docs.items() for m in re.finditer(r"token = \"([0-9a-f]{40})\"", x or "", re.I) if zlib.crc32(str(i).encode()) % 4 == 2}
    found = {(r.doc_id, r.start): r.is_secret for r in secrets.op1_secret_forest(spark, path).collect()}
    assert planted and all(found[x] for x in planted)


def test_secrets_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "key = 'a1b2c3d4e5f6a7b8c9'", None), (2, "", "p"), (3, "0" * 2000, "p")], "doc_id long, text string, source string")
    found = secrets.scan_secrets(docs).collect()
    assert {r.doc_id: r.is_secret for r in found} == {None: True, 3: False} and all(0 <= r.score <= 1 for r in found)
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, data_dir):
    """Each stage's rows against what a plain version keeps of its own input."""
    from tests.llm.test_text_operators import contamination_expected, near_expected

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, None, None, 0), (90_002, "123", "en", "src1", 3), (90_003, docs.first().text, "en", None, 1)], docs.schema)
    docs = docs.unionByName(extra)
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "mix_sources", "token_files"]
    steps = dict(corpus_pipeline.STAGES)
    read = steps["language_id"](spark, docs, data_dir)
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert read.columns == docs.columns and ids(docs) - ids(read) == Counter([90_001, 90_002])
    unique = steps["near_dedup"](spark, read, data_dir)
    roots = near_expected([(r.doc_id, r.text) for r in read.collect()])[1]
    assert unique.columns == docs.columns and ids(unique) == Counter(i for i, r in roots.items() if i == r)
    clean = steps["decontaminate"](spark, unique, data_dir)
    items = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    hit = {r.doc_id for r in unique.collect() if any(" ".join(re.findall(r"\w+", x.lower())[:10]) in " ".join(re.findall(r"\w+", r.text.lower())) for _, x in items)}
    gone = set(ids(unique)) - set(ids(clean))
    texts = {r.doc_id: r.text for r in unique.collect()}
    assert clean.columns == docs.columns and hit <= gone and all(contamination_expected(texts[i], items)[4] for i in gone)
    mixed = steps["mix_sources"](spark, clean, data_dir)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(clean)) and max(ids(mixed).values()) <= 3
    mixed = mixed.cache()
    tokens = steps["token_files"](spark, mixed, data_dir)
    assert sorted(map(tuple, tokens.collect()), key=lambda r: r[1]) == tokens_expected([(r.doc_id, r.text) for r in mixed.collect()])
    assert steps["token_files"](spark, steps["mix_sources"](spark, steps["decontaminate"](spark, steps["near_dedup"](spark, steps["language_id"](spark, docs.limit(0), data_dir), data_dir), data_dir), data_dir), data_dir).count() == 0


def test_one_url_over_many_ranges(spark, monkeypatch):
    """Captures of one URL key that fill several ranges are numbered on from range to range."""
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 7)
    pages = spark.createDataFrame([(k, "http://a.org/" if k % 10 else f"http://b.org/{k}", f"p{k}") for k in range(90)], "page_id long, url string, html string").repartition(5)
    index = warc.merge_runs(warc.write_archives(pages, captured=F.col("page_id") * 2)).orderBy("position").collect()
    own = [r for r in index if r.url_key == "org,a)/"]
    assert [r.nth for r in own] == list(range(1, 82)) and [r.previous_at for r in own] == [None, *(r.captured_at for r in own[:-1])]
    assert [r.position for r in index] == list(range(1, 91)) and [(r.url_key, r.captured_at) for r in index] == sorted((r.url_key, r.captured_at) for r in index)
