"""MinHash near-dedup, decontamination, line dedup, language ID and mixing against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from bandloom.llm import decontaminate, graph, language_id, line_dedup, mixing, near_dedup, shingles

DOCS = "doc_id long, text string, lang string, source string, n_words long, kept boolean"
EDGE_TEXTS = ["", None, "   \n\t ", "one", "One two three four", "one two three four", "é ü ñ 1234", "x" * 5000, "a b c d e f g h i j k " * 3000]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_expected(rows):
    sets = {i: shingle_set(x) for i, x in rows}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    links = []
    for i, s in sets.items():
        for j, n in Counter(k for x in s for k in inverted[x] if k > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                links.append((i, j))
    return sets, roots(sets, links)


def test_shingle_sets_match_plain_sets():
    texts = [x or "" for x in EDGE_TEXTS]
    raw = [x.encode() for x in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    sets, bounds = shingles.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert np.diff(bounds).tolist() == [len(shingle_set(x)) for x in texts]
    assert sets[bounds[4] : bounds[5]].tolist() == sets[bounds[5] : bounds[6]].tolist()
    d1, d2 = shingles.digests(sets, bounds)
    assert d1[4] == d1[5] and d2[4] == d2[5] and d1[3] != d1[6]


@pytest.mark.parametrize(("block", "small"), [(near_dedup.BLOCK_SHINGLES, near_dedup.SMALL_BUCKET), (120, 2)])
def test_near_duplicates_match_all_pairs(spark, data_dir, block, small):
    """The small sizes send clusters and buckets through the path of large ones."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = " ".join(f"w{k}" for k in range(60)).split()
    for k in range(40):  # a chain: neighbours are linked, far ones aren't
        rows.append((10_000 + k, " ".join([f"v{j}" for j in range(k)] + base[k:] if k < 30 else base[::-1][: 20 + k])))
    rows += [(20_000 + k, x) for k, x in enumerate(EDGE_TEXTS)]
    sets, expected = near_expected(rows)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_shingles=block, small=small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (len(sets[i]), expected[i], expected[i] == i) for i, _ in rows}
    assert len({x for x in expected.values()}) < len(rows) - 20


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None), (3, None)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1, True) for i, x in rows], DOCS)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 0, 1, 1, 3]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (None, 7)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(200)}


def contamination_expected(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, ids = set(), set()
    for item_id, item in items:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        wins = [x[k : k + 10] for k in range(max(1, len(x) - 9))] if x else []
        for win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(str(item_id))
    ids = sorted(ids)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [decontaminate.AUTOMATON_BYTES, 300])
def test_contamination_matches_plain_search(spark, limit):
    """The small limit deals the benchmark to several automata."""
    long = "Q: Which of the twelve apples, said K, fell on Newton's head at noon? A: the 4th"
    items = [(1, long), (20, "short item"), (3, None), (4, "..."), (5, "short item"), (6, "a a a a a a a a a a a a"), (7, "ÄPFEL und Birnen"), (None, "never listed words")]
    texts = [f"before {long.upper()} after", "Which of the twelve apples said K fell on Newton s", "short, ITEM!", "shortitem", "a " * 25, "äpfel Äpfel UND birnen", "which of the twelve apples said k fell on newton", "so never listed words, so", *EDGE_TEXTS]
    docs = spark.createDataFrame([(k, x, "n_hit") for k, x in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, ["doc_id"], automaton_bytes=limit).collect()
    for r in found:
        n, hit, _, _, bad = contamination_expected(texts[r.doc_id], [(k, x) for k, (_, x) in enumerate(items)])
        _, _, n_items, digest, _ = contamination_expected(texts[r.doc_id], [x for x in items if x[0] is not None])
        named = [x for x in r["items"] if x is not None]
        assert (r.n_words, r.n_hit, len(named), r.contaminated) == (n, hit, n_items, bad)
        assert hashlib.sha256(",".join(named).encode()).hexdigest() == digest
        assert (None in r["items"]) == ("never listed words" in (texts[r.doc_id] or ""))
    spans = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in found}
    assert spans[0] == [long.upper()] and spans[2] == ["short, ITEM"] and spans[5] == ["Äpfel UND birnen"]
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in found if not r.contaminated}
    assert decontaminate.find_contamination(docs.limit(0), bench, ["doc_id"]).count() == 0
    assert all(not r.contaminated for r in decontaminate.find_contamination(docs, bench.limit(0), ["doc_id"]).collect())


def test_contamination_of_the_given_documents(spark, data_dir):
    docs, bench = (spark.read.parquet(f"{data_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    items = [tuple(r) for r in bench.collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = decontaminate.op3_decontaminate(spark, data_dir).collect()
    some = [r for r in found if r.contaminated] + found[:40]
    assert all((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == contamination_expected(texts[r.doc_id], items) for r in some)
    assert any(r.contaminated for r in found)


def test_lines_match_the_sql(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data_dir}/documents.parquet'")
    expected = {r[0]: r[1:] for r in con.execute(line_dedup.OP7_SQL).fetchall()}
    found = {r.doc_id: (r.n_lines, r.n_removed, r.n_chars, r.clean_md5) for r in line_dedup.op7_line_dedup(spark, data_dir).collect()}
    assert found == expected and any(r[1] for r in expected.values())


def test_lines_on_many_sites(spark):
    """Estimates far from the threshold, near it, and one line on every row."""
    rows = [(k, f"everywhere\nline {k % 3}\n\n  Odd {k % 150}  \nown {k}", f"s{k % 300}") for k in range(600)] + [(1000, None, None), (1001, "", "x"), (1001, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sites = defaultdict(set)
    for _, x, s in rows:
        for line in (x or "").split("\n"):
            if line.strip():
                sites[line.strip().lower()].add(s)
    for least in (2, 4, 60, 100, 300, 301):
        clean = line_dedup.remove_boilerplate(docs, min_sites=least)
        expected = {(k, "\n".join(y for y in (x or "").split("\n") if not y.strip() or len(sites[y.strip().lower()]) < least)) for k, x, _ in rows}
        assert {(r.doc_id, r.clean_text) for r in clean.collect()} == expected
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


def test_language_of_held_out_documents(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir.replace('0.001', '0.01')}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = language_id.op8_language_id(spark, data_dir.replace("0.001", "0.01")).collect()
    out = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_texts(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "le chat et le chien", "fr"), (4, None, "fr"), (5, "12 34 !", "fr"), (6, "", None), (7, "the dog and the cat", None), (8, "日本", None), (8, "日本", None)]
    docs = spark.createDataFrame([(*r, "s", 1, True) for r in rows], DOCS)
    model = language_id.train(docs)
    found = language_id.identify(docs, model, ["doc_id", "kept"]).collect()
    by = {r.doc_id: r.lang_pred for r in found}
    assert by[1] == by[7] == "en" and by[2] == "de" and by[3] == "fr" and by[4] == by[5] == by[6] == "und" and by[8] != "und"
    none = language_id.identify(docs, language_id.train(docs.limit(0)), ["doc_id"])
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model, ["doc_id"]).count() == 0
    one = language_id.identify(docs, language_id.train(docs.where("lang = 'en'")), ["doc_id"])
    assert {r.lang_pred for r in one.collect()} == {"en", "und"}


@pytest.mark.parametrize("n", range(1, 40))
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(x) for x in code.tolist()}) == (n if n > 1 else 1)
    assert n < 3 or all(abs(c.sum()) < n for c in code.T)


def targets_expected(sizes, weights=(1, 2, 3)):
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    free, left = set(names), float(total)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_meets_the_targets(spark, data_dir):
    path = data_dir.replace("0.001", "0.01")
    texts = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    found = mixing.op5_mix_sources(spark, path).collect()
    again = mixing.op5_mix_sources(spark, path).collect()
    assert sorted(found) == sorted(again) and len(found) == len(texts)
    sizes = Counter()
    for source, n in texts.values():
        sizes[source] += n
    target = targets_expected(sizes)
    taken = Counter()
    for r in found:
        source, n = texts[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[source]) and abs(r.target - target[source]) < 1e-6 * (1 + target[source])
        assert r.taken % max(1, n) == 0 and r.taken <= 3 * n
        taken[source] += r.taken
    longest = max(n for _, n in texts.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)


def test_mix_edge_rows(spark):
    rows = [(k, "w " * (k % 7), ["a", "B", "ä", None][k % 4]) for k in range(200)] + [(500, None, "empty"), (None, "x y", "a"), (501, "big " * 5000, "big"), (502, "t", "tiny"), (502, "t", "tiny")]
    docs = spark.createDataFrame([(i, x, "en", s, 1, True) for i, x, s in rows], DOCS)
    found = mixing.mix(docs).collect()
    sizes = Counter()
    for _, x, s in rows:
        sizes[s] += len((x or "").split())
    target = targets_expected(sizes)
    assert len(found) == len(rows) and sorted({round(r.target, 6) for r in found}) == sorted({round(x, 6) for x in target.values()})
    assert all(r.taken <= 3 * r.size for r in found)
    out = mixing.mixed_documents(docs)
    copies = Counter({r.doc_id: 0 for r in found})
    for r in found:
        copies[r.doc_id] += r.copies
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == +copies
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
