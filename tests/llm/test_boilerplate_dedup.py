"""Near-duplicates among texts that share boilerplate, and under repeated ids."""

import random

from bandloom.llm import near_dedup
from tests.llm.test_text_operators import near_expected


def family(seed, n, share):
    """Texts of 200 words, the first of which are the same in all; some are near copies of others."""
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(int(200 * share))]
    rows = []
    for k in range(n):
        if k % 5 == 4:
            words = rows[-1].split()
            words[rng.randrange(len(common), 200)] = "changed"
        else:
            words = common + [f"w{rng.randrange(10**6)}" for _ in range(200 - len(common))]
        rows.append(" ".join(words))
    return rows


def test_shared_boilerplate_keeps_links_and_makes_no_large_cluster(spark, monkeypatch):
    rows = list(enumerate(family(1, 300, 0.5) + family(2, 300, 0.3)))
    sizes = []
    plain = near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges: sizes.append(edges.count()) or plain(edges))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    roots = near_expected(rows)[1]
    assert {r.doc_id: r.component_id for r in found} == roots
    assert sizes[0] <= 240  # candidate links: the 120 near copies, and hardly a pair that shares boilerplate alone


def test_a_pair_behind_an_unlike_smallest_member(spark):
    """Members of a bucket that are unlike its smallest one are still held against each other."""
    rows = list(enumerate(family(3, 200, 0.5)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), halves=40, rows=1, small=8).collect()
    assert {r.doc_id: r.component_id for r in found} == near_expected(rows)[1]


def test_one_id_with_unlike_texts(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(0, long), (1, long + " x"), (1, " ".join(f"v{k}" for k in range(60))), (2, "lone text of only some words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert found[1, 57] == (0, False) and found[1, 56] == (1, True) and found[2, 3] == (2, True)
    assert sorted(r.text[:2] for r in near_dedup.drop_near_duplicates(docs).collect()) == ["lo", "v0", "w0"]
