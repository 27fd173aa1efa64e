"""Pareto order sampling with unequal odds, against a plain version and by shares."""

import struct

import xxhash

from bandloom.llm import mixing


def uniform(seed, doc_id):
    chained = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=42))
    return (chained % (1 << 52) + 0.5) / (1 << 52)


def sampled(docs, target, seed):
    """Copies by id of one source's documents [(id, words)]: whole copies, then the first by random odds over inclusion odds."""
    total = sum(n for _, n in docs)
    whole = int(target / total + 1e-9)
    f, left = target / total - whole, target - whole * total
    copies = {i: whole for i, _ in docs}
    if f <= 0:
        return copies
    full = [(i, n) for i, n in docs if n]
    mean = sum(n for _, n in full) / len(full)
    z = {i: n / (n + mean) for i, n in full}
    z0 = sum(n * z[i] for i, n in full) / total
    lean = min(mixing.LEAN, 1 / f - 1)
    p = {i: f * (1 + lean * (z[i] - z0)) for i, _ in full}
    u = {i: uniform(seed, i) for i, _ in full}
    sofar = 0
    for i, n in sorted(full, key=lambda d: (u[d[0]] / (1 - u[d[0]])) / (p[d[0]] / (1 - p[d[0]]))):
        copies[i] += sofar + n / 2 <= left
        sofar += n
    return copies


def test_same_documents_as_the_plain_sampler(spark):
    rows = [(k, "w " * (1 + k * 7919 % 40), "abc"[k % 3]) for k in range(900)] + [(2000, "", "a"), (2001, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (20, 4):
        found = {r.doc_id: (r.copies, r.target) for r in mixing.mix(docs, seed=seed).collect()}
        for source in "abc":
            own = [(i, len((x or "").split())) for i, x, s in rows if s == source]
            expected = sampled(own, found[own[0][0]][1], seed)
            assert {i: found[i][0] for i, n in own if n} == {i: expected[i] for i, n in own if n}


def test_longer_documents_are_taken_more_often(spark):
    """Removing the inclusion odds from the order would take both kinds in equal shares."""
    rows = [(k, "w " * (2 if k % 2 else 30), "a") for k in range(8000)] + [(9000 + k, "w " * 32, "b") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, weights=(1.0, 3.0)).where("source_size > target").collect()
    shares = {n: [r.copies for r in found if r.size == n] for n in (2, 30)}
    short, long = (sum(x) / len(x) for x in (shares[2], shares[30]))
    f = found[0].target / found[0].source_size
    mean = 16
    z = {n: n / (n + mean) for n in (2, 30)}
    z0 = (2 * z[2] + 30 * z[30]) / 32
    lean = min(mixing.LEAN, 1 / f - 1)
    assert abs(short - f * (1 + lean * (z[2] - z0))) < 0.04 and abs(long - f * (1 + lean * (z[30] - z0))) < 0.04 and long > short + 0.1


def test_repeated_rows_are_dealt_evenly(spark, monkeypatch):
    """A quarter of the rows has no id and few texts: sources still meet their targets, and rows differ by one copy at most."""
    rows = [(None if k % 4 == 0 else k, "w " * (1 + k // 4 % 50), "abc"[k % 3], k) for k in range(12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    found = mixing.mix(docs).collect()
    targets = dict(zip("abc", sorted({r.target for r in found}), strict=True))
    assert len(found) == len(rows)
    for target in targets.values():
        own = [r for r in found if r.target == target]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50 and max(r.copies for r in own) - min(r.copies for r in own) <= 1
    for limit in (100_000, 40):
        monkeypatch.setattr(mixing, "ROWS_A_TASK", limit)
        kept = mixing.mixed_documents(docs).groupBy("source", "text").count().collect()
        for source in "abc":
            parts = 0 if limit > 40 else 50 * 25 * 4
            assert abs(sum(r["count"] * len(r.text.split()) for r in kept if r.source == source) - targets[source]) <= 50 + parts


def test_rows_that_are_all_alike(spark):
    docs = spark.createDataFrame([(7, "one two", "a")] * 1000 + [(8, "one two", "b")] * 1000, "doc_id long, text string, source string")
    found = mixing.mix(docs, weights=(1.0, 3.0)).collect()
    assert {(r.source_size, r.target) for r in found} == {(2000, 1000.0), (2000, 3000.0)}
    assert sorted({t: sum(r.taken for r in found if r.target == t) for t in (1000.0, 3000.0)}.values()) == [1000, 3000]
    assert {(r.source, r["count"]) for r in mixing.mixed_documents(docs, weights=(1.0, 3.0)).groupBy("source").count().collect()} == {("a", 500), ("b", 1500)}
