"""The Merkle manifest against a plain recursion, its layout, and hard rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.llm import merkle
from bandloom.llm.merkle import address, audit, build, document_leaves, layout, level_texts, siblings, size_of, verified_documents, write_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    fields = (doc_id, source, lang, n_chars, text)
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def path_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at - at % 8 : at - at % 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row, by the definition."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in groups}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            doc_id, text, *rest = row
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded, path = leaf_of(doc_id, text, *rest), path_of(trees[g], at) + path_of(top, place)
            for left, right in path:
                folded = h(left + folded + right)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return out


def found(df):
    return sorted(map(repr, map(tuple, df.select("key", "leaf", "subroot", "root", "proof", "folded", "verified").collect())))


@pytest.mark.parametrize("levels", range(1, 7))
def test_addresses_are_a_permutation_and_subtrees_lie_together(levels):
    places = [address(levels, d, np.arange(8**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(size_of(levels)))
    if levels > 1:
        top = levels // 2
        assert {int(p) for d in range(top) for p in places[d]} == set(range(size_of(top)))
        below = size_of(levels - top)
        first = [int(p) for d in range(top, levels) for p in places[d][: 8 ** (d - top)]]
        assert sorted(first) == list(range(size_of(top), size_of(top) + below))


@pytest.mark.parametrize("leaves", [1, 2, 8, 9, 63, 64, 65, 500])
def test_block_holds_each_level_in_order(leaves):
    digests = [h(str(k)) for k in range(leaves)]
    want = levels_of(digests)
    nodes = build(b"".join(map(bytes.fromhex, digests)), len(want) - 1)
    assert nodes[:32].hex() == want[-1][0]
    texts = level_texts(nodes, leaves, len(want) - 1)
    assert texts == ["".join(x) for x in want[:-1]]
    for at in {0, leaves // 2, leaves - 1}:
        assert list(zip(*siblings(texts, at), strict=True)) == path_of(want, at)
    assert sorted(np.concatenate(layout(leaves, len(want) - 1)).tolist()) == list(range(sum(map(len, want))))


def hard_rows():
    rows = [(k, f"Text {k} ÄÖ Word", "en", "s", k) for k in range(150)]
    rows += [(k, None if k % 5 == 0 else f"X{k}", "de" if k % 2 else None, None, None) for k in range(40)]
    rows += [(7, "Same", "en", "s", 1)] * 12 + [(None, "No id", "en", "s", 1)] * 3 + [(None, "no id", "zz", None, 2), (3, "", "", "", 0), (5, "A" * 300_000, "lone", "s", 5), (9, "lang with Ü", "Ü", "s", 1)]
    return rows


@pytest.mark.parametrize("height", [1, 2, 4])
def test_hard_rows_match_plain_recursion(spark, height):
    rows = hard_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clashing = docs.select("*", F.lit("x").alias("key"), F.lit(1).alias("leaf"), F.lit(2).alias("tree"), F.lit(3).alias("rank"), F.lit(4).alias("group"))
    got = found(verified_documents(clashing, height))
    assert got == sorted(map(repr, plain(rows)))
    assert any("False" in x for x in got) and any("True" in x for x in got)


def test_one_row_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "Alone", None, None, None)], SCHEMA)
    assert found(verified_documents(docs)) == sorted(map(repr, plain([(1, "Alone", None, None, None)])))
    out = verified_documents(docs.limit(0))
    assert out.count() == 0 and "verified" in out.columns


def test_siblings_prove_any_row(spark, tmp_path):
    rows = [(k, f"Text {k}", "en" if k % 3 else "de", "s", k) for k in range(100)]
    manifest, ranked = write_manifest(document_leaves(spark.createDataFrame(rows, SCHEMA)), f"file://{tmp_path}", 1)
    for r in audit(manifest, ranked.withColumn("claim", F.col("leaf")), whole=True).collect():
        assert r.verified and merkle.fold(r.leaf, r.left, r.right) == r.root == manifest.root
    assert sorted((r.group, r.subroot) for r in manifest.trees.collect()) == sorted({(g, levels_of([leaf_of(*x) for x in rows if x[2] == g])[-1][0]) for g in ("en", "de")})
