"""Corpus queries that SQL can express against DuckDB, over whole tables, and over a small table of hard cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from bandloom.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "benchmark", "pages", "embeddings", "conversations")


def both(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder.startswith('/tmp') else ''}')")
    found = QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    return sorted(map(repr, (tuple(r) for r in found.select(columns).collect()))), sorted(map(repr, expected))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_whole_tables(spark, data_dir, name):
    found, expected = both(spark, name, data_dir)
    assert found and found == expected


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hard"))
    words = [f"w{k}" for k in range(40)]
    texts = {
        1: None, 2: "", 3: " \t\n", 4: "one two", 5: "ONE two", 6: " ".join(words), 7: " ".join(words).upper(), 8: " ".join([*words[:37], "x"]), 9: " ".join(words[20:] + words[:20]),
        10: "one-two, THREE!", 11: "Ünï wörd ünï", 12: " ".join(words * 30), 13: "a b c d e f a b c d e f a b c d e f", 14: "line\nline\nline\x0bline",
    }
    items = {5: None, 10: "", 2: "...", 100: "one two three", 7: " ".join(words[5:25]), 8: "one two", 9: "ünï wörd", None: "a b c d e f a b c d e"}
    vectors = {0: None, 1: [], 2: [0.0, 0.0], 3: [1.0, 0.0], 4: [2.0, 0.0], 5: [1.0, 0.1], 6: [1.0, None], 7: [float("nan"), 1.0], 8: [float("inf"), 0.0], 9: [-1.0, 0.0], 10: [1.0, 0.0, 0.0], 11: [0.9, 0.35]}
    pages = [(1, "http://A.example.org:8080/x?y=1#z", "same"), (2, "https://b.example.org", "same"), (3, None, None), (4, "", ""), (5, "https://c.example.org:443/", "ünï"), (6, "http://d.example.org/?", "alone")]
    spark.createDataFrame([(k, v, "en", "s", 1) for k, v in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    said = [(1, 0, "user", "a <|im_end|> b"), (1, 1, "assistant", "<\\\\|x<|y"), (1, 1, "assistant", None), (2, None, None, None), (2, 0, "as\nsist\\<|", "ünï"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (None, 1, "user", "x")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_hard_cases(spark, hard, name):
    found, expected = both(spark, name, hard)
    assert found and found == expected
