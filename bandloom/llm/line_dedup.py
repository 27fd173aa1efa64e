"""Removal of boilerplate lines by the number of distinct sites that have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored

#: Distinct sites from which a line is boilerplate, and the log2 of a sketch's registers (4096: a standard error of 1.6%).
MIN_SITES, LG_REGISTERS = 5, 12

#: Lines whose estimate is within this share of the threshold, or within 2 sites of it, are counted exactly.
BAND = 0.1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


#: A text's hash, which tells rows of one id apart.
_TEXT_HASH = "xxhash64(text, 5)"


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(d, t, place, site, h1, h2): a stored row for each line of ``docs`` (doc_id, site, text).

    d and t are its row's id and hash of the text; h1 and h2 a 128-bit key of the line's trimmed, lower-cased text, null
    for blank lines. Rows that repeat an id and text repeat their lines.
    """
    lines = docs.select(F.col("doc_id").alias("d"), F.expr(_TEXT_HASH).alias("t"), F.xxhash64("site").alias("site"), F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    lines = lines.withColumn("line", F.lower(F.trim(F.translate("line", "\t\r", "  "))))
    key = lambda *x: F.when(F.col("line") != "", F.xxhash64("line", *x))
    lines = lines.withColumn("h1", key()).withColumn("h2", key(F.lit(11))).drop("line")
    return stored(lines, shared_folder(docs.sparkSession, "lines"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(h1, h2): keys of the lines that at least ``min_sites`` distinct sites have, from keyed_lines().

    Lines of a single site are left out by two hashes of their sites. For the others a HyperLogLog sketch a line is
    built in the tasks and merged by Spark's aggregation, so that a line that all documents have sends one sketch a
    task. Estimates clearly above or below the threshold decide; lines near it get an exact distinct count.
    """
    spark = lines.sparkSession
    key = ["h1", "h2"]
    lines = lines.where("h1 is not null").select(*key, "site")
    several = lines.groupBy(*key).agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select(*key)
    several = stored(several, shared_folder(spark, "several-sites"))
    spread = lines.join(several, key, "left_semi").groupBy(*key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_REGISTERS)).alias("sites"))
    spread = stored(spread, shared_folder(spark, "spread"))
    slack = max(2.0, band * min_sites)
    near = spread.where((F.col("sites") >= min_sites - slack) & (F.col("sites") <= min_sites + slack)).select(*key)
    # One row a line and site, dealt by both, before a line's sites meet.
    exact = lines.join(near, key, "left_semi").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("sites"))
    sure = spread.where(F.col("sites") > min_sites + slack).select(*key)
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select(*key))


def remove_boilerplate(docs: DataFrame, site_column: str = "source", text_column: str = "text", id_column: str = "doc_id", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_text for every row: the text without its boilerplate lines.

    A line is what stands between newlines; blank lines are neither counted for spread nor removed. A line's copies
    differ by letter case and outer spaces at most. Null is a site of its own; a null text has no lines and an empty
    clean text. Repeated rows get equal answers; an empty table gives an empty result; other columns are ignored.
    Lines are looked up by their place, so that the work on a text grows with its lines alone.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{site_column}`").alias("site"), F.col(f"`{text_column}`").alias("text"))
    lines = keyed_lines(slim)
    keys = stored(boilerplate_lines(lines, min_sites).withColumn("gone", F.lit(True)), shared_folder(spark, "boilerplate"))
    # For each text with a line to remove, whether each of its lines goes, by place.
    removed = lines.join(keys, ["h1", "h2"]).select("d", "t", "place").distinct()
    gone = removed.groupBy("d", "t").agg(F.sort_array(F.collect_list("place")).alias("places"))
    gone = stored(gone.where("t is not null"), shared_folder(spark, "gone-lines"))
    rows = slim.withColumn("t_own", F.expr(_TEXT_HASH))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["d"]) & (rows["t_own"] == gone["t"]), "left")
    rows = rows.withColumn("places", F.coalesce("places", F.array().cast("array<int>"))).withColumn("lines", _lines(F.col("text")))
    # Between one removed place and the next lies a slice that stays.
    cuts = F.concat(F.array(F.lit(-1)), F.col("places"), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("places")), lambda k: F.slice(F.col("lines"), F.get(F.col("cuts"), k) + 2, F.get(F.col("cuts"), k + 1) - F.get(F.col("cuts"), k) - 1)))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines"))
    rows = rows.withColumn("cuts", cuts)
    return rows.select("doc_id", n_lines.cast("long").alias("n_lines"), F.size("places").cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("clean_text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return clean.select("doc_id", "n_lines", "n_removed", F.length("clean_text").cast("long").alias("n_chars"), F.md5(F.encode("clean_text", "utf-8")).alias("clean_md5"))


OP7_SQL = f"""
with lines as (
  select doc_id, coalesce(source, chr(0)) as site, i as place, s[i] as line, lower(trim(replace(replace(s[i], chr(9), ' '), chr(13), ' '))) as k
  from (select doc_id, source, string_split(text, chr(10)) as s from documents where text is not null), unnest(range(1, len(s) + 1)) r(i)
), boilerplate as (select k from lines where k <> '' group by k having count(distinct site) >= {MIN_SITES}),
marked as (select l.*, b.k is not null as gone from lines l left join boilerplate b on l.k = b.k),
clean as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
    coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '') as clean_text
  from marked group by doc_id
)
select d.doc_id, coalesce(c.n_lines, 0) as n_lines, coalesce(c.n_removed, 0) as n_removed,
  cast(length(coalesce(c.clean_text, '')) as bigint) as n_chars, md5(coalesce(c.clean_text, '')) as clean_md5
from documents d left join clean c using (doc_id)
"""
