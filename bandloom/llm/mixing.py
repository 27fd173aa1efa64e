"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, shared_folder, stored

#: A document is taken at most so many times, so that a source's target stops at so many times its size.
MAX_COPIES = 3

#: How far inclusion odds lean to longer documents: at most by this share of the source's own.
LEAN = 0.5

#: Slices of the order of a source's documents; only the documents of the slice where the target lies are ranked.
SLICES = 4096

#: Rows of equal id and text that one task numbers.
ROWS_A_TASK = 100_000


def word_count(text: Column) -> Column:
    """Runs of other characters than space and \\t \\n \\v \\f \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size and more) with weight and target.

    Sources in order of their code points, null last, take the weights in turn. Together they get the sum of all sizes in
    proportion to their weights; no target is above ``max_copies`` times its source's size, and what that cuts off is
    shared again by weight. That is min(max_copies * size, level * weight) for one level: in order of size by weight,
    the sources before some place are cut off, and the level shares what they leave among the rest. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", picked).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    share = (everything - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # The level is that of the first source that its share does not fill.
    levels = ranked.withColumn("share", share).withColumn("level", F.max(F.when(F.col("cap") >= F.col("share") * F.col("weight"), F.col("share"))).over(Window.partitionBy()))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return levels.withColumn("target", target).drop("cap", "share", "level")


def _plan(docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: int, weights: tuple[float, ...], max_copies: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct documents, each with the number n of its rows; a row for each source; the documents taken once more in the last slice.

    Every document of a source is to be taken target / source_size times. The whole part of that is certain. The rest,
    f, is sampled with unequal probabilities p = f * (1 + lean * (z - z0)): z = size / (size + mean size) of the source
    leans to longer documents, which hold more connected text, and z0 is its mean over the source's words, so that the
    expected words of the sample are f of the source's. A document's Pareto rank is its random odds u / (1 - u) divided
    by its inclusion odds p / (1 - p), and documents are taken in the order of their ranks until the words left are
    reached: a sample of fixed size, up to half a document. Of n rows of one id, source and text, the whole part of n * p
    is certain, and the rest of it is one row's inclusion probability in the order. r / (1 + r) of a rank r lies between 0 and 1 and is cut into
    slices: whole slices are summed, and only the documents of the slice in which the last one lies are sorted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source_column}`").alias("source"), word_count(F.col(f"`{text_column}`")).alias("size"), F.xxhash64(F.col(f"`{text_column}`")).alias("tie"))
    rows = stored(rows.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("n")), shared_folder(spark, "sizes"))
    words = F.sum(F.col("size") * F.col("n"))
    sizes = stored(rows.groupBy("source").agg(words.alias("source_size"), (words / F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("mean_size")), shared_folder(spark, "source-sizes"))
    means = sizes.select(F.col("source").alias("m_source"), "mean_size")
    leaning = rows.where("size > 0").join(means, rows["source"].eqNullSafe(means["m_source"])).groupBy("m_source").agg((F.sum(F.col("size") * F.col("n") * _longer(F.col("size"), F.col("mean_size"))) / words).alias("z0"))
    sizes = sizes.join(leaning, sizes["source"].eqNullSafe(leaning["m_source"]), "left").drop("m_source")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("factor") + F.lit(1e-9))
    sources = source_targets(sizes, weights, max_copies).withColumn("factor", factor).withColumn("whole", whole.cast("long")).withColumn("f", F.greatest(F.lit(0.0), F.col("factor") - F.col("whole")))
    # No p above 1: z - z0 stays below 1.
    sources = sources.withColumn("lean", F.when(F.col("f") > 0, F.least(F.lit(LEAN), 1 / F.col("f") - 1)).otherwise(F.lit(0.0)))
    sources = stored(sources.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), shared_folder(spark, "sources"))

    placed = rows.join(sources.select("source", *ODDS, "left"), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = placed.where("f > 0 and size > 0").withColumn("certain", certain()).withColumn("place", _place(F.col("doc_id"), odds(), seed)).withColumn("slice", F.floor(F.col("place") * SLICES))
    slices = placed.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("certain")).alias("sure"), F.first("left").alias("left"))
    slices = slices.withColumn("left", F.col("left") - F.sum("sure").over(Window.partitionBy("source")))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("slice"))
    last = slices.withColumn("upto", running).where("upto >= left").groupBy("source").agg(F.min_by(F.struct("slice", "upto", "words", "left"), "slice").alias("x"))
    last = last.select("source", F.col("x.slice").alias("last_slice"), (F.col("x.upto") - F.col("x.words")).alias("before"), F.col("x.left").alias("left"))
    sources = stored(sources.drop("left").join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), shared_folder(spark, "plan"))

    edge = sources.where("last_slice is not null").select(F.col("source").alias("s"), "last_slice", "before", "left")
    near = placed.drop("left").join(edge, placed["source"].eqNullSafe(edge["s"]) & (F.col("slice") == F.col("last_slice")))
    order = Window.partitionBy("source").orderBy("place", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    sofar = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    taken = near.withColumn("sofar", sofar).where("sofar + size / 2 <= left")
    taken = stored(taken.select("doc_id", "source", "tie"), shared_folder(spark, "edge"))
    return rows, sources, taken


#: A source's columns that a document's inclusion probability takes.
ODDS = ("f", "lean", "mean_size", "z0")


def _longer(size: Column, mean_size: Column) -> Column:
    return size / (size + mean_size)


def inclusion() -> Column:
    """The probability, from a document's size and its source's ODDS, with which its last copy is taken."""
    return F.col("f") * (1 + F.col("lean") * (_longer(F.col("size"), F.col("mean_size")) - F.col("z0")))


def certain() -> Column:
    """Of a document's n rows, those that are surely taken once more."""
    return F.floor(F.col("n") * inclusion())


def odds() -> Column:
    """The probability that one more of its rows is."""
    return F.col("n") * inclusion() - certain()


def _place(doc_id: Column, p: Column, seed: int) -> Column:
    """r / (1 + r) of the Pareto rank r; the random number is a hash of id and seed, so that reruns agree."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    return u * (1 - p) / (u * (1 - p) + p * (1 - u))


def _with_copies(rows: DataFrame, sources: DataFrame, taken: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with doc_id, source, size, tie, n), the copies that each of the n takes (whole), and how many take one more (extra).

    The small tables are joined as their sizes allow.
    """
    s = sources.select(F.col("source").alias("s_source"), "source_size", "target", "whole", *ODDS, "last_slice")
    joined = rows.join(s, rows["source"].eqNullSafe(s["s_source"]))
    t = taken.select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("tie").alias("t_tie"), F.lit(1).alias("t_one"))
    joined = joined.join(t, joined["doc_id"].eqNullSafe(t["t_id"]) & joined["source"].eqNullSafe(t["t_source"]) & joined["tie"].eqNullSafe(t["t_tie"]), "left")
    slice_of = F.floor(_place(F.col("doc_id"), odds(), seed) * SLICES)
    one = F.when(F.col("last_slice").isNull() | (slice_of < F.col("last_slice")) | F.col("t_one").isNotNull(), 1).otherwise(0)
    extra = F.when((F.col("f") <= 0) | (F.col("size") <= 0), 0).otherwise(F.least("n", certain() + one))
    return joined.withColumn("extra", extra.cast("long")).drop("s_source", "t_id", "t_source", "t_tie", "t_one", *ODDS, "last_slice")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 20, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``docs``; taken is copies times size.

    A source's taken words differ from its target by half a document at most where its documents carry different random
    numbers; rows that repeat an id, source and text are dealt their copies as evenly as whole numbers allow. Documents of size 0 and null texts take no words; null
    is a source of its own; null ids share one random number. An empty table gives an empty result. Nothing of the size
    of the corpus goes through one task: sources and slices are sums, and a source's last slice holds 1/4096 of it.
    """
    rows, sources, taken = _plan(docs, id_column, text_column, source_column, seed, weights, max_copies)
    out = _with_copies(rows, sources, taken, seed).withColumn("some", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / ROWS_A_TASK))))
    out = out.withColumn("nth", F.explode(F.sequence(F.col("some") * ROWS_A_TASK + 1, F.least(F.col("n"), (F.col("some") + 1) * ROWS_A_TASK))))
    out = out.withColumn("copies", F.col("whole") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _dealt(repeated: DataFrame, spark: SparkSession, seed: int) -> DataFrame:
    """row and copies of rows that share id, source and text: their extra copies go to them evenly, in the order of all columns.

    Many such rows are first dealt to parts, which are written down so that a task that runs again finds the same.
    """
    parts = stored(repeated.withColumn("part", F.floor(F.rand(seed) * F.ceil(F.col("n") / ROWS_A_TASK))), shared_folder(spark, "repeated"))
    w = Window.partitionBy("doc_id", "source", "tie", "part").orderBy(F.xxhash64(F.to_json("row")))
    upto = lambda i: F.floor(i * F.col("extra") / F.col("n"))
    nth = F.col("nth")
    return parts.withColumn("nth", F.row_number().over(w)).select("row", (F.col("whole") + upto(nth) - upto(nth - 1)).alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 20, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as mix() takes it, columns unchanged."""
    rows, sources, taken = _plan(docs, "doc_id", "text", "source", seed, options.get("weights", (1.0, 2.0, 3.0)), options.get("max_copies", MAX_COPIES))
    spark = docs.sparkSession
    wrapped = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    repeats = stored(rows.where("n > 1").select(F.col("doc_id").alias("n_id"), F.col("source").alias("n_source"), F.col("tie").alias("n_tie"), "n"), shared_folder(spark, "repeats"))
    if repeats.isEmpty():
        out = _with_copies(wrapped.withColumn("n", F.lit(1)), sources, taken, seed).select("row", (F.col("whole") + F.col("extra")).alias("copies"))
    else:
        same = wrapped["doc_id"].eqNullSafe(repeats["n_id"]) & wrapped["source"].eqNullSafe(repeats["n_source"]) & wrapped["tie"].eqNullSafe(repeats["n_tie"])
        out = _with_copies(wrapped.join(repeats, same, "left").withColumn("n", F.coalesce("n", F.lit(1))), sources, taken, seed)
        single = out.where("n = 1").select("row", (F.col("whole") + F.col("extra")).alias("copies"))
        out = single.unionByName(_dealt(out.where("n > 1"), spark, seed))
    out = out.where("copies > 0")
    name = fresh("copy", docs.columns)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name)).select("row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
