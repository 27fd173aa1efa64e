"""Which regions are reachable on which band now, and whether that is unusual."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bands, classify, geo, numbers
from .conditions import recent
from .matching import from_here_ends, matched_spots

e = F.expr

# Public name, tag, whether the power is known, and the floors in dB for voice, Morse and digital modes.
SOURCE_PROFILES = (("wspr", "wspr", True, 10.0, -5.0, None), ("pskr", "mqtt", False, -5.0, -18.0, -24.0), ("rbn", "rbn", False, None, 8.0, None))


#: Seconds of the buckets in which windows and spots meet, and ways in which a bucket's spots are dealt to tasks.
BUCKET, SALT = 300, 16


def source_profiles(spark: SparkSession, names: list[str] | None = None, ssb_min_db: float | None = None, cw_min_db: float | None = None) -> DataFrame:
    """The profiles of the named sources, all if none is known; a given floor takes the place of each profile's own."""
    rows = [(k, *p) for k, p in enumerate(SOURCE_PROFILES) if p[0] in {n.strip().lower() for n in names or []}] or [(k, *p) for k, p in enumerate(SOURCE_PROFILES)]
    rows = [(k, n, t, p, ssb if ssb is None or ssb_min_db is None else float(ssb_min_db), cw if cw is None or cw_min_db is None else float(cw_min_db), d) for k, n, t, p, ssb, cw, d in rows]
    return spark.createDataFrame(rows, "source_order int, name string, source string, has_power boolean, ssb_floor double, cw_floor double, digital_floor double")


def windowed(spots: DataFrame, qths: DataFrame) -> DataFrame:
    """Prepared spots, once for each window (w0, w1) of ``qths`` that they lie in, with the level that openness is judged by
    and whether they lie in the window's first half.

    The level is the SNR at 100 W where the power is known, null for beacons of unknown power. Locations ask for a few
    windows, however many locations there are: only windows are joined to spots. Both meet in five minutes that they
    touch, in an equi-join, and the window's edges are tested after it; a bucket's spots are dealt to several tasks.
    """
    spans = qths.select(e("now - minutes * 60").alias("w0"), F.col("now").alias("w1")).distinct()
    spans = spans.withColumn("bucket_", F.explode(e(f"sequence(cast(floor(w0 / {BUCKET}) as bigint), cast(floor(w1 / {BUCKET}) as bigint))"))).withColumn("salt_", F.explode(e(f"sequence(0, {SALT - 1})")))
    near = recent(spots, qths).where(e(bands.band_in_scope("band"))).withColumns({"bucket_": e(f"cast(floor(t / {BUCKET}) as bigint)"), "salt_": e(f"pmod(hash(spot_id), {SALT})")})
    near = near.join(spans, ["bucket_", "salt_"]).where("t between w0 and w1").drop("bucket_", "salt_")
    level = f"case when source = 'wspr' then case when txpower > 0 then {bands.effective_snr('snr', 'txpower')} end else snr end"
    return near.withColumns({"level": e(level), "early": e("t < w0 + (w1 - w0) div 2")})


def _rising(early: str = "early_spots", late: str = "late_spots") -> str:
    return f"(case when {early} > 0 then cast({late} as double) / {early} >= 1.5 else {late} > 0 end)"


def _windowed_counts(near: DataFrame, qths: DataFrame) -> DataFrame:
    """(qth, band, source, region, level, early, from_here, n), as remote_counts() has them, for windowed() spots.

    What holds for every location of a window is reduced to one row a band, source and region before it is repeated for
    each; its levels are looked at for the cells alone that lose spots to another one.
    """
    q = qths.select("qth", e("now - minutes * 60").alias("w0"), F.col("now").alias("w1"))
    sided = near.withColumn("swap", e(bands.receiver_is_sender_side("source"))).withColumns({"recv": e("case when swap then s_region else r_region end"), "other": e("case when swap then r_region else s_region end"), "mark": e("coalesce(level, -9999)")})
    cell, detail = ["w0", "w1", "band", "source", "region"], ["mark", "early"]
    everywhere = sided.groupBy("w0", "w1", "band", "source", F.col("recv").alias("region"), *detail).agg(F.count(F.lit(1)).alias("n"))
    asked = qths.withColumns({"q0": e("now - minutes * 60"), "q1": F.col("now")})
    hits = matched_spots(sided, asked, "q0", "q1").where("w0 = q0 and w1 = q1").drop("q0", "q1")
    hits = hits.withColumn("to", e("case when case when swap then is_sender else is_receiver end then other else recv end"))
    lost = hits.groupBy("qth", "w0", "w1", "band", "source", F.col("recv").alias("region"), *detail).agg(F.count(F.lit(1)).alias("lost"))
    touched = lost.select("qth", *cell).distinct()
    # The half that a spot lies in stays apart; of the levels only the best counts.
    best = everywhere.groupBy(*cell, "early").agg(F.sum("n").alias("n"), F.max("mark").alias("mark"))
    plain = best.join(q, ["w0", "w1"]).join(touched, ["qth", *cell], "left_anti")
    rest = touched.join(everywhere, cell).join(lost, ["qth", *cell, *detail], "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).where("n > 0")
    moved = hits.groupBy("qth", "band", "source", F.col("to").alias("region"), *detail).agg(F.count(F.lit(1)).alias("n"))
    columns = ["qth", "band", "source", "region", "mark", "early", "n"]
    out = plain.select(*columns, F.lit(False).alias("from_here")).unionByName(rest.select(*columns, F.lit(False).alias("from_here"))).unionByName(moved.select(*columns, F.lit(True).alias("from_here")))
    return out.where("region <> '??'").withColumn("level", e("nullif(mark, -9999)")).drop("mark")


def source_cells(spots: DataFrame, qths: DataFrame, profiles: DataFrame) -> DataFrame:
    """(qth, band, region, source): spots, best level, open flags, rising. A flag is null where the source can't tell."""
    counted = _windowed_counts(windowed(spots, qths), qths)
    cells = counted.groupBy("qth", "band", "region", "source").agg(F.sum("n").alias("spots"), F.max("level").alias("best_level"), F.bool_or("from_here").alias("from_here"), F.sum(e("case when early then n else 0 end")).alias("early_spots"), F.sum(e("case when early then 0 else n end")).alias("late_spots"))
    return _opened(cells.join(profiles, "source"))


def from_here_only(cells: DataFrame) -> DataFrame:
    """The cells that a location's own spots support; a band without any is gone with its cells, from counts of bands too."""
    return cells.where("from_here")


def _opened(cells: DataFrame) -> DataFrame:
    flag = lambda floor: e(f"case when {floor} is not null then coalesce(best_level >= {floor}, false) end")
    out = cells.withColumns({"ssb_open": flag("ssb_floor"), "cw_open": flag("cw_floor"), "digital_open": flag("digital_floor")})
    out = out.withColumns({"open": e("coalesce(ssb_open, false) or coalesce(cw_open, false) or coalesce(digital_open, false)"), "rising": e(_rising()), "unknown_power": ~F.col("has_power")})
    return out.drop("ssb_floor", "cw_floor", "digital_floor", "digital_open", "has_power", "source").withColumnRenamed("name", "source")


def with_atypical(cells: DataFrame, stats: DataFrame, slot: int, minutes: int, threshold: float = 2.0, areas: DataFrame | None = None) -> DataFrame:
    """Adds z, sample_days, confidence and atypical against the source's calendar (filled_calendar_stats with public source names).

    ``areas`` is live_area(): the calendar isn't scaled to a widened block, whose larger counts would be taken for surges,
    so that a location with one has none.
    """
    now = stats.where(F.col("slot") == slot).select("source", "band", "region", "mean", "sd", "sample_days")
    out = cells.join(now, ["source", "band", "region"], "left").withColumn("z", F.when((F.col("sd") > 0) & (F.col("sample_days") >= 3), (F.col("spots") * (30.0 / minutes) - F.col("mean")) / F.col("sd")))
    if areas is not None:
        wide = areas.where("widened").select("qth", F.lit(True).alias("wide"))
        out = out.join(wide, "qth", "left").withColumn("z", F.when(F.col("wide").isNull(), F.col("z"))).drop("wide")
    out = out.withColumn("atypical", F.coalesce(F.col("z") >= threshold, F.lit(False)))
    return out.withColumn("z", F.when(F.col("atypical"), e(numbers.round_half_away("z", 3)))).withColumn("confidence", F.when(F.col("atypical"), e(numbers.round_half_away(classify.atypical_confidence("sample_days"), 3)))).drop("mean", "sd")


def with_flavor(cells: DataFrame, digital: DataFrame, slot: int, elapsed: float) -> DataFrame:
    """Adds to atypical beacon cells what the digital feed's calendar of the same slot says of them."""
    base = digital.where(F.col("slot") == slot).select("band", "region", F.col("mean").alias("d_mean"), F.col("sd").alias("d_sd"), F.col("active_days").alias("d_days"), F.col("today").alias("d_today"))
    out = cells.join(base, ["band", "region"], "left")
    return out.withColumn("flavor", F.when(F.col("atypical"), e(classify.flavor("d_days", "d_mean", "d_sd", "d_today", str(float(elapsed)))))).drop("d_mean", "d_sd", "d_days", "d_today")


def rollup(cells: DataFrame) -> DataFrame:
    """(qth, band, region): open on any source, the share of sources that agree, the surest atypical source."""
    best = F.max_by(F.struct("confidence", "z"), F.when(F.col("atypical"), F.struct("confidence", "z")))
    out = cells.groupBy("qth", "band", "region").agg(
        F.sum("spots").alias("spots"), F.bool_or("from_here").alias("from_here"), F.bool_or("open").alias("open"), F.bool_or(F.coalesce("ssb_open", F.lit(False))).alias("ssb_open"), F.bool_or(F.coalesce("cw_open", F.lit(False))).alias("cw_open"), F.bool_or("rising").alias("rising"),
        F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"), F.count_if("atypical").alias("n_atypical"), best.alias("best"), F.sort_array(F.collect_list(F.struct("source_order", "source"))).alias("active"),
    )
    return out.select("qth", "band", "region", "spots", "from_here", "open", "ssb_open", "cw_open", "rising", e(numbers.round_half_away("cast(n_open as double) / n", 2)).alias("open_agreement"), e(numbers.round_half_away("cast(n_atypical as double) / n", 2)).alias("atypical_agreement"), F.col("best.z").alias("z"), F.col("best.confidence").alias("confidence"), F.array_join(F.transform("active", lambda x: x["source"]), ",").alias("sources"))


def surge_strength(cells: DataFrame) -> DataFrame:
    return cells.withColumn("strength", F.when(F.col("z").isNotNull(), e(classify.surge_strength("z", "atypical_agreement"))))


#: Bits of a cell's flags in the summary.
FLAGS = {"ssb_open": 1, "cw_open": 2, "rising": 4, "is_atypical": 8, "from_here": 16}


def prop_summary(cells: DataFrame) -> DataFrame:
    """``cells`` (a rollup) with intensity, the share of the location's busiest cell, flags, and the band's rank by spots."""
    w = Window.partitionBy("qth")
    out = cells.withColumn("is_atypical", F.col("z").isNotNull()).withColumn("intensity", e(numbers.round_half_away("cast(spots as double) / max(spots) over (partition by qth)", 2)))
    out = out.withColumn("flags", sum((F.when(F.col(c), bit).otherwise(0) for c, bit in FLAGS.items()), F.lit(0)))
    out = out.withColumn("band_spots", F.sum("spots").over(Window.partitionBy("qth", "band")))
    return out.withColumn("band_rank", F.dense_rank().over(w.orderBy(F.desc("band_spots"), "band"))).select("qth", "band", "region", "spots", "intensity", "flags", "band_spots", "band_rank")


def top_bands(cells: DataFrame, most: int = 4) -> DataFrame:
    """(qth, rank, band, regions, ssb, cw, rising, spots) of a rollup: the busiest bands, each with its regions, the busiest first."""
    per_band = cells.groupBy("qth", "band").agg(
        F.sum("spots").alias("spots"), F.bool_or("ssb_open").alias("ssb"), F.bool_or("cw_open").alias("cw"), F.bool_or("rising").alias("rising"), F.sort_array(F.collect_list(F.struct((-F.col("spots")).alias("k"), "region"))).alias("x")
    )
    ranked = per_band.withColumn("rank", F.row_number().over(Window.partitionBy("qth").orderBy(F.desc("spots"), "band"))).where(F.col("rank") <= most)
    return ranked.select("qth", "rank", "band", e("transform(x, v -> v.region)").alias("regions"), "ssb", "cw", "rising", "spots")


def region_name(code: str) -> str:
    """A region's name for people; other codes as they are."""
    return f"(case {code} " + " ".join(f"when '{k}' then '{v}'" for k, v in geo.REGION_NAMES.items()) + f" else {code} end)"


def headline(cells: DataFrame, qths: DataFrame | None = None) -> DataFrame:
    """(qth, kind, text): the surest anomaly, else a rising path (an open one first, then the busiest), else quiet.

    With ``qths`` a location without any cell gets its row too.
    """
    open_first = F.when(F.col("ssb_open") | F.col("cw_open"), 0).otherwise(1)
    order = Window.partitionBy("qth").orderBy(F.col("z").isNull(), F.desc("confidence"), F.desc("z"), ~F.col("rising"), open_first, F.desc("spots"), "band", "region")
    top = cells.withColumn("n_bands", F.size(F.collect_set("band").over(Window.partitionBy("qth")))).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    text = f"case when z is not null then concat(band, ' atypical surge to ', {region_name('region')}, ' (z=', format_string('%.1f', z), ')') when rising then concat(band, ' rising toward ', {region_name('region')}) else concat(n_bands, ' bands active, none rising') end"
    out = top.select("qth", e("case when z is not null then 'atypical' when rising then 'rising' else 'quiet' end").alias("kind"), e(text).alias("text"))
    return out if qths is None else qths.select("qth").distinct().join(out, "qth", "left").na.fill({"kind": "quiet", "text": "0 bands active, none rising"})


def from_here_cells(spots: DataFrame, areas: DataFrame, profiles: DataFrame, t0: int, t1: int) -> DataFrame:
    """(area, band, region, source): paths from an area alone, each end inside it once, with stations at the far end."""
    middle = t0 + (t1 - t0) // 2
    level = f"case when source = 'wspr' then case when txpower > 0 then {bands.effective_snr('snr', 'txpower')} end else snr end"
    near = spots.where(F.col("t").between(t0, t1)).where(e(bands.band_in_scope("band"))).withColumns({"level": e(level), "early": F.col("t") < middle})
    ends = from_here_ends(near, areas)
    cells = ends.groupBy("area", "band", "region", "source").agg(F.count(F.lit(1)).alias("spots"), F.max("level").alias("best_level"), F.countDistinct(F.when(F.col("call") != "", F.col("call"))).alias("stations"), F.count_if("early").alias("early_spots"), F.count_if(~F.col("early")).alias("late_spots"))
    return _opened(cells.join(profiles, "source"))


def from_here_surges(cells: DataFrame, normals: DataFrame, threshold: float = 2.0) -> DataFrame:
    """The digital feed's cells with what is expected of them, and cells expected to have 5 spots or more that have none.

    A surge needs five spots from three stations; expected counts need three sample days.
    """
    live = cells.where("source = 'pskr'").select("area", "band", "region", "spots", "stations")
    known = normals.where("sample_days >= 3")
    days = known.groupBy("area").agg(F.max("sample_days").alias("days"))
    out = live.join(days, "area").join(known.drop("sample_days"), ["area", "band", "region"], "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    out = out.withColumn("z", F.when(e("sd > 0 and spots >= 5 and stations >= 3"), (F.col("spots") - F.col("expected")) / F.col("sd"))).withColumn("surge", F.coalesce(F.col("z") >= threshold, F.lit(False))).withColumn("silent", F.lit(False))
    quiet = known.where("expected >= 5").join(cells.select("area", "band", "region").distinct(), ["area", "band", "region"], "left_anti")
    quiet = quiet.select("area", "band", "region", F.lit(0).cast("long").alias("spots"), F.lit(0).cast("long").alias("stations"), F.col("sample_days").alias("days"), "expected", "sd", F.lit(None).cast("double").alias("z"), F.lit(False).alias("surge"), F.lit(True).alias("silent"))
    both = out.select(quiet.columns).unionByName(quiet)
    return both.select("area", "band", "region", "spots", "stations", e(numbers.round_half_away("expected", 1)).alias("expected"), F.when(F.col("surge"), e(numbers.round_half_away("z", 3))).alias("z"), "surge", "silent")


def from_here_trend(spots: DataFrame, areas: DataFrame, now: int, bins: int = 12, seconds: int = 300) -> DataFrame:
    """(area, band, region, bin, n): the digital feed's ends in the last twelve five-minute bins, the newest last; empty ones are 0."""
    start = now - bins * seconds
    near = spots.where((F.col("t") > start) & (F.col("t") <= now) & (F.col("source") == "mqtt")).where(e(bands.band_in_scope("band")))
    ends = from_here_ends(near, areas).withColumn("bin", e(f"cast(floor((t - {start} - 1) / {seconds}) as int)"))
    counts = ends.groupBy("area", "band", "region", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = counts.select("area", "band", "region").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, ["area", "band", "region", "bin"], "left").select("area", "band", "region", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def prop_cells_v1(spots: DataFrame, qths: DataFrame, cw_floor: float = -5.0) -> DataFrame:
    """(qth, band, region): beacon cells alone, with voice open from 10 dB and Morse from the floor asked for."""
    profiles = source_profiles(spots.sparkSession, ["wspr"], cw_min_db=cw_floor)
    return source_cells(spots.where("source = 'wspr'"), qths, profiles).select("qth", "band", "region", "spots", "best_level", "ssb_open", "cw_open", "rising", "from_here")


