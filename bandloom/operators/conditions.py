"""How good each band is now at each location, against its own normal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands, classify, geo, grid, numbers, times
from . import baselines, intervals
from .matching import band_events, cluster_ends, matched_spots, ring_squares

e = F.expr

# Bins of a window, km of a long path.
BINS, LONG_HAUL_KM = 12, 3000

# What a widened area rests on: minutes, SNR floor, spots of a full sample, bands that need one, widest radius.
AREA_MINUTES, AREA_FLOOR_DB, AREA_SAMPLE, AREA_BANDS, AREA_RADIUS = 20, -15, 25, 3, 3


#: Optional columns of qths: gaps in what was recorded (an array of structs a, b), and the first second that is complete.
LIVE = ("gaps", "complete_since")


def windows(qths: DataFrame) -> DataFrame:
    """``qths`` with the anchor of its cluster (null for a callsign), the window's start and end, and live_minutes.

    A window begins no earlier than ``complete_since``, and its live minutes, 1 at least, leave its gaps out.
    """
    start = intervals.live_start() if "complete_since" in qths.columns else "now - minutes * 60"
    out = qths.withColumns({"t0": e(start), "t1": F.col("now"), "anchor": e(f"case when {grid.is_locator('qth')} then {grid.cluster_anchor('qth')} end")})
    live = intervals.seconds_of(intervals.segments()) if "gaps" in qths.columns else "(t1 - t0)"
    return out.withColumn("live_minutes", e(f"greatest({live} / cast(60 as double), 1)"))


def _live(qths: DataFrame, start: str = "t0", end: str = "t1") -> tuple[list[str], str]:
    """The columns of windows() that tell whether a spot at t is in one, and the test."""
    return ([start, end, "gaps"], f"t between {start} and {end} and {intervals.recorded()}") if "gaps" in qths.columns else ([start, end], f"t between {start} and {end}")


def recent(spots: DataFrame, qths: DataFrame, t: str = "t", seconds: str = "minutes * 60") -> DataFrame:
    """The spots that the earliest and latest window of ``qths`` span: a filter that reaches the scan."""
    first, last = qths.agg(F.min(e(f"now - {seconds}")), F.max("now")).first()
    return between(spots, first, last, t) if first is not None else spots.where(F.lit(False))


def between(spots: DataFrame, first: int, last: int, t: str = "t") -> DataFrame:
    """Spots from one second to another, and of these days, by which stored spots lie."""
    near = spots.where(F.col(t).between(first, last))
    return near.where(F.col("day").between(first // 86400, last // 86400)) if "day" in spots.columns else near


def activity_by_bin(spots: DataFrame, qths: DataFrame) -> DataFrame:
    """(qth, band, bin, rate): spots a minute of any source in each twelfth of the window; bins without spots are 0.

    The last bin holds what lies beyond an even division. A band is listed once it has a spot.
    """
    near = recent(spots, qths).where(e(bands.band_in_scope("band"))).select("spot_id", "t", "band", "snr", "s4", "sc", "r4", "rc")
    hits = matched_spots(near, qths, "cw_min_db", "now", "minutes").where("t between now - minutes * 60 and now and snr >= cw_min_db").withColumn("bin_seconds", e(numbers.quotient("minutes * 60", str(BINS)))).where("bin_seconds > 0")
    binned = hits.withColumn("bin", e(f"cast(least({numbers.quotient('t - (now - minutes * 60)', 'bin_seconds')}, {BINS - 1}) as int)"))
    counts = binned.groupBy("qth", "band", "bin", "bin_seconds").agg(F.count(F.lit(1)).alias("n"))
    every = counts.select("qth", "band", "bin_seconds").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    return every.join(counts, ["qth", "band", "bin", "bin_seconds"], "left").select("qth", "band", "bin", e("coalesce(n, 0) / (bin_seconds / 60.0D)").alias("rate"))


def series(rates: DataFrame) -> DataFrame:
    """(qth, band, activity, sparkline): the bins in order, and each as hundredths of the largest, to two decimals."""
    rows = rates.groupBy("qth", "band").agg(F.sort_array(F.collect_list(F.struct("bin", "rate"))).alias("x")).select("qth", "band", e("transform(x, v -> v.rate)").alias("activity"))
    scaled = numbers.round_half_away("v / array_max(activity) * 100", 2)
    return rows.withColumn("sparkline", e(f"transform(activity, v -> case when array_max(activity) > 0 then {scaled} else 0.0D end)"))


def trends(rates: DataFrame, first_bins: DataFrame | None = None) -> DataFrame:
    """``series`` with trend, trend_delta and sustained.

    The newest bin is still filling: of eight bins and more it is left out, and the oldest too if an odd number is left; the
    trend compares the newer half with the older one, and is stable for fewer than six. ``first_bins`` has qth and
    from_bin, the first bin that the trend may read. Sustained is the run of bins of 30 and more at the end, from the
    bin before the newest if that one is lower.
    """
    out = series(rates)
    out = out.withColumn("from_bin", F.lit(0)) if first_bins is None else out.join(first_bins.select("qth", "from_bin"), "qth", "left").withColumn("from_bin", F.coalesce("from_bin", F.lit(0)))
    out = out.withColumn("read_", e("slice(sparkline, from_bin + 1, size(sparkline))"))
    out = out.withColumn("read_", e("case when size(read_) >= 8 then slice(read_, 1 + (size(read_) - 1) % 2, size(read_) - 1 - (size(read_) - 1) % 2) else read_ end"))
    mean = lambda part, n: f"aggregate({part}, 0.0D, (a, v) -> a + v) / ({n})"
    half = "size(read_) div 2"
    slope = f"{mean(f'slice(read_, cast({half} + 1 as int), size(read_))', f'size(read_) - {half}')} - {mean(f'slice(read_, 1, cast({half} as int))', half)}"
    out = out.withColumn("slope", e(f"case when size(read_) >= 6 then {slope} else 0.0D end"))
    out = out.withColumn("trend", e(classify.trend_word("slope", 6))).withColumn("trend_delta", e(numbers.round_half_away("slope / 10", 2)))
    run = "aggregate(reverse(case when element_at(sparkline, -1) < 30 then slice(sparkline, 1, size(sparkline) - 1) else sparkline end), named_struct('n', 0, 'open', true), (a, v) -> case when a.open and v >= 30 then named_struct('n', a.n + 1, 'open', true) else named_struct('n', a.n, 'open', false) end, a -> a.n)"
    return out.withColumn("sustained", e(run)).drop("slope", "read_", "from_bin")


def covered_bins(qths: DataFrame, areas: DataFrame, retention_minutes: int = 60) -> DataFrame:
    """(qth, from_bin) for trends(): a widened area (live_area()) reads live spots alone, so its bins count from the first that these cover."""
    q = qths if "complete_since" in qths.columns else qths.withColumn("complete_since", F.lit(None).cast("long"))
    return q.join(areas.where("widened").select("qth"), "qth").select("qth", e(intervals.covered_from_bin(BINS, retention_minutes)).alias("from_bin"))


def window_events(spots: DataFrame, qths: DataFrame) -> DataFrame:
    """Band events of each location inside its window and outside its gaps, in scope, with its parameters."""
    near = recent(spots, qths).where(e(bands.band_in_scope("band")))
    columns, within = _live(qths)
    return band_events(near, windows(qths), "now", "minutes", "cw_min_db", *columns, within=within).drop(*columns)


def scored_events(events: DataFrame) -> DataFrame:
    """The calibrated events above the SNR floor, the first of each half minute, stations and band alone."""
    w = Window.partitionBy("qth", "band", "bucket", "sc", "rc", "sl", "rl").orderBy("t", "spot_id")
    return events.where("calibrated and snr >= cw_min_db").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def band_features(scored: DataFrame) -> DataFrame:
    """(qth, band) with counts of spots, links, stations and squares, and of distances and SNR; percentiles by nearest rank."""
    disc = lambda p, x: e(f"percentile_disc({p}) within group (order by {x})")
    # Each key is made distinct before the shuffle, in the one aggregation; a window for each would shuffle and sort all rows each time.
    return scored.groupBy("qth", "band").agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct(F.struct("sc", "rc", "remote")).alias("unique_links"), F.count_distinct("sc").alias("unique_tx"), F.count_distinct("rc").alias("unique_rx"), F.count_distinct(e("nullif(remote4, '')")).alias("unique_grids"),
        F.avg("km").alias("avg_km"), disc(0.5, "km").alias("median_km"), disc(0.9, "km").alias("p90_km"), F.max("km").alias("max_km"), F.count_if(F.col("km") >= LONG_HAUL_KM).alias("long_haul"),
        F.avg("snr").alias("avg_snr"), disc(0.5, "snr").alias("median_snr"), disc(0.9, "snr").alias("p90_snr"), F.max("snr").alias("peak_snr"), F.count_if(F.col("snr") >= 0).alias("ssb_count"), F.count_if(F.col("snr") >= -12).alias("cw_count"),
        *[F.count_if(e(f"{classify.distance_tier('km')} = {k}")).alias(f"tier{k}") for k in range(5)],
    ).withColumn("tiered_p90", e(baselines.tier_p90([f"tier{k}" for k in range(5)]))).drop(*[f"tier{k}" for k in range(5)])


def azimuth_sectors(scored: DataFrame) -> DataFrame:
    """(qth, band, direction, n, dominant): spots by direction; the first of the most frequent, in compass order, is dominant."""
    counts = scored.where("direction <> ''").groupBy("qth", "band", "direction").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_position(F.array(*[F.lit(d) for d in geo.DIRECTIONS]), F.col("direction"))
    return counts.withColumn("dominant", F.row_number().over(Window.partitionBy("qth", "band").orderBy(F.desc("n"), order)) == 1)


def region_counts(scored: DataFrame) -> DataFrame:
    """(qth, band, region, n): spots by the region of the remote square."""
    return scored.withColumnRenamed("remote_region", "region").where("region <> '??'").groupBy("qth", "band", "region").agg(F.count(F.lit(1)).alias("n"))


def regional_spots(spots: DataFrame, qths: DataFrame) -> DataFrame:
    """(qth, band, regional): ends of calibrated spots in the location's cluster during its window, at any SNR, repeats included."""
    columns, within = _live(qths)
    w = windows(qths).select("qth", "anchor", *columns)
    ends = cluster_ends(recent(spots, qths).where("calibrated and band <> ''"))
    return ends.join(w, "anchor").where(within).groupBy("qth", "band").agg(F.count(F.lit(1)).alias("regional"))


def dx_conditions(spots: DataFrame, qths: DataFrame, clusters: DataFrame, everywhere: DataFrame, span: DataFrame, coverage: DataFrame) -> DataFrame:
    """The band table of every location: scores, status, mode, recommendation, and how the band compares with its normal.

    ``spots`` are prepared spots, ``qths`` has qth, surroundings, minutes, cw_min_db and now; the other tables are the
    baselines. A band is listed once it has a scored spot. Scores are shrunk by their support. Where qths has LIVE columns,
    counts, rates and what is expected leave out what wasn't recorded.
    """
    w = windows(qths)
    events = window_events(spots, qths)
    local = events.where("snr >= cw_min_db").groupBy("qth", "band").agg(F.count(F.lit(1)).alias("local"))
    out = band_features(scored_events(events)).join(w, "qth")

    pairs = baselines.baseline_with_fallback(clusters, everywhere, w.where("anchor is not null"))
    rates = baselines.slot_rates(pairs, span, coverage)  # three readers, a few thousand rows a location
    spans = w.where("anchor is not null").select("qth", "anchor", "t0", "t1", "cw_min_db")
    expected = expected_live(w.where("anchor is not null"), rates)
    reach = baselines.reach_baseline(spans, clusters, rates).select("qth", "band", "baseline_p90", "reach_support")
    quantiles = baselines.baseline_quantiles(pairs, "anchor", "band", "slot")
    out = out.withColumn("slot", e(times.slot_of_day("now")))
    out = out.join(rates.select("anchor", "band", "slot", F.col("rate").alias("baseline_rate"), F.col("support").alias("baseline_support"), "used_cluster"), ["anchor", "band", "slot"], "left").join(quantiles, ["anchor", "band", "slot"], "left")
    for part in (local, regional_spots(spots, qths), expected, reach):
        out = out.join(part, ["qth", "band"], "left")
    history = span.crossJoin(coverage).select(e(numbers.round_half_away("history_minutes * coverage")).alias("cluster_minutes"), "history_minutes")  # one row
    out = out.crossJoin(history).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("local", "regional", "baseline_rate", "baseline_support")}).withColumn("used_cluster", F.coalesce("used_cluster", F.lit(False)))

    trusted = "expected > 0 and expected / live_minutes * greatest(cluster_minutes / 1440, 1) * 30 >= 100"
    out = out.withColumn("activity_level", e(f"case when {trusted} then {classify.activity_level('regional', 'expected')} else 'no_baseline' end"))
    out = out.withColumn("activity_ratio", e(f"case when {trusted} then regional / expected else 0 end"))
    out = out.withColumn("reach_ratio", e("case when links >= 20 and reach_support >= 100 and baseline_p90 > 0 then tiered_p90 / baseline_p90 else 0 end"))
    out = out.withColumn("reach_level", e(f"case when reach_ratio > 0 then {classify.reach_level('reach_ratio')} else '' end"))
    out = out.withColumns({"dx_ratio": e("cast(long_haul as double) / links"), "spots_per_minute": e("cast(links as double) / live_minutes")})
    activity = f"case when activity_level in ('above', 'normal', 'below') then {numbers.clamp01('activity_ratio / 2')} else 0.5 end"
    out = out.withColumn("raw_score", e(f"cast(100 as double) * (0.45 * {numbers.clamp01('p90_km / 7000 * 0.7 + dx_ratio * 0.3')} + 0.35 * {activity} + 0.20 * {numbers.clamp01('cast(p90_snr + 20 as double) / 30')})"))
    out = out.withColumn("factor", e(f"{numbers.clamp01('links / 25.0')} * (0.35 + 0.65 * {numbers.clamp01('baseline_support / 2000.0')}) * case when q25 is null then 0.75 else 1 end"))
    out = out.withColumns({"score": e(numbers.clamp("raw_score * factor", 0, 100)), "confidence": e(numbers.clamp("100 * factor", 0, 99)), "status_score": e("(q25 + q75) / 2 + (raw_score - (q25 + q75) / 2) * factor")})
    out = out.withColumn("status", e(classify.band_status("status_score", "q25", "q75", "links"))).withColumn("mode", e(classify.spot_mode("ssb_count", "cw_count", "links")))
    out = out.withColumns({"condition": e(classify.condition_label("status", "score")), "recommendation": e(classify.recommendation("status", "mode", "dx_ratio", "spots_per_minute", "confidence"))})
    return out.withColumns({"repeat_ratio": e("cast(links - unique_links as double) / links"), "local_scale": e("case when regional > 0 then cast(local as double) / regional else 0 end")}).select(
        "qth", "band", "score", "confidence", "status", "condition", "mode", "recommendation", "links", "unique_links", "repeat_ratio", "spots_per_minute", "unique_tx", "unique_rx", "unique_grids",
        "avg_km", "max_km", "median_km", "p90_km", "dx_ratio", "avg_snr", "peak_snr", "median_snr", "p90_snr", "baseline_rate", "used_cluster", "q25", "q75", "activity_ratio", "activity_level",
        F.col("regional").alias("regional_spots"), F.col("expected").alias("regional_expected"), "local_scale", F.col("baseline_p90").alias("baseline_p90_km"), "reach_ratio", "reach_level", "history_minutes", "minutes", "live_minutes",
    )


def expected_live(w: DataFrame, rates: DataFrame) -> DataFrame:
    """(qth, band, expected) over the segments that windows() leave: null unless the cluster has every slot of each."""
    if "gaps" not in w.columns:
        return baselines.expected_counts(w.select("qth", "anchor", "t0", "t1"), rates).select("qth", "band", "expected")
    parts = baselines.expected_counts(intervals.split(w.select("qth", "anchor", "t0", "t1", "gaps")), rates)
    return parts.groupBy("qth", "band", "segments").agg(F.sum("expected").alias("x"), F.count("expected").alias("c")).select("qth", "band", e("case when c = segments then x end").alias("expected"))


def with_trends(conditions: DataFrame, rates: DataFrame, first_bins: DataFrame | None = None) -> DataFrame:
    """A band table with each band's trend, trend_delta, sustained and sparkline; a band without a series is stable."""
    out = conditions.join(trends(rates, first_bins).select("qth", "band", "trend", "trend_delta", "sustained", "sparkline"), ["qth", "band"], "left")
    return out.withColumns({"trend": F.coalesce("trend", F.lit("stable")), "trend_delta": F.coalesce("trend_delta", F.lit(0.0)), "sustained": F.coalesce("sustained", F.lit(0))})


def ranked_bands(conditions: DataFrame) -> DataFrame:
    """(qth, band, best_rank, worst_rank, listed_as): the three best and worst bands; best ones that are usable are
    recommended, worst ones that are surely bad are to avoid. Ties go by band."""
    best = Window.partitionBy("qth").orderBy(F.desc("score"), F.desc("confidence"), "band")
    worst = Window.partitionBy("qth").orderBy("score", F.desc("confidence"), "band")
    out = conditions.select("qth", "band", "status", "confidence", F.row_number().over(best).alias("best_rank"), F.row_number().over(worst).alias("worst_rank")).where("best_rank <= 3 or worst_rank <= 3")
    return out.withColumns({"recommended": e("best_rank <= 3 and status in ('green', 'yellow')"), "avoid": e("worst_rank <= 3 and confidence >= 30 and status in ('red', 'grey')")}).drop("status", "confidence")


def dx_overall(conditions: DataFrame) -> DataFrame:
    """(qth, score, confidence, status, condition, bands): all bands of a location, each by its number of spots.

    With with_trends() also trend_delta, weighted alike, and trend: rising or falling beyond 0.2 either way.
    """
    mean = lambda x, d: numbers.round_half_away(f"sum({x} * links) / sum(links)", d)
    out = conditions.groupBy("qth").agg(e(mean("score", 1)).alias("score"), e(mean("confidence", 1)).alias("confidence"), F.count(F.lit(1)).alias("bands"), F.count_if(e("status in ('green', 'yellow')")).alias("usable"))
    if "trend_delta" in conditions.columns:
        deltas = conditions.groupBy("qth").agg(e(mean("trend_delta", 2)).alias("trend_delta"))
        out = out.join(deltas, "qth").withColumn("trend", e("case when trend_delta > 0.2 then 'rising' when trend_delta < -0.2 then 'falling' else 'stable' end"))
    out = out.withColumn("status", e(classify.overall_status("score", "confidence", "bands")))
    return out.withColumn("condition", e(classify.condition_label("status", "score")))


def global_decision(overall: DataFrame) -> DataFrame:
    """Adds a verdict: go for a good overall status, selective if some bands are usable, wait otherwise."""
    return overall.withColumn("verdict", e("case when status = 'grey' or confidence < 20 then 'unclear' when status = 'green' then 'go' when usable > 0 then 'selective' else 'wait' end"))


def hot_bands(conditions: DataFrame, options: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(qth, band, kind, priority, rank, ...): bands that deserve attention, at most ``most`` (12) a location.

    ``conditions`` is with_trends(). ``options`` has qth, current_band (left out; null or all for none) and bands (an
    array of the only bands to look at; null for all).
    """
    c = conditions.where(e(bands.band_in_scope("band")))
    if options is not None:
        c = c.join(options.select("qth", e(bands.normalize_band("coalesce(current_band, '')")).alias("current_band"), "bands"), "qth", "left")
        c = c.where("coalesce(current_band, '') in ('', 'allm', 'all') or band <> current_band").where("bands is null or array_contains(bands, band)").drop("current_band", "bands")
    regional = "activity_level in ('above', 'normal', 'below')"
    c = c.withColumn("ratio", e(f"case when {regional} then {numbers.round_half_away('activity_ratio', 2)} when baseline_rate > 0 then spots_per_minute / baseline_rate else 0 end"))
    tail = numbers.poisson_upper_tail("links", f"(baseline_rate * {'live_minutes' if 'live_minutes' in c.columns else 'minutes'})")
    surprise = f"used_cluster and history_minutes >= 1440 and baseline_rate > 0 and baseline_rate <= 0.1 and ratio >= 5 and p90_km >= 800 and ({regional} or {tail} < 0.01)"
    surge = "used_cluster and history_minutes >= 1440 and reach_level = 'longer' and reach_ratio >= 1.5 and p90_km >= 5000"
    rising = "trend = 'rising' and trend_delta >= 1.5 and status in ('yellow', 'green') and ratio >= 1.5 and sustained >= 3 and spots_per_minute >= 1"
    c = c.where("sustained >= 2 and spots_per_minute >= 0.5").withColumn("kind", e(f"case when {surprise} then 'surprise' when {surge} then 'dx_surge' when {rising} then 'rising' end")).where("kind is not null")
    c = c.withColumns({"priority": e("case when kind = 'surprise' then 'high' else 'normal' end"), "rank_score": e("case kind when 'surprise' then ratio when 'dx_surge' then reach_ratio else score end")})
    order = Window.partitionBy("qth").orderBy(e("case priority when 'high' then 0 else 1 end"), e("case kind when 'surprise' then 0 when 'dx_surge' then 1 else 2 end"), F.desc("rank_score"), "band")
    ranked = c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(most, 12))
    return ranked.select("qth", "rank", "band", "kind", "priority", "rank_score", "spots_per_minute", "baseline_rate", "ratio", "sustained", "p90_km", "reach_ratio", "trend", "trend_delta", "status")


def holding(conditions: DataFrame, asked: DataFrame) -> DataFrame:
    """The present state of the bands that a location tracks (qth, band), hot or not."""
    return conditions.where(e(bands.band_in_scope("band"))).join(asked.select("qth", e(bands.normalize_band("band")).alias("band")).distinct(), ["qth", "band"]).select("qth", "band", "spots_per_minute", "status", "activity_level")


def _area_links(near: DataFrame, q: DataFrame) -> DataFrame:
    """(qth, spot_id, band, ring, ...): links of the last twenty minutes at the distance of their nearer end."""
    squares = ring_squares(q.withColumns({"x": e(grid.square_x("centre")), "y": e(grid.square_y("centre")), "r": F.lit(AREA_RADIUS)}), "qth")
    ends = near.select("spot_id", "t", "band", F.explode(F.array("s4", "r4")).alias("square"))
    return ends.join(squares, "square").groupBy("qth", "spot_id", "t", "band").agg(F.min("ring").alias("ring")).join(q, "qth").where(f"t between now - {AREA_MINUTES * 60} and now")


def widened_bands(spots: DataFrame, qths: DataFrame) -> DataFrame:
    """(qth, band, base_links, area_widened): links inside the block that a location asked for, and whether the band has a
    full sample only because the block was widened. Bands with a link in the widest block."""
    areas = live_area(spots, qths)
    near = recent(spots, qths, seconds=str(AREA_MINUTES * 60)).where(e(f"calibrated and s4 is not null and r4 is not null and snr >= {AREA_FLOOR_DB} and {bands.band_in_scope('band')}"))
    links = _area_links(near, areas.join(qths.select("qth", "now"), "qth"))
    counts = links.groupBy("qth", "band", "widened").agg(F.count_if(e("ring <= base_radius")).alias("base_links"))
    return counts.select("qth", "band", "base_links", (F.col("widened") & (F.col("base_links") < AREA_SAMPLE)).alias("area_widened"))


def band_details(spots: DataFrame, qths: DataFrame, rates: DataFrame) -> DataFrame:
    """(qth, band, dominant, sectors, regions, slot_rates, slot_own, activity, sparkline, area_widened): what a band's row shows
    beside its scores. sectors and regions are maps of counts; slot_rates and slot_own the 48 half hours' normal rates and
    whether they are the cluster's own; ``rates`` is slot_rates()."""
    scored = scored_events(window_events(spots, qths))
    sectors = azimuth_sectors(scored).groupBy("qth", "band").agg(F.max(F.when(F.col("dominant"), F.col("direction"))).alias("dominant"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("direction", "n")))).alias("sectors"))
    regions = region_counts(scored).groupBy("qth", "band").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("region", "n")))).alias("regions"))
    slots = rates.groupBy("anchor", "band").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("rate", "used_cluster")))).alias("x"))
    slots = slots.select("anchor", "band", e("transform(sequence(0, 47), s -> coalesce(x[s].rate, 0.0D))").alias("slot_rates"), e("transform(sequence(0, 47), s -> coalesce(x[s].used_cluster, false))").alias("slot_own"))
    out = scored.select("qth", "band").distinct().join(windows(qths).select("qth", "anchor"), "qth")
    for part in (sectors, regions, series(activity_by_bin(spots, qths)), widened_bands(spots, qths).select("qth", "band", "area_widened")):
        out = out.join(part, ["qth", "band"], "left")
    out = out.join(slots, ["anchor", "band"], "left").withColumns({"area_widened": F.coalesce("area_widened", F.lit(False)), "slot_rates": e("coalesce(slot_rates, array_repeat(0.0D, 48))"), "slot_own": e("coalesce(slot_own, array_repeat(false, 48))")})
    return out.select("qth", "band", "dominant", "sectors", "regions", "slot_rates", "slot_own", "activity", "sparkline", "area_widened")


def live_area(spots: DataFrame, qths: DataFrame) -> DataFrame:
    """(qth, centre, base_radius, radius, widened): the smallest square block with enough spots on enough bands.

    Links of the last twenty minutes count at the distance of their nearer end. With fewer than 25 links within three rings the
    block isn't widened; if no radius gives three bands 25 links each, it is the widest.
    """
    q = qths.where(e(grid.is_locator("qth"))).select("qth", e("substr(qth, 1, 4)").alias("centre"), e("case when coalesce(surroundings, false) then 1 else 0 end").alias("base_radius"), "now")
    near = recent(spots, qths, seconds=str(AREA_MINUTES * 60)).where(e(f"calibrated and s4 is not null and r4 is not null and snr >= {AREA_FLOOR_DB} and {bands.band_in_scope('band')}"))
    links = _area_links(near, q)
    by_radius = links.withColumn("radius", F.explode(e(f"sequence(ring, {AREA_RADIUS})"))).groupBy("qth", "band", "radius").agg(F.count(F.lit(1)).alias("n"))
    full = by_radius.groupBy("qth", "radius").agg(F.count_if(F.col("n") >= AREA_SAMPLE).alias("full_bands"), F.sum("n").alias("total"))
    picked = full.join(q, "qth").groupBy("qth").agg(F.min(e(f"case when full_bands >= {AREA_BANDS} and radius >= base_radius then radius end")).alias("found"), F.max(e(f"case when radius = {AREA_RADIUS} then total end")).alias("total"))
    out = q.join(picked, "qth", "left").withColumn("radius", e(f"case when coalesce(total, 0) < {AREA_SAMPLE} then base_radius else coalesce(found, {AREA_RADIUS}) end"))
    return out.select("qth", "centre", "base_radius", "radius", e("radius > base_radius").alias("widened"))
