"""Tables of counts that say what is normal, and what is read from them.

All counts are additive: a later batch is added by merge_counts().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands, classify, grid
from ..functions.numbers import clamp01
from .matching import cluster_ends, region_keys, with_path

e = F.expr

# The largest count of a bucket that is believed, the least weight behind quantiles, and minutes of a slot.
PLAUSIBLE, QUANTILE_WEIGHT, SLOT_MINUTES = 1 << 30, 200, 30.0

BASELINE_KEY = ("band", "slot", "distance_tier", "snr_tier")


def eligible(spots: DataFrame) -> DataFrame:
    """Spots that enter baselines: calibrated, with a band in scope and both locators, and their tiers."""
    gated = spots.where(e(f"calibrated and {bands.band_in_scope('band')} and {bands.baseline_gate('band', 'sl', 'rl')}"))
    return with_path(gated).withColumns({"distance_tier": e(classify.distance_tier("km")), "snr_tier": e(classify.snr_tier("snr"))})


def global_baseline(spots: DataFrame) -> DataFrame:
    """count by band, slot, distance tier and SNR tier."""
    return eligible(spots).groupBy(*BASELINE_KEY).agg(F.count(F.lit(1)).alias("count"))


def timed_baseline(spots: DataFrame) -> DataFrame:
    """The same with the first and last time of each: what baseline_span() tells, too, in one pass."""
    return eligible(spots).groupBy(*BASELINE_KEY).agg(F.count(F.lit(1)).alias("count"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def cluster_baseline(spots: DataFrame) -> DataFrame:
    """The same by the cluster of each end: a spot counts for both its ends, twice if they share a cluster."""
    return cluster_ends(eligible(spots)).groupBy(F.col("anchor").alias("cluster_anchor"), *BASELINE_KEY).agg(F.count(F.lit(1)).alias("count"))


def baseline_ends(spots: DataFrame) -> DataFrame:
    """cluster_baseline() and, for the anchor '', global_baseline() in one pass over spots with the anchors of their ends (s_anchor, r_anchor)."""
    ends = eligible(spots).withColumn("cluster_anchor", F.explode(F.array("s_anchor", "r_anchor", F.lit("")))).where("cluster_anchor is not null")
    return ends.groupBy("cluster_anchor", *BASELINE_KEY).agg(F.count(F.lit(1)).alias("count"))


def cluster_baseline_daily(spots: DataFrame) -> DataFrame:
    """The same for each day, with the first time observed: what a rebuild keeps of the days that it has done."""
    return cluster_ends(eligible(spots)).groupBy(F.col("anchor").alias("cluster_anchor"), *BASELINE_KEY, "day").agg(F.count(F.lit(1)).alias("count"), F.min("t").alias("first_t"))


def merge_counts(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Two tables of counts as one; columns other than the key are summed."""
    sums = [F.sum(c).alias(c) for c in old.columns if c not in key]
    return old.unionByName(new.select(old.columns)).groupBy(*key).agg(*sums)


#: SNR floors of the counters of region_daily.
FLOORS = (-20, -15, -10, -5, 0)


def floor_name(db: int) -> str:
    return f"snr_ge_{'m' if db < 0 else ''}{abs(db)}"


def region_ends(spots: DataFrame) -> DataFrame:
    """The rows that region_daily() counts."""
    return region_keys(spots.where(e(f"calibrated and {bands.band_in_scope('band')}")))


def region_daily(spots: DataFrame, *dealt: str) -> DataFrame:
    """Per square, band, slot, region of the other end and day: spots, and how many reach each SNR floor.

    ``dealt`` are columns that follow from day and slot, by which the spots are dealt to tasks already.
    """
    keyed = region_ends(spots)
    counters = [F.count_if(F.col("snr") >= db).alias(floor_name(db)) for db in FLOORS]
    return keyed.groupBy("target4", "band", "slot", "region", "day", *dealt).agg(F.count(F.lit(1)).alias("spot_count"), F.count("snr").alias("snr_spots"), *counters).drop(*dealt)


def ingest_slot_totals(daily: DataFrame) -> DataFrame:
    """Spots per day and slot, in the units of region_daily."""
    return daily.groupBy("day", "slot").agg(F.sum("spot_count").alias("spot_total"))


def wspr_daily(spots: DataFrame) -> DataFrame:
    """Beacon spots per band, slot, region and day; the region is that of the reporting end, else of the other."""
    return _daily(spots.where("source = 'wspr'"), F.col("s_region"), F.col("r_region"), "band", "slot")


def source_daily(spots: DataFrame) -> DataFrame:
    """Spots of each source per band, slot, region and day; the region is that of the receiving end, else of the other."""
    swap = e(bands.receiver_is_sender_side("source"))
    recv, other = (F.when(swap, F.col(a)).otherwise(F.col(b)) for a, b in (("s_region", "r_region"), ("r_region", "s_region")))
    return _daily(spots, recv, other, "band", "source", "slot")


def _daily(spots: DataFrame, first: Column, second: Column, *key: str) -> DataFrame:
    region = F.when(first != "??", first).otherwise(second)
    placed = spots.where(e(bands.band_in_scope("band"))).withColumn("region", region).where("region <> '??'")
    return placed.groupBy(*key, "region", "day").agg(F.count(F.lit(1)).alias("spot_count"))


def season_counts(daily: DataFrame, layer: str = "pskr") -> DataFrame:
    """The seasonal record in long form: count and six SNR bins of a square, band, region, day and slot, at most 255 each."""
    from ..functions.times import day_of_month, year_month

    bins = classify.snr_bins("snr_spots", [floor_name(db) for db in FLOORS])
    keyed = daily.where(f"band in ({bands.listed(bands.ALMANAC_BANDS)})")
    return keyed.select(F.col("target4").alias("grid4"), "band", "region", e(year_month("day")).alias("year_month"), F.lit(layer).alias("layer"), e(day_of_month("day")).alias("dom"), "slot", e(classify.saturating("spot_count")).alias("count"), F.array(*[e(b) for b in bins]).alias("snr_bins"))


def area_activity(season: DataFrame) -> DataFrame:
    """Days of the month, as bits from the first, on which a square and band had any spot."""
    return season.groupBy("grid4", "band", "year_month", "layer").agg(F.expr("bit_or(shiftleft(1, dom - 1))").alias("day_mask"))


def baseline_span(spots: DataFrame) -> DataFrame:
    """One row: first and last eligible spot, minutes between them, and how many there are."""
    return _span(eligible(spots).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("events")))


def span_of(timed: DataFrame) -> DataFrame:
    """baseline_span() from timed_baseline()."""
    return _span(timed.agg(F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), F.coalesce(F.sum("count"), F.lit(0)).alias("events")))


def _span(one: DataFrame) -> DataFrame:
    return one.withColumn("history_minutes", e("cast(floor((last_t - first_t) / 60) as bigint)"))


def cluster_coverage(clusters: DataFrame, everywhere: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """One row: the share of the global span that the cluster table covers, at most 1.

    ``firsts`` is one row with the first times of both tables (global_first, cluster_first) and now; where both are known,
    their spans tell. Otherwise half the cluster table's counts do.
    """
    if firsts is not None:
        known = firsts.select(coverage_of_spans(F.col("global_first"), F.col("cluster_first"), F.col("now")).alias("by_span"), (F.col("global_first").isNotNull() & F.col("cluster_first").isNotNull()).alias("known"))
        return cluster_coverage(clusters, everywhere).crossJoin(known).select(e("case when known then by_span else coverage end").alias("coverage"))  # one row each
    c, g = clusters.agg(F.sum("count").alias("c")), everywhere.agg(F.sum("count").alias("g"))
    return c.crossJoin(g).select(e("case when coalesce(g, 0) <= 0 or coalesce(c, 0) <= 0 then cast(1 as double) else least(cast(c as double) / (2 * g), 1) end").alias("coverage"))


def coverage_of_spans(global_first: Column, cluster_first: Column, now: Column) -> Column:
    """The share of the global table's span that the cluster table's covers, where both first times are known; else 1."""
    g, c = now - global_first, now - cluster_first
    return F.when((g <= 0) | (c <= 0) | (c >= g), F.lit(1.0)).otherwise(c / g)


def plausible(table: DataFrame) -> DataFrame:
    return table.where(f"count > 0 and count <= {PLAUSIBLE}")


def baseline_with_fallback(clusters: DataFrame, everywhere: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, band, slot, tiers, count, used_cluster) for the asked anchors.

    Where the cluster has any plausible count for a band and slot, its rows stand; elsewhere those of the whole world do.
    """
    own = plausible(clusters).join(anchors.select(F.col("anchor").alias("cluster_anchor")).distinct(), "cluster_anchor").withColumnRenamed("cluster_anchor", "anchor")
    has = own.select("anchor", "band", "slot").distinct()
    world = plausible(everywhere).crossJoin(anchors.select("anchor").distinct())  # a bounded table: bands, slots and tiers
    rest = world.join(has, ["anchor", "band", "slot"], "left_anti")
    return own.select("anchor", *BASELINE_KEY, "count", F.lit(True).alias("used_cluster")).unionByName(rest.select("anchor", *BASELINE_KEY, "count", F.lit(False).alias("used_cluster")))


def slot_rates(pairs: DataFrame, span: DataFrame, coverage: DataFrame) -> DataFrame:
    """(anchor, band, slot, rate, support, used_cluster): expected spots a minute, the count over days of 30 minutes.

    Counts of a cluster are spread over the part of the span that the cluster table covers; a day is the least span, and
    a rate is 0 where the span is unknown. Slots without any count are not listed: their rate is 0.
    """
    from ..functions.numbers import round_half_away

    sums = pairs.groupBy("anchor", "band", "slot", "used_cluster").agg(F.sum("count").alias("support"))
    known = sums.crossJoin(span.select("history_minutes")).crossJoin(coverage)  # one row each
    minutes = f"case when used_cluster then {round_half_away('history_minutes * coverage')} else cast(history_minutes as double) end"
    return known.withColumn("minutes", e(minutes)).select("anchor", "band", "slot", "used_cluster", "support", "minutes", e(f"case when minutes <= 0 then cast(0 as double) else support / (greatest(minutes / 1440, 1) * {SLOT_MINUTES}) end").alias("rate"))


def proxy_score(most: str = "most") -> str:
    """Score of a bucket, from 0 to 100: its distance tier, its share of the largest bucket and its SNR tier."""
    return f"(cast(100 as double) * (0.45 * cast(distance_tier as double) / 4 + 0.35 * {clamp01(f'cast(count as double) / {most}')} + 0.20 * cast(snr_tier as double) / 3))"


def baseline_quantiles(pairs: DataFrame, *key: str) -> DataFrame:
    """(key, q25, q75): weighted quartiles of the buckets' scores; only keys with a weight of at least 200.

    A quartile is the score at which the weight summed in order of score first reaches its share.
    """
    scored = pairs.withColumn("most", F.max("count").over(Window.partitionBy(*key))).withColumn("score", e(proxy_score()))
    upto = F.sum("count").over(Window.partitionBy(*key).orderBy("score").rangeBetween(Window.unboundedPreceding, 0))
    scored = scored.withColumn("upto", upto).withColumn("total", F.sum("count").over(Window.partitionBy(*key)))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("score")))
    return scored.where(f"total >= {QUANTILE_WEIGHT}").groupBy(*key).agg(at(0.25).alias("q25"), at(0.75).alias("q75"))


def slot_segments(windows: DataFrame, start: str = "t0", end: str = "t1") -> DataFrame:
    """``windows`` with a row for each half-hour slot that they touch: slot, slot_day and seconds of overlap."""
    out = windows.withColumn("k", F.explode(e(f"sequence(cast(floor({start} / 1800) as bigint), cast(floor(({end} - 1) / 1800) as bigint))")))
    return out.where(f"{end} > {start}").withColumns({"slot": e("cast(k % 48 as int)"), "slot_day": e("cast(floor(k / 48) as int)"), "seconds": e(f"least((k + 1) * 1800, {end}) - greatest(k * 1800, {start})")}).drop("k")


def expected_counts(windows: DataFrame, rates: DataFrame) -> DataFrame:
    """(window columns, band, expected): the cluster's expected spots from t0 to t1; null unless every slot is the cluster's.

    ``windows`` has anchor, t0 and t1.
    """
    segments = slot_segments(windows)
    needed = segments.groupBy(*windows.columns).agg(F.count(F.lit(1)).alias("slots"))
    found = segments.join(rates, ["anchor", "slot"]).where("used_cluster").groupBy(*windows.columns, "band").agg(F.sum(F.col("rate") * F.col("seconds") / 60).alias("x"), F.count(F.lit(1)).alias("c"))
    return found.join(needed, windows.columns).select(*windows.columns, "band", e("case when c = slots then x end").alias("expected"))


def tier_p90(weights: list[str]) -> str:
    """The 90th percentile of a path length whose weight in each distance tier is even between the tier's bounds; 0 without weight."""
    total = " + ".join(f"greatest({w}, 0)" for w in weights)
    cases, before = [], "cast(0 as double)"
    for k, w in enumerate(weights):
        target = f"(0.9 * ({total}) - ({before}))"
        low, high = classify.tier_low_km(str(k)), classify.tier_high_km(str(k))
        cases.append(f"when {w} > 0 and {before} + {w} >= 0.9 * ({total}) then {low} + {clamp01(f'{target} / nullif({w}, 0)')} * ({high} - {low})")
        before = f"{before} + greatest({w}, 0)"
    return f"(case when ({total}) <= 0 then cast(0 as double) {' '.join(cases)} else cast(12000 as double) end)"


def reach_baseline(windows: DataFrame, clusters: DataFrame, rates: DataFrame) -> DataFrame:
    """(window columns, band, baseline_p90, reach_support): the cluster's usual reach from t0 to t1 above an SNR floor.

    ``windows`` has anchor, t0, t1 and cw_min_db. Each slot's distances, of tiers that can reach the floor, weigh as many
    spots as are expected of them; a band is listed only if every slot has any.
    """
    segments = slot_segments(windows)
    needed = segments.groupBy(*windows.columns).agg(F.count(F.lit(1)).alias("slots"))
    pairs = plausible(clusters).withColumnRenamed("cluster_anchor", "anchor")
    joined = segments.join(pairs, ["anchor", "slot"])
    loud = e(f"{classify.snr_tier_max_db('snr_tier')} >= cw_min_db")
    tiers = [F.sum(F.when(loud & (F.col("distance_tier") == k), F.col("count")).otherwise(0)).alias(f"d{k}") for k in range(5)]
    by_slot = joined.groupBy(*windows.columns, "slot", "seconds", "band").agg(F.sum("count").alias("all"), *tiers).withColumn("heard", e("d0 + d1 + d2 + d3 + d4")).where("heard > 0")
    by_slot = by_slot.join(rates.where("used_cluster").select("anchor", "band", "slot", "rate"), ["anchor", "band", "slot"])
    weight = e("rate * seconds / 60 * heard / all")
    mixed = by_slot.groupBy(*windows.columns, "band").agg(F.count(F.lit(1)).alias("c"), F.sum("heard").alias("reach_support"), *[F.sum(weight * F.col(f"d{k}") / F.col("heard")).alias(f"w{k}") for k in range(5)])
    return mixed.join(needed, windows.columns).where("c = slots").select(*windows.columns, "band", e(tier_p90([f"w{k}" for k in range(5)])).alias("baseline_p90"), "reach_support")


def calendar_stats(daily: DataFrame, today: int, days: int, *key: str) -> DataFrame:
    """Statistics over the days with spots among the ``days`` before ``today``: quartiles, mean, sample deviation, and today's count."""
    within = daily.where((F.col("day") >= today - days) & (F.col("day") <= today)).groupBy(*key, "day").agg(F.sum("spot_count").alias("n"))
    past: Column = F.when(F.col("day") < today, F.col("n"))
    quartile = lambda p: F.percentile(past, p)
    return within.groupBy(*key).agg(quartile(0.25).alias("p25"), quartile(0.5).alias("p50"), quartile(0.75).alias("p75"), F.avg(past).alias("mean"), F.stddev_samp(past).alias("sd"), F.count(past).alias("active_days"), F.coalesce(F.sum(F.when(F.col("day") == today, F.col("n"))), F.lit(0)).alias("today"))


def filled_calendar_stats(daily: DataFrame, today: int, days: int, *key: str) -> DataFrame:
    """Mean and sample deviation over all complete days since the source's first one within ``days``, days without spots as 0."""
    within = daily.where((F.col("day") >= today - days) & (F.col("day") <= today))
    first = within.where(F.col("day") < today).groupBy("source").agg((F.lit(today) - F.min("day")).alias("sample_days"))
    past = F.when(F.col("day") < today, F.col("spot_count")).otherwise(0).cast("double")
    sums = within.groupBy("source", *key).agg(F.sum(past).alias("x"), F.sum(past * past).alias("xx"), F.sum(F.when(F.col("day") == today, F.col("spot_count")).otherwise(0)).alias("today"))
    known = sums.join(first, "source").withColumn("mean", e("x / sample_days"))
    return known.select("source", *key, "sample_days", "mean", e("case when sample_days > 1 then sqrt(greatest(xx - sample_days * mean * mean, 0) / (sample_days - 1)) end").alias("sd"), "today")


def from_here_normals(daily: DataFrame, coverage: DataFrame, windows: DataFrame, days: int = 28) -> DataFrame:
    """(area, band, region, expected, sd, sample_days): what an area usually has in the window from t0 to t1.

    ``daily`` has area, band, region, slot, day and spot_count; ``coverage`` lists (day, slot) with ingest; ``windows`` has
    area, t0 and t1. Each of the ``days`` before the window's last day is a sample if every slot of the window was
    covered that day; a slot's count weighs as much as the window overlaps it. Days without spots count as 0.
    """
    segments = slot_segments(windows).withColumn("weight", F.col("seconds") / 1800).withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(days)))).withColumn("day", F.col("slot_day") - F.col("back"))
    needed = segments.groupBy("area", "back").agg(F.count(F.lit(1)).alias("slots"))
    covered = segments.join(coverage.select("day", "slot").distinct(), ["day", "slot"])
    samples = covered.groupBy("area", "back").agg(F.count(F.lit(1)).alias("c")).join(needed, ["area", "back"]).where("c = slots").select("area", "back")
    counts = covered.join(samples, ["area", "back"]).join(daily, ["area", "day", "slot"]).groupBy("area", "band", "region", "back").agg(F.sum(F.col("spot_count") * F.col("weight")).alias("x"))
    n = samples.groupBy("area").agg(F.count(F.lit(1)).alias("sample_days"))
    sums = counts.groupBy("area", "band", "region").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    known = sums.join(n, "area").withColumn("expected", e("x / sample_days"))
    return known.select("area", "band", "region", "expected", e("case when sample_days > 1 then sqrt(greatest(xx - sample_days * expected * expected, 0) / (sample_days - 1)) end").alias("sd"), "sample_days")


def from_here_day_curves(daily: DataFrame, coverage: DataFrame) -> DataFrame:
    """(area, band, region, slot, usual): mean count of each slot over the days that were covered in it, to one decimal."""
    from ..functions.numbers import round_half_away

    covered = coverage.select("day", "slot").distinct()
    days = covered.groupBy("slot").agg(F.count(F.lit(1)).alias("days"))
    sums = daily.join(covered, ["day", "slot"], "left_semi").groupBy("area", "band", "region", "slot").agg(F.sum("spot_count").alias("x"))
    return sums.join(days, "slot").select("area", "band", "region", "slot", e(round_half_away("cast(x as double) / days", 1)).alias("usual"))


def area_daily(daily: DataFrame, areas: DataFrame) -> DataFrame:
    """region_daily summed over the squares of each area (area, centre, rings)."""
    from .matching import ring_squares, small

    squares = ring_squares(areas.select("area", e(grid.square_x("centre")).alias("x"), e(grid.square_y("centre")).alias("y"), F.col("rings").alias("r")), "area")
    return daily.join(small(squares.withColumnRenamed("square", "target4")), "target4").groupBy("area", "band", "region", "slot", "day").agg(F.sum("spot_count").alias("spot_count"))
