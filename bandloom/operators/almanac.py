"""When a band is usually open from an area to each region: N of M days, per half-hour slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands, classify, geo, grid, numbers
from .matching import ring_squares, small

e = F.expr

# Days of the window, active days that a slot needs (in a month: 8; with few days of SNR: from 2), spots
# that make a day open in each layer, the share from which a slot is usual, the share of the median from which ingest ran.
DAYS, ACTIVE_DAYS, MONTH_ACTIVE_DAYS, LEAST_DAYS, OPEN_SPOTS, USUAL, ALIVE = 30, 10, 8, 2, {"pskr": 2, "wspr": 1}, 0.5, 0.10

# Widest radius, known slots that a band needs, share of bands that widening ends at, slots bridged and looked ahead.
MOST_RINGS, KNOWN_SLOTS, WIDEN_SHARE, BRIDGE, LOOK_AHEAD = 2, 8, 0.5, 1, 24


def area_squares(areas: DataFrame, rings: int = MOST_RINGS) -> DataFrame:
    """(area, grid4, ring) of the squares around each area's centre (area, centre)."""
    q = areas.select("area", e("substr(upper(centre), 1, 4)").alias("c")).where(e(grid.is_locator("c")))
    return ring_squares(q.withColumns({"x": e(grid.square_x("c")), "y": e(grid.square_y("c")), "r": F.lit(rings)}), "area").select("area", F.col("square").alias("grid4"), "ring")


def ring_levels(daily: DataFrame, areas: DataFrame) -> DataFrame:
    """region_daily summed by area and ring: area, ring, band, region, day, slot, n, ge_* and snr_n."""
    floors = [c for c in daily.columns if c.startswith("snr_ge_")]
    joined = daily.where(f"band in ({bands.listed(bands.ALMANAC_BANDS)})").join(small(area_squares(areas).withColumnRenamed("grid4", "target4")), "target4")
    return joined.groupBy("area", "ring", "band", "region", "day", "slot").agg(F.sum("spot_count").alias("n"), F.sum("snr_spots").alias("snr_n"), *[F.sum(c).alias(c) for c in floors])


def season_and_tail(season: DataFrame, daily: DataFrame, watermark: int) -> DataFrame:
    """Daily rows from the seasonal record up to the watermark, and from the daily table beyond it: each day once."""
    day = e("cast(datediff(make_date(cast(floor(year_month / 100) as int), year_month % 100, dom), date '1970-01-01') as int)")
    from_bins = {f"snr_ge_{'m' if f < 0 else ''}{abs(f)}": e(f"aggregate(slice(snr_bins, {k + 2}, {5 - k}), 0, (a, v) -> a + v)") for k, f in enumerate(classify.ALMANAC_FLOORS)}
    old = season.where("layer = 'pskr'").withColumn("day", day).where(F.col("day") <= watermark).withColumns({**from_bins, "snr_spots": e("aggregate(snr_bins, 0, (a, v) -> a + v)")})
    columns = ["target4", "band", "slot", "region", "day", "spot_count", "snr_spots", *from_bins]
    old = old.withColumnRenamed("grid4", "target4").withColumnRenamed("count", "spot_count").select(columns)
    return old.unionByName(daily.where(F.col("day") > watermark).select(columns))


def alive_mask(ingest: DataFrame, first_day: int, days: int = DAYS, lost: DataFrame | None = None) -> DataFrame:
    """(day, slot) in which ingest ran: spots, and a tenth of the slot's median over all days (absent ones as 0), and not a lost day."""
    spark = ingest.sparkSession
    every = spark.range(first_day, first_day + days).select(F.col("id").cast("int").alias("day")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(47))))
    full = every.join(ingest.select("day", "slot", "spot_total"), ["day", "slot"], "left").withColumn("spot_total", F.coalesce("spot_total", F.lit(0)))
    median = full.groupBy("slot").agg(F.percentile("spot_total", 0.5).alias("median"))
    alive = full.join(median, "slot").where(f"spot_total > 0 and spot_total >= {ALIVE} * median").select("day", "slot")
    return alive if lost is None else alive.join(lost.select(F.col("day_index").alias("day")), "day", "left_anti")


def active_slot_days(levels: DataFrame, alive: DataFrame) -> DataFrame:
    """(area, radius, band, day, slot): alive slots in which the area had a spot on the band, to any region, then or in the next slot.

    The slot after a day's last is the next day's first.
    """
    seen = levels.select("area", "ring", "band", "day", "slot").distinct()
    either = seen.unionByName(seen.select("area", "ring", "band", e("case when slot = 0 then day - 1 else day end").alias("day"), e("case when slot = 0 then 47 else slot - 1 end").alias("slot")))
    wide = either.withColumn("radius", F.explode(e(f"sequence(ring, {MOST_RINGS})"))).select("area", "radius", "band", "day", "slot").distinct()
    return wide.join(alive, ["day", "slot"], "left_semi")


def known_slot_counts(active: DataFrame, need: int = ACTIVE_DAYS) -> DataFrame:
    """(area, radius, band, known): slots with enough active days to say anything."""
    per_slot = active.groupBy("area", "radius", "band", "slot").agg(F.count(F.lit(1)).alias("m"))
    return per_slot.where(F.col("m") >= need).groupBy("area", "radius", "band").agg(F.count(F.lit(1)).alias("known"))


def almanac_radius(areas: DataFrame, known: DataFrame) -> DataFrame:
    """(area, radius): the smallest at which more than half of the bands have eight known slots, else the widest."""
    need = int(len(bands.ALMANAC_BANDS) * WIDEN_SHARE) + 1
    enough = known.where(F.col("known") >= KNOWN_SLOTS).groupBy("area", "radius").agg(F.count(F.lit(1)).alias("b")).where(F.col("b") >= need)
    return areas.select("area").join(enough.groupBy("area").agg(F.min("radius").alias("found")), "area", "left").select("area", F.coalesce("found", F.lit(MOST_RINGS)).alias("radius"))


def almanac_lanes(levels: DataFrame, active: DataFrame, radius: DataFrame, open_spots: int = 2, floor: int | None = None, snr_since: int | None = None) -> DataFrame:
    """(area, band, region, slot, n, m, share, m_min): of m active days the band was open to the region on n.

    Every region of an active band has all 48 slots. With an SNR floor, only spots that reach it count, share is how
    many of all do (thousandths, -1 without any), days before SNR was collected (``snr_since``) don't count, and fewer
    days are asked for while few are covered.
    """
    spark = levels.sparkSession
    days = active.join(radius, ["area", "radius"])
    bands_of = days.select("area", "band").distinct()
    if floor is not None:
        days = days.where(F.col("day") >= snr_since) if snr_since is not None else days.where(F.lit(False))
    m = days.groupBy("area", "band", "slot").agg(F.count(F.lit(1)).alias("m"))
    opened = "n" if floor is None else f"snr_ge_{'m' if floor < 0 else ''}{abs(floor)}"
    inside = levels.join(radius, "area").where("ring <= radius").groupBy("area", "band", "region", "day", "slot").agg(F.sum(opened).alias("opened"), F.sum("snr_n").alias("snr_n"))
    hits = inside.join(days.select("area", "band", "day", "slot"), ["area", "band", "day", "slot"]).groupBy("area", "band", "region", "slot").agg(F.count_if(F.col("opened") >= open_spots).alias("n"), F.sum("opened").alias("ge"), F.sum("snr_n").alias("of"))
    regions = spark.createDataFrame([(r,) for r in geo.REGIONS], "region string")
    every = bands_of.crossJoin(F.broadcast(regions)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(47))))  # 11 regions
    out = every.join(m, ["area", "band", "slot"], "left").join(hits, ["area", "band", "region", "slot"], "left").na.fill(0, ["m", "n", "ge", "of"])
    if floor is None:
        return out.select("area", "band", "region", "slot", "n", "m", F.lit(-1).cast("bigint").alias("share"), F.lit(ACTIVE_DAYS).alias("m_min"))
    covered = days.groupBy("area").agg(F.countDistinct("day").alias("covered"))
    out = out.join(covered, "area", "left").withColumn("m_min", e(f"cast(least({ACTIVE_DAYS}, greatest({LEAST_DAYS}, coalesce(covered, 0))) as int)"))
    return out.select("area", "band", "region", "slot", "n", "m", e(numbers.share_code("ge", "of")).alias("share"), "m_min")


def open_today(levels: DataFrame, radius: DataFrame, today: int, slot: int, open_spots: int = 2) -> DataFrame:
    """(area, band, region) open in the present slot or the one before, which may be yesterday's last."""
    before = (today, slot - 1) if slot else (today - 1, 47)
    near = levels.join(radius, "area").where("ring <= radius").where(((F.col("day") == today) & (F.col("slot") == slot)) | ((F.col("day") == before[0]) & (F.col("slot") == before[1])))
    sums = near.groupBy("area", "band", "region", "day", "slot").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= open_spots).select("area", "band", "region").distinct()


def usual_slots(lanes: DataFrame) -> DataFrame:
    return lanes.withColumn("usual", e(f"m > 0 and m >= m_min and n >= {USUAL} * m"))


def usual_windows(lanes: DataFrame) -> DataFrame:
    """(area, band, region, start, len): runs of usual slots around the clock; a single other slot between two is bridged.

    The day is laid out twice; runs that begin in the first copy, after a slot that is none, are kept.
    """
    key = ["area", "band", "region"]
    w = Window.partitionBy(*key).orderBy("slot")
    u = usual_slots(lanes).select(*key, "slot", "usual")
    ring = lambda f, edge: F.coalesce(f("usual").over(w), F.max(F.when(F.col("slot") == edge, F.col("usual"))).over(Window.partitionBy(*key)))
    b = u.withColumn("on", F.col("usual") | (ring(F.lag, 47) & ring(F.lead, 0)))
    twice = b.withColumn("pos", F.explode(F.array(F.col("slot"), F.col("slot") + 48)))
    w2 = Window.partitionBy(*key).orderBy("pos")
    islands = twice.withColumn("new", F.when(F.col("on") & ~F.coalesce(F.lag("on").over(w2), F.lit(False)), 1).otherwise(0)).withColumn("island", F.sum("new").over(w2)).where("on")
    runs = islands.groupBy(*key, "island").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("len"))
    first_on = b.where("slot = 47").select(*key, F.col("on").alias("last_on"))
    runs = runs.join(first_on, key).where("len >= 48 and start = 0 or len < 48 and start < 48 and not (start = 0 and last_on)")
    return runs.select(*key, F.col("start").cast("int").alias("start"), e("cast(least(len, 48) as int)").alias("len"))


def agenda(lanes: DataFrame, now_minute: int, today: DataFrame | None = None) -> DataFrame:
    """Windows that contain now or begin within twelve hours: the window, its status, and its best usual slot.

    The best slot has the largest share, then the most days, then comes first. nth orders an area's windows: ongoing ones
    first, then by start, then by the best slot's share, then by band and region.
    """
    key = ["area", "band", "region"]
    slot = now_minute // 30
    w = usual_windows(lanes).withColumn("ongoing", e(f"({slot} - start + 48) % 48 < len")).withColumn("starts_in", e(f"case when ongoing then 0 else (start * 30 - {now_minute} + 1440) % 1440 end")).where(f"ongoing or starts_in <= {LOOK_AHEAD * 30}")
    inside = w.select(*key, "start", F.explode(e("sequence(0, len - 1)")).alias("i")).withColumn("slot", e("(start + i) % 48"))
    best = inside.join(usual_slots(lanes).where("usual"), [*key, "slot"]).groupBy(*key, "start").agg(F.max_by(F.struct("slot", "n", "m", "share"), F.struct(F.col("n") / F.col("m"), F.col("m"), -F.col("i"))).alias("peak"))
    out = w.join(best, [*key, "start"], "left")
    if today is not None:
        out = out.join(today.withColumn("open_today", F.lit(True)), key, "left")
    out = out.withColumn("open_today", F.coalesce("open_today", F.lit(False)) if today is not None else F.lit(False))
    out = out.select(*key, "start", "len", e("len < 48 and start + len > 48").alias("crosses_midnight"), e("len >= 48").alias("all_day"), e("case when ongoing then 'ongoing' else 'upcoming' end").alias("status"), "starts_in", F.col("peak.slot").alias("peak_slot"), F.col("peak.n").alias("peak_n"), F.col("peak.m").alias("peak_m"), F.col("peak.share").alias("peak_share"), "open_today")
    order = Window.partitionBy("area").orderBy("status", "starts_in", F.desc(F.col("peak_n") / F.greatest("peak_m", F.lit(1))), "band", "region", "start")
    return out.withColumn("nth", F.row_number().over(order))


def agenda_text(agenda: DataFrame, areas: DataFrame, most: int = 3) -> DataFrame:
    """(area, text): up to ``most`` paths that are usually open now, and the next one with its start."""
    nows = agenda.where("status = 'ongoing'").groupBy("area", "band", "region").agg(F.min("nth").alias("nth")).withColumn("k", F.row_number().over(Window.partitionBy("area").orderBy("nth"))).where(F.col("k") <= most)
    nows = nows.groupBy("area").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.concat_ws(" ", "band", "region").alias("path")))), lambda x: x["path"]), ", ").alias("now"))
    clock = e("concat(lpad(cast(floor(x.start / 2) as string), 2, '0'), case when x.start % 2 = 1 then ':30' else ':00' end)")
    nexts = agenda.where("status = 'upcoming'").groupBy("area").agg(F.min_by(F.struct("band", "region", "start"), "nth").alias("x")).select("area", F.concat(F.col("x.band"), F.lit(" "), F.col("x.region"), F.lit(" ~"), clock).alias("next"))
    out = areas.select("area").join(nows, "area", "left").join(nexts, "area", "left")
    text = F.concat_ws(". ", F.concat(F.lit("Now usually: "), F.col("now")), F.concat(F.lit("Next: "), F.col("next")))
    return out.select("area", F.when(text == "", f"Nothing usually open in the next {LOOK_AHEAD // 2} h").otherwise(text).alias("text"))


def season_months(season: DataFrame, ingest: DataFrame, squares: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """(area, band, region, layer, year_month, slot, n, m, days): N of M days of each calendar month of the seasonal record.

    ``squares`` lists (area, grid4); ``ingest`` has day, slot, layer and spot_total. As in the almanac's window, with the
    median within the month; a month's last slot looks at the next month's first, if there is one.
    """
    k = e("case layer when 'wspr' then 1 else 2 end")
    start = e("cast(datediff(make_date(cast(floor(year_month / 100) as int), year_month % 100, 1), date '1970-01-01') as int)")
    rows = season.join(small(squares.select("area", "grid4")), "grid4").withColumn("day", start + F.col("dom") - 1)
    counts = rows.groupBy("area", "band", "region", "layer", "year_month", "day", "slot").agg(F.sum("count").alias("n"))
    months = counts.select("layer", "year_month").distinct().withColumn("first", start).withColumn("size", e("day(last_day(make_date(cast(floor(year_month / 100) as int), year_month % 100, 1)))"))
    days = months.withColumn("day", F.explode(e("sequence(first, first + size - 1)"))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(47))))
    full = days.join(ingest.select("day", "slot", "layer", "spot_total"), ["day", "slot", "layer"], "left").withColumn("spot_total", F.coalesce("spot_total", F.lit(0)))
    median = full.groupBy("layer", "year_month", "slot").agg(F.percentile("spot_total", 0.5).alias("median"))
    alive = full.join(median, ["layer", "year_month", "slot"]).where(f"spot_total > 0 and spot_total >= {ALIVE} * median").select("layer", "year_month", "day", "slot")
    if lost is not None:
        alive = alive.join(lost.select(F.col("day_index").alias("day")), "day", "left_anti")
    seen = counts.select("area", "band", "layer", "day", "slot").distinct()
    either = seen.unionByName(seen.select("area", "band", "layer", e("case when slot = 0 then day - 1 else day end").alias("day"), e("case when slot = 0 then 47 else slot - 1 end").alias("slot"))).distinct()
    ok = either.join(alive, ["layer", "day", "slot"])
    m = ok.groupBy("area", "band", "layer", "year_month", "slot").agg(F.count(F.lit(1)).alias("m"))
    total = ok.groupBy("area", "band", "layer", "year_month").agg(F.countDistinct("day").alias("days"))
    n = counts.join(ok.select("area", "band", "layer", "day", "slot"), ["area", "band", "layer", "day", "slot"]).where(F.col("n") >= k).groupBy("area", "band", "region", "layer", "year_month", "slot").agg(F.count(F.lit(1)).alias("n"))
    lanes = counts.select("area", "band", "region", "layer", "year_month").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(47))))
    out = lanes.join(m, ["area", "band", "layer", "year_month", "slot"], "left").join(n, ["area", "band", "region", "layer", "year_month", "slot"], "left").join(total, ["area", "band", "layer", "year_month"], "left")
    return out.na.fill(0, ["n", "m", "days"]).select("area", "band", "region", "layer", "year_month", "slot", "n", "m", "days")


def season_pick(months: DataFrame, newest: int, lookback: int = 60) -> DataFrame:
    """For each calendar month the latest year of the first layer with enough days, else of the second; others are not collected.

    Months more than ``lookback`` before ``newest`` (year times 100 plus month) don't count.
    """
    back = F.lit(newest // 100 * 12 + newest % 100) - (F.floor(F.col("year_month") / 100) * 12 + F.col("year_month") % 100)
    fit = months.where((F.col("days") >= MONTH_ACTIVE_DAYS) & (back >= 0) & (back < lookback)).withColumn("month", F.col("year_month") % 100)
    order = Window.partitionBy("area", "band", "region", "month").orderBy(e("case layer when 'pskr' then 0 else 1 end"), F.desc("year_month"))
    choice = fit.select("area", "band", "region", "month", "layer", "year_month").distinct().withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "month")
    return months.join(choice, ["area", "band", "region", "layer", "year_month"], "left_semi")


def wspr_covered(squares: DataFrame, backfilled: DataFrame) -> DataFrame:
    """(area, covered): whether every square of the area lies in a ring that was filled from the beacon archive (grid4)."""
    done = backfilled.select("grid4").distinct().withColumn("done", F.lit(True))
    return squares.join(done, "grid4", "left").groupBy("area").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("covered"))


def acceptance(lanes: DataFrame, tests: DataFrame) -> DataFrame:
    """(id, verdict): whether openings that are expected show in an area's lanes.

    ``tests`` has id, area, bands and regions (arrays), from_hour and to_hour (null for all day; the later one excluded),
    low and high (bounds of the share, null for none), stat (median or max) and combine (any or all). A path needs half of its slots known.
    """
    hours = e("case when from_hour is null then sequence(0, 47) else transform(sequence(0, ((to_hour - from_hour + 24) % 24) * 2 - 1), i -> (from_hour * 2 + i) % 48) end")
    paths = tests.withColumn("band", F.explode("bands")).withColumn("region", F.explode("regions")).withColumn("slot", F.explode(hours))
    shares = paths.join(lanes, ["area", "band", "region", "slot"], "left").withColumn("value", e("case when m > 0 and m >= m_min then cast(n as double) / m end"))
    judged = shares.groupBy("id", "band", "region", "low", "high", "stat", "combine").agg(F.count(F.lit(1)).alias("slots"), F.count("value").alias("known"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("max"))
    judged = judged.withColumn("x", e("case when stat = 'max' then max else median end")).withColumn("verdict", e("case when known = 0 or known < ceil(slots * 0.5) then 'INCONCLUSIVE' when x >= coalesce(low, x) and x <= coalesce(high, x) then 'PASS' else 'FAIL' end"))
    has = lambda v: F.bool_or(F.col("verdict") == v)
    any_of = F.when(has("PASS"), "PASS").when(has("INCONCLUSIVE"), "INCONCLUSIVE").otherwise("FAIL")
    all_of = F.when(has("FAIL"), "FAIL").when(has("PASS"), "PASS").otherwise("INCONCLUSIVE")
    return judged.groupBy("id", "combine").agg(any_of.alias("a"), all_of.alias("b")).select("id", e("case when combine = 'any' then a else b end").alias("verdict"))


