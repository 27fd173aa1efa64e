"""Squares, replay and density of matched spots (qth, spot_id, t, band, snr, sender, receiver, remote, lat, lon)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, numbers

e = F.expr

# A density's radius in km and the thresholds of a territory.
RADIUS_KM, CORE, PRESENCE, CO_DOMINANT = 400.0, 5.0, 1.5, 0.6


def spot_filter(spots: DataFrame, only_bands: list[str] | None = None, sources: list[str] | None = None, snr_mode: str = "", ssb_min_db: int = 0, cw_min_db: int = -15) -> DataFrame:
    """Spots of the given bands and sources; in snr_mode ssb or cw those that reach its floor, and all beacon spots."""
    out = spots if only_bands is None else spots.where(F.col("band").isin([b for b in only_bands]))
    out = out if sources is None else out.where(F.col("source").isin(sources))
    floor = {"ssb": ssb_min_db, "cw": cw_min_db}.get(snr_mode)
    return out if floor is None else out.where((F.col("source") == "wspr") | (F.col("snr") >= floor))


def history(matched: DataFrame, t0: int, t1: int, most: int = 50_000, longest: int = 86400) -> DataFrame:
    """The newest ``most`` spots of each location between t0 and t1, a span of at most a day, and whether some were left out.

    Spots are counted by second first; only those of the second at which the limit falls are put in order.
    """
    t0 = max(t0, t1 - longest)
    within = matched.where(F.col("t").between(t0, t1))
    newest = Window.partitionBy("qth").orderBy(F.desc("t"))
    upto = within.groupBy("qth", "t").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(newest))
    edge = upto.groupBy("qth").agg(F.max("upto").alias("total"), F.max_by(F.struct("t", (F.lit(most) - F.col("upto") + F.col("c")).alias("room")), F.when(F.col("upto") - F.col("c") < most, F.col("upto"))).alias("edge"))
    near = within.join(edge, "qth").where("t >= edge.t").withColumn("truncated", F.col("total") > most)
    last = near.where("t = edge.t").withColumn("nth", F.row_number().over(Window.partitionBy("qth", "t").orderBy(F.desc("spot_id")))).where("nth <= edge.room")
    return near.where("t > edge.t").drop("total", "edge").unionByName(last.drop("total", "edge", "nth"))


def square_details(matched: DataFrame) -> DataFrame:
    """(qth, square): spots, SNR range and mean, and the band with the most spots (the first by name among equals)."""
    per_band = matched.where("length(remote) >= 4").groupBy("qth", e("substr(remote, 1, 4)").alias("square"), "band").agg(F.count(F.lit(1)).alias("n"), F.min("snr").alias("lo"), F.max("snr").alias("hi"), F.sum("snr").alias("s"))
    best = F.max_by("band", F.struct(F.col("n"), F.struct(*[-F.ascii(F.substr("band", F.lit(k), F.lit(1))) for k in range(1, 5)])))
    return per_band.groupBy("qth", "square").agg(F.sum("n").alias("spots"), F.min("lo").alias("min_snr"), F.max("hi").alias("max_snr"), (F.sum("s") / F.sum("n")).alias("avg_snr"), F.count(F.lit(1)).alias("bands"), best.alias("best_band"))


def top_reports(matched: DataFrame, most: int = 10) -> DataFrame:
    """(qth, square, rank): the first report of each pair of stations and band, the strongest ``most``; ties by band, then stations."""
    pair = Window.partitionBy("qth", "square", "sender", "receiver", "band").orderBy("t", "spot_id")
    firsts = matched.where("length(remote) >= 4").withColumn("square", e("substr(remote, 1, 4)")).withColumn("nth", F.row_number().over(pair)).where("nth = 1")
    order = Window.partitionBy("qth", "square").orderBy(F.desc("snr"), "band", "sender", "receiver")
    return firsts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("qth", "square", "rank", "sender", "receiver", "band", "snr")


#: Columns that together tell one spot from another, wherever it was read; t counts in whole seconds.
IDENTITY = {"source": "lower(coalesce(source, ''))", "band": "lower(coalesce(band, ''))", "sender": "upper(coalesce(sender, ''))", "receiver": "upper(coalesce(receiver, ''))", "remote": "upper(coalesce(remote, ''))", "reporter": "upper(coalesce(reporter, ''))", "lat": "lat", "lon": "lon", "snr": "snr", "t": "cast(floor(coalesce(t, 0)) as bigint)"}


def distinct_spots(matched: DataFrame) -> DataFrame:
    """Matched spots, each once for a location whatever it was read from: of equal ones that with the smallest spot_id."""
    keyed = matched.groupBy("qth", *[e(x).alias(f"k_{name}") for name, x in IDENTITY.items()]).agg(F.min_by(F.struct(*matched.columns), "spot_id").alias("row"))
    return keyed.select("row.*")


def square_bands(matched: DataFrame) -> DataFrame:
    """(qth, square, bands, dominant): each square's spots by band, and the band with the most (the first by name among equals)."""
    counts = matched.where("length(remote) >= 4").groupBy("qth", e("substr(remote, 1, 4)").alias("square"), "band").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("qth", "square").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", "n")))).alias("bands"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "band")))[0]["band"].alias("dominant"))


def grid_squares(matched: DataFrame) -> DataFrame:
    """(qth, square): spots, the mean SNR of the strongest quarter, of one spot at least (from counts by SNR), and square_bands()."""
    by_band = square_bands(matched)
    counts = matched.where("length(remote) >= 4").groupBy("qth", e("substr(remote, 1, 4)").alias("square"), "snr").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("qth", "square")
    ranked = counts.withColumns({"n": F.sum("c").over(w), "before": F.coalesce(F.sum("c").over(w.orderBy(F.desc("snr")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    ranked = ranked.withColumn("taken", e("least(c, greatest(cast(ceil(n / 4.0) as bigint) - before, 0))"))
    out = ranked.groupBy("qth", "square").agg(F.first("n").alias("spots"), e("sum(snr * taken) / cast(sum(case when snr is not null then taken else 0 end) as double)").alias("top_quarter_snr"))
    return out.join(by_band, ["qth", "square"])


def moments(matched: DataFrame, step: int = 300, window: int = 900) -> DataFrame:
    """Each spot in every replay moment that shows it: moments lie ``step`` seconds apart and show the last ``window`` seconds."""
    first, last = f"cast(ceil(t / {float(step)}) as bigint)", f"cast(floor((t + {window}) / {float(step)}) as bigint)"
    out = matched.withColumn("moment", F.explode(e(f"sequence({first}, {last})"))).withColumn("moment", F.col("moment") * step)
    return out.withColumn("age", F.col("moment") - F.col("t"))


def coverage_intervals(spots: DataFrame, gap: int = 300, *key: str) -> DataFrame:
    """(key, t0, t1, n): spans in which no two neighbouring spots lie more than ``gap`` seconds apart.

    Spans are found within each hour first, in as many tasks as there are hours; only these few meet by key.
    """

    def joined(parts: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("t0")
        marked = parts.withColumn("new", F.when(F.col("t0") - F.lag("t1").over(w) <= gap, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
        return marked.groupBy(*by, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n")).drop("island")

    times = spots.groupBy(*key, F.col("t").alias("t0")).agg(F.count(F.lit(1)).alias("n")).withColumns({"t1": F.col("t0"), "hour": e("t0 div 3600")})
    return joined(joined(times, *key, "hour").drop("hour"), *key)


def covers(intervals: DataFrame, asked: DataFrame, *key: str) -> DataFrame:
    """``asked`` (key, t0, t1) with covered: one interval holds all of it, or what of it lies before the data's end."""
    ends = intervals.groupBy(*key).agg(F.max("t1").alias("last_t")) if key else intervals.agg(F.max("t1").alias("last_t"))
    spans = asked.join(ends, list(key), "left") if key else asked.crossJoin(ends)  # one row
    i = intervals.select(*key, F.col("t0").alias("i0"), F.col("t1").alias("i1"))
    on = [spans[k] == i[k] for k in key] + [i["i0"] <= spans["t0"], i["i1"] >= F.least(spans["t1"], spans["last_t"]), spans["t0"] <= spans["last_t"]]
    hits = spans.join(i, on, "left_semi").withColumn("covered", F.lit(True)).drop("last_t")
    return asked.join(hits, [*key, "t0", "t1"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def activity_vs_normal(rates: DataFrame, slot_rates: DataFrame, scale: DataFrame, qths: DataFrame) -> DataFrame:
    """(qth, band, bin, rate, normal): each bin's rate beside the cluster's usual rate in the bin's slot, scaled to the location."""
    w = qths.select("qth", "anchor", "now", "minutes").withColumn("bin_seconds", e(numbers.quotient("minutes * 60", "12")))
    placed = rates.join(w, "qth").withColumn("slot", e("cast(floor(((now - minutes * 60 + bin * bin_seconds) % 86400) / 1800) as int)"))
    out = placed.join(slot_rates.select("anchor", "band", "slot", F.col("rate").alias("usual")), ["anchor", "band", "slot"], "left").join(scale.select("qth", "band", "local_scale"), ["qth", "band"], "left")
    return out.select("qth", "band", "bin", "slot", "rate", e("coalesce(usual, 0) * coalesce(local_scale, 0)").alias("normal"))


def distance_snr_profile(matched: DataFrame, centres: DataFrame) -> DataFrame:
    """(qth, band): samples, the distance that 95% of all the location's samples keep within (500 km at least), samples beyond it, SNR range.

    ``centres`` has qth, lat0 and lon0.
    """
    placed = matched.join(centres, "qth").withColumn("km", e(geo.haversine_km("lat0", "lon0", "lat", "lon")))
    cap = location_percentile(placed, 0.95).select("qth", F.greatest(F.lit(500.0), "value").alias("cap_km"))
    out = placed.join(cap, "qth").groupBy("qth", "band").agg(F.count(F.lit(1)).alias("samples"), F.first("cap_km").alias("cap_km"), F.count_if(F.col("km") > F.col("cap_km")).alias("clipped"), F.least(F.lit(-20), F.min("snr")).alias("low_snr"), F.greatest(F.lit(20), F.max("snr")).alias("high_snr"))
    return out


def location_percentile(placed: DataFrame, share: float) -> DataFrame:
    """(qth, value): the exact percentile of km, interpolated, at each location.

    Counts by whole kilometre tell in which of them its rank lies; only the distances of that one, or of two, are then
    counted and put in order.
    """
    counts = placed.where("km is not null").groupBy("qth", F.floor("km").alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("qth")
    cum = counts.withColumns({"upto": F.sum("c").over(w.orderBy("bucket")), "rank": (F.sum("c").over(w) - 1) * F.lit(float(share))})
    cum = cum.withColumn("before", F.col("upto") - F.col("c"))
    edge = cum.where("floor(rank) >= before and floor(rank) < upto or ceil(rank) >= before and ceil(rank) < upto").select("qth", "bucket", "before", "rank")
    near = placed.where("km is not null").withColumn("bucket", F.floor("km")).join(edge, ["qth", "bucket"]).groupBy("qth", "bucket", "before", "rank", "km").agg(F.count(F.lit(1)).alias("c"))
    inside = near.withColumn("end", F.col("before") + F.sum("c").over(Window.partitionBy("qth", "bucket").orderBy("km")))
    at = lambda r: F.max(F.when((F.col("end") > r) & (F.col("end") - F.col("c") <= r), F.col("km")))
    ends = inside.groupBy("qth", "rank").agg(at(F.floor("rank")).alias("low"), at(F.ceil("rank")).alias("high"))
    return ends.select("qth", e("low + (high - low) * (rank - floor(rank))").alias("value"))


def density_points(matched: DataFrame) -> DataFrame:
    """(qth, band, lat, lon, n, weight): one point a place and band, the square root of its spots its weight."""
    out = matched.where("lat is not null and lon is not null").groupBy("qth", "band", e(numbers.round_half_away("lat", 3)).alias("lat"), e(numbers.round_half_away("lon", 3)).alias("lon")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("weight", F.sqrt("n"))


def band_density(points: DataFrame, cell_deg: float = 1.0, radius_km: float = RADIUS_KM) -> DataFrame:
    """(qth, band, row, col, density): weights spread by a bell curve, cut at the radius, to the corners of a grid of degrees.

    Corner (row, col) lies at row and col times ``cell_deg``.
    """
    pad, km_lat, km_lon = radius_km / 110.57, 110.57, 111.32
    rows = points.withColumn("row", F.explode(e(f"sequence(cast(ceil(greatest(lat - {pad}, -89) / {cell_deg}) as int), cast(floor(least(lat + {pad}, 89) / {cell_deg}) as int))")))
    rows = rows.withColumn("km_lon", e(f"greatest({km_lon} * cos(radians((row * {cell_deg} + lat) / 2)), 1e-9)")).withColumn("span", e(f"least({radius_km} / greatest(km_lon, 1), 180)"))
    cells = rows.withColumn("col", F.explode(e(f"sequence(cast(ceil(greatest(lon - span, -180) / {cell_deg}) as int), cast(floor(least(lon + span, 180) / {cell_deg}) as int))")))
    cells = cells.withColumn("dd", e(f"power((row * {cell_deg} - lat) * {km_lat}, 2) + power((col * {cell_deg} - lon) * km_lon, 2)")).where(F.col("dd") <= radius_km * radius_km)
    return cells.groupBy("qth", "band", "row", "col").agg(F.sum(e(f"weight * exp(-dd / {2 * (radius_km / 2.2) ** 2}D)")).alias("density"))


def territory(density: DataFrame) -> DataFrame:
    """(qth, row, col, band, density, part): the leading band of each corner, core from 5 on, and bands that come within 60% of it."""
    order = Window.partitionBy("qth", "row", "col").orderBy(F.desc("density"), "band")
    ranked = density.withColumns({"nth": F.row_number().over(order), "top": F.max("density").over(Window.partitionBy("qth", "row", "col"))}).where(F.col("density") >= PRESENCE)
    part = F.when(F.col("nth") == 1, F.when(F.col("density") >= CORE, "core").otherwise("territory")).when(F.col("density") >= F.col("top") * CO_DOMINANT, "hatch")
    return ranked.withColumn("part", part).where("part is not null").select("qth", "row", "col", "band", "density", "part")


def lone_points(points: DataFrame, density: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Points whose nearest corner their band does not reach."""
    near = points.withColumns({"row": e(f"cast(floor(lat / {cell_deg} + 0.5) as int)"), "col": e(f"cast(floor(lon / {cell_deg} + 0.5) as int)")})
    return near.join(density, ["qth", "band", "row", "col"], "left").where(f"coalesce(density, 0) < {PRESENCE}").select("qth", "band", "lat", "lon", "n")


def with_daylight(matched: DataFrame) -> DataFrame:
    """Adds the sun's zenith angle at the remote end and day, twilight or night."""
    return matched.withColumn("zenith", e(geo.solar_zenith("lat", "lon", "t"))).withColumn("light", e(geo.daylight("zenith")))
