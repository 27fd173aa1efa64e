"""Spots and station locations (QTHs): all locations of a table are answered in one job.

A table of locations has qth (a locator or callsign) and may have surroundings (boolean: the eight squares around count
too), minutes, cw_min_db and now. Matching is an equi-join of tokens: a spot's end has its square and the runs of parts
of its call, a location has its squares or its call. No side is assumed small; Spark picks the join by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, geo, grid, times

e = F.expr


#: Ways in which the spots of one square or call are dealt to tasks, where locations are too many to be broadcast.
SALT = 8


#: Rows up to which a table that is counted first may be broadcast (some 15 MB).
SMALL = 200_000


def small(table: DataFrame) -> DataFrame:
    """The table, broadcast if it is counted to be small: rows from the driver have no size that Spark knows."""
    return table if table.isStreaming or table.limit(SMALL + 1).count() > SMALL else F.broadcast(table)


def location_tokens(qths: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and tokens: the square of a locator and, with surroundings, those around it inside the grid; other names as they are."""
    q = qths.select("qth", *[c for c in keep if c != "qth"], e("upper(trim(qth))").alias("q_"), F.coalesce("surroundings", F.lit(False)).alias("around_"))
    q = q.withColumns({"x_": e(f"case when {grid.is_locator('q_')} then {grid.square_x('q_')} end"), "y_": e(f"case when {grid.is_locator('q_')} then {grid.square_y('q_')} end")})
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    near = ", ".join(f"named_struct('x', x_ + {dx}, 'y', y_ + {dy})" for dx, dy in steps)
    places = f"filter(case when around_ then array({near}) else array(named_struct('x', x_ + 0, 'y', y_ + 0)) end, p -> p.x between 0 and 179 and p.y between 0 and 179)"
    squares = f"transform({places}, p -> {grid.square_at('p.x', 'p.y')})"
    return q.withColumn("tokens_", e(f"case when x_ is null then array(q_) else {squares} end")).drop("q_", "around_", "x_", "y_")


def qth_squares(qths: DataFrame) -> DataFrame:
    """(qth, token): what an end of a spot must have to match a location."""
    return location_tokens(qths).select("qth", F.explode("tokens_").alias("token"))


def ring_squares(centres: DataFrame, *keep: str) -> DataFrame:
    """(keep..., square, ring) for centres with x, y and r: all squares within r, and how many rings out each is."""
    out = centres.withColumn("dx", F.explode(e("sequence(-r, r)"))).withColumn("dy", F.explode(e("sequence(-r, r)")))
    out = out.withColumn("nx", e("x + dx")).withColumn("ny", e("y + dy")).where("nx between 0 and 179 and ny between 0 and 179")
    return out.select(*keep, e(grid.square_at("nx", "ny")).alias("square"), e("greatest(abs(dx), abs(dy))").alias("ring"))


def call_runs(call: Column) -> Column:
    """All runs of neighbouring parts of a call: DL/W1AW/P has DL, W1AW, P, DL/W1AW, W1AW/P and the whole."""
    parts = F.split(F.upper(F.trim(call)), "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i + 1), lambda n: F.array_join(F.slice(parts, i, n), "/")))
    return F.array_distinct(F.flatten(each))


def end_tokens(square: str, call: str) -> Column:
    """What an end of a prepared spot has to match by: its square and the runs of its call."""
    return F.filter(F.array_compact(F.array_union(F.array(square), call_runs(F.col(call)))), lambda x: x != "")


def matched_spots(spots: DataFrame, qths: DataFrame, *keep: str) -> DataFrame:
    """A row for each location and spot of which an end matches: qth, ``keep`` columns of the location, is_sender, is_receiver and the spot.

    One join: each token of a spot carries the spot along, and of the tokens that match a location the first one counts, so
    that nothing is gathered by spot afterwards. Tokens are salted, so that a busy square's spots spread over tasks where
    the locations aren't broadcast. Batch and streaming spots alike.
    """
    hidden = {"sends_": end_tokens("s4", "sc"), "gets_": end_tokens("r4", "rc"), "salt_": e(f"pmod(hash(spot_id), {SALT})")}
    carried = spots.select("*", *[x.alias(name) for name, x in hidden.items()])
    carried = carried.withColumn("all_", F.array_union("sends_", "gets_")).withColumn("token_", F.explode("all_"))
    asked = location_tokens(qths, *keep).withColumn("token_", F.explode("tokens_")).withColumn("salt_", F.explode(e(f"sequence(0, {SALT - 1})")))
    hits = carried.join(small(asked), ["token_", "salt_"]).where("array_intersect(all_, tokens_)[0] = token_")
    flags = {"is_sender": F.arrays_overlap("sends_", "tokens_"), "is_receiver": F.arrays_overlap("gets_", "tokens_")}
    return hits.withColumns(flags).drop("token_", "salt_", "all_", "sends_", "gets_", "tokens_")


def matched_ends(spots: DataFrame, qths: DataFrame) -> DataFrame:
    """(qth, spot_id, is_sender, is_receiver): one row for each location and spot of which an end matches."""
    return matched_spots(spots.select("spot_id", "s4", "sc", "r4", "rc"), qths).select("qth", "spot_id", "is_sender", "is_receiver")


def match_spots(spots: DataFrame, qths: DataFrame) -> DataFrame:
    """Each location's spots with the remote end: the receiver's if the location sent, else the sender's."""
    hits = matched_spots(spots, qths, "now")
    remote = hits.withColumn("remote", F.when(F.col("is_sender"), F.col("rl")).otherwise(F.col("sl"))).where("remote <> ''")
    return remote.select("qth", "spot_id", "t", "band", "snr", "source", F.col("sc").alias("sender"), F.col("rc").alias("receiver"), "remote", e(bands.reporter_locator("source", "sl", "rl")).alias("reporter"), F.when(F.col("is_sender"), F.col("r_lat")).otherwise(F.col("s_lat")).alias("lat"), F.when(F.col("is_sender"), F.col("r_lon")).otherwise(F.col("s_lon")).alias("lon"), e(times.age_seconds("now", "t")).alias("age"))


def band_events(spots: DataFrame, qths: DataFrame, *keep: str, within: str = "true") -> DataFrame:
    """Matched spots with both locators: the remote square, distance, direction, and the half minute that counts once.

    ``keep`` are columns of the location, which ``within`` may test.
    """
    gated = spots.where(e(bands.baseline_gate("band", "sl", "rl")))
    hits = matched_spots(gated, qths, *keep).where(within)
    return with_path(hits, e("is_sender")).withColumn("bucket", e(times.dedup_bucket("t")))


def with_path(spots: DataFrame, from_sender: Column | None = None) -> DataFrame:
    """Adds remote, remote4 ('' for none), remote_region, km and direction ('' where an end is unknown), seen from the sender or, where ``from_sender`` is false, from the receiver."""
    sender = F.lit(True) if from_sender is None else from_sender
    near, far = (lambda x: F.when(sender, F.col(f"s{x}")).otherwise(F.col(f"r{x}"))), (lambda x: F.when(sender, F.col(f"r{x}")).otherwise(F.col(f"s{x}")))
    out = spots.withColumns({"lat1": near("_lat"), "lon1": near("_lon"), "lat2": far("_lat"), "lon2": far("_lon"), "remote": far("l"), "remote4": F.coalesce(far("4"), F.lit("")), "remote_region": far("_region")})
    out = out.withColumn("km", e(geo.haversine_km("lat1", "lon1", "lat2", "lon2"))).withColumn("degrees", e(geo.bearing_deg("lat1", "lon1", "lat2", "lon2")))
    known = "not (lat1 = 0 and lon1 = 0) and not (lat2 = 0 and lon2 = 0)"
    return out.withColumn("direction", e(f"case when {known} then {geo.direction8('degrees')} else '' end")).drop("degrees", "lat1", "lon1", "lat2", "lon2")


def area_ends(spots: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, spot_id, s_ring, r_ring): rings between an area's centre and the spot's ends, null beyond ``rings``.

    ``areas`` has area, centre (a locator) and rings; an end matches if it lies within the rings.
    """
    squares = ring_squares(areas.select("area", e(grid.square_x("centre")).alias("x"), e(grid.square_y("centre")).alias("y"), F.col("rings").alias("r")), "area")
    ends = spots.select("spot_id", F.explode(e("array(named_struct('side', 's', 'square', s4), named_struct('side', 'r', 'square', r4))")).alias("end")).select("spot_id", "end.*").where("square is not null")
    hits = ends.join(small(squares), "square")
    return hits.groupBy("area", "spot_id").agg(F.min(F.when(F.col("side") == "s", F.col("ring"))).alias("s_ring"), F.min(F.when(F.col("side") == "r", F.col("ring"))).alias("r_ring"))


def remote_counts(spots: DataFrame, qths: DataFrame, *cells: str) -> DataFrame:
    """(qth, cells..., region, from_here, n): spots by the region of the end that is remote for each location.

    The receiving station's end is tested first: if it is the location's, the other end is remote; if the other end is,
    the receiving one is (from_here is true for both). A spot of which neither end matches counts for the receiving end.
    As that holds for nearly all spots and every location, the receiving ends are counted once, by ``cells``; only these
    counts are repeated for each location, and the spots that match it are moved from one cell to the other.
    """
    swap = e(bands.receiver_is_sender_side("source"))
    sided = spots.withColumn("swap", swap).withColumn("recv", e("case when swap then s_region else r_region end")).withColumn("other", e("case when swap then r_region else s_region end"))
    everywhere = sided.groupBy(*cells, F.col("recv").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    hits = matched_spots(sided, qths)
    receives = e("case when swap then is_sender else is_receiver end")
    hits = hits.withColumn("to", F.when(receives, F.col("other")).otherwise(F.col("recv")))
    parts = [
        everywhere.crossJoin(qths.select("qth")).select("qth", *cells, "region", F.lit(False).alias("from_here"), "n"),
        hits.groupBy("qth", *cells, F.col("recv").alias("region")).agg((-F.count(F.lit(1))).alias("n")).select("qth", *cells, "region", F.lit(False).alias("from_here"), "n"),
        hits.groupBy("qth", *cells, F.col("to").alias("region")).agg(F.count(F.lit(1)).alias("n")).select("qth", *cells, "region", F.lit(True).alias("from_here"), "n"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("qth", *cells, "region", "from_here").agg(F.sum("n").alias("n")).where("n > 0 and region <> '??'")


def from_here_ends(spots: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, spot columns, region): a row for each end inside an area, with the region of the other end.

    A spot with both ends in the same square counts once; unknown regions don't count.
    """
    near = area_ends(spots, areas).join(spots, "spot_id")
    sides = e("array_compact(array(case when s_ring is not null then named_struct('here4', s4, 'call', rc, 'region', r_region) end, case when r_ring is not null and (s_ring is null or s4 <> r4) then named_struct('here4', r4, 'call', sc, 'region', s_region) end))")
    return near.withColumn("end", F.explode(sides)).select("*", "end.*").drop("end").where("region <> '??'")


def cluster_ends(spots: DataFrame) -> DataFrame:
    """A row for each end with a square, with the anchor of its cluster; a spot inside one cluster has two."""
    ends = spots.withColumn("end4", F.explode(F.array("s4", "r4"))).where("end4 is not null")
    return ends.withColumn("anchor", e(grid.cluster_anchor("end4")))


def region_keys(spots: DataFrame) -> DataFrame:
    """(spot columns, target4, region): the sender's square with the receiver's region and the other way round.

    Equal pairs count once, unknown regions not at all, and a spot needs a band.
    """
    both = e("array_distinct(array(named_struct('target4', s4, 'region', r_region), named_struct('target4', r4, 'region', s_region)))")
    keyed = spots.where("coalesce(band, '') <> ''").withColumn("key", F.explode(both))
    return keyed.withColumn("target4", F.col("key.target4")).withColumn("region", F.col("key.region")).drop("key").where("target4 is not null and region <> '??'")
