"""Gaps in what was recorded, bucketed windows and the join of locations with spots."""

import random

import pytest
from pyspark.sql import functions as F

from bandloom.operators import baselines, conditions, intervals, matching, nowcast
from bandloom.plans.spots import prepared
from tests.test_pipelines import spot_rows

QTHS = "qth string, surroundings boolean, minutes int, cw_min_db int, now long"


def cut(t0, t1, gaps):
    """Seconds of the window outside all gaps, as [start, end) runs."""
    out = []
    for t in range(t0, t1):
        if not any(a <= t < b for a, b in gaps):
            if out and out[-1][1] == t:
                out[-1][1] = t + 1
            else:
                out.append([t, t + 1])
    return [tuple(x) for x in out]


def test_segments(spark):
    cases = [(100, 200, None), (100, 200, []), (100, 200, [(120, 150)]), (130, 200, [(120, 150)]), (160, 200, [(120, 150)]), (100, 200, [(150, 120)]), (100, 200, [(90, 210)]), (100, 200, [(100, 110), (190, 200)])]
    rng = random.Random(1)
    cases += [(0, 60, [(a, a + rng.randint(-2, 15)) for a in rng.sample(range(-10, 70), k)]) for k in range(8)]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"k int, t0 long, t1 long, gaps {intervals.GAPS}")
    found = {r.k: [(s.a, s.b) for s in r.x] for r in frame.select("k", F.expr(intervals.segments()).alias("x")).collect()}
    assert found == {k: cut(a, b, gaps or []) for k, (a, b, gaps) in enumerate(cases)}
    parts = intervals.split(frame).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("segments").alias("of"), F.sum(F.col("t1") - F.col("t0")).alias("s")).collect()
    assert {r.k: (r.n, r.of, r.s) for r in parts} == {k: (len(x), len(x), sum(b - a for a, b in x)) for k, x in found.items() if x}


def test_windows_find_their_own_gaps(spark):
    windows = spark.createDataFrame([("a", 0, 10_000), ("a", 9_000, 20_000), ("b", 0, 10_000), ("c", 50, 50)], "qth string, t0 long, t1 long")
    gaps = spark.createDataFrame([("a", 100, 9_500), ("a", 30_000, 40_000), ("b", 10_000, 10_001), ("b", 500, 400), ("a", 100, 9_500)], "qth string, a long, b long")
    found = {(r.qth, r.t0): [tuple(g) for g in r.gaps or []] for r in intervals.with_gaps(windows, gaps, "qth").collect()}
    assert found == {("a", 0): [(100, 9_500)], ("a", 9_000): [(100, 9_500)], ("b", 0): [], ("c", 50): []}


def test_first_covered_bin(spark):
    now = 1_800_000_000
    rows = spark.createDataFrame([(now, 60, None), (now, 120, None), (now, 60, now - 25 * 60), (now, 60, now + 5), (now, 0, None)], "now long, minutes int, complete_since long")
    assert [r.x for r in rows.select(F.expr(intervals.covered_from_bin(12, 60)).alias("x")).collect()] == [0, 6, 7, 12, 0]


def test_a_trend_reads_covered_bins_alone(spark):
    def rates(values):
        return spark.createDataFrame([("q", "20m", k, float(v)) for k, v in enumerate(values)], "qth string, band string, bin int, rate double")

    def trend(values, first):
        r = conditions.trends(rates(values), spark.createDataFrame([("q", first)], "qth string, from_bin int")).first()
        return r.trend, r.trend_delta

    # Six bins without data and six alike: rising over all, flat over those that are covered.
    assert trend([0] * 6 + [10] * 6, 0)[0] == "rising" and trend([0] * 6 + [10] * 6, 6) == ("stable", 0.0)
    assert trend([0] * 7 + [1, 2, 3, 4, 5], 7) == ("stable", 0.0)  # fewer than six
    assert trend([9, 9, 0, 0, 10, 10, 10, 5, 5, 5, 5, 99], 2)[0] == conditions.trends(rates([0, 0, 10, 10, 10, 5, 5, 5, 5, 99])).first().trend
    assert trend([0, 2, 2, 2, 2, 2, 10, 10, 10, 10, 10, 0], 0) == ("rising", 8.0)


def test_a_gap_is_no_quiet_air(spark):
    """A spot a minute, with twenty minutes missing: with the gap known, the rate is one a minute and two thirds are expected."""
    now = 1_800_000_000
    live = [(now - 60 * k, "JO62QM", "JO50AA", f"S{k}", f"R{k}", "10m", -5) for k in range(60) if not 20 < k <= 40]
    past = [(now - 86400 * d - 60 * k, "JO62QM", "JO50AA", f"S{k}", f"R{k}", "10m", -5) for d in range(1, 11) for k in range(-30, 90)]
    p, before = prepared(spot_rows(spark, live)), prepared(spot_rows(spark, past))
    clusters, everywhere, span = (f(before).cache() for f in (baselines.cluster_baseline, baselines.global_baseline, baselines.baseline_span))
    plain = spark.createDataFrame([("JO62", False, 60, -15, now)], QTHS)

    def band(qths):
        return conditions.dx_conditions(p, qths, clusters, everywhere, span, baselines.cluster_coverage(clusters, everywhere)).first()

    gap = F.expr("array(named_struct('a', now - 2400, 'b', now - 1200))")
    without, known = band(plain), band(plain.withColumn("gaps", gap))
    assert known.regional_expected == pytest.approx(without.regional_expected * 2 / 3, rel=0.02)
    assert known.activity_ratio > without.activity_ratio * 1.3
    assert without.spots_per_minute == pytest.approx(40 / 60, abs=0.05) and known.spots_per_minute == pytest.approx(1, abs=0.05)
    late = band(plain.withColumn("complete_since", F.col("now") - 600))
    assert late.live_minutes == 10 and late.regional_expected < without.regional_expected / 3 and late.spots_per_minute == pytest.approx(1, abs=0.15)
    nothing = band(plain.withColumn("gaps", F.expr("array(named_struct('a', now - 4000, 'b', now - 1200))")))
    assert nothing.live_minutes == 20


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def many(spark, n=400):
    rng = random.Random(2)
    squares = ["JO32", "JO31", "FN45", "JO40"]
    return prepared(spot_rows(spark, [(rng.randint(0, 7200), rng.choice(squares), rng.choice([*squares, ""]), rng.choice(["DL1A", "W1AW/P", "JO31"]), rng.choice(["K1", "W1AW", "DL/K1"]), "20m", -3) for _ in range(n)]))


def test_windows_meet_spots_in_buckets(spark):
    p = many(spark)
    qths = spark.createDataFrame([("JO32", False, 60, -15, 7200), ("JO31", True, 15, -15, 7000), ("K1", False, 15, -15, 7000), ("FN45", False, 1, -15, 300)], QTHS)
    found = nowcast.windowed(p, qths)
    times = [r.t for r in p.select("t").collect()]
    want = sorted((t, w0, w1) for w0, w1 in {(3600, 7200), (6100, 7000), (240, 300)} for t in times if w0 <= t <= w1)
    assert sorted((r.t, r.w0, r.w1) for r in found.select("t", "w0", "w1").collect()) == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_locations_and_spots_meet_in_one_join(spark, tmp_path):
    many(spark).write.parquet(f"{tmp_path}/spots")
    p = spark.read.parquet(f"{tmp_path}/spots")
    qths = spark.createDataFrame([("JO32", False, 60, -15, 7200), ("JO31", True, 60, -15, 7200), ("W1AW", False, 60, -15, 7200), ("AA00", True, 60, -15, 7200)], QTHS)
    squares = {"JO32": {"JO32"}, "JO31": {f"JO{x}{y}" for x in (2, 3, 4) for y in (0, 1, 2)}, "W1AW": {"W1AW"}, "AA00": {"AA00", "AA01", "AA10", "AA11"}}

    def tokens(square, call):
        parts = call.split("/")
        return {square} | {"/".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)}

    want = {}
    for r in p.collect():
        for q, own in squares.items():
            flags = bool(tokens(r.s4, r.sc) & own), bool(tokens(r.r4, r.rc) & own)
            if any(flags):
                want[q, r.spot_id] = flags
    found = matching.matched_spots(p, qths, "minutes")
    assert {(r.qth, r.spot_id): (r.is_sender, r.is_receiver) for r in found.collect()} == want and found.count() == len(want)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = matching.matched_spots(p, qths)
        assert plan(shuffled).count("SortMergeJoin") == 1 and plan(shuffled).count("Exchange hashpartitioning") == 2
        # A square with nearly all spots: its rows lie in several partitions.
        busy = prepared(spot_rows(spark, [(k, "JO32", "FN45", f"S{k}", "R", "20m", 0) for k in range(400)]))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        places = matching.matched_spots(busy, qths.where("qth = 'JO32'")).groupBy(F.spark_partition_id()).count().collect()
        assert len(places) > 1 and max(r["count"] for r in places) < 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cells_from_here_alone(spark):
    cells = spark.createDataFrame([("a", "20m", "EU", True), ("a", "20m", "NA", False), ("a", "40m", "EU", False)], "qth string, band string, region string, from_here boolean")
    assert [(r.band, r.region) for r in nowcast.from_here_only(cells).collect()] == [("20m", "EU")]
