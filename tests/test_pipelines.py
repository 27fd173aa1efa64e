"""Sources, matching, jobs and streams on small rows; registered queries against their SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from bandloom.operators import almanac, baselines, callsigns, conditions, matching
from bandloom.plans import jobs, snapshots
from bandloom.plans.oracle import ORACLE_SQL
from bandloom.plans.queries import QUERIES
from bandloom.plans.spots import SPOT_SCHEMA, prepared, spots
from bandloom.sources import archive, feeds, reference_tables
from bandloom.streaming import live, maintain


def spot_rows(spark, rows):
    """Spots from (t, sl, rl, sc, rc, band, snr) and, if given, source, mode, txpower."""
    full = [(k, r[0], r[0] + 30, r[1], r[2], r[3], r[4], r[5], r[6], *(r[7:10] if len(r) > 7 else ("mqtt", "FT8", 0))) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, SPOT_SCHEMA)


def test_feeds(spark):
    topic = "pskr/filter/v2/20m/FT8/S.1/R1/JO62qm/FN31"
    messages = [(topic, '{"t":100,"rp":-7}', 160), (topic, '{"rp":3}', 170), (topic.replace("FT8", "CW"), '{"t":1}', 1), (topic, "nonsense", 1), ("short", '{"t":5,"rp":1,"b":"40m","md":"ft4","sc":"a","rc":"b","sl":"jo32","rl":"fn20"}', 9), (topic.replace("R1", "unknown"), '{"t":7}', 9)]
    found = feeds.read_pskr(spark.createDataFrame(messages, "topic string, payload string, arrival long")).orderBy("t").collect()
    assert [(r.t, r.sc, r.rc, r.sl, r.band, r.snr) for r in found] == [(5, "A", "B", "JO32", "40m", 1), (7, "S/1", "", "JO62QM", "20m", 0), (100, "S/1", "R1", "JO62QM", "20m", -7), (170, "S/1", "R1", "JO62QM", "20m", 3)]
    lines = ["DX de W3LPL-#:      14024.0  N0CALL         CW   22 dB   EN91   1234 Z", "DX de OH8X-1: 7040.1 dl1abc rtty 15 dB", "", "callsign:", "DX de A: 14000 B CW 22"]
    found = feeds.read_rbn(spark.createDataFrame([(x, 50) for x in lines], "line string, observed_at long")).orderBy("sc").collect()
    assert [(r.sc, r.rc, r.freq_khz, r.mode, r.snr, r.band) for r in found] == [("OH8X-1", "DL1ABC", 7040.1, "RTTY", 15, "40m"), ("W3LPL-#", "N0CALL", 14024.0, "CW", 22, "20m")]
    rows = [("2024-01-01 00:02:00", 14, "DL1ABC", "JO31", "KF5XYZ", "EM12", 14097000, 43, 5, 1), ("bad", 14, "A1", "", "B1", "", 1, 20, 0, 77), ("", 14, "A1", "", "", "", 1, 20, 0, 1), ("", 2, "A1", "", "B1", "", 1, 20, 0, 1)]
    wspr = feeds.read_wspr(spark.createDataFrame(rows, "time string, band int, rx_sign string, rx_loc string, tx_sign string, tx_loc string, frequency long, power int, snr int, arrival long"))
    assert [(r.t, r.band, r.sl, r.rl, r.freq_khz, r.txpower) for r in wspr.orderBy("t").collect()] == [(77, "20m", "", "", 0.001, 20), (1704067320, "20m", "JO31", "EM12", 14097.0, 43)]
    assert feeds.dedup_wspr(wspr.unionByName(wspr)).count() == 2


def test_reference_tables(spark):
    page = "<tr><th>x</th></tr><tr><td><a>VE6WZ-4</a></td><td>b</td><td>do21st</td></tr><tr><td>IK4VET-#</td><td></td><td>JN54</td></tr><tr><td>IK4VET</td><td></td><td>JN54MM</td></tr><tr><td>X</td><td></td><td>no</td></tr>"
    found = reference_tables.load_skimmers(spark.createDataFrame([(page,)], "html string"))
    assert {r.call: r.grid for r in found.collect()} == {"VE6WZ-4": "DO21ST", "IK4VET": "JN54MM"}
    text = "Germany: 14: 28: EU: 51.00: -10.00: -1.0: DL:\n    DA,DB,DL,=DL0XX(14)[28];\n# note\nHawaii: 31: 61: OC: 21.12: 157.48: 10.0: *KH6:\n    AH6,KH6,KH7,=K5B<21/157>;\n"
    exact, prefixes = reference_tables.load_dxcc(spark.createDataFrame([(text,)], "text string"))
    assert {r.token for r in exact.collect()} == {"DL0XX", "K5B"} and {(r.token, r.lon, r.primary_prefix) for r in prefixes.where("token in ('DL', 'KH7')").collect()} == {("DL", 10.0, "DL"), ("KH7", -157.48, "KH6")}
    calls = spark.createDataFrame([("dl1abc",), ("K5B",), ("XX1",), ("KH7Z",)], "call string")
    assert {r.call: r.name for r in callsigns.resolve_dxcc(calls, exact, prefixes).collect()} == {"dl1abc": "Germany", "K5B": "Hawaii", "XX1": None, "KH7Z": "Hawaii"}
    snapshot = json.dumps({"buckets": {"a": {"band": "20m", "hour_of_week": 26, "distance_tier": 1, "snr_tier": 2, "count": 3}, "b": {"band": "20m", "hour_of_week": 2, "distance_tier": 1, "snr_tier": 2, "count": 4}}})
    assert [tuple(r) for r in reference_tables.import_baseline_json(spark.createDataFrame([(snapshot,)], "json string")).collect()] == [("20m", 4, 1, 2, 7)]


def test_matching_of_calls_and_squares(spark):
    p = prepared(spot_rows(spark, [(100, "jo32ab", "FN31", "DL/W1AW/P", "K1", "20m", -5), (101, "JO40", "JO33", "A1", "B1", "20m", 0), (102, "FN31", "", "X", "JO32", "20m", 0), (103, "FN31", "JO32", "X", "W1AWX", " 40 ", 0)]))
    q = spark.createDataFrame([("JO32", False, 200), ("W1AW", False, 200), ("JO31", True, 200), ("DL/W1AW", False, 200)], "qth string, surroundings boolean, now long")
    hits = {(r.qth, r.spot_id): (r.is_sender, r.is_receiver) for r in matching.matched_ends(p, q).collect()}
    assert hits == {("JO32", 0): (True, False), ("W1AW", 0): (True, False), ("DL/W1AW", 0): (True, False), ("JO31", 0): (True, False), ("JO31", 1): (True, False), ("JO32", 2): (False, True), ("JO31", 2): (False, True), ("JO32", 3): (False, True), ("JO31", 3): (False, True)}
    found = {(r.qth, r.spot_id): (r.remote, r.age) for r in matching.match_spots(p, q).collect()}
    assert found[("JO32", 0)] == ("FN31", 100) and found[("JO32", 3)] == ("FN31", 97) and ("JO32", 2) in found
    keys = {(r.target4, r.region) for r in matching.region_keys(p.where("spot_id = 0")).collect()}
    assert keys == {("JO32", "NA"), ("FN31", "EU")} and matching.region_keys(prepared(spot_rows(spark, [(1, "JO32", "JO32", "a", "b", "20m", 0)]))).count() == 1


def test_locator_of_calls(spark):
    reports = spark.createDataFrame([("DL1ABC", "JO31", 10), ("DL1ABC", "jo31lk", 5), ("DL1ABC", "JO40", 7), ("K1XY", "FN31", 1), ("K1XY", "EM12", 2), ("AB", "FN31", 3)], "call string, locator string, t long")
    known = {r.call: (r.loc, r.seen) for r in callsigns.call_locators(reports).collect()}
    assert known == {"DL1ABC": ("JO31LK", 10), "K1XY": ("EM12", 2)}
    table = spark.createDataFrame([("DL1ABC", "JO31", "feed", 1000), ("K1/P", "EM10", "qrz", 1000), ("K1", "EM12", "feed", 1000), ("N0", None, "negative", 1000), ("OLD", "AA00", "feed", -700000)], "call string, loc string, src string, seen long")
    asked = spark.createDataFrame([(c, 2000) for c in ("DL1ABC/P", "K1/P", "N0", "OLD", "EA8/DL1ABC")], "call string, now long")
    found = {r.call: (r.loc, r.origin) for r in callsigns.resolve_call_locators(asked, table).collect()}
    assert found == {"DL1ABC/P": ("JO31", "feed"), "K1/P": ("EM12", "feed"), "N0": (None, "negative"), "OLD": (None, "miss"), "EA8/DL1ABC": (None, "miss")}


def test_live_area_widens(spark):
    rows = []
    for band, square in (("20m", "FN76"), ("40m", "FN77"), ("15m", "FN74"), ("10m", "FN79")):  # rings 0, 1, 2, 3
        rows += [(1000 + k, square, "JO32", f"S{k}", "R", band, 0) for k in range(30)]
    q = spark.createDataFrame([("FN76", False, 60, -15, 1100), ("AA11", True, 60, -15, 1100)], "qth string, surroundings boolean, minutes int, cw_min_db int, now long")
    found = {r.qth: (r.radius, r.widened) for r in conditions.live_area(prepared(spot_rows(spark, rows)), q).collect()}
    assert found == {"FN76": (2, True), "AA11": (1, False)}


def test_usual_windows_around_midnight(spark):
    def lane(region, slots):
        return [("a", "20m", region, s, 10 if s in slots else 0, 20, -1, 10) for s in range(48)]

    rows = lane("EU", {46, 47, 1, 2}) + lane("NA", set(range(48))) + lane("AS", {5, 6, 8, 20}) + lane("OC", set()) + lane("SA", {0}) + lane("JA", set(range(47)))
    lanes = spark.createDataFrame(rows, "area string, band string, region string, slot int, n int, m int, share int, m_min int")
    found = {(r.region, r.start, r.len) for r in almanac.usual_windows(lanes).collect()}
    assert found == {("EU", 46, 5), ("NA", 0, 48), ("AS", 5, 4), ("AS", 20, 1), ("SA", 0, 1), ("JA", 0, 48)}
    agenda = {(r.region, r.start): (r.status, r.starts_in, r.peak_slot) for r in almanac.agenda(lanes, 15).collect()}
    assert agenda[("EU", 46)] == ("ongoing", 0, 46) and agenda[("AS", 5)] == ("upcoming", 135, 5) and agenda[("AS", 20)][1] == 585


def test_fold_twice_is_the_same_and_archive_prunes(spark, data_dir, tmp_path):
    raw = spots(spark, data_dir).where("spot_id % 8 = 0")
    archive.write_raw(raw, f"{tmp_path}/raw")
    last = raw.agg(F.max("t")).first()[0]
    scan = archive.scan_raw(spark, f"{tmp_path}/raw", last - 3600, last)
    assert scan.count() == raw.where(f"t >= {last - 3600}").count() == archive.count_raw(spark, f"{tmp_path}/raw", last - 3600, last)
    assert "PartitionFilters: [isnotnull(day_index" in scan._jdf.queryExecution().toString()
    daily = baselines.region_daily(prepared(raw)).persist()
    today = last // 86400
    store = snapshots.Store(spark, f"file://{tmp_path}/store")
    assert jobs.fold_run(store, daily, today) == []
    mark = store.manifest()["marks"]["watermark"]
    once = sorted(map(str, store.read("season").collect()))
    jobs.refold_days(store, daily, mark - 3, mark)
    assert sorted(map(str, store.read("season").collect())) == once
    lost = jobs.fold_run(store, daily, today, forced_to=today)
    assert mark == today - 2 and store.manifest()["marks"]["watermark"] == today and lost == [today - 1, today]
    assert sorted(map(str, store.read("season").collect())) == once
    first = daily.agg(F.min("day")).first()[0]
    assert archive.apply_retention(spark, f"{tmp_path}/raw", first + 4) == [first]
    assert archive.scan_raw(spark, f"{tmp_path}/raw", 0, last).agg(F.min("day_index")).first()[0] > first


def test_stream_gives_the_batch_tables(spark, data_dir, tmp_path):
    raw = spots(spark, data_dir).where("spot_id % 16 = 0").persist()
    raw.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = maintain.maintain(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    maintain.write_batch(f"{tmp_path}/out")(spark.read.parquet(f"{tmp_path}/in").limit(0), 99)
    p = prepared(raw)
    for name, build in (("cluster_baseline", baselines.cluster_baseline), ("region_daily", baselines.region_daily), ("source_daily", baselines.source_daily)):
        expected = build(p)
        found = maintain.read_table(spark, f"{tmp_path}/out", name).select(expected.columns)
        assert found.exceptAll(expected).count() == expected.exceptAll(found).count() == 0
    maintain.compact(spark, f"{tmp_path}/out", "region_daily", 1)
    assert maintain.read_table(spark, f"{tmp_path}/out", "region_daily").select(baselines.region_daily(p).columns).exceptAll(baselines.region_daily(p)).count() == 0


def test_stateful_locators_and_windows_on_a_stream(spark, tmp_path):
    rows = [("DL1ABC", "JO31", 1000), ("DL1ABC", "jo31lk", 1010), ("DL1ABC", "JO40", 990), ("K1XY", "FN31", 1005), ("K1XY", "EM12", 1015)]
    spark.createDataFrame(rows, "call string, locator string, t long").coalesce(1).write.parquet(f"{tmp_path}/reports")
    stream = spark.readStream.schema("call string, locator string, t long").parquet(f"{tmp_path}/reports")
    query = live.latest_locators(stream).writeStream.outputMode("update").format("memory").queryName("locators").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.call, r["loc"], r.seen) for r in spark.table("locators").collect()} == {("DL1ABC", "JO31LK", 1010), ("K1XY", "EM12", 1015)}
    spot_rows(spark, [(1000 + 100 * k, "JO32", "FN31", "a", "b", "20m", 0) for k in range(10)]).coalesce(1).write.parquet(f"{tmp_path}/spots")
    stream = spark.readStream.schema(SPOT_SCHEMA).parquet(f"{tmp_path}/spots")
    query = live.windowed_activity(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.t0, r.n) for r in spark.table("windows").collect()} == {(900, 2), (1200, 3), (1500, 3), (1800, 2)}


def test_feed_lag_and_segments(spark):
    arrivals = [(1000 + k, 1200 + k) for k in range(120)] + [(5000, 5000)]
    lags = live.feed_lag(live.lag_minutes(spark.createDataFrame(arrivals, "t long, arrival long")), spark.createDataFrame([(1320,), (1260,), (2000,), (1000,)], "now long"))
    found = {r.now: (r.lag, r.fresh) for r in lags.collect()}
    assert found[1320] == (195, True) and found[1260] == (195, True) and found[1000] == (0, False)
    assert found[2000] == (2000 - (1319 - 195), False)
    shifted = {r.now: r.eval_now for r in live.eval_now(lags, 15).collect()}
    assert shifted[1320] == 1125 and shifted[1000] == 1000
    w = spark.createDataFrame([(0, 100, 20, 50), (0, 100, None, None), (0, 100, 0, 30)], "t0 long, t1 long, gap_start long, gap_end long")
    assert sorted((r.t0, r.t1) for r in live.live_segments(w).collect()) == [(0, 20), (0, 100), (30, 100), (50, 100)]


CHECKED = ["raw_archive", "spot_paths", "cluster_baseline", "region_daily", "slot_rates", "region_calendar", "source_calendar", "match_spots", "band_events", "band_features", "remote_counts", "from_here_ends", "grid_squares", "coverage_intervals", "almanac_lanes", "live_area", "prop_cells_v2", "prop_rollup", "prop_headline", "from_here_cells", "from_here_surges", "history", "band_density", "lone_points", "snr_backfill", "season_months", "season_pick", "acceptance", "agenda_text_one", "resolve_call_locators", "resolve_dxcc"]


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_their_sql(spark, data_dir, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from '{data_dir}/events.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    tidy = lambda row: tuple(round(float(x), 5) if isinstance(x, float) else x for x in row)
    expected = sorted((tidy(r) for r in cursor.fetchall()), key=str)
    found = QUERIES[name](spark, data_dir)
    assert sorted(found.columns) == sorted(columns)
    assert sorted((tidy(r) for r in found.select(columns).collect()), key=str) == expected and expected


def test_entry_and_names(spark):
    assert set(ORACLE_SQL) <= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "score" in __spark_entry__.entry(spark).columns


def test_open_today_looks_at_two_slots(spark):
    rows = [("A", 0, "20m", "EU", 9, 47, 2), ("A", 0, "20m", "NA", 10, 0, 1), ("A", 1, "20m", "NA", 10, 0, 1), ("A", 2, "20m", "AF", 10, 0, 5), ("A", 0, "20m", "AS", 9, 46, 9), ("A", 0, "40m", "EU", 10, 0, 1), ("A", 0, "40m", "EU", 9, 47, 1)]
    levels = spark.createDataFrame(rows, "area string, ring int, band string, region string, day int, slot int, n long")
    radius = spark.createDataFrame([("A", 1)], "area string, radius int")
    # Counts of slots aren't added up, rings within the radius are; before the first slot comes yesterday's last.
    assert sorted(tuple(r) for r in almanac.open_today(levels, radius, 10, 0).collect()) == [("A", "20m", "EU"), ("A", "20m", "NA")]
    assert [tuple(r) for r in almanac.open_today(levels, radius, 9, 47).collect() if r.region == "AS"] == [("A", "20m", "AS")]
