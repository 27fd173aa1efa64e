"""What queries write, shuffle and sort keeps to what they need, whatever the number of events."""

import glob
import os

from pyspark.sql import functions as F

from bandloom.operators import almanac, baselines, callsigns
from bandloom.plans import jobs, queries, tables
from bandloom.plans.queries import QUERIES, Inputs
from bandloom.plans.spots import SPOT_SCHEMA, prepared, spots, spots_by_half_hour
from bandloom.streaming import live, maintain


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_store_no_spots(spark, data_dir):
    state = tables.Tables(spark, data_dir).state
    for name in ("match_spots", "density_points", "band_events", "trends", "region_keys", "source_calendar"):
        assert QUERIES[name](spark, data_dir).count() > 0
    folder = f"{tables.shared_root(spark).removeprefix('file:').replace('///', '/')}/bandloom/tables/{state}"
    assert glob.glob(f"{folder}/*") and not glob.glob(f"{folder}/spots*")


def test_counts_and_bands_move_few_bytes_an_event(spark, data_dir, tmp_path):
    events = spark.read.parquet(f"{data_dir}/events.parquet")
    more = events.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).withColumns({"event_id": F.expr("event_id + copy * 1000"), "user_id": F.expr("user_id + copy * 15")}).drop("copy")
    more.write.parquet(f"{tmp_path}/events.parquet")
    sc, n = spark.sparkContext._jsc.sc(), more.count()
    folder = f"{tables.shared_root(spark).removeprefix('file:').replace('///', '/')}/bandloom/tables/{tables.Tables(spark, str(tmp_path)).state}"

    def moved():
        sc.listenerBus().waitUntilEmpty(30_000)
        stored = sum(os.path.getsize(x) for x in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(x))
        return sc.statusStore().executorSummary("driver").totalShuffleWrite() + stored

    before = moved()
    for name in ("trends_widened", "old_snapshots", "source_calendar", "region_keys", "band_details", "activity_vs_normal", "hot_bands"):
        QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert moved() - before < 2000 * n
    for name in ("season_counts", "area_activity"):
        QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert moved() - before < 4000 * n
    assert not glob.glob(f"{folder}/spots*") and not glob.glob(f"{folder}/raw*")


def test_the_daily_table_shuffles_events_and_not_its_cells(spark, tmp_path):
    events = 6000
    spark.range(events).selectExpr("id as event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 600) as ts", "id % 1500 as user_id").write.parquet(f"{tmp_path}/events.parquet")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before, t = shuffled(), tables.Tables(spark, str(tmp_path))
    found = t.daily
    assert shuffled() - before < 200 * events
    want = baselines.region_daily(t.spots)
    assert found.columns == want.columns and found.count() > 10 * events
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0


def test_half_hours_have_all_their_spots(spark, data_dir, tmp_path):
    # Events on both sides of a half hour, one half hour with most of them, some before 1970 and some without a time.
    late = "case when event_id % 4 = 0 then ts when event_id % 9 = 0 then null when event_id % 7 = 0 then timestamp_ntz '1969-12-31 23:59:30' else timestamp_ntz '2024-01-05 11:29:01' + make_dt_interval(0, 0, 0, event_id % 60) end"
    spark.read.parquet(f"{data_dir}/events.parquet").where("event_id < 200").withColumn("ts", F.expr(late)).write.parquet(f"{tmp_path}/events.parquet")
    want = spots(spark, str(tmp_path))
    daily = baselines.region_daily(prepared(want))
    for most, parts in ((1 << 17, 1), (40, 2)):
        found = spots_by_half_hour(spark, str(tmp_path), most)
        assert len(found) == parts
        whole = found[0] if parts == 1 else found[0].unionByName(found[1])
        assert whole.where("not half <=> cast(floor(t / 1800) as bigint)").count() == 0
        whole = whole.select(want.columns)
        assert whole.exceptAll(want).count() == want.exceptAll(whole).count() == 0
        cells = baselines.region_daily(prepared(found[0], None, "half"), "half")
        cells = cells if parts == 1 else cells.unionByName(baselines.region_daily(prepared(found[1])))
        assert cells.exceptAll(daily).count() == daily.exceptAll(cells).count() == 0


def test_a_window_has_all_its_spots(spark, data_dir):
    i = Inputs(spark, data_dir)
    whole = prepared(spots(spark, data_dir))
    assert i.now == whole.agg(F.max("t")).first()[0]
    for seconds in (1, 59, 3600, 86400):
        first, found = i.now - seconds, i.since(seconds)
        want = whole.where(F.col("t").between(first, i.now))
        assert found.columns == whole.columns and found.count() > 0
        assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0


def test_the_newest_time_deals_no_events(spark, tmp_path):
    events = 40_000
    spark.range(events).selectExpr("id as event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 60) as ts", "id % 1500 as user_id").write.parquet(f"{tmp_path}/events.parquet")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    now = Inputs(spark, str(tmp_path)).now
    assert shuffled() - before < events and now == spots(spark, str(tmp_path)).agg(F.max("t")).first()[0]


def test_span_from_the_timed_baseline(spark, data_dir):
    whole = prepared(spots(spark, data_dir))
    for some in (whole, whole.where("band = 'none'")):
        assert baselines.span_of(baselines.timed_baseline(some)).collect() == baselines.baseline_span(some).collect()


def test_archive_files_are_sorted_where_their_spots_are_made(spark, data_dir):
    t = tables.Tables(spark, data_dir)
    files = spark.read.parquet(t.archive_path)
    assert files.select(sorted(files.columns)).exceptAll(t.raw.select(sorted(files.columns))).count() == 0 and files.count() == t.raw.count()


def test_snr_backfill_joins_only_the_days_it_recounts(spark, data_dir):
    i = Inputs(spark, data_dir)
    daily, start = i.daily.withColumn("snr_spots", F.lit(0).cast("long")), i.today - 2
    found = jobs.snr_backfill(daily, i.days(i.today - 6), start)
    days = {r.day: r.n for r in found.groupBy("day").agg(F.sum("snr_spots").alias("n")).collect()}
    assert found.count() == daily.count() and all((n > 0) == (i.today - 6 <= d < start) for d, n in days.items())
    assert "Union" in plan(found)


def test_areas_are_broadcast_to_the_daily_table(spark, data_dir):
    i = Inputs(spark, data_dir)
    for joined in (almanac.ring_levels(i.daily, i.areas()), baselines.area_daily(i.daily, i.areas())):
        assert "BroadcastHashJoin" in plan(joined) and "SortMergeJoin" not in plan(joined)


def test_reports_of_a_call_are_not_sorted(spark):
    rows = [("S1", "JO32", 5), ("S1AA", "JO32", 5), ("S1AA", "JO32AB", 3), ("S1AA", "JO31", 4), ("S1AB", "JO32AB", 5), ("S1AB", "JO32AC", 7), ("S1AB", "JO32AB", 7)]
    found = callsigns.call_locators(spark.createDataFrame(rows, "call string, locator string, t long"))
    assert {tuple(r) for r in found.collect()} == {("S1AA", "JO32AB", 5), ("S1AB", "JO32AC", 7)}
    lines = [x for x in plan(found).splitlines() if "Aggregate" in x]
    assert "HashAggregate" in lines[-1] and "max(t" in lines[-1]


def test_sessions_of_a_batch_meet_by_hour(spark):
    rows = [("wspr", t) for t in (0, 0, 120, 241, 3599, 3700, 7300)] + [("rbn", 50)]
    found = live.sessions(spark.createDataFrame(rows, "source string, t long"), "2 minutes")
    assert {tuple(r) for r in found.collect()} == {("wspr", 0, 240, 3), ("wspr", 241, 361, 1), ("wspr", 3599, 3820, 2), ("wspr", 7300, 7420, 1), ("rbn", 50, 170, 1)}
    assert "SessionWindow" not in plan(found)


def test_names_are_made_of_distinct_ends(spark, data_dir):
    lines = plan(queries.classified_names(Inputs(spark, data_dir))).splitlines()
    at = next(k for k, x in enumerate(lines) if "Generate" in x and "explode(CASE" in x)
    assert any("Aggregate" in x for x in lines[at:])


def test_stations_are_found_among_names_that_are_made_once(spark, data_dir, tmp_path):
    found = QUERIES["resolve_dxcc"](spark, data_dir)
    assert "event_id" not in plan(found)  # spots are made for the table of names alone
    p = Inputs(spark, data_dir).spots.selectExpr("inline(array(named_struct('qth', sc), named_struct('qth', rc), named_struct('qth', s4)))").distinct()
    names = found.select("qth")
    assert names.exceptAll(p).count() == p.exceptAll(names).count() == 0
    spark.createDataFrame([(x,) for x in ("S1A", "S1A", "S1B", "AB1", " x", "", None, "JO32")], "qth string").write.parquet(f"{tmp_path}/names")
    stations = "token string, name string, continent string, lat double, lon double, primary_prefix string"
    exact = spark.createDataFrame([("S1B", "Isle", "OC", -20.0, 150.0, "I")], stations)
    prefixes = spark.createDataFrame([("S", "Land", "EU", 50.0, 10.0, "S"), ("S1", "Land 1", "NA", 40.0, -75.0, "S1"), ("X", "Nowhere", "EU", 0.0, 0.0, "X")], stations)
    got = callsigns.resolve_qth(spark.read.parquet(f"{tmp_path}/names"), exact, prefixes)
    assert plan(got).count("FileScan") == 2  # the names themselves, and once for their entities
    assert sorted(map(repr, ((r.qth, r.locator, r.origin) for r in got.collect()))) == sorted(map(repr, [("S1A", "FN20", "entity"), ("S1A", "FN20", "entity"), ("S1B", "QH50", "entity"), ("AB1", None, "unknown"), (" x", None, "unknown"), ("", None, "unknown"), (None, None, "unknown"), ("JO32", "JO32", "locator")]))


def test_maintained_tables_need_no_stored_archive(spark, data_dir, tmp_path):
    spark.read.parquet(f"{data_dir}/events.parquet").coalesce(1).write.parquet(f"{tmp_path}/folder/events.parquet")
    os.mkdir(f"{tmp_path}/file")
    os.link(glob.glob(f"{tmp_path}/folder/events.parquet/part-*")[0], f"{tmp_path}/file/events.parquet")
    for place in (f"{tmp_path}/folder", f"{tmp_path}/file"):
        state = tables.Tables(spark, place).state
        found = QUERIES["maintained_baseline"](spark, place)
        assert not glob.glob(f"{tables.shared_root(spark).removeprefix('file:').replace('///', '/')}/bandloom/tables/{state}/raw*")
        want = baselines.global_baseline(prepared(spots(spark, place))).select(found.columns)
        assert found.count() > 0 and found.exceptAll(want).count() == want.exceptAll(found).count() == 0


def test_a_batch_of_untidy_spots_counts_as_its_spots_do(spark, tmp_path):
    ends, times_ = ["JO32", " jo32ab ", "FN45", "", None, "ZZ99", "jo", "KK11"], [0, 1_000_000, 1_003_599, None, 86_400 * 30]
    given = ["mqtt", " WSPR ", "", None, "rbn", "odd/one=1", "Wspr"]
    rows = []
    for k in range(2400):  # of two spots of one number one may be late
        t = times_[k % 5]
        rows.append((k // 2, t, (t or 0) + (30, 90_000, -700, None)[k % 4] if k % 4 < 3 else None, ends[k % 8], ends[k // 8 % 8], f" s{k % 9}", f"r{k % 7} ", ["20m", " 40M", "15", "", None, "70cm"][k // 3 % 6], k % 50 - 30 if k % 19 else None, given[k // 5 % 7], ["FT8", " ft4", None, "CW"][k // 2 % 4], k % 3))
    batch = spark.createDataFrame(rows, SPOT_SCHEMA)
    for _ in range(2):  # a batch that runs again replaces what it wrote
        maintain.write_batch(str(tmp_path))(batch, 3)
    p = prepared(batch)
    wanted = {"global_baseline": baselines.global_baseline(p), "cluster_baseline": baselines.cluster_baseline(p), "region_daily": baselines.region_daily(prepared(maintain.timely(batch))), "wspr_daily": baselines.wspr_daily(p), "source_daily": baselines.source_daily(p)}
    assert set(wanted) == set(maintain.TABLES)
    for name, want in wanted.items():
        found = maintain.read_table(spark, str(tmp_path), name).select(want.columns)
        assert found.count() > 0 and found.exceptAll(want).count() == want.exceptAll(found).count() == 0, name
    assert spark.read.parquet(f"{tmp_path}/raw").count() == len(rows)
