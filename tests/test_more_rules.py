"""Rules on hand-made rows: hot bands, agenda texts, seasons, acceptance, windows of each location's own, folds and compaction."""

import math
import shutil

from pyspark.sql import functions as F

from bandloom.operators import almanac, baselines, conditions, nowcast
from bandloom.plans import jobs
from bandloom.plans.snapshots import Store
from bandloom.plans.spots import prepared
from bandloom.streaming import maintain
from tests.test_pipelines import spot_rows

QTHS = "qth string, surroundings boolean, minutes int, cw_min_db int, now long"


def test_hot_bands_by_kind_and_rank(spark):
    plain = dict(qth="A", activity_level="normal", activity_ratio=1.0, baseline_rate=1.0, spots_per_minute=1.0, links=60, minutes=60, used_cluster=True, history_minutes=2000, p90_km=900.0, reach_level="typical", reach_ratio=1.0, trend="stable", trend_delta=0.0, status="green", sustained=3, score=50.0)
    rows = [
        plain | dict(band="10m", activity_ratio=6.0, baseline_rate=0.05, sustained=2, spots_per_minute=0.5),
        plain | dict(band="15m", reach_level="longer", reach_ratio=1.6, p90_km=6000.0),
        plain | dict(band="20m", trend="rising", trend_delta=2.0, activity_ratio=1.5),
        plain | dict(band="40m", activity_ratio=6.0, baseline_rate=0.05, sustained=1),  # not sustained
        plain | dict(band="17m", activity_level="no_baseline", baseline_rate=0.05, spots_per_minute=0.6, links=36),  # 12 times its rate, by Poisson
        plain | dict(band="12m", activity_level="no_baseline", baseline_rate=0.05, spots_per_minute=0.6, links=36, used_cluster=False),
        plain | dict(band="30m", activity_ratio=6.0, baseline_rate=0.05, p90_km=700.0),  # too near
    ]
    c = spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))
    found = lambda **k: [(r.band, r.kind, r.priority) for r in conditions.hot_bands(c, **k).orderBy("rank").collect()]
    assert found(most=12) == [("17m", "surprise", "high"), ("10m", "surprise", "high"), ("15m", "dx_surge", "normal"), ("20m", "rising", "normal")]
    assert [x[0] for x in found()] == ["17m", "10m", "15m"]
    options = spark.createDataFrame([("A", "17", ["17m", "15m", "20m"])], "qth string, current_band string, bands array<string>")
    assert [x[0] for x in found(options=options)] == ["15m", "20m"]


def test_agenda_text(spark):
    rows = [("a", "20m", "EU", "ongoing", 1, 4), ("a", "40m", "NA", "ongoing", 2, 4), ("a", "15m", "AS", "upcoming", 3, 11), ("a", "10m", "AF", "upcoming", 4, 30), ("b", "10m", "AF", "upcoming", 1, 30)]
    agenda = spark.createDataFrame(rows, "area string, band string, region string, status string, nth int, start int")
    areas = spark.createDataFrame([("a",), ("b",), ("c",)], "area string")
    assert {r.area: r.text for r in almanac.agenda_text(agenda, areas).collect()} == {"a": "Now usually: 20m EU, 40m NA. Next: 15m AS ~05:30", "b": "Next: 10m AF ~15:00", "c": "Nothing usually open in the next 12 h"}


def test_months_of_the_season_and_their_choice(spark):
    season = [("JO32", "20m", "EU", 202401, "pskr", d, 10, 3 if d <= 12 else 1) for d in range(1, 14)]
    season = spark.createDataFrame(season, "grid4 string, band string, region string, year_month int, layer string, dom int, slot int, count int")
    first = 19723  # 1 January 2024
    ingest = spark.createDataFrame([(first + d, s, "pskr", 0 if (d, s) == (4, 10) else 100) for d in range(31) for s in (9, 10)], "day int, slot int, layer string, spot_total long")
    squares = spark.createDataFrame([("a", "JO32")], "area string, grid4 string")
    by = {r.slot: (r.n, r.m, r.days) for r in almanac.season_months(season, ingest, squares).collect()}
    # The fifth has no ingest in slot 10; two spots make an opening; a spot keeps the slot before it active.
    assert len(by) == 48 and by[10] == (11, 12, 13) and by[9] == (0, 13, 13) and by[11] == (0, 0, 13)
    months = [("a", "20m", "EU", layer, ym, 10, 5, 12, days) for layer, ym, days in (("pskr", 202301, 20), ("pskr", 202401, 20), ("wspr", 202401, 20), ("wspr", 202402, 20), ("pskr", 202402, 1), ("pskr", 201801, 20))]
    months = spark.createDataFrame(months, "area string, band string, region string, layer string, year_month int, slot int, n long, m long, days long")
    assert {(r.layer, r.year_month) for r in almanac.season_pick(months, 202402).collect()} == {("pskr", 202401), ("wspr", 202402)}


def test_acceptance_verdicts(spark):
    lanes = [("a", "20m", "EU", s, 8, 10, -1, 10) for s in range(48)] + [("a", "20m", "NA", s, 8 if s < 4 else 0, 10 if s < 20 else 0, -1, 10) for s in range(48)]
    lanes = spark.createDataFrame(lanes, "area string, band string, region string, slot int, n long, m long, share long, m_min int")
    tests = [("all day", ["EU"], None, None, 0.5, None, "median", "all"), ("early", ["NA"], 0, 2, 0.5, None, "median", "all"), ("few known", ["NA"], 8, 20, 0.5, None, "median", "all"), ("too much", ["EU"], None, None, None, 0.5, "max", "all"), ("any", ["NA", "EU"], 8, 20, 0.5, None, "median", "any"), ("all", ["NA", "EU"], 8, 20, 0.5, None, "median", "all")]
    tests = spark.createDataFrame([(i, "a", ["20m"], *x) for i, *x in tests], "id string, area string, bands array<string>, regions array<string>, from_hour int, to_hour int, low double, high double, stat string, combine string")
    assert {r.id: r.verdict for r in almanac.acceptance(lanes, tests).collect()} == {"all day": "PASS", "early": "PASS", "few known": "INCONCLUSIVE", "too much": "FAIL", "any": "PASS", "all": "PASS"}


def test_locations_with_windows_of_their_own(spark):
    now = 200_000
    rows = [(now - 100 * k, ("JO32", "FN45", "PM95")[k % 3], ("FN45", "JO32", "QF22")[k % 3], f"S{k % 7}", f"R{k % 5}", ("20m", "40m")[k % 2], k % 30 - 15, *(("mqtt", "FT8", 0), ("wspr", "WSPR", 37), ("rbn", "CW", 0))[k % 3]) for k in range(60)]
    p, profiles = prepared(spot_rows(spark, rows)), nowcast.source_profiles(spark)
    asked = [("JO32", False, 15, -15, now), ("FN45", False, 60, -15, now), ("PM95", False, 30, -15, now - 1200)]
    cells = lambda q: {tuple(r) for r in nowcast.source_cells(p, spark.createDataFrame(q, QTHS), profiles).drop("unknown_power").collect()}
    assert cells(asked) == set().union(*(cells([q]) for q in asked)) != set()


def test_no_surges_in_widened_areas(spark):
    cells = spark.createDataFrame([(q, "pskr", "20m", "EU", 100) for q in "ab"], "qth string, source string, band string, region string, spots long")
    stats = spark.createDataFrame([("pskr", "20m", "EU", 5, 10.0, 2.0, 20)], "source string, band string, region string, slot int, mean double, sd double, sample_days int")
    areas = spark.createDataFrame([("a", True), ("b", False)], "qth string, widened boolean")
    assert {r.qth: r.atypical for r in nowcast.with_atypical(cells, stats, 5, 30, areas=areas).collect()} == {"a": False, "b": True}


def test_headline_of_a_silent_location(spark):
    cells = spark.createDataFrame([("a", "20m", "KH6", 5, True, False, True, None, None), ("a", "40m", "EU", 9, True, False, False, None, None)], "qth string, band string, region string, spots long, ssb_open boolean, cw_open boolean, rising boolean, z double, confidence double")
    qths = spark.createDataFrame([("a",), ("b",)], "qth string")
    assert {r.qth: (r.kind, r.text) for r in nowcast.headline(cells, qths).collect()} == {"a": ("rising", "20m rising toward Hawaii"), "b": ("quiet", "0 bands active, none rising")}
    top = nowcast.top_bands(cells.unionByName(cells.where("band = '20m'").withColumn("region", F.lit("EU")).withColumn("spots", F.lit(7)))).orderBy("rank").collect()
    assert [(r.band, r.regions, r.spots, r.rising) for r in top] == [("20m", ["EU", "KH6"], 12, True), ("40m", ["EU"], 9, False)]


def test_final_days_wait_for_flush_and_pending_counts(spark):
    daily = spark.createDataFrame([(100,)], "day int")
    assert jobs.final_days(daily, 104, 110) == (105, 108) and jobs.final_days(daily, None, 110) == (100, 108) and jobs.final_days(daily, 108, 110) is None
    flushed = 107 * 86400 + 3600  # an hour after the end of day 106
    assert jobs.final_days(daily, 104, 110, flushed_at=flushed + 1) == (105, 106) and jobs.final_days(daily, 104, 110, flushed_at=flushed) == (105, 105)
    assert jobs.final_days(daily, 104, 110, pending_day=106) == (105, 105) and jobs.final_days(daily, 104, 110, pending_day=105) is None


def test_a_day_without_rows_loses_its_cells(spark, tmp_path):
    rows = [(86400 * d + 3600, "JO32", "FN45", "S", "R", "20m", 0) for d in (100, 101, 102)]
    daily = baselines.region_daily(prepared(spot_rows(spark, rows)))
    store = Store(spark, f"file://{tmp_path}/store")
    jobs.fold_run(store, daily, 104)
    assert store.read("season").count() == 6
    jobs.refold_days(store, daily.where("day <> 101"), 100, 102)
    again = store.read("season")
    assert again.count() == 4 and again.select("dom").distinct().count() == 2
    days = jobs.fold_run(store, daily, 103, forced_to=105, recorded_at=7)
    assert days == [103, 104, 105] and store.manifest()["marks"]["watermark"] == 105
    assert sorted((r.day_index, r.recorded_at) for r in store.read("lost").collect()) == [(103, 7), (104, 7), (105, 7)]


def test_part_days_add_and_months_are_refolded(spark):
    cell = lambda n, ym=202401: ("JO32", "20m", "EU", ym, "wspr", 5, 10, n, [n, 0, 0, 0, 0, 0])
    schema = "grid4 string, band string, region string, year_month int, layer string, dom int, slot int, count int, snr_bins array<int>"
    season, part = spark.createDataFrame([cell(200), cell(3, 202402)], schema), spark.createDataFrame([cell(100)], schema)
    added = {r.year_month: (r["count"], r.snr_bins[0]) for r in jobs.add_part_day(season, part).collect()}
    assert added == {202401: (255, 255), 202402: (3, 3)}
    assert {r.year_month: r["count"] for r in jobs.refold_month(season, part, 202401, "wspr").collect()} == {202401: 100, 202402: 3}


def test_coverage_of_spans(spark):
    rows = spark.createDataFrame([(0, 500, 1000), (0, 0, 1000), (900, 100, 1000), (1000, 5, 1000)], "g long, c long, now long")
    assert [r.x for r in rows.select(baselines.coverage_of_spans(F.col("g"), F.col("c"), F.col("now")).alias("x")).collect()] == [0.5, 1.0, 1.0, 1.0]


def test_compaction_that_broke_off_loses_and_doubles_nothing(spark, tmp_path):
    key = "band string, slot int, distance_tier int, snr_tier int, count long, batch int"
    for batch in range(4):
        spark.createDataFrame([("20m", 1, 0, 0, 10**batch, batch)], key).write.mode("append").partitionBy("batch").parquet(f"{tmp_path}/global_baseline")
    total = lambda: maintain.read_table(spark, str(tmp_path), "global_baseline").first()["count"]
    shutil.copytree(f"{tmp_path}/global_baseline/batch=1", f"{tmp_path}/saved")
    maintain.compact(spark, str(tmp_path), "global_baseline", 1)
    assert total() == 1111
    shutil.copytree(f"{tmp_path}/saved", f"{tmp_path}/global_baseline/batch=1")  # as if it had not been deleted
    assert total() == 1111
    maintain.compact(spark, str(tmp_path), "global_baseline", 2)
    assert total() == 1111


def test_band_features_in_one_aggregation(spark):
    far = lambda k: (k * 37) % 5000
    rows = [("A", "20m" if k % 3 else "40m", k, f"S{k % 7}", f"R{k % 11}", f"JO{k % 10}{k % 4}aa", f"JO{k % 10}{k % 4}" if k % 5 else "", float(far(k)), k % 40 - 25) for k in range(500)] + [("B", "20m", 1, "S", "R", "x", "", 10.0, 3)]
    scored = spark.createDataFrame(rows, "qth string, band string, spot_id long, sc string, rc string, remote string, remote4 string, km double, snr int")
    out = conditions.band_features(scored)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ObjectHashAggregate" in plan and plan.count("Exchange hashpartitioning") == 2
    for r in out.collect():
        of = [x for x in rows if x[:2] == (r.qth, r.band)]
        km, snr = sorted(x[7] for x in of), sorted(x[8] for x in of)
        at = lambda x, p: x[math.ceil(p * len(x)) - 1]
        assert (r.links, r.unique_links, r.unique_tx, r.unique_rx, r.unique_grids) == (len(of), len({x[3:6] for x in of}), len({x[3] for x in of}), len({x[4] for x in of}), len({x[6] for x in of} - {""}))
        assert (r.median_km, r.p90_km, r.max_km, r.median_snr, r.p90_snr, r.peak_snr) == (at(km, 0.5), at(km, 0.9), km[-1], at(snr, 0.5), at(snr, 0.9), snr[-1])
        assert r.long_haul == sum(x >= 3000 for x in km) and r.ssb_count == sum(x >= 0 for x in snr) and r.cw_count == sum(x >= -12 for x in snr)
