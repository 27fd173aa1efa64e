"""Rules of the live part on hand-made rows: windows, targets, streamed locators, a stalled feed, lines of the skimmer feed."""

import pytest

from bandloom.functions import classify
from bandloom.operators import conditions
from bandloom.plans.queries import QUERIES, Inputs
from bandloom.plans.spots import prepared
from bandloom.sources import archive, feeds
from bandloom.streaming import live
from tests.test_pipelines import spot_rows


def test_live_area_looks_back_twenty_minutes(spark):
    now = 100_000
    rows = []
    for band, age in (("20m", 60), ("40m", 60), ("15m", 19 * 60), ("10m", 21 * 60)):
        rows += [(now - age, "FN76", "JO32", f"S{k}", "R", band, 0) for k in range(30)]
    rows += [(now - 60, "FN77", "JO32", f"S{k}", "R", "10m", 0) for k in range(30)]
    q = spark.createDataFrame([("FN76", False, 60, -15, now)], "qth string, surroundings boolean, minutes int, cw_min_db int, now long")
    p = prepared(spot_rows(spark, rows))
    assert conditions.live_area(p, q).first()["radius"] == 0
    # Without the band of 19 minutes ago two are left in the square, and that of 21 minutes ago is no third.
    assert conditions.live_area(p.where("band <> '15m'"), q).first()["radius"] == 1


@pytest.mark.parametrize("target, expected", [("JO31", True), ("JO31LK", True), ("JO31LK22", True), ("JO31LK22AB", True), ("SZ00", False), ("AB12!!", False), ("JO31L", False), ("JO", False), ("DL1ABC", False), ("JO31LZ", False), ("JO31LK22AB00", False)])
def test_target_locators(target, expected):
    assert classify.is_target_locator(target) == expected


def test_targets_by_locator_or_call(spark):
    rows = archive.raw_rows(spot_rows(spark, [(1, "JO31LK22", "FN31", "A", "B", "20m", 0), (2, "FN20", "FN31", "SZ00", "B", "20m", 0), (3, "SZ00", "FN31", "A", "C", "20m", 0), (4, "JO31AA", "FN31", "A", "D", "20m", 0)]))
    found = lambda *x: sorted(r.spot_id for r in archive.for_targets(rows, list(x)).collect())
    assert found("jo31lk22") == [0] and found("SZ00") == [1] and found("JO31") == [0, 3] and found("JO31AA", "B") == [0, 1, 3]


def test_streamed_locators_move_between_subsquares(spark, tmp_path):
    def run(name, *batches):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, "call string, locator string, t long").coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
        stream = spark.readStream.schema("call string, locator string, t long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
        query = live.latest_locators(stream).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        last = {}
        for r in spark.table(name).collect():
            last[r.call] = max(last.get(r.call, (-1, "")), (r.seen, r["loc"]))
        return {k: (v[1], v[0]) for k, v in last.items()}

    rows = [("DL1ABC", "JO31LK", 1000), ("DL1ABC", "JO31AA", 1010), ("K1XY", "FN31PR", 1000), ("K1XY", "FN31", 1020), ("G4ZZ", "IO91AB", 1030), ("G4ZZ", "IO91CD", 1001), ("F5QQ", "JN18", 1000), ("F5QQ", "JN18DU", 1000)]
    assert run("subsquares", rows) == {"DL1ABC": ("JO31AA", 1010), "K1XY": ("FN31PR", 1020), "G4ZZ": ("IO91AB", 1030), "F5QQ": ("JN18DU", 1000)}


def test_stalled_feed_remembers_two_minutes(spark):
    # Fifty arrivals in minutes 10 and 11, few in 12 and 13: these stand where the full ones stood.
    full = [(60 * m + k - 200, 60 * m + k) for m in (10, 11) for k in range(60)]
    few = [(60 * m - 5, 60 * m) for m in (12, 13)]
    lag = lambda rows, now: live.feed_lag(live.lag_minutes(spark.createDataFrame(rows, "t long, arrival long")), spark.createDataFrame([(now,)], "now long")).first()
    assert lag(full, 900)["lag"] == 900 - (60 * 11 + 59 - 195) and not lag(full, 900)["fresh"]
    assert lag(full + few[:1], 900)["lag"] == 900 - (60 * 11 + 59 - 195)
    assert lag(full + few, 900)["lag"] == 0


def test_skimmer_lines(spark):
    lines = ["dx de ab1cd-#: 7012.5 xy2z CW 9dB 20 WPM", "DX de AB1CD : 3573 XY2Z/P FT8 12 DB", "DX de AB1CD:14070.15 XY2Z PSK31 7 dB", "DX de AB1CD: 14070 XY2Z PSKX 7 dB", "DX de A_1: 14000 XY2Z CW 7 dB", "DX de AB1CD: 0 XY2Z CW 7 dB", "DX de AB1CD: 14000 XY2Z CW -7 dB", "hello", None]
    found = feeds.read_rbn(spark.createDataFrame([(x, 5) for x in lines], "line string, observed_at long")).collect()
    assert sorted((r.sc, r.rc, r.freq_khz, r.mode, r.snr) for r in found) == [("AB1CD", "XY2Z", 14070.15, "PSK31", 7), ("AB1CD", "XY2Z/P", 3573.0, "FT8", 12), ("AB1CD-#", "XY2Z", 7012.5, "CW", 9)]


def test_lines_of_few_words_that_are_made_of_spots(spark, data_dir):
    # The words of such a line are tested before they are counted.
    found = QUERIES["read_rbn"](spark, data_dir)
    want = Inputs(spark, data_dir).raw.where("source = 'rbn' and spot_id % 11 <> 0").selectExpr("t", "concat(sc, '-#') as sc", "rc", "band", "abs(snr) as snr", "'CW' as mode")
    assert found.count() > 0 and found.exceptAll(want).count() == want.exceptAll(found).count() == 0
