"""Scalar functions on hand-computed values."""

import pytest

from bandloom.functions import bands, classify, geo, grid, numbers, times


def value(spark, text, **columns):
    frame = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return frame.selectExpr(f"{text} as x").first()["x"]


@pytest.mark.parametrize("x, digits, expected", [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.125, 2, 0.13), (-0.004, 2, 0.0)])
def test_rounding_is_half_away_on_the_binary_value(spark, x, digits, expected):
    assert value(spark, numbers.round_half_away("v", digits), v=x) == expected


@pytest.mark.parametrize("k, rate, expected", [(0, 3.0, 1.0), (1, 1.0, 0.63212056), (3, 1.0, 0.0803014), (10, 2.0, 4.64981e-05), (2, 0.0, 0.0)])
def test_poisson_tail(spark, k, rate, expected):
    assert value(spark, numbers.poisson_upper_tail("k", "r"), k=k, r=rate) == pytest.approx(expected, rel=1e-5)


def test_shares(spark):
    assert [value(spark, numbers.share_code("a", "b"), a=a, b=b) for a, b in ((1, 3), (2, 3), (1, 2000), (0, 5), (3, 0))] == [333, 667, 1, 0, -1]


@pytest.mark.parametrize("x, x_y, anchor, lat, lon, region", [("JO62", (96, 142), "JN68", 52.5, 13.0, "EU"), ("JO73", (97, 143), "JN68", 53.5, 15.0, "EU"), ("FN31", (53, 131), None, 41.5, -73.0, "NA"), ("PM95", None, None, 35.5, 139.0, "JA"), ("BL11", None, None, 21.5, -157.0, "KH6"), ("RR99", (179, 179), "RR44", 89.5, 179.0, "??"), ("QF22", None, None, -37.5, 145.0, "VK"), ("AA00", (0, 0), "AA00", -89.5, -179.0, "AN")])
def test_grid(spark, x, x_y, anchor, lat, lon, region):
    assert value(spark, grid.is_locator("s"), s=x) and not value(spark, grid.is_locator("s"), s=x.lower()) and value(spark, grid.is_locator_fold("s"), s=x.lower())
    if x_y:
        assert (value(spark, grid.square_x("s"), s=x), value(spark, grid.square_y("s"), s=x)) == x_y
        assert value(spark, grid.square_at("a", "b"), a=x_y[0], b=x_y[1]) == x
    if anchor:
        assert value(spark, grid.cluster_anchor("s"), s=x) == anchor
    assert (value(spark, grid.latitude("s"), s=x), value(spark, grid.longitude("s"), s=x)) == (lat, lon)
    assert value(spark, grid.locator_at("a", "o"), a=lat, o=lon) == x
    assert value(spark, geo.region_of_locator("s"), s=x) == region


def test_locators(spark):
    cases = {"jo62qm77": "JO62QM", " JO62 ": "JO62", "JO62Z": "JO62", "JO6": "", "ZZ00": "", "JO62zz": "JO62"}
    assert {x: value(spark, grid.normalize_locator("s"), s=x) for x in cases} == cases
    assert value(spark, grid.latitude("s"), s="JO62QM") == pytest.approx(52 + 12.5 * 2.5 / 60) and value(spark, grid.longitude("s"), s="JO") == 10
    assert value(spark, grid.locator_at("a", "o"), a=95.0, o=200.0) == "RR99"


def test_bands(spark):
    assert [value(spark, bands.normalize_band("b"), b=b) for b in (" 20M ", "40", "", "70cm")] == ["20m", "40m", "", "70cm"]
    assert [value(spark, bands.band_from_khz("f"), f=f) for f in (14074.0, 14350.0, 1800.0, 432000.0)] == ["20m", "", "160m", "70cm"]
    assert [value(spark, bands.band_from_wspr_code("c"), c=c) for c in (1, 14, 144, 2)] == ["160m", "20m", "2m", ""]
    assert [value(spark, bands.band_index("b"), b=b) for b in ("160m", "2m", "70cm")] == [0, 12, -1]
    assert value(spark, bands.effective_snr("s", "p"), s=5, p=43) == 12 and value(spark, bands.effective_snr("s", "p"), s=5, p=0) == 5


def test_distance_and_direction(spark):
    km = value(spark, geo.haversine_km("a", "b", "c", "d"), a=0.0, b=1.0, c=0.0, d=91.0)
    assert km == pytest.approx(10007.543, abs=0.01) and value(spark, geo.haversine_km("a", "b", "c", "d"), a=0.0, b=0.0, c=41.5, d=-73.0) == 0
    assert [value(spark, geo.direction8("d"), d=d) for d in (0.0, 22.4, 22.5, 180.0, 337.5, 359.0)] == ["N", "N", "NE", "S", "N", "N"]
    assert value(spark, geo.bearing_deg("a", "b", "c", "d"), a=0.0, b=0.0, c=0.0, d=-10.0) == pytest.approx(270)


def test_sun(spark):
    t = 1718884800  # noon UTC on 20 June 2024
    assert value(spark, geo.subsolar_latitude("t"), t=t) == pytest.approx(23.43, abs=0.05)
    assert value(spark, geo.subsolar_longitude("t"), t=t) == pytest.approx(0.45, abs=0.3)
    assert [value(spark, geo.daylight("z"), z=z) for z in (80.0, 90.0, 100.0)] == ["day", "twilight", "night"]


def test_tiers_and_times(spark):
    assert [value(spark, classify.snr_tier("d"), d=d) for d in (-16, -15, -9, -8, -2, -1)] == [0, 1, 1, 2, 2, 3]
    assert [value(spark, classify.distance_tier("d"), d=float(d)) for d in (499, 500, 1500, 3000, 7000)] == [0, 1, 2, 3, 4]
    assert [value(spark, classify.almanac_tier_for("d"), d=d) for d in (-30, -18, -17, -8, -7, 3)] == [-20, -20, -15, -10, -5, 0]
    assert value(spark, times.slot_of_day("t"), t=-1) == 47 and value(spark, times.day_index("t"), t=-1) == -1
    assert value(spark, times.year_month("d"), d=19723) == 202401 and value(spark, times.day_of_month("d"), d=19753) == 31


def test_words(spark):
    assert [value(spark, classify.classify_qth("q"), q=q) for q in ("jo32", "JO32AB", "JO32A", "SZ00", "DL1ABC", "EA8/DL1ABC", "ABC", "a b")] == ["locator", "locator", "bad_locator", "bad_locator", "callsign", "callsign", "bad", "bad"]
    assert [value(spark, classify.base_call("c"), c=c) for c in ("DL1ABC/P", "W3LPL-#", "VE6WZ-4", "EA8/DL1ABC")] == ["DL1ABC", "W3LPL", "VE6WZ", "EA8/DL1ABC"]
    assert [value(spark, classify.activity_level("o", "x"), o=o, x=x) for o, x in ((60, 15.0), (10, 44.0), (3, 11.0), (30, 30.0), (5, 0.0))] == ["above", "below", "low_sample", "normal", "no_baseline"]
    assert value(spark, classify.flavor("d", "m", "s", "t", "f"), d=10, m=20.0, s=5.0, t=0, f=0.5) == "atypical-wspr-silent-ft8"


def values(spark, text, *columns):
    rows = [(k, *c.values()) for k, c in enumerate(columns)]
    found = spark.createDataFrame(rows, ["nth", *columns[0]]).selectExpr("nth", f"{text} as x").collect()
    return [r.x for r in sorted(found)]


def test_centres_and_corners_of_locators(spark):
    # Centres by hand: a field is 20 by 10 degrees, a square 2 by 1, a subsquare 5 by 2.5 minutes.
    places = {"JJ00": (0.5, 1.0), "IO91WM": (51.520833, -0.125), "FN20": (40.5, -75.0), "RE78": (-41.5, 175.0), "AA00AA": (-89.979167, -179.958333), "RR99XX": (89.979167, 179.958333)}
    for x, (lat, lon) in places.items():
        assert value(spark, grid.latitude("s"), s=x) == pytest.approx(lat, abs=1e-6) and value(spark, grid.longitude("s"), s=x) == pytest.approx(lon, abs=1e-6)
    corners = {(0.0, 0.0): "JJ00", (-0.001, -0.001): "II99", (51.999, 1.999): "JO01", (52.0, 2.0): "JO12", (90.0, 180.0): "RR99", (-90.0, -180.0): "AA00"}
    for (lat, lon), x in corners.items():
        assert value(spark, grid.locator_at("a", "o"), a=lat, o=lon) == x and value(spark, grid.locator_at("a", "o", 2), a=lat, o=lon) == x[:2]


def test_regions_of_well_known_places(spark):
    places = [(51.5, -0.1, "EU"), (64.1, -21.9, "??"), (40.7, -74.0, "NA"), (18.5, -66.1, "CAR"), (21.3, -157.9, "KH6"), (-23.5, -46.6, "SA"), (-33.9, 18.4, "AF"), (35.7, 139.7, "JA"), (39.9, 116.4, "AS"), (-33.9, 151.2, "VK"), (-36.8, 174.8, "VK"), (-17.7, -149.4, "OC"), (-75.0, 0.0, "AN")]
    assert values(spark, geo.region_of("a", "o"), *[{"a": a, "o": o} for a, o, _ in places]) == [r for *_, r in places]


def test_distances_of_cities(spark):
    # London to New York, Sydney to Auckland, and a quarter of a meridian, by other tables.
    for (a, b, c, d), km in {(51.5074, -0.1278, 40.7128, -74.0060): 5570, (-33.8688, 151.2093, -36.8485, 174.7633): 2156, (1.0, 10.0, 91.0, 10.0): 10007.5}.items():
        assert value(spark, geo.haversine_km("a", "b", "c", "d"), a=a, b=b, c=c, d=d) == pytest.approx(km, abs=2)
    assert value(spark, geo.bearing_deg("a", "b", "c", "d"), a=51.5074, b=-0.1278, c=40.7128, d=-74.0060) == pytest.approx(288.3, abs=0.2)
    # At the equinox the sun stands over the equator; at noon of a place on it, it stands overhead, twelve hours later below.
    t = 1710903960  # 03:06 UTC on 20 March 2024
    assert value(spark, geo.subsolar_latitude("t"), t=t) == pytest.approx(0, abs=0.02)
    noon = value(spark, geo.subsolar_longitude("t"), t=t)
    assert value(spark, geo.solar_zenith("a", "o", "t"), a=0.0, o=noon, t=t) == pytest.approx(0, abs=0.1) and value(spark, geo.solar_zenith("a", "o", "t"), a=0.0, o=noon - 180, t=t) == pytest.approx(180, abs=0.1)


def test_feeds_sides_and_gates(spark):
    kinds = [{"s": x} for x in (" RBN ", "wspr", "mqtt", "")]
    assert values(spark, bands.source_type("s"), *kinds) == ["rbn", "wspr", "mqtt", "mqtt"]
    assert values(spark, bands.receiver_is_sender_side("s"), *kinds) == [True, True, False, False]
    assert values(spark, bands.reporter_locator("s", "'jo32 '", "'fn31'"), *kinds) == ["JO32", "JO32", "FN31", "FN31"]
    modes = [{"m": m, "s": s} for m, s in (("ft8", "mqtt"), (" FT4 ", ""), ("", "mqtt"), ("CW", "mqtt"), ("FT8", "rbn"), ("WSPR", "wspr"))]
    assert values(spark, bands.is_conditions_spot("m", "s"), *modes) == [True, True, True, False, False, False]
    ends = [{"s": s, "a": a, "b": b} for s, a, b in (("rbn", "JO32", ""), ("rbn", "JO32", "FN31"), ("wspr", "", "FN31"), ("wspr", "JO32", " "), ("mqtt", "", ""))]
    assert values(spark, bands.usable_live("s", "a", "b"), *ends) == [False, True, True, False, True]
    gates = [{"x": x, "a": a, "b": b} for x, a, b in (("20m", "JO32", "FN31"), (" ", "JO32", "FN31"), ("20m", "", "FN31"), ("20m", "JO32", " "))]
    assert values(spark, bands.baseline_gate("x", "a", "b"), *gates) == [True, False, False, False]
    assert values(spark, bands.band_in_scope("x"), {"x": "160m"}, {"x": "2m"}, {"x": "70cm"}, {"x": ""}) == [True, True, False, False]


def test_bounds_of_tiers_and_statuses(spark):
    whole = lambda f, *rows: values(spark, f(*"abcde"[: len(rows[0])]), *[dict(zip("abcde", r, strict=False)) for r in rows])
    assert whole(classify.snr_tier_max_db, (0,), (1,), (2,)) == [-16, -9, -2]
    assert whole(classify.tier_low_km, *[(k,) for k in range(5)]) == [0, 500, 1500, 3000, 7000] and whole(classify.tier_high_km, *[(k,) for k in range(5)]) == [500, 1500, 3000, 7000, 12000]
    assert whole(classify.band_status, (60.0, 20.0, 50.0, 5), (50.0, 20.0, 50.0, 5), (20.0, 20.0, 50.0, 5), (19.9, 20.0, 50.0, 5), (60.0, 20.0, 50.0, 1)) == ["green", "yellow", "yellow", "red", "grey"]
    assert whole(classify.overall_status, (65.0, 15.0, 1), (64.9, 15.0, 1), (34.9, 90.0, 3), (90.0, 14.9, 3), (90.0, 90.0, 0)) == ["green", "yellow", "red", "grey", "grey"]
    assert whole(classify.condition_label, ("green", 78.0), ("green", 77.9), ("yellow", 99.0), ("red", 10.0), ("grey", 90.0)) == ["Excellent", "Good", "Fair", "Poor", "Poor"]
    assert whole(classify.spot_mode, (55, 90, 100), (54, 55, 100), (54, 54, 100), (0, 0, 2), (0, 0, 0)) == ["ssb", "cw", "digital", "none", "none"]
    advice = [("green", "ssb", 0.4, 1.0, 50.0), ("green", "cw", 0.4, 1.0, 50.0), ("green", "digital", 0.5, 1.0, 50.0), ("green", "ssb", 0.3, 0.9, 50.0), ("yellow", "ssb", 0.9, 0.8, 50.0), ("red", "ssb", 0.9, 2.0, 50.0), ("grey", "ssb", 0.9, 2.0, 50.0), ("green", "ssb", 0.9, 2.0, 19.9)]
    assert whole(classify.recommendation, *advice) == ["Try DX on SSB", "Try DX on CW", "Try DX", "Band usable now", "Monitor for openings", "Avoid for now", "Insufficient data", "Insufficient data"]
    assert whole(classify.activity_level, (150, 100.0), (149, 100.0), (67, 100.0), (68, 100.0), (19, 19.0), (20, 1.0)) == ["above", "normal", "below", "normal", "low_sample", "above"]
    assert whole(classify.reach_level, (1.3,), (1.29,), (0.77,), (0.76,)) == ["longer", "typical", "typical", "shorter"]
    assert whole(classify.trend_word, (0.21,), (0.2,), (-0.2,), (-0.21,)) == ["rising", "stable", "stable", "falling"]
    assert whole(classify.surge_strength, (4.0, 0.0), (3.9, 0.5), (3.9, 0.49)) == ["strong", "strong", "normal"]
    assert [float(x) for x in whole(classify.atypical_confidence, (0,), (15,), (30,), (60,))] == pytest.approx([0.3, 0.65, 1.0, 1.0])
    assert whole(classify.saturating, (-1,), (255,), (256,)) == [0, 255, 255]
    assert whole(times.age_seconds, (10, 4), (4, 10)) == [6, 0] and whole(times.dedup_bucket, (29,), (30,), (-1,)) == [0, 1, -1]
    assert [classify.is_target_locator(x) for x in ("JO62", "JO62QM", "JO62QM77", "JO62QM77AX", "JO", "JO6", "SO62", "JO62YM")] == [True, True, True, True, False, False, False, False]


def test_bins_of_cumulative_counts(spark):
    steps = {"n": 300, "a": 20, "b": 15, "c": 15, "d": 4, "e": 1}
    assert [value(spark, x, **steps) for x in classify.snr_bins("n", list("abcde"))] == [255, 5, 0, 11, 3, 1]
