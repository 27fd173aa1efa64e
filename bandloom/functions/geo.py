"""Regions, distances, directions and the sun."""

from __future__ import annotations

from .grid import is_locator_fold, latitude, longitude
from .numbers import quotient

# Regions in order of display.
REGIONS = ("EU", "NA", "SA", "AF", "AS", "JA", "OC", "VK", "KH6", "CAR", "AN")

# The regions' names.
REGION_NAMES = {
    "EU": "Europe", "NA": "North America", "SA": "South America", "AF": "Africa", "AS": "Asia", "OC": "Oceania", "AN": "Antarctica", "JA": "Japan", "VK": "Australia", "KH6": "Hawaii", "CAR": "Caribbean",
}

# The boxes of the regions; they overlap, and the first that holds a point names its region.
REGION_BOXES = (
    ("AN", "{lat} <= -60"),
    ("JA", "{lat} >= 30 and {lat} <= 46 and {lon} >= 128 and {lon} <= 146"),
    ("KH6", "{lat} >= 18 and {lat} <= 29 and {lon} >= -161 and {lon} <= -154"),
    ("CAR", "{lat} >= 10 and {lat} <= 25 and {lon} >= -85 and {lon} <= -60"),
    ("VK", "{lat} >= -50 and {lat} <= -10 and {lon} >= 110 and {lon} <= 180"),
    ("EU", "{lat} >= 35 and {lat} <= 72 and {lon} >= -15 and {lon} <= 45"),
    ("AF", "{lat} >= -40 and {lat} <= 37 and {lon} >= -20 and {lon} <= 55"),
    ("NA", "{lat} >= 15 and {lat} <= 84 and {lon} >= -170 and {lon} <= -50"),
    ("SA", "{lat} >= -60 and {lat} < 15 and {lon} >= -90 and {lon} <= -30"),
    ("AS", "{lat} >= 0 and {lat} <= 78 and {lon} >= 40 and {lon} <= 180"),
    ("OC", "{lat} >= -50 and {lat} <= 30 and ({lon} >= 130 or {lon} <= -130)"),
)

DIRECTIONS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def region_of(lat: str, lon: str) -> str:
    """The region of a point, '??' outside all boxes."""
    return "(case " + " ".join(f"when {box.format(lat=lat, lon=lon)} then '{name}'" for name, box in REGION_BOXES) + " else '??' end)"


def region_of_locator(x: str) -> str:
    """The region of a locator's centre; '??' for what is no locator and null. For a few rows: it spells out the centre in every box."""
    return f"(case when {is_locator_fold(x)} then {region_of(latitude(f'upper({x})'), longitude(f'upper({x})'))} else '??' end)"


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance on a sphere of 6371 km; 0 if a point is exactly (0, 0), which stands for unknown."""
    h = f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(case when ({lat1} = 0 and {lon1} = 0) or ({lat2} = 0 and {lon2} = 0) then cast(0 as double) else 6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - {h})) end)"


def bearing_deg(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Initial course from the first point to the second, from 0 up to 360."""
    y = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    x = f"(cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1})))"
    d = f"degrees(atan2({y}, {x}))"
    return f"(case when {d} < 0 then {d} + 360 else {d} end)"


def direction8(degrees: str) -> str:
    """One of eight directions; '' for null."""
    k = f"({quotient(f'{degrees} / 45 + 0.5', '1')} % 8)"
    return "(case " + k + " " + " ".join(f"when {i} then '{d}'" for i, d in enumerate(DIRECTIONS)) + " else '' end)"


def _sun(t: str) -> tuple[str, str, str]:
    """Days since the start of 2000, the sun's ecliptic longitude and the ecliptic's tilt, by the low-precision formulas of the astronomical almanacs."""
    n = f"((({t}) - 946728000) / cast(86400 as double))"
    g = f"radians(357.528 + 0.9856003 * {n})"
    return n, f"radians(280.460 + 0.9856474 * {n} + 1.915 * sin({g}) + 0.020 * sin(2 * {g}))", f"radians(23.439 - 0.0000004 * {n})"


def subsolar_latitude(t: str) -> str:
    """Latitude over which the sun stands at t seconds since 1970."""
    _, longitude_of_sun, tilt = _sun(t)
    return f"degrees(asin(sin({tilt}) * sin({longitude_of_sun})))"


def subsolar_longitude(t: str) -> str:
    """Longitude over which the sun stands, from -180 up to 180."""
    n, longitude_of_sun, tilt = _sun(t)
    ascension = f"degrees(atan2(cos({tilt}) * sin({longitude_of_sun}), cos({longitude_of_sun})))"
    x = f"({ascension} - 280.46061837 - 360.98564736629 * {n})"
    return f"({x} - 360 * floor(({x} + 180) / 360))"


def solar_zenith(lat: str, lon: str, t: str) -> str:
    """Degrees between the sun and the zenith."""
    d, o = subsolar_latitude(t), subsolar_longitude(t)
    c = f"(sin(radians({lat})) * sin(radians({d})) + cos(radians({lat})) * cos(radians({d})) * cos(radians({lon} - {o})))"
    return f"degrees(acos(least(greatest({c}, -1.0), 1.0)))"


def daylight(zenith: str) -> str:
    """day, twilight (within 7.5 degrees of the horizon) or night."""
    return f"(case when {zenith} <= 82.5 then 'day' when {zenith} >= 97.5 then 'night' else 'twilight' end)"
