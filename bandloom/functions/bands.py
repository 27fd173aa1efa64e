"""Bands, modes and sources."""

from __future__ import annotations

# The 13 bands in scope, in order.
BANDS = ("160m", "80m", "60m", "40m", "30m", "20m", "17m", "15m", "12m", "10m", "6m", "4m", "2m")

# The 10 bands of the almanac.
ALMANAC_BANDS = BANDS[:10]

# Band edges in kHz, the upper one excluded.
BAND_EDGES_KHZ = (
    ("160m", 1800, 2000),
    ("80m", 3500, 4000),
    ("60m", 5250, 5450),
    ("40m", 7000, 7300),
    ("30m", 10100, 10150),
    ("20m", 14000, 14350),
    ("17m", 18068, 18168),
    ("15m", 21000, 21450),
    ("12m", 24890, 24990),
    ("10m", 28000, 29700),
    ("6m", 50000, 54000),
    ("4m", 70000, 71000),
    ("2m", 144000, 148000),
    ("70cm", 430000, 440000),
)

# The band codes of the beacon feed.
WSPR_CODES = {1: "160m", 3: "80m", 5: "60m", 7: "40m", 10: "30m", 14: "20m", 18: "17m", 21: "15m", 24: "12m", 28: "10m", 50: "6m", 70: "4m", 144: "2m"}


def listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def normalize_band(x: str) -> str:
    """Trimmed, in small letters, with m at the end; '' stays."""
    b = f"lower(trim({x}))"
    return f"(case when {b} = '' or {b} like '%m' then {b} else concat({b}, 'm') end)"


def band_in_scope(b: str) -> str:
    return f"coalesce({b} in ({listed(BANDS)}), false)"


def band_index(b: str) -> str:
    """Place of a band among the 13, from 0; -1 for others and null."""
    return "(case " + " ".join(f"when {b} = '{x}' then {k}" for k, x in enumerate(BANDS)) + " else -1 end)"


def band_from_khz(f: str) -> str:
    """The band of a frequency, '' outside all."""
    return "(case " + " ".join(f"when {f} >= {low} and {f} < {high} then '{b}'" for b, low, high in BAND_EDGES_KHZ) + " else '' end)"


def band_from_wspr_code(c: str) -> str:
    return "(case " + " ".join(f"when {c} = {k} then '{b}'" for k, b in WSPR_CODES.items()) + " else '' end)"


def source_type(source: str) -> str:
    """The feed of a spot in small letters; rows without one are of the first feed."""
    return f"coalesce(nullif(lower(trim({source})), ''), 'mqtt')"


def receiver_is_sender_side(source: str) -> str:
    """The beacon and skimmer feeds put the reporting station on the sender's side."""
    return f"{source_type(source)} in ('rbn', 'wspr')"


def reporter_locator(source: str, sl: str, rl: str) -> str:
    return f"upper(trim(case when {receiver_is_sender_side(source)} then {sl} else {rl} end))"


def is_conditions_spot(mode: str, source: str) -> str:
    """Digital spots of the first feed, on whose SNR scale the conditions are calibrated."""
    return f"(upper(trim(coalesce({mode}, ''))) in ('', 'FT8', 'FT4') and not {receiver_is_sender_side(source)})"


def usable_live(source: str, sl: str, rl: str) -> str:
    """Whether a spot can be placed: skimmer spots need both locators, beacon spots that of the station heard."""
    has = lambda x: f"coalesce(trim({x}), '') <> ''"
    return f"(case {source_type(source)} when 'rbn' then {has(sl)} and {has(rl)} when 'wspr' then {has(rl)} else true end)"


def baseline_gate(band: str, sl: str, rl: str) -> str:
    """A spot enters baselines with a band and two locators."""
    return f"(coalesce(trim({band}), '') <> '' and coalesce(trim({sl}), '') <> '' and coalesce(trim({rl}), '') <> '')"


def effective_snr(snr: str, power_dbm: str) -> str:
    """SNR as if 100 W had been sent; unchanged where the power is unknown."""
    return f"(case when {power_dbm} > 0 then {snr} + 50 - {power_dbm} else {snr} end)"
