"""Tiers, levels, statuses and texts."""

from __future__ import annotations

from .grid import is_locator
from .numbers import quotient, round_half_away

# SNR floors of the almanac in dB.
ALMANAC_FLOORS = (-20, -15, -10, -5, 0)


def snr_tier(db: str) -> str:
    return f"(case when {db} <= -16 then 0 when {db} <= -9 then 1 when {db} <= -2 then 2 else 3 end)"


def snr_tier_max_db(tier: str) -> str:
    """The strongest report of a tier; the last is open."""
    return f"(case {tier} when 0 then -16 when 1 then -9 when 2 then -2 else 2147483647 end)"


def distance_tier(km: str) -> str:
    return f"(case when {km} < 500 then 0 when {km} < 1500 then 1 when {km} < 3000 then 2 when {km} < 7000 then 3 else 4 end)"


def tier_low_km(tier: str) -> str:
    return f"(case {tier} when 0 then 0 when 1 then 500 when 2 then 1500 when 3 then 3000 else 7000 end)"


def tier_high_km(tier: str) -> str:
    """Upper bound for interpolation; the open tier ends at 12000."""
    return f"(case {tier} when 0 then 500 when 1 then 1500 when 2 then 3000 when 3 then 7000 else 12000 end)"


def almanac_tier_for(db: str) -> str:
    """The nearest floor of the almanac; of two as near the stricter, that is higher, one."""
    cuts = [(a + b) / 2 for a, b in zip(ALMANAC_FLOORS, ALMANAC_FLOORS[1:], strict=False)]
    return "(case " + " ".join(f"when {db} < {c} then {f}" for f, c in zip(ALMANAC_FLOORS, cuts, strict=False)) + f" else {ALMANAC_FLOORS[-1]} end)"


def atypical_confidence(days: str) -> str:
    """0.3 without history up to 1 after 30 days."""
    return f"least(0.3 + 0.7 * {days} / 30.0, 1.0)"


def band_status(score: str, q25: str, q75: str, spots: str) -> str:
    return f"(case when {spots} < 2 or {q25} is null then 'grey' when {score} > {q75} then 'green' when {score} < {q25} then 'red' else 'yellow' end)"


def overall_status(score: str, confidence: str, bands: str) -> str:
    return f"(case when {bands} = 0 or {confidence} < 15 then 'grey' when {score} >= 65 then 'green' when {score} >= 35 then 'yellow' else 'red' end)"


def condition_label(status: str, score: str) -> str:
    return f"(case when {status} = 'green' and {score} >= 78 then 'Excellent' when {status} = 'green' then 'Good' when {status} = 'yellow' then 'Fair' else 'Poor' end)"


def spot_mode(ssb: str, cw: str, total: str) -> str:
    """The most demanding mode that at least 55% of the spots would carry."""
    return f"(case when {total} <= 0 then 'none' when cast({ssb} as double) / {total} >= 0.55 then 'ssb' when cast({cw} as double) / {total} >= 0.55 then 'cw' when {total} >= 3 then 'digital' else 'none' end)"


def recommendation(status: str, mode: str, dx_ratio: str, per_minute: str, confidence: str) -> str:
    return (
        f"(case when {confidence} < 20 or {status} = 'grey' then 'Insufficient data' "
        f"when {status} = 'green' and {dx_ratio} >= 0.4 then case {mode} when 'ssb' then 'Try DX on SSB' when 'cw' then 'Try DX on CW' else 'Try DX' end "
        f"when {status} in ('green', 'yellow') then case when {per_minute} > 0.8 then 'Band usable now' else 'Monitor for openings' end else 'Avoid for now' end)"
    )


def activity_level(observed: str, expected: str) -> str:
    """Against the expected count; the ratio is rounded to two places first."""
    r = round_half_away(f"({observed}) / nullif({expected}, 0)", 2)
    return f"(case when {expected} is null or {expected} <= 0 then 'no_baseline' when greatest({observed}, {expected}) < 20 then 'low_sample' when {r} >= 1.5 then 'above' when {r} <= 0.67 then 'below' else 'normal' end)"


def reach_level(ratio: str) -> str:
    return f"(case when {ratio} >= 1.3 then 'longer' when {ratio} <= 1 / cast(1.3 as double) then 'shorter' else 'typical' end)"


def trend_word(delta: str, cut: float = 0.2) -> str:
    return f"(case when {delta} > {cut} then 'rising' when {delta} < -{cut} then 'falling' else 'stable' end)"


# Shapes of locators and callsigns.
LOCATOR_SHAPE, LOCATOR_STRICT, CALL_SHAPE = "^[A-Z]{2}[0-9]{2}([A-Z]{2}([0-9]{2})?)?$", "^[A-R]{2}[0-9]{2}([A-X]{2}([0-9]{2})?)?$", "^[A-Z0-9/]{3,15}$"


def classify_qth(x: str, matches: str = "regexp_like") -> str:
    """locator, bad_locator (shaped or beginning like one), callsign, or bad; ``matches`` names the engine's search for a pattern."""
    u = f"upper(trim(coalesce({x}, '')))"
    call = f"{matches}({u}, '{CALL_SHAPE}') and {matches}({u}, '[A-Z]') and {matches}({u}, '[0-9]')"
    return f"(case when {matches}({u}, '{LOCATOR_STRICT}') then 'locator' when {matches}({u}, '{LOCATOR_SHAPE}') or {is_locator(u)} then 'bad_locator' when {call} then 'callsign' else 'bad' end)"


def is_target_locator(x: str) -> bool:
    """Whether a target in capitals is compared by locator: 2 to 5 pairs, of a field, a square, and finer ones in turn."""
    first, finer = ("AR", "09"), ("AX", "09", "AX")
    pairs = [x[k : k + 2] for k in range(0, len(x), 2)]
    spans = [*first, *finer][: len(pairs)]
    return len(x) % 2 == 0 and 2 <= len(pairs) <= 5 and all(lo <= c <= hi for pair, (lo, hi) in zip(pairs, spans, strict=True) for c in pair)


def base_call(x: str) -> str:
    """A call without a portable or power suffix and a skimmer's number; Spark only."""
    return f"regexp_replace(regexp_replace(upper(trim({x})), '-(#|[0-9]+)$', ''), '/(P|QRP|M|A)$', '')"


def saturating(x: str, most: int = 255) -> str:
    return f"cast(least(greatest({x}, 0), {most}) as int)"


def snr_bins(total: str, at_least: list[str]) -> list[str]:
    """Six disjoint counts from a total and five cumulative ones (floors from low to high), none below 0, at most 255."""
    steps = [total, *at_least]
    return [saturating(f"{a} - {b}") for a, b in zip(steps, [*at_least, "0"], strict=True)]


def flavor(days: str, mean: str, sd: str, today: str, elapsed: str) -> str:
    """How a beacon anomaly sits with the digital feed's own count of today, whose slot is ``elapsed`` (0 to 1) over."""
    part = f"least({elapsed}, 1.0)"
    return (
        f"(case when {days} is null or {days} < 3 or coalesce({sd}, 0) <= 0 or {elapsed} < cast(1 as double) / 6 then 'atypical-wspr-only' "
        f"when {today} > 0 and ({today} - {mean} * {part}) / ({sd} * sqrt({part})) >= 2 then 'atypical-both' "
        f"when {today} = 0 or {today} < {mean} * {part} * 0.1 then 'atypical-wspr-silent-ft8' else 'atypical-wspr-only' end)"
    )


def surge_strength(z: str, agreement: str) -> str:
    return f"(case when {z} >= 4 or {agreement} >= 0.5 then 'strong' else 'normal' end)"
