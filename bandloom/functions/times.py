"""Slots and days of Unix seconds, in UTC."""

from __future__ import annotations

from .numbers import modulo, quotient

SLOTS, SLOT_SECONDS, DAY_SECONDS = 48, 1800, 86400


def slot_of_day(t: str) -> str:
    """Half hour of the day, from 0 to 47."""
    return f"cast({quotient(modulo(t, DAY_SECONDS), str(SLOT_SECONDS))} as int)"


def day_index(t: str) -> str:
    """Days since 1970, rounded down."""
    return f"cast({quotient(t, str(DAY_SECONDS))} as int)"


def year_month(day: str) -> str:
    """Year times 100 plus month of a day index."""
    date = f"(date '1970-01-01' + cast({day} as int))"
    return f"cast(year({date}) * 100 + month({date}) as int)"


def day_of_month(day: str) -> str:
    return f"cast(day(date '1970-01-01' + cast({day} as int)) as int)"


def age_seconds(now: str, t: str) -> str:
    return f"greatest({now} - {t}, 0)"


def dedup_bucket(t: str) -> str:
    """Half minute within which the same report counts once."""
    return quotient(t, "30")
