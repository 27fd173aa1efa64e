"""Rounding, ratios and the Poisson tail."""

from __future__ import annotations


def round_half_away(x: str, digits: int = 0) -> str:
    """Half away from zero on the binary value, unlike Spark's round(), which works on the decimal text."""
    v, scale = f"cast({x} as double)", f"cast({10**digits} as double)"
    return f"(case when {v} < 0 then -1 else 1 end * cast(floor(abs({v}) * {scale} + 0.5) as double) / {scale})"


def clamp(x: str, low: float | str, high: float | str) -> str:
    return f"least(greatest({x}, {low}), {high})"


def clamp01(x: str) -> str:
    return clamp(f"cast({x} as double)", "cast(0 as double)", "cast(1 as double)")


def quotient(a: str, b: str) -> str:
    """Whole part of a / b, rounded down; for whole numbers below 2**53."""
    return f"cast(floor(({a}) / cast({b} as double)) as bigint)"


def modulo(a: str, b: int) -> str:
    """The remainder with the sign of b."""
    return f"(((({a}) % {b}) + {b}) % {b})"


def ratio(a: str, b: str) -> str:
    """a / b as a double, null if b is 0."""
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


def share_code(num: str, den: str) -> str:
    """A share in thousandths, rounded half up and from 0 to 1000; -1 if the whole is 0."""
    part = f"least(greatest({num}, 0), {den})"
    return f"(case when {den} > 0 then {quotient(f'({part}) * 1000 + {quotient(den, "2")}', den)} else -1 end)"


def share_value(code: str) -> str:
    """The share that a code of share_code() stands for, from 0 to 1; null if there is none."""
    return f"(case when {code} >= 0 then cast({code} as double) / 1000 end)"


def poisson_upper_tail(k: str, rate: str) -> str:
    """P(X >= k) for a Poisson variable: one minus the k terms below, each made from the one before. Spark only."""
    terms = f"aggregate(sequence(1, greatest(cast({k} as int) - 1, 0)), named_struct('i', 0, 'term', exp(-({rate})), 'sum', exp(-({rate}))), (s, i) -> case when i > cast({k} as int) - 1 or i < 1 then s else named_struct('i', i, 'term', s.term * ({rate}) / i, 'sum', s.sum + s.term * ({rate}) / i) end, s -> s.sum)"
    return f"(case when {k} <= 0 then cast(1 as double) when {rate} <= 0 then cast(0 as double) else greatest(cast(0 as double), 1 - {terms}) end)"
