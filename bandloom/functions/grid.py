"""Maidenhead locators: squares, coordinates, clusters."""

from __future__ import annotations

from .numbers import quotient

#: Squares on a side of a cluster, and of the grid.
CLUSTER, SIDE = 6, 180


def is_locator(x: str) -> str:
    """True for texts that begin with a field in capital letters and a square; false for null."""
    return f"coalesce(length({x}) >= 4 and substr({x}, 1, 1) between 'A' and 'R' and substr({x}, 2, 1) between 'A' and 'R' and substr({x}, 3, 1) between '0' and '9' and substr({x}, 4, 1) between '0' and '9', false)"


def is_locator_fold(x: str) -> str:
    """The same for any letter case."""
    return is_locator(f"upper({x})")


def square(x: str) -> str:
    """The first four characters of a locator in capital letters; null for others."""
    return f"case when {is_locator_fold(x)} then substr(upper({x}), 1, 4) end"


def square_x(s: str) -> str:
    """Column of a valid square, 0 to 179 from west to east."""
    return f"((ascii(substr({s}, 1, 1)) - 65) * 10 + ascii(substr({s}, 3, 1)) - 48)"


def square_y(s: str) -> str:
    """Row of a valid square, 0 to 179 from south to north."""
    return f"((ascii(substr({s}, 2, 1)) - 65) * 10 + ascii(substr({s}, 4, 1)) - 48)"


def square_at(x: str, y: str) -> str:
    """The square in a column and row."""
    letter, digit = (lambda v: f"chr(cast(65 + {quotient(v, '10')} as int))"), (lambda v: f"chr(cast(48 + ({v}) % 10 as int))")
    return f"concat({letter(x)}, {letter(y)}, {digit(x)}, {digit(y)})"


def cluster_anchor(s: str) -> str:
    """The south-western square of the 6 by 6 cluster of a valid square; the last cluster ends at the grid's edge."""
    base = lambda v: f"least({quotient(v, str(CLUSTER))} * {CLUSTER}, {SIDE - CLUSTER})"
    return square_at(base(square_x(s)), base(square_y(s)))


def normalize_locator(x: str) -> str:
    """Trimmed, in capitals, cut to six or else four valid characters; '' for what is no locator."""
    g = f"upper(trim({x}))"
    sub = f"length({g}) >= 6 and substr({g}, 5, 1) between 'A' and 'X' and substr({g}, 6, 1) between 'A' and 'X'"
    return f"(case when not {is_locator(g)} then '' when {sub} then substr({g}, 1, 6) else substr({g}, 1, 4) end)"


def _axis(x: str, first: int, field: int, zero: int, step: int, sub: float) -> str:
    code = lambda k, base: f"(ascii(substr({x}, {k}, 1)) - {base})"
    inner = f"case when length({x}) < 4 then cast({field / 2} as double) when length({x}) < 6 then {code(first + 2, 48)} * {step} + cast({step / 2} as double) else {code(first + 2, 48)} * {step} + ({code(first + 4, 65)} + cast(0.5 as double)) * {sub} / 60 end"
    return f"(case when length({x}) < 2 then cast(0 as double) else {code(first, 65)} * {field} - {zero} + {inner} end)"


def latitude(x: str) -> str:
    """Centre of a field, square or subsquare in capitals; 0 for shorter texts."""
    return _axis(x, 2, 10, 90, 1, 2.5)


def longitude(x: str) -> str:
    return _axis(x, 1, 20, 180, 2, 5.0)


def locator_at(lat: str, lon: str, precision: int = 4) -> str:
    """The square (or with precision 2 the field) of a point; points beyond the edges are moved to them."""
    a, o = f"least(greatest(cast({lat} as double), -90.0), 90.0)", f"least(greatest(cast({lon} as double), -180.0), 180.0)"
    fx, fy = f"least({quotient(f'{o} + 180', '20')}, 17)", f"least({quotient(f'{a} + 90', '10')}, 17)"
    if precision == 2:
        return f"concat(chr(cast(65 + {fx} as int)), chr(cast(65 + {fy} as int)))"
    col, row = f"least({quotient(f'{o} + 180 - {fx} * 20', '2')}, 9)", f"least({quotient(f'{a} + 90 - {fy} * 10', '1')}, 9)"
    return f"concat(chr(cast(65 + {fx} as int)), chr(cast(65 + {fy} as int)), chr(cast(48 + {col} as int)), chr(cast(48 + {row} as int)))"
