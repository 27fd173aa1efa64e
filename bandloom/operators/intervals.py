"""Windows without the gaps in which nothing was recorded.

A gap is [a, b) in seconds. A window carries its gaps as an array of structs (a, b), in any order, overlapping or not: those
of a live window are few. What is left of the window are its segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

e = F.expr

GAPS = "array<struct<a: bigint, b: bigint>>"

#: Seconds of a bucket in which gaps and windows meet.
BUCKET = 3600


def segments(t0: str = "t0", t1: str = "t1", gaps: str = "gaps") -> str:
    """The parts of [t0, t1) outside all gaps, in order: an array of structs (a, b)."""
    inside = f"array_sort(filter(coalesce({gaps}, cast(array() as {GAPS})), g -> g.b > g.a and g.b > {t0} and g.a < {t1}))"
    cut = "case when g.a > x.at then concat(x.parts, array(named_struct('a', x.at, 'b', cast(g.a as bigint)))) else x.parts end"
    start = f"named_struct('at', cast({t0} as bigint), 'parts', cast(array() as {GAPS}))"
    last = f"case when x.at < {t1} then concat(x.parts, array(named_struct('a', x.at, 'b', cast({t1} as bigint)))) else x.parts end"
    return f"aggregate({inside}, {start}, (x, g) -> named_struct('at', greatest(x.at, cast(g.b as bigint)), 'parts', {cut}), x -> {last})"


def recorded(t: str = "t", gaps: str = "gaps") -> str:
    """Whether a second lies in no gap."""
    return f"not exists(coalesce({gaps}, cast(array() as {GAPS})), g -> {t} >= g.a and {t} < g.b)"


def seconds_of(parts: str) -> str:
    return f"aggregate({parts}, 0L, (n, s) -> n + s.b - s.a)"


def with_gaps(windows: DataFrame, gaps: DataFrame, *by: str) -> DataFrame:
    """``windows`` (t0, t1 and more) with the gaps (a, b) that meet them, of the same ``by`` columns if any are named.

    Windows and gaps meet in hours that both touch, in an equi-join; a window's own gaps are gathered, not all gaps.
    """
    hours = lambda a, b: F.explode(e(f"sequence(cast(floor({a} / {BUCKET}) as bigint), cast(floor(({b} - 1) / {BUCKET}) as bigint))"))
    sound = gaps.where("b > a").select(*by, "a", "b", hours("a", "b").alias("hour"))
    key = [*by, "t0", "t1"]
    touched = windows.where("t1 > t0").select(*key).distinct().withColumn("hour", hours("t0", "t1"))
    found = touched.join(sound, ["hour", *by]).where("b > t0 and a < t1").groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))).alias("gaps"))
    return windows.join(found, key, "left")


def split(windows: DataFrame) -> DataFrame:
    """A row for each segment of a window with gaps: t0 and t1 are the segment's, segment its number, segments their count."""
    out = windows.withColumn("parts_", e(segments())).select(*[c for c in windows.columns if c not in ("t0", "t1", "gaps")], F.size("parts_").alias("segments"), F.posexplode("parts_").alias("segment", "part_"))
    return out.withColumns({"t0": F.col("part_.a"), "t1": F.col("part_.b")}).drop("part_")


def live_start(retention_minutes: int | None = None) -> str:
    """Where a window of qths (now, minutes, complete_since) begins that holds nothing from before ``complete_since``, null for no bound."""
    start = "now - minutes * 60" if retention_minutes is None else f"greatest(now - minutes * 60, now - {retention_minutes * 60})"
    return f"case when complete_since > {start} and complete_since < now then complete_since else {start} end"


def covered_from_bin(bins: int, retention_minutes: int | None) -> str:
    """The first of a window's ``bins`` that is covered from its start on: 0 if all are, ``bins`` if none is."""
    size = f"cast(floor(minutes * 60 / {bins}) as bigint)"
    start = f"greatest(coalesce(complete_since, 0), {f'now - {retention_minutes * 60}' if retention_minutes else '0'})"
    lacking = f"({start} - (now - minutes * 60))"
    return f"cast(case when minutes <= 0 or {size} <= 0 or {lacking} <= 0 then 0 else least(cast(floor(({lacking} + {size} - 1) / {size}) as bigint), {bins}) end as int)"
