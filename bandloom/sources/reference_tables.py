"""Skimmer lists, country files and old snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid

e = F.expr

SNAPSHOT = "struct<buckets: map<string, struct<band: string, hour_of_week: int, slot_of_day: int, distance_tier: int, snr_tier: int, count: long>>>"


def load_skimmers(pages: DataFrame) -> DataFrame:
    """(call, grid) from status pages (html): cells 0 and 2 of each table row; of a call that stands twice, the later row."""
    rows = pages.select(F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("place", "row"))
    cells = rows.withColumn("c", F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)).where("size(c) >= 3")
    text = lambda k: F.trim(F.replace(F.replace(F.regexp_replace(F.col("c")[k], r"(?s)<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))
    found = cells.select("place", F.regexp_replace(F.upper(text(0)), "-#$", "").alias("call"), text(2).alias("g")).withColumn("grid", e(grid.normalize_locator("g"))).where("call <> '' and grid <> ''")
    return found.groupBy("call").agg(F.max_by("grid", "place").alias("grid"))


def load_dxcc(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact calls and prefixes (token, name, continent, lat, lon, primary_prefix) from country files (text).

    An entity is eight fields that end in colons, then prefixes up to a semicolon. = marks a whole call; what stands in
    ( [ < { ~ overrides nothing here; longitudes are west-positive in the file. Of a token that stands twice, the later.
    """
    clean = F.regexp_replace("text", r"(?m)^\s*#.*$", "")
    entries = files.select(F.posexplode(F.split(clean, ";")).alias("place", "entry")).withColumn("f", F.transform(F.split("entry", ":"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))).where("size(f) >= 9")
    named = entries.select("place", e("f[0]").alias("name"), e("f[3]").alias("continent"), e("coalesce(try_cast(f[4] as double), 0.0D)").alias("lat"), e("coalesce(-try_cast(f[5] as double), 0.0D)").alias("lon"), F.regexp_replace(e("f[7]"), r"^\*", "").alias("primary_prefix"), e("f[8]").alias("list"))
    tokens = named.select("*", F.posexplode(F.split("list", ",")).alias("nth", "raw")).withColumn("raw", F.trim("raw"))
    tokens = tokens.withColumns({"is_exact": F.col("raw").startswith("="), "token": F.upper(F.trim(F.regexp_replace(F.regexp_replace("raw", "^=", ""), r"[(\[<{~].*$", "")))}).where("token <> ''")
    last = tokens.groupBy("token", "is_exact").agg(F.max_by(F.struct("name", "continent", "lat", "lon", "primary_prefix"), F.struct("place", "nth")).alias("x")).select("token", "is_exact", "x.*")
    return last.where("is_exact").drop("is_exact"), last.where("not is_exact").drop("is_exact")


def import_baseline_json(snapshots: DataFrame) -> DataFrame:
    """(band, slot, distance_tier, snr_tier, count) from old snapshots (json); an hour of the week becomes the slot in which it begins."""
    b = snapshots.select(F.explode(F.from_json("json", SNAPSHOT)["buckets"])).select("value.*")
    slot = e("cast(case when slot_of_day is not null then slot_of_day else (hour_of_week % 24) * 2 end as int)")
    return b.select("band", slot.alias("slot"), "distance_tier", "snr_tier", "count").groupBy("band", "slot", "distance_tier", "snr_tier").agg(F.sum("count").alias("count"))


def import_climatology_v1(old: DataFrame, present: DataFrame) -> DataFrame:
    """The per-source table with the beacon rows of an old snapshot where it has none of that key."""
    key = ["band", "source", "slot", "region", "day"]
    new = old.withColumn("source", F.lit("wspr")).select(*key, "spot_count").join(present.select(key), key, "left_anti")
    return present.select(*key, "spot_count").unionByName(new)
