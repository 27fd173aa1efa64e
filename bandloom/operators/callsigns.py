"""Where stations are: countries by prefix, and the latest grid of each call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, grid

e = F.expr

# Seconds for which a grid from a report, from a call book, and the answer that there is none hold.
TTL = {"feed": 7 * 86400, "qrz": 30 * 86400, "negative": 7 * 86400}


def entities(calls: DataFrame, exact: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each distinct call of ``calls`` (call), but empty ones, with its entity as in resolve_dxcc(). ``calls`` are read once."""
    c = calls.select("call").distinct().withColumn("u", e("upper(trim(call))")).where("u <> ''")
    entity = F.struct("name", "continent", "lat", "lon", "primary_prefix")
    cut = c.withColumn("token", F.explode(e("transform(sequence(1, length(u)), n -> substr(u, 1, n))"))).join(prefixes.select("token", entity.alias("entity")), "token", "left")
    longest = cut.groupBy("call", "u").agg(F.max_by("entity", F.when(F.col("entity").isNotNull(), F.length("token"))).alias("by_prefix"))
    whole = longest.join(exact.select(F.col("token").alias("u"), entity.alias("by_call")), "u", "left")
    return whole.withColumn("x", F.coalesce("by_call", "by_prefix")).select("call", "x.*")


def resolve_dxcc(calls: DataFrame, exact: DataFrame, prefixes: DataFrame, iso: DataFrame | None = None) -> DataFrame:
    """``calls`` (call) with the entity of the exact call, else of its longest known prefix; null without either.

    ``exact`` and ``prefixes`` have token, name, continent, lat, lon and primary_prefix; ``iso`` has primary_prefix and iso2.
    A call is joined by all its prefixes, so the join is one of equal keys.
    """
    out = entities(calls, exact, prefixes)
    if iso is not None:
        out = out.join(iso, "primary_prefix", "left")
    return calls.join(out, "call", "left")


def resolve_qth(qths: DataFrame, exact: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(qth, locator, anchor, origin): a locator as it is, a call by the centre of its entity (unless that is 0, 0)."""
    q = qths.select("qth", e(grid.normalize_locator("qth")).alias("own"))
    found = entities(q.where("own = ''").select(F.col("qth").alias("call")), exact, prefixes).select(F.col("call").alias("qth"), "lat", "lon").distinct()
    out = q.join(found, "qth", "left").withColumn("by_entity", e(f"case when not (lat = 0 and lon = 0) then {grid.locator_at('lat', 'lon')} end"))
    out = out.withColumn("locator", e("coalesce(nullif(own, ''), by_entity)"))
    return out.select("qth", "locator", e(f"case when locator is not null then {grid.cluster_anchor('locator')} end").alias("anchor"), e("case when own <> '' then 'locator' when by_entity is not null then 'entity' else 'unknown' end").alias("origin"))


def call_locators(reports: DataFrame) -> DataFrame:
    """(call, loc, seen) from (call, locator, t): each call's latest square; within it, a six-character locator over a four-character one.

    seen is the time of the latest report from that square.
    """
    r = reports.select(e("upper(trim(call))").alias("call"), e(grid.normalize_locator("locator")).alias("loc"), "t").where("length(call) >= 3 and loc <> ''").withColumn("square", e("substr(loc, 1, 4)"))
    # Each locator's latest time first: sums of numbers need no sort, and the structs are compared for a row a call and locator.
    r = r.groupBy("call", "square", "loc").agg(F.max("t").alias("t"))
    # The last run of reports from one square: the largest t of any other square comes before it.
    squares = r.groupBy("call", "square").agg(F.max("t").alias("seen"), F.max_by("loc", F.struct(F.length("loc"), F.col("t"), F.col("loc"))).alias("loc"))
    latest = Window.partitionBy("call").orderBy(F.desc("seen"), F.desc("square"))
    return squares.withColumn("nth", F.row_number().over(latest)).where("nth = 1").select("call", "loc", "seen")


def resolve_call_locators(calls: DataFrame, known: DataFrame) -> DataFrame:
    """``calls`` (call, now) with loc and origin: feed, qrz, negative (known to have none) or miss.

    ``known`` has call, loc, src (feed, qrz or negative) and seen. Answers expire. A call with a portable suffix takes
    the plain call's grid if that comes from a report, or if its own answer has none; a report's grid wins.
    """
    ttl = "case src when 'qrz' then {qrz} when 'negative' then {negative} else {feed} end".format(**TTL)
    k = known.select(F.col("call").alias("k"), "loc", "src", "seen")
    c = calls.withColumn("own_key", e("upper(trim(call))")).withColumn("base_key", e("case when own_key rlike '^[^/]+/(P|QRP|M|A)$' then substring_index(own_key, '/', 1) end"))
    for name in ("own", "base"):
        answer = k.select(F.col("k").alias(f"{name}_key"), F.struct("loc", "src", "seen").alias(name))
        c = c.join(answer, f"{name}_key", "left").withColumn(name, e(f"case when now - {name}.seen <= {ttl.replace('src', name + '.src')} then {name} end"))
    pick = "case when own.src = 'feed' then own when base.src = 'feed' then base when own.src = 'qrz' then own when base.src = 'qrz' then base else own end"
    out = c.withColumn("x", e(pick)).withColumn("origin", e("case when own_key = '' then 'negative' else coalesce(x.src, 'miss') end"))
    return out.withColumn("found", e("case when origin in ('feed', 'qrz') then x.loc end")).drop("own_key", "base_key", "own", "base", "x").withColumnRenamed("found", "loc")


def enrich_rbn(spots: DataFrame, skimmers: DataFrame, known: DataFrame) -> DataFrame:
    """Skimmer spots (skimmer, dx_call, t and more) with sl, rl and where each comes from.

    A skimmer's locator is looked up in the list, without its number, then among the known calls.
    """
    s = spots.withColumn("key", e("regexp_replace(upper(trim(skimmer)), '-#$', '')")).withColumn("base", e(classify.base_call("skimmer")))
    listed = skimmers.select(F.col("call").alias("key"), F.col("grid").alias("by_list"))
    s = s.join(listed, "key", "left").join(listed.select(F.col("key").alias("base"), F.col("by_list").alias("by_base")), "base", "left")
    needed = s.select(F.col("base").alias("call"), F.col("t").alias("now")).unionByName(s.select(F.col("dx_call").alias("call"), F.col("t").alias("now"))).distinct()
    answers = resolve_call_locators(needed, known)
    side = lambda key, name: answers.select(F.col("call").alias(key), F.col("now").alias("t"), F.col("loc").alias(f"{name}_loc"), F.col("origin").alias(f"{name}_origin"))
    s = s.join(side("base", "skimmer"), ["base", "t"], "left").join(side("dx_call", "dx"), ["dx_call", "t"], "left")
    s = s.withColumns({"sl": F.coalesce("by_list", "by_base", "skimmer_loc"), "rl": F.col("dx_loc"), "skimmer_from": e("case when coalesce(by_list, by_base) is not null then 'list' when skimmer_loc is not null then 'cache' else 'missing' end"), "dx_from": e("case dx_origin when 'negative' then 'no_grid' when 'miss' then 'missing' else dx_origin end")})
    return s.drop("key", "base", "by_list", "by_base", "skimmer_loc", "skimmer_origin", "dx_loc", "dx_origin")
