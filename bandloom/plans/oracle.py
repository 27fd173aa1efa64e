"""The registered queries in DuckDB's SQL. Common parts are common table expressions over ``events``."""

from __future__ import annotations

from ..functions import bands, classify, geo, grid, numbers, times
from ..operators import almanac, baselines
from .spots import DUCK_SPOTS, PREPARED_SQL

R = numbers.round_half_away
IN_SCOPE = bands.band_in_scope("band")
GATE = bands.baseline_gate("band", "sl", "rl")
KM = geo.haversine_km("s_lat", "s_lon", "r_lat", "r_lon")
FLOORS = [baselines.floor_name(f) for f in baselines.FLOORS]


def r6(column: str, name: str | None = None) -> str:
    return f"{R(column, 6)} as {name or column}"


#: Every common table expression that a query may name, in an order in which each may use the ones before.
PARTS = {
    "spots": DUCK_SPOTS,
    "p": PREPARED_SQL,
    "n": "select max(t) as now, max(t) // 86400 as today, max(t) % 86400 // 1800 as now_slot from spots",
    "q": "select qth, surroundings, 60 as minutes, -15 as cw_min_db, now from (values ('JO32', false), ('FN45', false), ('JO31', true), ('S17', false)) v(qth, surroundings), n",
    "tok": f"select qth, {grid.square_at('x + dx', 'y + dy')} as token from (select qth, {grid.square_x('qth')} as x, {grid.square_y('qth')} as y, case when surroundings then 1 else 0 end as r from q where {grid.is_locator('qth')}), (select unnest(range(-1, 2)) as dx), (select unnest(range(-1, 2)) as dy) where abs(dx) <= r and abs(dy) <= r union all select qth, qth from q where not {grid.is_locator('qth')}",
    "hit": "select qth, spot_id, bool_or(s) as is_sender, bool_or(not s) as is_receiver from (select qth, spot_id, true as s from p join tok on s4 = token or sc = token union all select qth, spot_id, false from p join tok on r4 = token or rc = token) group by 1, 2",
    "m": f"select h.qth, p.spot_id, p.t, p.band, p.snr, p.source, p.sc as sender, p.rc as receiver, case when is_sender then rl else sl end as remote, {bands.reporter_locator('source', 'sl', 'rl')} as reporter, case when is_sender then r_lat else s_lat end as lat, case when is_sender then r_lon else s_lon end as lon, greatest(now - t, 0) as age from hit h join p using (spot_id), n where case when is_sender then rl else sl end <> ''",
    "ev": f"select * exclude (deg), case when not (lat1 = 0 and lon1 = 0) and not (lat2 = 0 and lon2 = 0) then {geo.direction8('deg')} else '' end as direction from (select *, {geo.haversine_km('lat1', 'lon1', 'lat2', 'lon2')} as km, {geo.bearing_deg('lat1', 'lon1', 'lat2', 'lon2')} as deg from (select h.qth, p.*, case when is_sender then rl else sl end as remote, case when is_sender then coalesce(r4, '') else coalesce(s4, '') end as remote4, case when is_sender then r_region else s_region end as remote_region, case when is_sender then s_lat else r_lat end as lat1, case when is_sender then s_lon else r_lon end as lon1, case when is_sender then r_lat else s_lat end as lat2, case when is_sender then r_lon else s_lon end as lon2, {times.dedup_bucket('t')} as bucket from hit h join p using (spot_id) where {GATE} and {IN_SCOPE}))",
    "elig": f"select *, {classify.distance_tier('km')} as distance_tier, {classify.snr_tier('snr')} as snr_tier from (select *, {KM} as km from p where calibrated and {IN_SCOPE} and {GATE})",
    "ends": f"select *, {grid.cluster_anchor('end4')} as anchor from (select *, s4 as end4 from p union all select *, r4 from p) where end4 is not null",
    "eends": f"select *, {grid.cluster_anchor('end4')} as anchor from (select *, s4 as end4 from elig union all select *, r4 from elig) where end4 is not null",
    "gb": "select band, slot, distance_tier, snr_tier, count(*) as count from elig group by all",
    "cb": "select anchor as cluster_anchor, band, slot, distance_tier, snr_tier, count(*) as count from eends group by all",
    "span": "select min(t) as first_t, max(t) as last_t, count(*) as events, (max(t) - min(t)) // 60 as history_minutes from elig",
    "cov": "select least(cast((select sum(count) from cb) as double) / (2 * (select sum(count) from gb)), 1) as coverage",
    "anchors": f"select distinct {grid.cluster_anchor('qth')} as anchor from q where {grid.is_locator('qth')}",
    "own": "select anchor, band, slot, distance_tier, snr_tier, count, true as used_cluster from cb join anchors on cluster_anchor = anchor",
    "pairs": "select * from own union all select anchor, band, slot, distance_tier, snr_tier, count, false from gb, anchors where not exists (select 1 from own o where o.anchor = anchors.anchor and o.band = gb.band and o.slot = gb.slot)",
    "rates": f"select anchor, band, slot, used_cluster, sum(count) as support, sum(count) / (greatest(case when used_cluster then {R('history_minutes * coverage')} else cast(history_minutes as double) end / 1440, 1) * 30.0) as rate from pairs, span, cov group by anchor, band, slot, used_cluster, history_minutes, coverage",
    "keys": f"select distinct spot_id, band, slot, day, snr, target4, region from (select *, s4 as target4, r_region as region from p union all select *, r4, s_region from p) where target4 is not null and region <> '??' and calibrated and {IN_SCOPE}",
    "rd": "select target4, band, slot, region, day, count(*) as spot_count, count(snr) as snr_spots, " + ", ".join(f"count(*) filter (where snr >= {f}) as {n}" for f, n in zip(baselines.FLOORS, FLOORS, strict=True)) + " from keys group by all",
    "ing": "select day, slot, sum(spot_count) as spot_total from rd group by all",
    "sd": f"select band, source, slot, region, day, count(*) as spot_count from (select *, case when recv <> '??' then recv else other end as region from (select *, case when source in ('rbn', 'wspr') then s_region else r_region end as recv, case when source in ('rbn', 'wspr') then r_region else s_region end as other from p)) where {IN_SCOPE} and region <> '??' group by all",
    "wd": f"select band, slot, region, day, count(*) as spot_count from (select *, case when s_region <> '??' then s_region else r_region end as region from p where source = 'wspr') where {IN_SCOPE} and region <> '??' group by all",
    "areas": "select * from (values ('JO32', 'JO32', 0), ('JO31+', 'JO31', 1), ('FN45+', 'FN45', 2)) v(area, centre, rings)",
    "sq": f"select area, {grid.square_at('x + dx', 'y + dy')} as square, greatest(abs(dx), abs(dy)) as ring, rings from (select area, rings, {grid.square_x('centre')} as x, {grid.square_y('centre')} as y from areas), (select unnest(range(-2, 3)) as dx), (select unnest(range(-2, 3)) as dy)",
    "ae": "select area, spot_id, min(ring) filter (where side = 's') as s_ring, min(ring) filter (where side = 'r') as r_ring from (select area, spot_id, 's' as side, ring from p join sq on s4 = square where ring <= rings union all select area, spot_id, 'r', ring from p join sq on r4 = square where ring <= rings) group by 1, 2",
    "fh": "select area, p.*, case when k = 0 then rc else sc end as call, case when k = 0 then r_region else s_region end as region from ae join p using (spot_id), (select unnest(range(2)) as k) where (k = 0 and s_ring is not null or k = 1 and r_ring is not null and (s_ring is null or s4 <> r4)) and case when k = 0 then r_region else s_region end <> '??'",
    "ad": "select area, band, region, slot, day, sum(spot_count) as spot_count from rd join sq on target4 = square where ring <= rings group by all",
    "lev": f"select area, ring, band, region, day, slot, sum(spot_count) as n, sum(snr_spots) as snr_n, sum(snr_ge_m10) as ge_m10 from rd join sq on target4 = square where band in ({bands.listed(bands.ALMANAC_BANDS)}) group by all",
    "grid48": "select cast(today - 30 + d as int) as day, cast(s as int) as slot from n, (select unnest(range(30)) as d), (select unnest(range(48)) as s)",
    "alive": "select day, slot from (select g.day, g.slot, coalesce(spot_total, 0) as x, median(coalesce(spot_total, 0)) over (partition by g.slot) as med from grid48 g left join ing i on g.day = i.day and g.slot = i.slot) where x > 0 and x >= 0.10 * med",
    "act": "select distinct area, radius, band, day, slot from (select area, ring, band, day, slot from lev union all select area, ring, band, case when slot = 0 then day - 1 else day end, case when slot = 0 then 47 else slot - 1 end from lev), (select unnest(range(3)) as radius) where ring <= radius and (day, slot) in (select (day, slot) from alive)",
    "known": "select area, radius, band, count(*) as known from (select area, radius, band, slot from act group by all having count(*) >= 10) group by all",
    "rad": "select area, coalesce((select min(radius) from (select radius, count(*) as b from known k where k.area = a.area and known >= 8 group by 1) where b >= 6), 2) as radius from areas a",
    "days": "select act.* from act join rad using (area, radius)",
    "inside": "select area, band, region, day, slot, sum(n) as n, sum(snr_n) as snr_n, sum(ge_m10) as ge_m10 from lev join rad using (area) where ring <= radius group by all",
    "lanes": "select e.area, e.band, e.region, e.slot, coalesce(h.n, 0) as n, coalesce(m.m, 0) as m from (select area, band, region, cast(s as int) as slot from (select distinct area, band from days), (select unnest(['EU', 'NA', 'SA', 'AF', 'AS', 'JA', 'OC', 'VK', 'KH6', 'CAR', 'AN']) as region), (select unnest(range(48)) as s)) e left join (select area, band, slot, count(*) as m from days group by all) m using (area, band, slot) left join (select area, band, region, slot, count(*) filter (where n >= 2) as n from inside join days using (area, band, day, slot) group by all) h using (area, band, region, slot)",
}


def sql(text: str) -> str:
    """A query with the common table expressions that it needs before it."""
    import re

    needed, todo = set(), [text]
    while todo:
        words = set(re.findall(r"\b\w+\b", todo.pop()))
        new = {k for k in PARTS if k in words and k not in needed}
        needed |= new
        todo += [PARTS[k] for k in new]
    text = f"select * from ({text})" if text.startswith("with ") else text
    return "with " + ", ".join(f"{k} as materialized ({v})" for k, v in PARTS.items() if k in needed) + " " + text


SCORED = "(select * from (select *, row_number() over (partition by qth, band, bucket, sc, rc, sl, rl order by t, spot_id) as nth from ev, n where calibrated and snr >= -15 and t between now - {s} and now) where nth = 1)"
BINS = f"(select g.qth, g.band, cast(b as int) as bin, coalesce(n_spots, 0) / cast(5 as double) as rate from (select distinct qth, band from hit join p using (spot_id), n where t between now - 3600 and now and snr >= -15 and {IN_SCOPE}) g cross join (select unnest(range(12)) as b) left join (select qth, band, least((t - now + 3600) // 300, 11) as bin, count(*) as n_spots from hit join p using (spot_id), n where t between now - 3600 and now and snr >= -15 and {IN_SCOPE} group by all) c on c.qth = g.qth and c.band = g.band and c.bin = b)"
STATS = "select source, band, region, slot, sample_days, mean, case when sample_days > 1 then sqrt(greatest(xx - sample_days * mean * mean, 0) / (sample_days - 1)) end as sd, today_n as today from (select *, x / sample_days as mean from (select {s} as source, band, region, slot, cast(sum(case when day < today then spot_count else 0 end) as double) as x, cast(sum(case when day < today then spot_count * spot_count else 0 end) as double) as xx, sum(case when day = today then spot_count else 0 end) as today_n from {t}, n where day between today - 30 and today group by all) join (select {s} as source, any_value(today) - min(day) as sample_days from {t}, n where day >= today - 30 and day < today group by 1) using (source))"
MATCHED_6H, MATCHED_24H = "(select m.* from m, n where t >= now - 21600)", "(select m.* from m, n where t >= now - 86400)"
RD_SUMS = ", ".join(f"sum({c}) as {c}" for c in ("spot_count", "snr_spots", *FLOORS))
BIN_COLUMNS = ", ".join(f"{b} as bin{k}" for k, b in enumerate(classify.snr_bins("snr_spots", FLOORS)))

TEXTS = {
    "raw_archive": f"select cast(t // 86400 as int) as day_index, source, {grid.square('sl')} as source_grid4, count(*) as n, min(t) as first_t from spots group by all",
    "raw_scan": f"select spot_id, t, source, {grid.square('sl')} as source_grid4, band, snr from spots, n where t between now - 7200 and now",
    "raw_targets": "select spot_id, sl, rl, sc, rc from spots, n where t >= now - 86400 and (starts_with(sl, 'JO31') or starts_with(rl, 'JO31') or sc in ('JO3', 'S17', 'R5') or rc in ('JO3', 'S17', 'R5'))",
    "live_window": "select source, band, count(*) as n from spots, n where t between now - 3600 and now group by all",
    "retention": "select day as day_index, sum(spot_count) as n from rd, n where day > today - 21 and (day > today - 14 or day > today - 18) group by all",
    "wspr_archive_totals": "select day, slot, count(*) as n from p where source = 'wspr' group by all",
    "wspr_archive": "select day, slot, band, s4 as rx4, r4 as tx4, count(*) as n, count(*) filter (where snr < -20) as bin0, count(*) filter (where snr >= -20 and snr < -15) as bin1, count(*) filter (where snr >= -15 and snr < -10) as bin2, count(*) filter (where snr >= -10 and snr < -5) as bin3, count(*) filter (where snr >= -5 and snr < 0) as bin4, count(*) filter (where snr >= 0) as bin5 from p where source = 'wspr' and (s4 in ('JO32', 'JO31', 'FN45') or r4 in ('JO32', 'JO31', 'FN45')) group by all",
    "wspr_dedup": "select band, count(*) as n from (select distinct t, band, sc, rc from spots where source = 'wspr') group by all",
    "spot_paths": f"select from_region, to_region, direction, {classify.distance_tier('km')} as distance_tier, {classify.snr_tier('snr')} as snr_tier, count(*) as n, {R('avg(km)', 3)} as avg_km from (select s_region as from_region, r_region as to_region, snr, km, case when not (s_lat = 0 and s_lon = 0) and not (r_lat = 0 and r_lon = 0) then {geo.direction8('deg')} else '' end as direction from (select *, {KM} as km, {geo.bearing_deg('s_lat', 's_lon', 'r_lat', 'r_lon')} as deg from p)) group by 1, 2, 3, 4, 5",
    "spot_grids": f"select s4, {grid.square_x('s4')} as x, {grid.square_y('s4')} as y, {grid.cluster_anchor('s4')} as anchor, {grid.latitude('s4')} as lat, {grid.longitude('s4')} as lon, region, s4 as again from (select distinct s4, s_region as region from p)",
    "power_budget": f"select band, txpower, {classify.almanac_tier_for('snr')} as tier, count(*) as n, max({bands.effective_snr('snr', 'txpower')}) as best from p where source = 'wspr' group by 1, 2, 3",
    "daylight": f"select qth, {geo.daylight('z')} as light, count(*) as n, {R('avg(z)', 4)} as zenith from (select *, {geo.solar_zenith('lat', 'lon', 't')} as z from {MATCHED_6H}) group by 1, 2",
    "global_baseline": "select * from gb",
    "cluster_baseline": "select * from cb",
    "merged_baseline": "select * from cb",
    "region_daily": "select * from rd",
    "ingest_slot_totals": "select * from ing",
    "wspr_daily": "select * from wd",
    "source_daily": "select * from sd",
    "season_counts": f"select target4 as grid4, band, region, {times.year_month('day')} as year_month, {times.day_of_month('day')} as dom, slot, {classify.saturating('spot_count')} as count, {BIN_COLUMNS} from rd where band in ({bands.listed(bands.ALMANAC_BANDS)})",
    "area_activity": f"select target4 as grid4, band, {times.year_month('day')} as year_month, cast(bit_or(1 << ({times.day_of_month('day')} - 1)) as int) as day_mask from rd where band in ({bands.listed(bands.ALMANAC_BANDS)}) group by 1, 2, 3",
    "baseline_span": "select * from span",
    "cluster_coverage": f"select {r6('coverage')} from cov",
    "baseline_fallback": "select * from pairs",
    "slot_rates": f"select anchor, band, slot, used_cluster, support, {r6('rate')} from rates",
    "baseline_quantiles": f"select anchor, band, slot, {R('min(score) filter (where upto >= total * 0.25)', 6)} as q25, {R('min(score) filter (where upto >= total * 0.75)', 6)} as q75 from (select *, sum(count) over (partition by anchor, band, slot order by score range unbounded preceding) as upto, sum(count) over (partition by anchor, band, slot) as total from (select *, {baselines.proxy_score()} as score from (select *, max(count) over (partition by anchor, band, slot) as most from pairs))) where total >= 200 group by all",
    "region_calendar": f"select area, band, region, slot, {R('quantile_cont(past, 0.25)', 6)} as p25, {R('quantile_cont(past, 0.5)', 6)} as p50, {R('quantile_cont(past, 0.75)', 6)} as p75, {R('avg(past)', 6)} as mean, {R('stddev_samp(past)', 6)} as sd, count(past) as active_days, coalesce(sum(spot_count) filter (where day = today), 0) as today from (select *, case when day < today then spot_count end as past from ad, n where day between today - 30 and today) group by area, band, region, slot",
    "source_calendar": f"select source, band, region, slot, sample_days, {r6('mean')}, {r6('sd')}, today from ({STATS.format(s='source', t='sd')})",
    "wspr_calendar": f"select band, region, slot, sample_days, {r6('mean')}, {r6('sd')}, today from ({STATS.format(s=chr(39) + 'wspr' + chr(39), t='wd')})",
    "from_here_curves": f"select area, band, region, slot, {R('cast(x as double) / days', 1)} as usual from (select area, band, region, slot, sum(spot_count) as x from ad group by all) join (select slot, count(*) as days from ing group by all) using (slot)",
    "match_spots": f"select qth, spot_id, remote, reporter, lat, lon, age from {MATCHED_6H}",
    "area_ends": "select area, spot_id, min(ring) filter (where side = 's') as s_ring, min(ring) filter (where side = 'r') as r_ring from (select spot_id, 's' as side, s4 as square from p, n where t >= now - 21600 union all select spot_id, 'r', r4 from p, n where t >= now - 21600) join (select area, square, ring from sq where ring <= rings) using (square) group by area, spot_id",
    "band_events": f"select qth, spot_id, band, remote4, direction, {r6('km')}, bucket from ev, n where t between now - 10800 and now",
    "from_here_ends": "select area, band, source, region, count(*) as n, count(distinct call) as stations from fh, n where t >= now - 21600 group by all",
    "cluster_ends": "select anchor, band, count(*) as n from ends group by all",
    "region_keys": "select target4, region, count(*) as n from (select distinct spot_id, target4, region from (select spot_id, s4 as target4, r_region as region from p union all select spot_id, r4, s_region from p) where target4 is not null and region <> '??') group by all",
    "call_locators": "select call, loc, seen from (select *, row_number() over (partition by call order by seen desc, loc desc) as nth from (select call, loc, max(t) as seen from (select sc as call, s4 as loc, t from p union all select rc, r4, t from p) where length(call) >= 3 group by all)) where nth = 1",
    "remote_counts": "select qth, band, source, region, from_here, count(*) as n from (select q.qth, band, source, coalesce(is_sender or is_receiver, false) as from_here, case when case when source in ('rbn', 'wspr') then is_sender else is_receiver end then case when source in ('rbn', 'wspr') then r_region else s_region end else case when source in ('rbn', 'wspr') then s_region else r_region end end as region from p cross join q left join hit h on h.qth = q.qth and h.spot_id = p.spot_id where t >= q.now - 3600) where region <> '??' group by all",
    "activity_by_bin": f"select qth, band, bin, {r6('rate')} from {BINS}",
    "azimuth_sectors": "select qth, band, direction, n, row_number() over (partition by qth, band order by n desc, list_position(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], direction)) = 1 as dominant from (select qth, band, direction, count(*) as n from " + SCORED.format(s=10800) + " where direction <> '' group by all)",
    "region_counts": "select qth, band, remote_region as region, count(*) as n from " + SCORED.format(s=10800) + " where remote_region <> '??' group by all",
    "regional_spots": f"select qth, band, count(*) as regional from ends join q on anchor = {grid.cluster_anchor('qth')} where {grid.is_locator('qth')} and calibrated and t between now - 3600 and now group by all",
    "band_features": "select qth, band, count(*) as links, count(distinct concat(sc, '|', rc, '|', remote)) as unique_links, count(distinct sc) as unique_tx, count(distinct rc) as unique_rx, count(distinct nullif(remote4, '')) as unique_grids, count(*) filter (where km >= 3000) as long_haul, cast(min(snr) filter (where rs >= ceil(0.5 * c)) as bigint) as median_snr, cast(min(snr) filter (where rs >= ceil(cast(0.9 as double) * c)) as bigint) as p90_snr, cast(max(snr) as bigint) as peak_snr, count(*) filter (where snr >= 0) as ssb_count, count(*) filter (where snr >= -12) as cw_count, "
    + f"{R('avg(km)', 6)} as avg_km, {R('min(km) filter (where rk >= ceil(0.5 * c))', 6)} as median_km, {R('min(km) filter (where rk >= ceil(cast(0.9 as double) * c))', 6)} as p90_km, {R('max(km)', 6)} as max_km, {R('avg(snr)', 6)} as avg_snr, {R(baselines.tier_p90([f'count(*) filter (where {classify.distance_tier("km")} = {k})' for k in range(5)]), 6)} as tiered_p90 from (select *, count(*) over (partition by qth, band) as c, row_number() over (partition by qth, band order by snr) as rs, row_number() over (partition by qth, band order by km) as rk from "
    + SCORED.format(s=3600)
    + ") group by qth, band",
    "from_here_trend": f"select g.area, g.band, g.region, cast(b as int) as bin, coalesce(c, 0) as n from (select distinct area, band, region from fh, n where source = 'mqtt' and {IN_SCOPE} and t > now - 3600 and t <= now) g cross join (select unnest(range(12)) as b) left join (select area, band, region, (t - now + 3600 - 1) // 300 as bin, count(*) as c from fh, n where source = 'mqtt' and {IN_SCOPE} and t > now - 3600 and t <= now group by all) x on x.area = g.area and x.band = g.band and x.region = g.region and x.bin = b",
    "square_details": f"select qth, square, spots, min_snr, max_snr, {R('s / cast(spots as double)', 6)} as avg_snr, bands, best_band from (select qth, square, cast(sum(n_band) as bigint) as spots, min(lo) as min_snr, max(hi) as max_snr, sum(sums) as s, count(*) as bands, arg_min(band, nth) as best_band from (select *, row_number() over (partition by qth, square order by n_band desc, band) as nth from (select qth, substr(remote, 1, 4) as square, band, count(*) as n_band, min(snr) as lo, max(snr) as hi, sum(snr) as sums from {MATCHED_24H} group by all)) group by all)",
    "top_reports": f"select qth, square, rank, sender, receiver, band, snr from (select *, row_number() over (partition by qth, square order by snr desc, band, sender, receiver) as rank from (select *, substr(remote, 1, 4) as square, row_number() over (partition by qth, substr(remote, 1, 4), sender, receiver, band order by t, spot_id) as nth from {MATCHED_24H}) where nth = 1) where rank <= 10",
    "grid_squares": f"select qth, square, any_value(c) as spots, {R('avg(snr) filter (where nth <= ceil(c / cast(4 as double)))', 6)} as top_quarter_snr from (select *, substr(remote, 1, 4) as square, row_number() over (partition by qth, substr(remote, 1, 4) order by snr desc, spot_id) as nth, count(*) over (partition by qth, substr(remote, 1, 4)) as c from {MATCHED_24H}) group by qth, square",
    "moments": "select qth, moment, count(*) as n, max(moment - t) as oldest from (select m.*, unnest(range(cast(ceil(t / cast(300 as double)) as bigint), cast(floor((t + 900) / cast(300 as double)) as bigint) + 1)) * 300 as moment from m, n where t >= now - 10800) group by all",
    "coverage_intervals": "select source, min(t) as t0, max(t) as t1, count(*) as n from (select *, sum(new) over (partition by source order by t range unbounded preceding) as island from (select source, t, case when t - lag(t) over (partition by source order by t, spot_id) <= 120 then 0 else 1 end as new from p)) group by source, island",
    "sessions": "select source, min(t) as t0, max(t) + 120 as t1, count(*) as n from (select *, sum(new) over (partition by source order by t range unbounded preceding) as island from (select source, t, case when t - lag(t) over (partition by source order by t, spot_id) <= 120 then 0 else 1 end as new from p)) group by source, island",
    "windowed_activity": "select t // 300 * 300 as t0, band, source, count(*) as n from p group by 1, 2, 3",
    "sliding_activity": "select t0, band, source, count(*) as n from (select *, (t // 300 - k) * 300 as t0 from p, n, (select unnest(range(3)) as k) where t >= now - 7200) group by all",
    "subscriptions": "select distinct qth, spot_id, is_sender from (select qth, spot_id, t, true as is_sender from p join tok on s4 = token or sc = token union all select qth, spot_id, t, false from p join tok on r4 = token or rc = token), n where t >= now - 3600",
    "density_points": f"select qth, band, {R('lat', 3)} as lat, {R('lon', 3)} as lon, count(*) as n, {R('sqrt(count(*))', 6)} as weight from {MATCHED_6H} group by 1, 2, 3, 4",
    "distance_snr": f"select qth, band, count(*) as samples, {R('any_value(cap)', 6)} as cap_km, count(*) filter (where km > cap) as clipped, least(-20, min(snr)) as low_snr, greatest(20, max(snr)) as high_snr from (select *, greatest(500, quantile_cont(km, 0.95) over (partition by qth)) as cap from (select qth, band, snr, {geo.haversine_km('lat0', 'lon0', 'lat', 'lon')} as km from (select *, {grid.latitude('qth')} as lat0, {grid.longitude('qth')} as lon0 from {MATCHED_24H} where {grid.is_locator('qth')}))) group by qth, band",
    "alive_mask": "select day, slot from alive, n where day <> today - 5",
    "active_slot_days": "select area, radius, band, day, count(*) as slots from act group by all",
    "known_slot_counts": "select * from known",
    "almanac_radius": "select * from rad",
    "almanac_lanes": "select * from lanes",
    "open_today": "select distinct area, band, region from inside, n where n.now is not null and inside.n >= 2 and (day = today and slot = now_slot or (now_slot > 0 and day = today and slot = now_slot - 1 or now_slot = 0 and day = today - 1 and slot = 47))",
    "season_tail": f"select day, band, sum(n_) as n, sum(s_) as snr_n, sum(g_) as ge_m10 from (select day, band, case when day <= today - 3 then least(spot_count, 255) else spot_count end as n_, case when day <= today - 3 then {' + '.join(classify.snr_bins('snr_spots', FLOORS))} else snr_spots end as s_, case when day <= today - 3 then {' + '.join(classify.snr_bins('snr_spots', FLOORS)[3:])} else snr_ge_m10 end as g_ from rd, n where day > today - 3 or band in ({bands.listed(bands.ALMANAC_BANDS)})) group by all",
    "wspr_covered": "select area, bool_and(square in (select s4 from p where source = 'wspr')) as covered from sq where ring <= 1 group by all",
    "untimely": "select cast(a // 86400 as int) as day, count(*) filter (where a - t > 86400) as late, count(*) filter (where a - t < -600) as early from (select t, case when spot_id % 11 = 0 then arrival + 90000 when spot_id % 13 = 0 then arrival - 2000 else arrival end as a from spots) group by 1",
    "ingest_report": "select source, count(*) as seen, count(*) filter (where spot_id % 7 <> 0) as parsed, count(distinct spot_id) filter (where spot_id % 7 <> 0) as kept, count(distinct spot_id) filter (where spot_id % 7 <> 0) as live_usable, 0 as no_locator, count(*) filter (where spot_id % 7 <> 0) - count(distinct spot_id) filter (where spot_id % 7 <> 0) as duplicate from (select source, spot_id from spots union all select source, spot_id from spots where spot_id % 5 = 0) group by all",
}

#: What the band table is made of.
TIERS = [f"count(*) filter (where {classify.distance_tier('km')} = {k})" for k in range(5)]
LOUD = f"{classify.snr_tier_max_db('snr_tier')} >= -15"
PARTS |= {
    "feat": f"select qth, band, count(*) as links, count(distinct concat(sc, '|', rc, '|', remote)) as unique_links, count(*) filter (where km >= 3000) as long_haul, min(km) filter (where rk >= ceil(cast(0.9 as double) * c)) as p90_km, min(snr) filter (where rs >= ceil(cast(0.9 as double) * c)) as p90_snr, count(*) filter (where snr >= 0) as ssb_count, count(*) filter (where snr >= -12) as cw_count, {baselines.tier_p90(TIERS)} as tiered_p90 from (select *, count(*) over (partition by qth, band) as c, row_number() over (partition by qth, band order by snr) as rs, row_number() over (partition by qth, band order by km) as rk from {SCORED.format(s=3600)}) group by qth, band",
    "segs": f"select qth, anchor, cast(k % 48 as int) as slot, least((k + 1) * 1800, now) - greatest(k * 1800, now - 3600) as seconds from (select qth, {grid.cluster_anchor('qth')} as anchor, now, unnest(range((now - 3600) // 1800, (now - 1) // 1800 + 1)) as k from q where {grid.is_locator('qth')})",
    "nsegs": "select qth, count(*) as slots from segs group by 1",
    "expd": "select qth, band, case when c = slots then x end as expected from (select qth, band, sum(rate * seconds / 60) as x, count(*) as c from segs join rates using (anchor, slot) where used_cluster group by all) join nsegs using (qth)",
    "slotted": "select qth, anchor, slot, seconds, band, sum(count) as all_n, " + ", ".join(f"coalesce(sum(count) filter (where {LOUD} and distance_tier = {k}), 0) as d{k}" for k in range(5)) + " from segs join (select cluster_anchor as anchor, band, slot, distance_tier, snr_tier, count from cb) using (anchor, slot) group by all",
    "reached": "select qth, band, p90 as baseline_p90, reach_support from (select qth, band, count(*) as c, sum(heard) as reach_support, " + baselines.tier_p90([f"sum(weight * d{k} / heard)" for k in range(5)]) + " as p90 from (select *, rate * seconds / 60 * heard / all_n as weight from (select *, d0 + d1 + d2 + d3 + d4 as heard from slotted) join (select anchor, band, slot, rate from rates where used_cluster) using (anchor, band, slot) where heard > 0) group by all) join nsegs using (qth) where c = slots",
    "quart": "select anchor, band, slot, min(score) filter (where upto >= total * 0.25) as q25, min(score) filter (where upto >= total * 0.75) as q75 from (select *, sum(count) over (partition by anchor, band, slot order by score range unbounded preceding) as upto, sum(count) over (partition by anchor, band, slot) as total from (select *, " + baselines.proxy_score() + " as score from (select *, max(count) over (partition by anchor, band, slot) as most from pairs))) where total >= 200 group by all",
    "region_ends": f"select qth, band, count(*) as regional from ends join q on anchor = {grid.cluster_anchor('qth')} where {grid.is_locator('qth')} and calibrated and t between now - 3600 and now group by all",
    "near_by": "select qth, band, count(*) as local from ev, n where snr >= -15 and t between now - 3600 and now group by all",
    "c1": f"select f.*, q.now, q.minutes, coalesce(local, 0) as local, coalesce(regional, 0) as regional, expected, baseline_p90, reach_support, coalesce(rate, 0) as baseline_rate, coalesce(support, 0) as baseline_support, coalesce(used_cluster, false) as used_cluster, q25, q75, {R('history_minutes * coverage')} as cluster_minutes from feat f join q using (qth) left join (select qth as lq, case when {grid.is_locator('qth')} then {grid.cluster_anchor('qth')} end as anchor from q) l on lq = f.qth left join rates r on r.anchor = l.anchor and r.band = f.band and r.slot = q.now % 86400 // 1800 left join quart u on u.anchor = l.anchor and u.band = f.band and u.slot = q.now % 86400 // 1800 left join near_by b on b.qth = f.qth and b.band = f.band left join region_ends e on e.qth = f.qth and e.band = f.band left join expd x on x.qth = f.qth and x.band = f.band left join reached z on z.qth = f.qth and z.band = f.band, span, cov",
    "c2": f"select *, case when trusted then {classify.activity_level('regional', 'expected')} else 'no_baseline' end as activity_level, case when trusted then regional / expected else 0 end as activity_ratio, case when links >= 20 and reach_support >= 100 and baseline_p90 > 0 then tiered_p90 / baseline_p90 else 0 end as reach_ratio, cast(long_haul as double) / links as dx_ratio, cast(links as double) / minutes as spots_per_minute from (select *, coalesce(expected > 0 and expected / minutes * greatest(cluster_minutes / 1440, 1) * 30 >= 100, false) as trusted from c1)",
    "c3": f"select *, case when reach_ratio > 0 then {classify.reach_level('reach_ratio')} else '' end as reach_level, cast(100 as double) * (0.45 * {numbers.clamp01('p90_km / 7000 * 0.7 + dx_ratio * 0.3')} + 0.35 * case when activity_level in ('above', 'normal', 'below') then {numbers.clamp01('activity_ratio / 2')} else 0.5 end + 0.20 * {numbers.clamp01('cast(p90_snr + 20 as double) / 30')}) as raw_score, {numbers.clamp01('links / 25.0')} * (0.35 + 0.65 * {numbers.clamp01('baseline_support / 2000.0')}) * case when q25 is null then 0.75 else 1 end as factor from c2",
    "c4": f"select *, {numbers.clamp('raw_score * factor', 0, 100)} as score, {numbers.clamp('100 * factor', 0, 99)} as confidence, {classify.spot_mode('ssb_count', 'cw_count', 'links')} as mode, {classify.band_status('((q25 + q75) / 2 + (raw_score - (q25 + q75) / 2) * factor)', 'q25', 'q75', 'links')} as status from c3",
    "cond": f"select *, {classify.condition_label('status', 'score')} as condition, {classify.recommendation('status', 'mode', 'dx_ratio', 'spots_per_minute', 'confidence')} as recommendation, cast(links - unique_links as double) / links as repeat_ratio, case when regional > 0 then cast(local as double) / regional else 0 end as local_scale from c4",
    "overall": f"select *, {classify.overall_status('score', 'confidence', 'bands')} as status from (select qth, {R('sum(score * links) / sum(links)', 1)} as score, {R('sum(confidence * links) / sum(links)', 1)} as confidence, count(*) as bands, count(*) filter (where status in ('green', 'yellow')) as usable from cond group by 1)",
}
TEXTS |= {
    "expected_counts": f"select qth, band, {r6('expected')} from expd",
    "reach_baseline": f"select qth, band, {r6('baseline_p90')}, reach_support from reached",
    "dx_conditions": "select qth, band, status, condition, mode, recommendation, activity_level, reach_level, " + ", ".join(r6(c) for c in ("score", "confidence", "repeat_ratio", "spots_per_minute", "dx_ratio", "baseline_rate", "activity_ratio")) + f", {r6('expected', 'regional_expected')}, {r6('local_scale')}, {r6('baseline_p90', 'baseline_p90_km')}, {r6('reach_ratio')}, links, regional as regional_spots, used_cluster from cond",
    "dx_overall": f"select *, {classify.condition_label('status', 'score')} as condition, case when status = 'grey' or confidence < 20 then 'unclear' when status = 'green' then 'go' when usable > 0 then 'selective' else 'wait' end as verdict, case when trend_delta > 0.2 then 'rising' when trend_delta < -0.2 then 'falling' else 'stable' end as trend from overall join (select qth, {R('sum(coalesce(trend_delta, 0) * links) / sum(links)', 2)} as trend_delta from cond left join trended using (qth, band) group by qth) using (qth)",
    "ranked_bands": "select qth, band, best_rank, worst_rank, best_rank <= 3 and status in ('green', 'yellow') as recommended, worst_rank <= 3 and confidence >= 30 and status in ('red', 'grey') as avoid from (select *, row_number() over (partition by qth order by score desc, confidence desc, band) as best_rank, row_number() over (partition by qth order by score, confidence desc, band) as worst_rank from cond) where best_rank <= 3 or worst_rank <= 3",
    "holding": f"select qth, band, {r6('spots_per_minute')}, status, activity_level from cond where (qth, band) in (('JO32', '20m'), ('JO32', '40m'), ('JO31', '2m'))",
}

#: What the nowcast and the maps are made of.
LEVEL = f"case when source = 'wspr' then case when txpower > 0 then {bands.effective_snr('snr', 'txpower')} end else snr end"
RISING = "case when early_n > 0 then cast(late_n as double) / early_n >= 1.5 else late_n > 0 end"
ISLANDS = TEXTS["coverage_intervals"]


def opened(cells: str) -> str:
    flags = ", ".join(f"case when {k}_floor is not null then coalesce(best_level >= {k}_floor, false) end as {k}_open" for k in ("ssb", "cw", "digital"))
    return f"select *, coalesce(ssb_open, false) or coalesce(cw_open, false) or coalesce(digital_open, false) as open, {RISING} as rising from (select c.*, k, name, {flags} from {cells} c join prof using (source))"


def density(matched: str) -> str:
    """Weights of points, spread to the corners of whole degrees within 400 km."""
    rows = "select *, greatest(111.32 * cos(radians((row + lat) / 2)), 1e-9) as km_lon from (select *, unnest(range(cast(ceil(greatest(lat - pad, -89)) as bigint), cast(floor(least(lat + pad, 89)) as bigint) + 1)) as row from (select *, cast(400 as double) / 110.57 as pad from points))"
    cells = f"select *, unnest(range(cast(ceil(greatest(lon - span, -180)) as bigint), cast(floor(least(lon + span, 180)) as bigint) + 1)) as col from (select *, least(cast(400 as double) / greatest(km_lon, 1), 180) as span from ({rows}))"
    return f"with points as ({TEXTS['density_points'].replace(MATCHED_6H, matched).replace(R('sqrt(count(*))', 6), 'sqrt(count(*))')}) select qth, band, row, col, sum(weight * exp(-dd / (2 * power(cast(400 as double) / 2.2, 2)))) as density from (select *, power((row - lat) * 110.57, 2) + power((col - lon) * km_lon, 2) as dd from ({cells})) where dd <= 160000 group by all"


PARTS |= {
    "bins12": BINS,
    "shape": f"select qth, band, bin, case when top > 0 then {R('rate / top * 100', 2)} else cast(0 as double) end as v from (select *, max(rate) over (partition by qth, band) as top from bins12)",
    "slopes": "select qth, band, sum(v) filter (where bin between 6 and 10) / 5 - sum(v) filter (where bin between 1 and 5) / 5 as slope, max(v) as top, case when max(v) filter (where bin = 11) < 30 then 10 else 11 end - coalesce(max(bin) filter (where v < 30 and bin <= 10), -1) as sustained from shape group by all",
    "trended": f"select qth, band, {classify.trend_word('slope', 6)} as trend, {R('slope / 10', 2)} as trend_delta, sustained, top from slopes",
    "prof": "select * from (values (0, 'wspr', 'wspr', 10, -5, null), (1, 'pskr', 'mqtt', -5, -18, -24), (2, 'rbn', 'rbn', null, 8, null)) v(k, name, source, ssb_floor, cw_floor, digital_floor)",
    "remote": f"select q.qth, band, source, t < q.now - 1800 as early, {LEVEL} as level, coalesce(is_sender or is_receiver, false) as from_here, case when case when source in ('rbn', 'wspr') then is_sender else is_receiver end then case when source in ('rbn', 'wspr') then r_region else s_region end else case when source in ('rbn', 'wspr') then s_region else r_region end end as region from p cross join q left join hit h on h.qth = q.qth and h.spot_id = p.spot_id where t between q.now - 3600 and q.now and {IN_SCOPE}",
    "cell0": "select qth, band, region, source, count(*) as spots, max(level) as best_level, bool_or(from_here) as from_here, count(*) filter (where early) as early_n, count(*) filter (where not early) as late_n from remote where region <> '??' group by all",
    "cell1": opened("cell0"),
    "cstat": f"select source, band, region, mean, sd, sample_days from ({STATS.format(s='source', t='sd')}), n where slot = now_slot",
    "cell2": "select *, coalesce(z0 >= 1, false) as atypical from (select c.*, sample_days, case when sd > 0 and sample_days >= 3 then (spots * cast(0.5 as double) - mean) / sd end as z0 from cell1 c left join cstat using (source, band, region))",
    "cell": f"select *, case when atypical then {R('z0', 3)} end as z, case when atypical then {R(classify.atypical_confidence('sample_days'), 3)} end as confidence from cell2",
    "roll": f"select qth, band, region, sum(spots) as spots, bool_or(from_here) as from_here, bool_or(open) as open, bool_or(coalesce(ssb_open, false)) as ssb_open, bool_or(coalesce(cw_open, false)) as cw_open, bool_or(rising) as rising, {R('cast(count(*) filter (where open) as double) / count(*)', 2)} as open_agreement, {R('cast(count(*) filter (where atypical) as double) / count(*)', 2)} as atypical_agreement, first(z order by confidence desc, z desc) filter (where atypical) as z, first(confidence order by confidence desc, z desc) filter (where atypical) as confidence, string_agg(name, ',' order by k) as sources from cell group by all",
    "near_ends": f"select area, band, region, source, count(*) as spots, max({LEVEL}) as best_level, count(distinct nullif(call, '')) as stations, count(*) filter (where t < now - 1350) as early_n, count(*) filter (where t >= now - 1350) as late_n from fh, n where t between now - 2700 and now and {IN_SCOPE} group by all",
    "near_cells": opened("near_ends"),
    "wseg": "select k % 48 as slot, k // 48 as slot_day, (least((k + 1) * 1800, now) - greatest(k * 1800, now - 2700)) / cast(1800 as double) as weight from (select now, unnest(range((now - 2700) // 1800, (now - 1) // 1800 + 1)) as k from n)",
    "wdays": "select back, slot, weight, day from (select *, slot_day - back as day from wseg, (select unnest(range(1, 29)) as back)) join ing using (day, slot)",
    "wbacks": "select back from wdays group by 1 having count(*) = (select count(*) from wseg)",
    "normals": "select area, band, region, expected, case when sample_days > 1 then sqrt(greatest(xx - sample_days * expected * expected, 0) / (sample_days - 1)) end as sd, sample_days from (select *, x / sample_days as expected from (select area, band, region, sum(x) as x, sum(x * x) as xx from (select area, band, region, back, sum(spot_count * weight) as x from wdays join wbacks using (back) join ad using (day, slot) group by all) group by all), (select count(*) as sample_days from wbacks))",
    "usual": f"select *, m >= {almanac.ACTIVE_DAYS} and n >= cast({almanac.USUAL} as double) * m as usual from lanes",
    "bridged": "select area, band, region, slot, usual or (coalesce(lag(usual) over w, bool_or(usual and slot = 47) over k) and coalesce(lead(usual) over w, bool_or(usual and slot = 0) over k)) as lit from usual window w as (partition by area, band, region order by slot), k as (partition by area, band, region)",
    "runs": "select area, band, region, cast(start as int) as start, cast(least(len, 48) as int) as len from (select area, band, region, min(pos) as start, count(*) as len from (select *, pos - row_number() over (partition by area, band, region order by pos) as island from (select *, slot + 48 * copy as pos from bridged, (select unnest(range(2)) as copy) where lit)) group by area, band, region, island) r join (select area, band, region, lit as last_lit from bridged where slot = 47) using (area, band, region) where len >= 48 and start = 0 or len < 48 and start < 48 and not (start = 0 and last_lit)",
    "late_sd": PARTS["sd"].replace("from p)", "from p, n where t > now - 432000)"),
    "hot0": f"select c.*, coalesce(trend, 'stable') as trend, coalesce(trend_delta, 0) as trend_delta, coalesce(sustained, 0) as sustained, history_minutes, activity_level in ('above', 'normal', 'below') as judged from cond c left join trended using (qth, band), span where {IN_SCOPE} and (qth, band) <> ('JO32', '20m') and (qth <> 'JO31' or band in ('40m', '15m', '10m', '17m'))",
    "hot1": f"select *, case when judged then {R('activity_ratio', 2)} when baseline_rate > 0 then spots_per_minute / baseline_rate else 0 end as ratio, used_cluster and history_minutes >= 1440 as known, baseline_rate * minutes as mean_n from hot0",
    "hot2": "select *, case when known and baseline_rate > 0 and baseline_rate <= 0.1 and ratio >= 5 and p90_km >= 800 and (judged or 1 - list_sum([exp(i * ln(mean_n) - mean_n - lgamma(i + 1)) for i in range(links)]) < 0.01) then 'surprise' when known and reach_level = 'longer' and reach_ratio >= 1.5 and p90_km >= 5000 then 'dx_surge' when trend = 'rising' and trend_delta >= 1.5 and status in ('yellow', 'green') and ratio >= 1.5 and sustained >= 3 and spots_per_minute >= 1 then 'rising' end as kind from hot1 where sustained >= 2 and spots_per_minute >= 0.5",
}
FLAGS = "case when ssb_open then 1 else 0 end + case when cw_open then 2 else 0 end + case when rising then 4 else 0 end + case when z is not null then 8 else 0 end + case when from_here then 16 else 0 end"
RING = "('JO32', 'JO31', 'FN45')"
PARTS |= {
    "la_c": f"select qth, substr(qth, 1, 4) as centre, case when surroundings then 1 else 0 end as base_radius from q where {grid.is_locator('qth')}",
    "la_blocks": f"select qth, {grid.square_at('x + dx', 'y + dy')} as square, greatest(abs(dx), abs(dy)) as ring from (select qth, {grid.square_x('centre')} as x, {grid.square_y('centre')} as y from la_c), (select unnest(range(-3, 4)) as dx), (select unnest(range(-3, 4)) as dy)",
    "la_near": f"select p.* from p, n where t between now - 1200 and now and calibrated and s4 is not null and r4 is not null and snr >= -15 and {IN_SCOPE}",
    "la_links": "select qth, spot_id, band, min(ring) as ring from (select * from la_near join la_blocks on s4 = square union all select * from la_near join la_blocks on r4 = square) group by all",
    "la_counts": "select qth, radius, count(*) filter (where c >= 25) as full_bands, sum(c) as total from (select qth, band, radius, count(*) as c from la_links, (select unnest(range(4)) as radius) where ring <= radius group by all) group by all",
    "la": "select *, radius > base_radius as widened from (select qth, centre, base_radius, cast(case when coalesce((select total from la_counts x where x.qth = c.qth and radius = 3), 0) < 25 then base_radius else coalesce((select min(radius) from la_counts x where x.qth = c.qth and full_bands >= 3 and radius >= base_radius), 3) end as int) as radius from la_c c)",
    "asked": "select q.*, mins from q join (values ('JO32', 15), ('JO31', 60), ('FN45', 30), ('S17', 30)) v(name, mins) on name = qth",
    "wremote": PARTS["remote"].replace("t < q.now - 1800", "t < q.now - mins * 30").replace("between q.now - 3600 and", "between q.now - mins * 60 and").replace("cross join q ", "cross join asked q "),
    "wcell0": PARTS["cell0"].replace("from remote", "from wremote"),
    "wcell1": opened("wcell0"),
}
LISTED = bands.listed(bands.ALMANAC_BANDS)
TEXTS |= {
    "trends": "select qth, band, trend, trend_delta, sustained, top from trended",
    "dx_overall_enabled": f"select qth, score, confidence, bands, {classify.overall_status('score', 'confidence', 'bands')} as status from (select qth, {R('sum(score * links) / sum(links)', 1)} as score, {R('sum(confidence * links) / sum(links)', 1)} as confidence, count(*) as bands from cond where band in ('40m', '20m', '15m') group by 1)",
    "hot_bands": "select qth, rank, band, kind, case when kind = 'surprise' then 'high' else 'normal' end as priority, sustained, trend, status from (select *, row_number() over (partition by qth order by case kind when 'surprise' then 0 when 'dx_surge' then 1 else 2 end, case kind when 'surprise' then ratio when 'dx_surge' then reach_ratio else score end desc, band) as rank from hot2 where kind is not null) where rank <= 5",
    "live_area": "select * from la",
    "widened_bands": "select qth, band, count(*) filter (where ring <= base_radius) as base_links, widened and count(*) filter (where ring <= base_radius) < 25 as area_widened from la_links join la using (qth) group by qth, band, widened",
    "band_details": f"select f.qth, f.band, dominant, sectors, regions, {R('coalesce(usual, 0)', 6)} as usual, cast(coalesce(own_slots, 0) as int) as own_slots, {r6('peak')}, coalesce(area_widened, false) as area_widened from feat f left join (select qth, case when {grid.is_locator('qth')} then {grid.cluster_anchor('qth')} end as anchor from q) l on l.qth = f.qth left join (select qth, band, string_agg(direction || ':' || n, ',' order by direction) as sectors, first(direction order by n desc, list_position(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], direction)) as dominant from (select qth, band, direction, count(*) as n from {SCORED.format(s=3600)} where direction <> '' group by all) group by all) s on s.qth = f.qth and s.band = f.band left join (select qth, band, string_agg(region || ':' || n, ',' order by region) as regions from (select qth, band, remote_region as region, count(*) as n from {SCORED.format(s=3600)} where remote_region <> '??' group by all) group by all) g on g.qth = f.qth and g.band = f.band left join (select anchor, band, sum(rate) as usual, count(*) filter (where used_cluster) as own_slots from rates group by all) r on r.anchor = l.anchor and r.band = f.band left join (select qth, band, max(rate) as peak from bins12 group by all) b on b.qth = f.qth and b.band = f.band left join ({{WIDENED}}) w on w.qth = f.qth and w.band = f.band",
    "prop_cells_v1": "select qth, band, region, spots, best_level, coalesce(best_level >= 10, false) as ssb_open, coalesce(best_level >= -8, false) as cw_open, rising, from_here from cell1 where source = 'wspr'",
    "prop_cells_v2": "select qth, band, region, name as source, spots, best_level, from_here, ssb_open, cw_open, open, rising, atypical, z, confidence from cell",
    "prop_rollup": "select qth, band, region, spots, from_here, open, rising, open_agreement, atypical_agreement, sources from roll",
    "prop_summary": f"select qth, band, region, spots, {R('cast(spots as double) / most', 2)} as intensity, {FLAGS} as flags, band_spots, dense_rank() over (partition by qth order by band_spots desc, band) as band_rank from (select *, max(spots) over (partition by qth) as most, sum(spots) over (partition by qth, band) as band_spots from roll)",
    "prop_headline": "select q.qth, coalesce(kind, 'quiet') as kind, coalesce(text, '0 bands active, none rising') as text from q left join (select qth, case when z is not null then 'atypical' when rising then 'rising' else 'quiet' end as kind, case when z is not null then concat(band, ' atypical surge to ', coalesce(label, region), ' (z=', format('{:.1f}', z), ')') when rising then concat(band, ' rising toward ', coalesce(label, region)) else concat(n_bands, ' bands active, none rising') end as text from (select *, row_number() over (partition by qth order by z is null, confidence desc nulls last, z desc nulls last, not rising, not (ssb_open or cw_open), spots desc, band, region) as nth, (select count(distinct band) from roll b where b.qth = a.qth) as n_bands from roll a) left join (values ('EU', 'Europe'), ('NA', 'North America'), ('SA', 'South America'), ('AF', 'Africa'), ('AS', 'Asia'), ('OC', 'Oceania'), ('AN', 'Antarctica'), ('JA', 'Japan'), ('VK', 'Australia'), ('KH6', 'Hawaii'), ('CAR', 'Caribbean')) names(code, label) on code = region where nth = 1) h using (qth)",
    "prop_top_bands": "select qth, rank, band, regions, ssb, cw, rising, spots from (select *, row_number() over (partition by qth order by spots desc, band) as rank from (select qth, band, string_agg(region, ',' order by spots desc, region) as regions, bool_or(ssb_open) as ssb, bool_or(cw_open) as cw, bool_or(rising) as rising, cast(sum(spots) as bigint) as spots from roll group by all)) where rank <= 4",
    "prop_cells_windows": "select qth, band, region, name as source, spots, best_level, from_here, open, rising from wcell1",
    "prop_flavor": f"select qth, c.band, c.region, atypical, case when atypical then {classify.flavor('d_days', 'd_mean', 'd_sd', 'd_today', '(now % 1800 / cast(1800 as double))')} end as flavor from cell c left join (select band, region, avg(past) as d_mean, stddev_samp(past) as d_sd, count(past) as d_days, coalesce(sum(spot_count) filter (where day = today), 0) as d_today from (select *, case when day < today then spot_count end as past from sd, n where source = 'mqtt' and day between today - 30 and today and slot = now_slot) group by 1, 2) d on d.band = c.band and d.region = c.region, n where source = 'wspr'",
    "from_here_cells": "select area, band, region, name as source, spots, stations, best_level, ssb_open, cw_open, open, rising from near_cells",
    "from_here_normals": f"select area, band, region, {r6('expected')}, {r6('sd')}, sample_days from normals",
    "from_here_surges": f"select area, band, region, spots, stations, {R('expected', 1)} as expected, surge, silent from (select c.area, c.band, c.region, spots, stations, coalesce(expected, 0) as expected, coalesce(case when sd > 0 and spots >= 5 and stations >= 3 then (spots - coalesce(expected, 0)) / sd end >= 1, false) as surge, false as silent from near_cells c left join (select * from normals where sample_days >= 3) m using (area, band, region) where source = 'mqtt' and c.area in (select area from normals where sample_days >= 3) union all select area, band, region, 0, 0, expected, false, true from normals m where sample_days >= 3 and expected >= 5 and not exists (select 1 from near_cells c where c.area = m.area and c.band = m.band and c.region = m.region))",
    "history": "select qth, spot_id, t, truncated from (select m.*, row_number() over (partition by qth order by t desc, spot_id desc) as nth, count(*) over (partition by qth) > 50000 as truncated from m, n where t between now - 86400 and now and (source = 'wspr' or source = 'mqtt' and snr >= -15)) where nth <= 50000",
    "covers": f"with spans as ({ISLANDS}), ends_ as (select source, max(t1) as last_t from spans group by 1) select source, a.t0, a.t1, exists (select 1 from spans i where i.source = a.source and i.t0 <= a.t0 and i.t1 >= least(a.t1, last_t) and a.t0 <= last_t) as covered from (select source, now - b as t0, now - a as t1 from n, (values ('mqtt'), ('wspr'), ('rbn')) s(source), (values (0, 60), (0, 3600), (-500, 100), (-900, -300), (7000, 7200)) v(a, b)) a left join ends_ using (source)",
    "activity_vs_normal": f"select qth, band, bin, slot, {r6('rate')}, {R('coalesce(usual, 0) * coalesce(local_scale, 0)', 6)} as normal from (select b.*, now, case when {grid.is_locator('b.qth')} then {grid.cluster_anchor('b.qth')} end as anchor, cast((now - 3600 + bin * 300) % 86400 // 1800 as int) as slot from bins12 b join q using (qth)) left join (select anchor, band, slot, rate as usual from rates) using (anchor, band, slot) left join (select qth, band, local_scale from cond) using (qth, band)",
    "band_density": f"select qth, band, row, col, {R('density', 5)} as density from ({density(MATCHED_6H)})",
    "territory": f"select qth, row, col, band, part from (select *, case when nth = 1 then case when density >= 5 then 'core' else 'territory' end when density >= top * cast(0.6 as double) then 'hatch' end as part from (select *, row_number() over (partition by qth, row, col order by density desc, band) as nth, max(density) over (partition by qth, row, col) as top from ({density(MATCHED_24H)})) where density >= 1.5) where part is not null",
    "lone_points": f"select d.qth, d.band, lat, lon, n from ({TEXTS['density_points']}) d left join ({density(MATCHED_6H)}) c on c.qth = d.qth and c.band = d.band and row = floor(lat + 0.5) and col = floor(lon + 0.5) where coalesce(density, 0) < 1.5",
    "almanac_snr_lanes": f"with since as (select days.* from days, n where day >= today - 20), hits as (select area, band, region, slot, count(*) filter (where ge_m10 >= 2) as n_, sum(ge_m10) as ge, sum(snr_n) as of_ from inside join since using (area, band, day, slot) group by all) select l.area, l.band, l.region, l.slot, coalesce(n_, 0) as n, coalesce(h.m, 0) as m, {numbers.share_code('coalesce(ge, 0)', 'coalesce(of_, 0)')} as share, cast(least({almanac.ACTIVE_DAYS}, greatest({almanac.LEAST_DAYS}, coalesce(covered, 0))) as int) as m_min from lanes l left join (select area, band, slot, count(*) as m from since group by all) h using (area, band, slot) left join hits x on x.area = l.area and x.band = l.band and x.region = l.region and x.slot = l.slot left join (select area, count(distinct day) as covered from since group by 1) c on c.area = l.area",
    "usual_windows": "select * from runs",
    "live_segments": "select m.qth, t0, count(*) as n from m join (select qth, now - 3600 + a as t0, now - 3600 + b as t1 from q join (values ('JO32', 0, 600), ('JO32', 1500, 3600), ('JO31', 800, 3600), ('FN45', 0, 3600), ('S17', 0, 3600)) v(name, a, b) on name = qth) x on x.qth = m.qth and t >= t0 and t < t1 group by all",
    "backfill_source_daily": "select band, source, slot, region, day, spot_count + 1000 as spot_count from late_sd union all select * from sd s where not exists (select 1 from late_sd l where l.band = s.band and l.source = s.source and l.slot = s.slot and l.region = s.region and l.day = s.day)",
    "snr_backfill": "select day, band, sum(spot_count) as spot_count, " + ", ".join(f"coalesce(sum(least({c}, spot_count)) filter (where day in (select day from (select day, row_number() over (order by day desc) as k from (select distinct day from rd, n where day >= today - 6 and day < today - 2)), n where today - 2 - day = k)), 0) as {c}" for c in ("snr_spots", *FLOORS)) + " from rd group by all",
    "wspr_backfill": f"select grid4, band, region, {times.day_of_month('day')} as dom, slot, cast(least(count(*), 255) as int) as count, " + ", ".join(f"cast(least(count(*) filter (where snr >= {lo} and snr < {lo + w}), 255) as int) as bin{k}" for k, (lo, w) in enumerate([(-1000, 980), (-20, 5), (-15, 5), (-10, 5), (-5, 5), (0, 1000)])) + f" from (select s4 as grid4, r_region as region, band, day, slot, snr from p where source = 'wspr' union all select r4, s_region, band, day, slot, snr from p where source = 'wspr'), n where grid4 in {RING} and region <> '??' and band in ({LISTED}) and {times.year_month('day')} = {times.year_month('today')} group by grid4, band, region, day, slot",
}

TEXTS["band_details"] = TEXTS["band_details"].replace("{WIDENED}", TEXTS["widened_bands"])

TEXTS |= {
    "read_pskr": "select t, arrival, sl, rl, sc, rc, band, snr, mode from spots where source = 'mqtt'",
    "read_rbn": "select t, concat(sc, '-#') as sc, rc, band, abs(snr) as snr, 'CW' as mode from spots where source = 'rbn' and spot_id % 11 <> 0",
    "read_wspr": "select t, band, sl, rl, sc, rc, snr, cast(case band when '80m' then 3525 when '40m' then 7012.5 when '30m' then 10110 when '20m' then 14025 when '17m' then 18080 when '15m' then 21025 when '10m' then 28025 else 144050 end as double) as freq_khz, txpower from spots where source = 'wspr'",
    "skimmer_list": "select call, loc as grid from (" + TEXTS["call_locators"] + ")",
    "enrich_rbn": "with known as (" + TEXTS["call_locators"] + ") select a.loc as sl, b.loc as rl, case when length(sc) = 4 then 'list' when a.loc is not null then 'cache' else 'missing' end as skimmer_from, count(*) as n from spots left join known a on a.call = sc and a.seen >= (select now from n) - 604800 left join known b on b.call = rc and b.seen >= (select now from n) - 604800 where source = 'rbn' group by all",
    "fold_season": f"select band, region, {times.year_month('day')} as year_month, {times.day_of_month('day')} as dom, count(*) as cells, sum(least(spot_count, 255)) as n from rd, n where day <= today - 2 and band in ({LISTED}) group by 1, 2, 3, 4",
    "ingest_seed": "select day, slot, 'pskr' as layer, max(x) as spot_total from (select day, slot, case when slot % 3 = 1 then spot_total // 2 else spot_total + 5 end as x from ing where slot % 3 > 0 union all select day, slot, spot_total from ing, n where day between today - 20 and today - 2) group by all",
}

_FOLDED = f"from rd, n where day <= today - 2 and band in ({LISTED})"
_YM, _DOM = times.year_month("day"), times.day_of_month("day")
TEXTS |= {
    "fold_activity": f"select target4 as grid4, band, {_YM} as year_month, 'pskr' as layer, cast(bit_or(1 << ({_DOM} - 1)) as int) as day_mask {_FOLDED} group by 1, 2, 3",
    "fold_ingest": "select day, slot, 'pskr' as layer, spot_total from ing, n where day <= today - 2",
    "fold_lost": "select cast(today - k as int) as day_index, 'forced' as reason, now as recorded_at from n, (select unnest([0, 1]) as k)",
    "part_day_season": f"select target4 as grid4, band, region, {_DOM} as dom, slot, cast(least(spot_count, 255) as int) as count from rd, n where day = today - 4 and band in ({LISTED})",
    "snr_refold": f"select target4 as grid4, band, region, {_DOM} as dom, slot, {classify.saturating('spot_count')} as count, " + ", ".join(f"case when day >= today - 6 then {b} else 0 end as bin{k}" for k, b in enumerate(classify.snr_bins("snr_spots", FLOORS))) + f" {_FOLDED} and day >= today - 12",
    "rebuild_region_daily": "select * from rd",
    "rebuild_cluster_baseline": "select cb.*, first_t as first_observed from cb, span",
    "wspr_backfill_activity": f"select grid4, band, {times.year_month('today')} as year_month, cast(bit_or(1 << (dom - 1)) as int) as day_mask from (" + TEXTS["wspr_backfill"] + "), n group by 1, 2, 3",
    "wspr_backfill_ingest": f"select day, slot, n * 2 as spot_total from (" + TEXTS["wspr_archive_totals"] + f") x where {_YM} = (select {times.year_month('today')} from n)",
}

# The band table where something wasn't recorded: the live parts of each window, spelled out, in place of the hour.
PARTS |= {
    "live": "select q.qth, now - x as a, now - y as b, y = 0 as ends, piece, pieces from q join (values ('JO32', 3600, 2400, 0, 2), ('JO32', 1200, 0, 1, 2), ('JO31', 3000, 1500, 0, 2), ('JO31', 900, 0, 1, 2), ('FN45', 1500, 0, 0, 1), ('S17', 3600, 0, 0, 1)) v(name, x, y, piece, pieces) on name = qth",
    "lived": "select qth, sum(b - a) / cast(60 as double) as live_minutes from live group by qth",
    "evg": "select ev.* from ev join live on live.qth = ev.qth and t >= a and (t < b or ends and t = b)",
    "featg": PARTS["feat"].replace("from ev,", "from evg,"),
    "psegs": f"select qth, anchor, piece, pieces, cast(k % 48 as int) as slot, least((k + 1) * 1800, b) - greatest(k * 1800, a) as seconds from (select qth, {grid.cluster_anchor('qth')} as anchor, a, b, piece, pieces, unnest(range(a // 1800, (b - 1) // 1800 + 1)) as k from live where {grid.is_locator('qth')})",
    "expdg": "select qth, band, case when count(*) filter (where c = n_slots) = pieces then sum(x) end as expected from (select qth, piece, pieces, band, sum(rate * seconds / 60) as x, count(*) as c from psegs join rates using (anchor, slot) where used_cluster group by all) join (select qth, piece, count(*) as n_slots from psegs group by all) using (qth, piece) group by qth, band, pieces",
    "segsg": PARTS["segs"].replace("now - 3600", "(case qth when 'FN45' then now - 1500 else now - 3600 end)"),
    "nsegsg": "select qth, count(*) as slots from segsg group by 1",
    "slottedg": PARTS["slotted"].replace("from segs ", "from segsg "),
    "reachedg": PARTS["reached"].replace("from slotted", "from slottedg").replace("join nsegs ", "join nsegsg "),
    "region_endsg": f"select qth, band, count(*) as regional from ends join live on anchor = {grid.cluster_anchor('qth')} and t >= a and (t < b or ends and t = b) where {grid.is_locator('qth')} and calibrated group by all".replace("or ends and", "or live.ends and"),
    "near_byg": PARTS["near_by"].replace("from ev,", "from evg,"),
    "c1g": PARTS["c1"].replace("q.minutes,", "live_minutes as minutes,").replace("from feat f", "from featg f join lived using (qth)").replace("join near_by ", "join near_byg ").replace("join region_ends ", "join region_endsg ").replace("join expd ", "join expdg ").replace("join reached ", "join reachedg "),
    "c2g": PARTS["c2"].replace("from c1)", "from c1g)"),
    "c3g": PARTS["c3"].replace("from c2", "from c2g"),
    "c4g": PARTS["c4"].replace("from c3", "from c3g"),
    "condg": PARTS["cond"].replace("from c4", "from c4g"),
}
TEXTS |= {
    "dx_conditions_gap": TEXTS["dx_conditions"].replace(" from cond", ", " + r6("minutes", "live_minutes") + " from condg"),
    "segments": "select live.qth, b - a as seconds, a as t0, piece as segment, pieces as segments, " + r6("live_minutes") + " from live join lived using (qth)",
    "prop_from_here": "select qth, band, region, sum(spots) as spots, count(*) as sources from cell where from_here group by all",
}

_M24 = f"(select *, substr(remote, 1, 4) as square from {MATCHED_24H} where length(remote) >= 4)"
_NEW_CB = "select anchor, band, slot, distance_tier, snr_tier, count(*) as count, true as used_cluster from eends, n where day >= today - 5 and anchor in (select anchor from anchors) group by all"
_NEW_PAIRS = f"(select * from nown union all select anchor, band, slot, distance_tier, snr_tier, count, false from gb, anchors where not exists (select 1 from nown o where o.anchor = anchors.anchor and o.band = gb.band and o.slot = gb.slot))"
_DELIVERED = "(values ('a', 'JO32', 0, null, false, false, '', null, null), ('b', 'JO31', 1, ['20m', '40m'], true, false, 'ssb', 0, -15), ('c', 'S17', 0, null, false, true, 'cw', 5, -12), ('d', 'FN45', 0, ['2m'], false, false, '', null, null), ('e', 'JO31', 1, null, true, true, 'cw', 0, -15)) s(client, name, r, bands, no_rbn, no_wspr, mode, ssb, cw)"
_LAGGED = "(select t, arrival + 240 as arrival from spots where source = 'mqtt')"
PARTS |= {
    "nown": _NEW_CB,
    "ncov": "select coalesce(least(cast(now - cf as double) / nullif(now - first_t, 0), 1), 1) as by_span, least(cast((select count(*) from eends, n where day >= today - 5) as double) / (2 * (select sum(count) from gb)), 1) as by_counts from n, span, (select min(t) as cf from elig, n where day >= today - 5)",
    "lagm": f"select arrival // 60 as minute, least(greatest(arrival - t, 0) // 15, 239) as bucket, count(*) as n, max(arrival) as last from {_LAGGED} where t > 0 and arrival > 0 group by all",
    "lagq": "select minute, min(bucket) filter (where upto >= greatest(floor(total * cast(0.10 as double) + 0.5), 1)) * 15 as q, any_value(head) as head, any_value(total) as total from (select minute, bucket, sum(n) over (partition by minute) as total, sum(n) over (partition by minute order by bucket) as upto, max(last) over (partition by minute) as head from lagm) group by minute",
    "laga": "select now + d as asked_at from n, (select unnest([0, 60, 200, 900, 5000]) as d)",
    "lagfresh": "select asked_at, min(bucket) filter (where upto >= greatest(floor(total * cast(0.10 as double) + 0.5), 1)) * 15 as q from (select asked_at, bucket, sum(c) over (partition by asked_at) as total, sum(c) over (partition by asked_at order by bucket) as upto from (select asked_at, bucket, sum(n) as c from laga join lagm on minute in (asked_at // 60, asked_at // 60 - 1) group by all)) where total >= 50 group by asked_at",
    "lagstale": "select asked_at, arg_max(case when total >= 50 then head - q end, case when total >= 50 and minute < asked_at // 60 - 1 then minute end) as head from (select asked_at, minute, q, head, total, row_number() over (partition by asked_at, minute % 2 order by minute desc) as k from laga join lagq on minute <= asked_at // 60) where k = 1 group by asked_at",
    "lag": "select asked_at as now, coalesce(q, case when head > 0 and asked_at >= head then asked_at - head end, 0) as lag, q is not null as fresh from laga left join lagfresh using (asked_at) left join lagstale using (asked_at)",
}
TEXTS |= {
    "count_raw": "select h as hours, count(*) as n from spots, n, (select unnest([1, 24]) as h) where t between now - 3600 * h and now group by h",
    "country_file": "select token, 'Land ' || p as name, 'EU' as continent, 40.5 + cast(substr(p, 2, 1) as int)::double as lat, -(cast(substr(p, 2, 1) as int) * 10 + 0.25)::double as lon, p as primary_prefix, whole from (select distinct sc as token, substr(sc, 1, 2) as p, true as whole from p where length(sc) >= 2 union all select distinct substr(sc, 1, 2), substr(sc, 1, 2), false from p where length(sc) >= 2)",
    "old_snapshots": "select band, cast(slot // 2 * 2 as int) as slot, distance_tier, snr_tier, sum(count) as count from gb group by all",
    "old_climatology": "select band, source, slot, region, day, spot_count + 7 as spot_count from sd where day % 2 = 0 union all select band, 'wspr', slot, region, day, spot_count from wd where not exists (select 1 from sd where sd.day % 2 = 0 and sd.source = 'wspr' and sd.band = wd.band and sd.slot = wd.slot and sd.region = wd.region and sd.day = wd.day)",
    "classified_names": f"select name, {classify.classify_qth('name', 'regexp_matches')} as kind from (select distinct unnest([sl, rc, sl || 'AB', sl || 'Z', 'Z' || sl, rc || '/P', ' ' || lower(sl), substr(sl, 1, 3), '', '!!']) as name from p)",
    "grid_squares": "select * from (" + TEXTS["grid_squares"] + f") x join (select qth, square, string_agg(band || ':' || c, ',' order by band) as bands, first(band order by c desc, band) as dominant from (select qth, square, band, count(*) as c from {_M24} group by all) group by qth, square) y using (qth, square)",
    "distinct_spots": f"select qth, spot_id, t, band, sender, receiver, remote, snr from (select *, row_number() over (partition by qth, source, band, sender, receiver, remote, reporter, lat, lon, snr, t order by spot_id) as k from {MATCHED_6H}) where k = 1",
    "surge_strength": f"select qth, band, region, {classify.surge_strength('z', 'atypical_agreement')} as strength, z from roll where z is not null",
    "almanac_snr_lanes": f"select *, {numbers.share_value('share')} as part from (" + TEXTS["almanac_snr_lanes"] + ") x",
    "recent_spots": "select square, band, count(*) as n, max(t) as newest from (select t, band, unnest(list_distinct(list_filter([s4, r4], lambda x: x is not null))) as square from p where band <> ''), n where (t // 60 + 61) * 60 > now group by all",
    "delivered": f"select client, qth, spot_id, t, band, snr, bool_or(sends) as is_sender, bool_or(not sends) as is_receiver from (select s.*, p.*, q.qth, s4 = token or sc = token as sends from p, n, {_DELIVERED} join q on q.qth = s.name join tok on tok.qth = q.qth where (s4 = token or sc = token) and t between n.now - 3600 and n.now union all select s.*, p.*, q.qth, false from p, n, {_DELIVERED} join q on q.qth = s.name join tok on tok.qth = q.qth where (r4 = token or rc = token) and t between n.now - 3600 and n.now) where not (source = 'rbn' and no_rbn) and not (source = 'wspr' and no_wspr) and (bands is null or list_contains(bands, lower(band))) and (source = 'wspr' or case mode when 'ssb' then snr >= ssb when 'cw' then snr >= cw else true end) group by client, qth, spot_id, t, band, snr",
    "maintained_baseline": "select * from gb",
    "span_coverage": f"select anchor, band, slot, used_cluster, support, {R('support / (greatest(minutes / 1440, 1) * cast(30 as double))', 6)} as rate, k as way from (select anchor, band, slot, used_cluster, sum(count) as support, case when used_cluster then {R('history_minutes * case when k = $span$span$span$ then by_span else by_counts end')} else cast(history_minutes as double) end as minutes, k from {_NEW_PAIRS}, span, ncov, (select unnest(['span', 'counts']) as k) group by anchor, band, slot, used_cluster, history_minutes, by_span, by_counts, k)".replace("$span$span$span$", "'span'"),
    "feed_lag": "select now, lag, fresh, now - case when lag < 120 or lag > 1800 then 0 else least(lag, 2640) end as eval_now from lag",
}

# Windows of the almanac, with two spots for an open path and with one.
for _one, _spots in (("", "2"), ("1", "1")):
    _own = lambda text, one=_one: text.replace(" from lanes", f" from lanes{one}").replace(" from usual ", f" from usual{one} ").replace(" from bridged", f" from bridged{one}")
    if _one:
        PARTS["lanes1"] = PARTS["lanes"].replace("n >= 2", "n >= 1")
        TEXTS["open_today_one"] = TEXTS["open_today"].replace("inside.n >= 2", "inside.n >= 1")
        PARTS |= {k + _one: _own(PARTS[k]) for k in ("usual", "bridged", "runs")}
        TEXTS["usual_windows_one"] = "select * from runs1"
    _name = "_one" if _one else ""
    PARTS |= {
        f"ag{_one}a": f"select *, case when ongoing then 0 else (start * 30 - minute + 1440) % 1440 end as starts_in from (select *, (now_slot - start + 48) % 48 < len as ongoing, now % 86400 // 60 as minute from runs{_one}, n)",
        f"ag{_one}p": f"select area, band, region, start, slot as peak_slot, n as peak_n, m as peak_m from (select r.area, r.band, r.region, start, slot, u.n, m, row_number() over (partition by r.area, r.band, r.region, start order by cast(u.n as double) / m desc, m desc, i) as nth from (select *, unnest(range(len)) as i from ag{_one}a) r join usual{_one} u on u.area = r.area and u.band = r.band and u.region = r.region and slot = (start + i) % 48 where usual) where nth = 1",
        f"ag{_one}": f"select area, band, region, start, len, len < 48 and start + len > 48 as crosses_midnight, len >= 48 as all_day, if(ongoing, 'ongoing', 'upcoming') as status, starts_in, peak_slot, peak_n, peak_m, (area, band, region) in (select (area, band, region) from ({TEXTS['open_today' + _name]})) as open_today, row_number() over (partition by area order by ongoing desc, starts_in, cast(peak_n as double) / greatest(peak_m, 1) desc nulls last, band, region, start) as nth from ag{_one}a left join ag{_one}p using (area, band, region, start) where ongoing or starts_in <= 720",
    }
    TEXTS |= {
        f"agenda{_name}": f"select * from ag{_one}",
        f"agenda_text{_name}": f"select a.area, case when lit is null and soon is null then 'Nothing usually open in the next 12 h' else concat_ws('. ', 'Now usually: ' || lit, 'Next: ' || soon) end as text from areas a left join (select area, string_agg(path, ', ' order by nth) as lit from (select area, band || ' ' || region as path, min(nth) as nth, row_number() over (partition by area order by min(nth)) as k from ag{_one} where status = 'ongoing' group by area, band, region) where k <= 3 group by area) x on x.area = a.area left join (select area, arg_min(band || ' ' || region || ' ~' || lpad(cast(start // 2 as varchar), 2, '0') || if(start % 2 = 1, ':30', ':00'), nth) as soon from ag{_one} where status = 'upcoming' group by area) y on y.area = a.area",
    }

# Calendar months of the seasonal record, by the calendar itself.
PARTS |= {
    "seas": f"select area, band, region, year(d) * 100 + month(d) as ym, day, slot, sum(least(spot_count, 255)) as n from (select *, date '1970-01-01' + cast(day as int) as d from rd join sq on target4 = square and ring <= 1 where band in ({LISTED})) group by all",
    "sfull": "select ym, g.day, s.slot, coalesce(spot_total, 0) as x from (select ym, date_diff('day', date '1970-01-01', cast(unnest(generate_series(f, last_day(f), interval 1 day)) as date)) as day from (select distinct ym, make_date(ym // 100, ym % 100, 1) as f from seas)) g cross join (select unnest(range(48)) as slot) s left join ing on ing.day = g.day and ing.slot = s.slot",
    "sok": "select area, band, ym, day, slot from (select distinct area, band, unnest([day, if(slot = 0, day - 1, day)]) as day, unnest([slot, if(slot = 0, 47, slot - 1)]) as slot from seas) join (select * from (select *, median(x) over (partition by ym, slot) as med from sfull) where x > 0 and x >= cast(0.10 as double) * med) using (day, slot)",
    "smonths": "select l.area, l.band, l.region, 'pskr' as layer, l.ym as year_month, cast(l.slot as int) as slot, coalesce(n, 0) as n, coalesce(m, 0) as m, coalesce(days, 0) as days from (select distinct area, band, region, ym, s as slot from seas, (select unnest(range(48)) as s)) l left join (select area, band, ym, slot, count(*) as m from sok group by all) a on a.area = l.area and a.band = l.band and a.ym = l.ym and a.slot = l.slot left join (select area, band, ym, count(distinct day) as days from sok group by all) b on b.area = l.area and b.band = l.band and b.ym = l.ym left join (select seas.area, seas.band, seas.region, seas.ym, seas.slot, count(*) as n from seas join sok on sok.area = seas.area and sok.band = seas.band and sok.day = seas.day and sok.slot = seas.slot where seas.n >= 2 group by all) c on c.area = l.area and c.band = l.band and c.region = l.region and c.ym = l.ym and c.slot = l.slot",
}
TEXTS |= {
    "season_months": "select * exclude (layer) from smonths where m > 0",
    "season_pick": "select area, band, region, layer, year_month from (select *, row_number() over (partition by area, band, region, year_month % 100 order by year_month desc) as nth from (select distinct area, band, region, layer, year_month, date_diff('month', make_date(year_month // 100, year_month % 100, 1), date '1970-01-01' + cast(today as int)) as back from smonths, n where days >= 8) where back between 0 and 59) where nth = 1",
    "acceptance": "with t(id, area, bands, regions, hours, low, high, stat, combine) as (values ('1', 'JO31+', ['20m'], ['NA'], range(26, 36), cast(0.5 as double), cast(null as double), 'median', 'all'), ('2', 'JO31+', ['40m', '30m'], ['SA', 'AF'], [44, 45, 46, 47, 0, 1, 2, 3, 4, 5], 0.3, null, 'median', 'any'), ('3', 'JO32', ['10m'], ['KH6', 'EU'], range(48), null, 0.2, 'max', 'all'), ('4', 'FN45+', ['15m'], ['EU'], range(12, 20), 0.1, 0.9, 'median', 'all')), paths as (select id, area, band, unnest(regions) as region, hours, low, high, stat, combine from (select *, unnest(bands) as band from t)), shares as (select v.*, if(m >= 10, cast(n as double) / m, null) as share from (select *, unnest(hours) as slot from paths) v left join lanes using (area, band, region, slot)), seen as (select id, combine, low, high, band, region, count(share) * 2 >= count(*) and count(share) > 0 as enough, if(stat = 'max', max(share), median(share)) as x from shares group by id, combine, low, high, stat, band, region), verdicts as (select id, combine, case when not enough then 'INCONCLUSIVE' when (low is null or x >= low) and (high is null or x <= high) then 'PASS' else 'FAIL' end as v from seen) select id, coalesce(case when combine = 'any' then max(v) filter (where v = 'PASS') else max(v) filter (where v = 'FAIL') end, case when combine = 'any' then max(v) filter (where v = 'INCONCLUSIVE') else max(v) filter (where v = 'PASS') end, max(v)) as verdict from verdicts group by id, combine",
}

# Trends over two hours; where the area was widened, of the last, which live spots cover, alone.
_TWO_HOURS = f"hit join p using (spot_id), n where t between now - 7200 and now and snr >= -15 and {IN_SCOPE} and qth in ('FN45', 'JO31')"
TEXTS["trends_widened"] = (
    f"with counts as (select qth, band, least((t - now + 7200) // 600, 11) as bin, count(*) as c from {_TWO_HOURS} group by all), listed as (select qth, band, bin, coalesce(c, 0) as c, max(c) over (partition by qth, band) as top from (select distinct qth, band, b as bin from counts, (select unnest(range(12)) as b)) left join counts using (qth, band, bin)), "
    f"scaled as (select qth, band, bin, {R('cast(c as double) / top * 100', 2)} as v, coalesce(widened, false) as widened from listed left join la using (qth)), "
    "sums as (select qth, band, if(widened, avg(v) filter (where bin between 9 and 11) - avg(v) filter (where bin between 6 and 8), avg(v) filter (where bin between 6 and 10) - avg(v) filter (where bin between 1 and 5)) as slope from scaled group by qth, band, widened) "
    f"select qth, band, {classify.trend_word('slope', 6)} as trend, {R('slope / 10', 2)} as trend_delta from sums"
)

# Calls: answers of last week's reports, and centres of four made entities by hand.
TEXTS |= {
    "resolve_call_locators": "with heard as (select call as k, loc, case when length(call) = 3 then 'qrz' when call like '%7' then 'negative' else 'feed' end as src, seen from (" + TEXTS["call_locators"] + ")), asked as (select if(length(sc) = 4, sc || '/P', sc) as call, now + 601200 as now, sc from (select distinct sc from p), n), fresh as (select call, now, k = call as plain, heard.loc, src from asked join heard on k in (call, sc) where asked.now - seen <= if(src = 'qrz', 2592000, 604800)), best as (select call, arg_min(src, pref) as src, arg_min(loc, pref) as loc from (select *, case when src = 'feed' then if(plain, 1, 2) when src = 'qrz' then if(plain, 3, 4) when plain then 5 end as pref from fresh) where pref is not null group by call) select call, now, coalesce(src, 'miss') as origin, if(src in ('feed', 'qrz'), loc, null) as loc from asked left join best using (call)",
    "resolve_dxcc": f"select qth, locator, case when locator is not null then {grid.cluster_anchor('locator')} end as anchor, case when is_square then 'locator' when locator is not null then 'entity' else 'unknown' end as origin from (select qth, is_square, case when is_square then qth when qth = 'S17' then 'QH50' when qth like 'S39%' then 'PM95' when qth like 'S1%' then 'FN20' when qth like 'S%' then 'JO50' end as locator from (select distinct qth, regexp_full_match(qth, '[A-R]{{2}}[0-9]{{2}}') as is_square from (select unnest([sc, rc, s4]) as qth from p)))",
}

ORACLE_SQL = {name: sql(text) for name, text in TEXTS.items()}
