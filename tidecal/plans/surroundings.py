"""Queries on weather, holidays and geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import geo, history, holidays, weather
from .adapters import oracle, view
from .registry import query

st = lambda s, d: view(s, d, "station")
KEY = ["entity_id", "day"]

query("hourly_to_daily", oracle("select station, cast(hour as date) as date, lead, max(temp) as temp_max, min(temp) as temp_min, sum(precip) as rain, sum(case when precip >= 0.1 then 1 when precip is not null then 0 end)::bigint as wet_hours from hourly group by 1, 2, 3", "hourly"))(
    lambda s, d: weather.hourly_to_daily(view(s, d, "hourly"))
)
FLAGS = "(precip >= 1)::int::double as wet, (precip >= 10)::int::double as very_wet, (temp_max >= 30)::int::double as hot, (temp_max <= 5)::int::double as cold, (temp_min <= 0)::int::double as frost, sunshine / 3600 as sun_hours"
query("weather_flags", oracle(f"select entity_id, day, {FLAGS} from station", "station"))(lambda s, d: weather.weather_flags(st(s, d)).select(*KEY, "wet", "very_wet", "hot", "cold", "frost", "sun_hours"))
query(
    "weather_lookback",
    oracle(
        """select entity_id, day, case when count(precip) over a >= 2 then sum(precip) over a end as rain_prev3, case when count(precip) over b >= 5 then sum((precip >= 1)::int) over b end::double as wet_prev7 from station
        window a as (partition by entity_id order by day rows between 3 preceding and 1 preceding), b as (partition by entity_id order by day rows between 7 preceding and 1 preceding)""",
        "station",
    ),
)(lambda s, d: weather.look_back(st(s, d)).select(*KEY, "rain_prev3", "wet_prev7"))
query(
    "weather_lookahead",
    oracle("select entity_id, day, case when count(precip) over a >= 2 then sum(precip) over a end as rain_next3, lead(temp_max) over o as temp_next, lead(precip) over o as rain_next from station window o as (partition by entity_id order by day), a as (partition by entity_id order by day rows between 1 following and 3 following)", "station"),
)(lambda s, d: weather.look_ahead(st(s, d)).select(*KEY, "rain_next3", "temp_next", "rain_next"))
query(
    "climatology_anomaly",
    oracle(
        """with m as (select entity_id, least(dayofyear(date), 365) as doy, avg(temp_max) as m from station group by 1, 2), x as (select entity_id, ((doy - 1 + k) % 365 + 365) % 365 + 1 as doy, m from m, (select unnest(range(-7, 8)) as k)),
        u as (select entity_id, doy, case when count(m) = 15 then avg(m) end as usual from x group by 1, 2) select s.entity_id, s.day, u.usual, s.temp_max - u.usual as anomaly from station s left join u on u.entity_id = s.entity_id and u.doy = least(dayofyear(s.date), 365)""",
        "station",
    ),
)(lambda s, d: weather.anomaly(st(s, d), "temp_max").select(*KEY, "usual", "anomaly"))
query(
    "prefer_source_union",
    oracle(
        """with a as (select * from station where precip is not null), f as (select * from station where sunshine <= 14400) select entity_id, day, temp_max, 'archive' as wx_source from a where entity_id in (select entity_id from f)
        union all select entity_id, day, temp_max, 'forecast' from f where (entity_id, day) not in (select (entity_id, day) from a)""",
        "station",
    ),
)(lambda s, d: weather.prefer(st(s, d).where("precip is not null"), st(s, d).where("sunshine <= 14400")).select(*KEY, "temp_max", "wx_source"))
#: All weather columns of a station day, as weather.features() gives them.
WEATHER = f"""fl as (select entity_id, day, least(dayofyear(date), 365) as doy, temp_max, temp_min, precip, sunshine, {FLAGS}, case when count(precip) over a >= 2 then sum(precip) over a end as rain_prev3, case when count(precip) over b >= 5 then sum((precip >= 1)::int) over b end::double as wet_prev7
   from station window a as (partition by entity_id order by day rows between 3 preceding and 1 preceding), b as (partition by entity_id order by day rows between 7 preceding and 1 preceding)),
 mc as (select entity_id, doy, avg(temp_max) as t, avg(precip) as p from fl group by 1, 2), xc as (select entity_id, ((doy - 1 + k) % 365 + 365) % 365 + 1 as doy, t, p from mc, (select unnest(range(-7, 8)) as k)),
 uc as (select entity_id, doy, case when count(t) = 15 then avg(t) end as t, case when count(p) = 15 then avg(p) end as p from xc group by 1, 2),
 wf as materialized (select fl.*, temp_max - t as temp_anomaly, precip - p as rain_anomaly from fl left join uc on uc.entity_id = fl.entity_id and uc.doy = fl.doy)"""
query("weather_features", oracle(f"with {WEATHER} select entity_id, day, {', '.join(weather.FEATURES)} from wf", "station"))(lambda s, d: weather.features(st(s, d)))


def swapped(s, d):
    """Station days with yesterday's weather as the forecast, where all four values of it are known."""
    days = weather.features(st(s, d)).join(st(s, d).select(*KEY, "sunshine"), KEY)
    return weather.swap_forecast(days, st(s, d).withColumn("day", F.col("day") + 1), ["temp_max", "temp_min", "precip", "sunshine"], 0.0, {"temp_anomaly": "temp_max", "rain_anomaly": "precip"})


query(
    "forecast_weather_swap",
    oracle(
        f"""with {WEATHER}, f as (select entity_id, day + 1 as day, temp_max as t, temp_min as m, precip as p, sunshine as u from station), j as (select wf.*, t, m, p, u, t is not null and m is not null and p is not null and u is not null as swapped from wf left join f using (entity_id, day)),
        r as (select entity_id, day, swapped, rain_prev3, wet_prev7, case when swapped then t else temp_max end as temp_max, case when swapped then m else temp_min end as temp_min, case when swapped then p else precip end as precip, case when swapped then u else sunshine end as sunshine,
          temp_max - temp_anomaly as ct, precip - rain_anomaly as cp from j)
        select entity_id, day, swapped, rain_prev3, wet_prev7, temp_max, temp_min, precip, sunshine / 3600 as sun_hours, coalesce(precip >= 1, false)::int::double as wet, coalesce(precip >= 10, false)::int::double as very_wet, coalesce(temp_max >= 30, false)::int::double as hot,
          coalesce(temp_max <= 5, false)::int::double as cold, coalesce(temp_min <= 0, false)::int::double as frost, temp_max - ct as temp_anomaly, precip - cp as rain_anomaly from r""",
        "station",
    ),
)(lambda s, d: swapped(s, d).select(*KEY, "swapped", *weather.FEATURES))
query("blank_drift", oracle("select entity_id, day, null::double as drift1, label / 7 as drift7, label / 14 as drift14 from activity", "activity"))(
    lambda s, d: weather.blank_drift(view(s, d, "activity").withColumns({f"drift{h}": F.col("label") / h for h in (1, 7, 14)}), 7).select(*KEY, "drift1", "drift7", "drift14")
)

src = lambda s, d: view(s, d, "source_rows")
reg = lambda s, d: view(s, d, "regions")
kinds = lambda s, d: [src(s, d).where(f"type = '{t}'") for t in ("school", "national")]
query(
    "supersede_rows",
    oracle("with v as (select * from source_rows where type = 'national') select code, day, type, row_id from source_rows s where type = 'school' and not exists (select 1 from v where v.code = s.code and v.day = s.day) union all select code, day, type, row_id from v", "source_rows"),
)(
    lambda s, d: (lambda school, national: holidays.supersede(school, national, national, ["code", "day"]).select("code", "day", "type", "row_id"))(*kinds(s, d))
)
EITHER = "1 - exp(sum(ln(1 - least(greatest(share, 0), 1 - 1e-9))))"
query("overlap_combine", oracle(f"select code, day, type, {EITHER} as share from source_rows group by 1, 2, 3", "source_rows"))(lambda s, d: holidays.overlap_combine(src(s, d), ["code", "day", "type"]))
FAN = "fan as (select s.code, s.day, s.date, s.type, s.share from source_rows s where code in (select code from regions) union all select r.code, s.day, s.date, s.type, s.share from source_rows s join regions r on r.country = s.code)"
query("hierarchy_fanout", oracle(f"with {FAN} select code, day, type, count(*) as n, {EITHER} as share from fan group by 1, 2, 3", "source_rows", "regions"))(
    lambda s, d: holidays.fan_out(src(s, d), reg(s, d)).groupBy("code", "day", "type").agg(F.count(F.lit(1)).alias("n"), holidays.either(F.col("share")).alias("share"))
)
query("unknown_keys", oracle("select code, count(*) as n from (select code || case when row_id % 7 = 0 then 'x' else '' end as code from source_rows) where code not in (select code from regions union select country from regions) group by 1", "source_rows", "regions"))(
    lambda s, d: holidays.unknown_codes(src(s, d).withColumn("code", F.concat("code", F.when(F.col("row_id") % 7 == 0, "x").otherwise(""))), reg(s, d))
)
query(
    "child_fraction",
    oracle(
        f"""with n as (select code, country, count(*) over (partition by country) as k from regions), c as (select country, day, type, least(1.0, sum(share / k)) as share from source_rows join n using (code) group by 1, 2, 3),
        own as (select code as country, day, type, share from source_rows where code in (select country from regions) union all select * from c) select country, day, type, {EITHER} as share from own group by 1, 2, 3""",
        "source_rows",
        "regions",
    ),
)(lambda s, d: holidays.child_fraction(src(s, d), reg(s, d).join(reg(s, d).groupBy("country").agg(F.count(F.lit(1)).alias("n_children")), "country").select("code", "country", "n_children")))
query(
    "coverage_flags",
    oracle(
        """with b as (select split_part(code, '-', 1) as country, year(date) as year, max((type = 'school')::int) as school, max((type = 'national')::int) as national from source_rows group by 1, 2),
        s as (select distinct country, y.year from regions, (select distinct year(date) as year from source_rows) y) select s.country, s.year, coalesce(b.school, 0) as school, max(coalesce(b.national, 0)) over (partition by s.country) as national from s left join b using (country, year)""",
        "source_rows",
        "regions",
    ),
)(lambda s, d: holidays.coverage(src(s, d), reg(s, d)))
ROUND4 = "floor(coalesce(max(share) filter (type = '{0}'), 0) * 10000 + 0.5) / 10000 as {0}"
query("calendar_sparse", oracle(f"with w as (select code, day, {ROUND4.format('national')}, {ROUND4.format('school')} from source_rows group by 1, 2) select * from w where national > 1e-6 or school > 1e-6", "source_rows"))(lambda s, d: holidays.sparse(src(s, d), ["code", "day"]))
query("code_remap", oracle("select row_id, case code when 'R0-5' then 'R0-A' when 'R0-10' then 'R0-A' else code end as code, least(1.0, share * case code when 'R0-10' then 0.55 else 1.0 end)::double as share from source_rows", "source_rows"))(
    lambda s, d: holidays.remap(src(s, d), s.sql("select 'R0-5' as code, 'R0-A' as new_code, 1.0D as factor union all select 'R0-10', 'R0-A', 0.55D")).select("row_id", "code", "share")
)
iv = lambda s, d: view(s, d, "intervals")
query("interval_explode", oracle("select row_id, unnest(range(start_day, end_day + 1)) as day from intervals", "intervals"))(lambda s, d: holidays.interval_days(iv(s, d)).select("row_id", "day"))
query("interval_share", oracle("with x as (select state, weight, unnest(range(start_day, end_day + 1)) as day from intervals), t as (select state, sum(weight) as t from intervals group by 1) select state, day, sum(weight) / any_value(t) as share from x join t using (state) group by 1, 2", "intervals"))(lambda s, d: holidays.interval_share(iv(s, d)))
query(
    "nearest_year",
    oracle(
        """with k as (select code, year(date) as known_year, sum(share) as value from source_rows where name = '1-URGENT' and share > 0.85 group by 1, 2), w as (select distinct code, year(date) as year from source_rows),
        r as (select w.code, w.year, k.known_year, k.value, row_number() over (partition by w.code, w.year order by abs(w.year - k.known_year), k.known_year) as n from w join k using (code)) select code, year, known_year, value from r where n = 1""",
        "source_rows",
    ),
)(
    lambda s, d: holidays.nearest_year(
        src(s, d).select("code", F.year("date").alias("year")).distinct(), src(s, d).withColumn("year", F.year("date")).where("name = '1-URGENT' and share > 0.85").groupBy("code", "year").agg(F.sum("share").alias("value")), ["code"]
    )
)
query(
    "source_disagreements",
    oracle("with a as (select distinct code, day from source_rows where type = 'school'), b as (select distinct code, day from source_rows where type = 'national') select code, day, 'a' as only_in from a where (code, day) not in (select (code, day) from b) union all select code, day, 'b' from b where (code, day) not in (select (code, day) from a)", "source_rows"),
)(lambda s, d: holidays.disagreements(*kinds(s, d), ["code", "day"]))
query(
    "supplement_groups",
    oracle("with a as (select * from source_rows where type = 'school'), b as (select * from source_rows where type = 'national') select row_id, code, day from a union all select row_id, code, day from b where (code, day) not in (select (code, day) from a) and (isodow(date) <> 7 or code in ('R1', 'R2-2'))", "source_rows"),
)(lambda s, d: holidays.supplement(*kinds(s, d), ["code", "day"], s.sql("select explode(array('R1', 'R2-2')) as code")).select("row_id", "code", "day"))
query("term_gaps", oracle("with n as (select state, end_day, lead(start_day) over (partition by state order by start_day, end_day, row_id) as nx from intervals) select state, end_day + 1 as start_day, nx - 1 as end_day from n where nx > end_day + 1", "intervals"))(lambda s, d: holidays.term_gaps(iv(s, d)))
query(
    "weekend_inherit",
    oracle(
        """with t as (select code, day, max(share) as share from source_rows group by 1, 2), x as (select * from t union all select code, day + k, share from t, (select unnest([1, 2]) as k) where (day + 3) % 7 = 4 union all select code, day - k, share from t, (select unnest([1, 2]) as k) where (day + 3) % 7 = 0)
        select code, day, max(share) as share from x group by 1, 2""",
        "source_rows",
    ),
)(lambda s, d: holidays.weekend_inherit(src(s, d).groupBy("code", "day").agg(F.max("share").alias("share")), ["code"]))
query("share_ramp", oracle("with x as (select row_id, start_day, end_day, unnest(range(start_day, end_day + 1)) as day from intervals) select row_id, day, least(1.0, (day - start_day + 1) / 3.0, (end_day - day + 1) / 3.0)::double as share from x", "intervals"))(lambda s, d: holidays.ramps(iv(s, d)).select("row_id", "day", "share"))
EASTER = """ea as (select y, make_date(y, ((h + m - 7 * n + 114) // 31)::int, ((h + m - 7 * n + 114) % 31 + 1)::int) as easter from (select *, (a + 11 * h + 22 * m) // 451 as n from (select *, (32 + 2 * e + 2 * i - h - k) % 7 as m from (
 select *, (19 * a + b - d - g + 15) % 30 as h, c // 4 as i, c % 4 as k from (select y, y % 19 as a, y // 100 as b, y % 100 as c, (y // 100) // 4 as d, (y // 100) % 4 as e, (8 * (y // 100) + 13) // 25 as g from (select unnest(range(1990, 2012))::int as y)))))) """
query(
    "year_shift",
    oracle(
        f"""with {EASTER}, r as (select row_id, date, case row_id % 3 when 0 then 'easter' when 1 then 'same' else 'weeks' end as rule from source_rows)
        select row_id, cast(case rule when 'easter' then e2.easter + (r.date - e1.easter)::int when 'same' then make_date(year(r.date) + 1, month(r.date), 1) + (day(r.date) - 1)::int else r.date + 364 end as date) as shifted from r join ea e1 on e1.y = year(r.date) join ea e2 on e2.y = year(r.date) + 1""",
        "source_rows",
    ),
)(lambda s, d: holidays.shift_year(src(s, d).withColumn("rule", F.when(F.col("row_id") % 3 == 0, "easter").when(F.col("row_id") % 3 == 1, "same").otherwise("weeks"))).select("row_id", "shifted"))
query(
    "date_anchors",
    oracle(
        f"""with {EASTER}, y as (select distinct year(date) as y from source_rows)
        select y.y as year, easter, (make_date(y.y, 9, 1) + ((0 - (isodow(make_date(y.y, 9, 1)) - 1) + 7) % 7)::int) as labour, (last_day(make_date(y.y, 5, 1)) - ((isodow(last_day(make_date(y.y, 5, 1))) - 1) % 7)::int) as memorial,
         (make_date(y.y, 1, 4) - (isodow(make_date(y.y, 1, 4)) - 1)::int + 7 * 9) as week10 from y join ea on ea.y = y.y""",
        "source_rows",
    ),
)(
    lambda s, d: src(s, d).select(F.year("date").alias("year")).distinct().select("year", cal.easter(F.col("year")).alias("easter"), cal.nth_weekday(F.col("year"), 9, 0, 1).alias("labour"), cal.nth_weekday(F.col("year"), 5, 0, -1).alias("memorial"), cal.iso_monday(F.col("year"), 10).alias("week10"))
)
query("interval_extend", oracle("select row_id, start_day - case when (start_day + 3) % 7 = 0 then 2 else 0 end as start_day, end_day + case when (end_day + 3) % 7 = 4 then 2 else 0 end as end_day from intervals", "intervals"))(lambda s, d: holidays.extend_to_weekend(iv(s, d)).select("row_id", "start_day", "end_day"))
query(
    "block_overlap",
    oracle(
        """with a as (select code, year(date) as y, day, max(share) as sa from source_rows where type = 'school' group by 1, 2, 3), b as (select code, year(date) as y, day, max(share) as sb from source_rows where type = 'national' group by 1, 2, 3)
        select code, y, min(case when sb is not null then day end) - min(case when sa is not null then day end) as start_error, max(case when sb is not null then day end) - max(case when sa is not null then day end) as end_error,
          count(*) filter (sa is not null and sb is not null) / count(*) as jaccard, sum(abs(coalesce(sa, 0) - coalesce(sb, 0))) as difference from a full join b using (code, y, day) group by 1, 2""",
        "source_rows",
    ),
)(lambda s, d: holidays.block_overlap(*[x.groupBy("code", F.year("date").alias("y"), "day").agg(F.max("share").alias("share")) for x in kinds(s, d)], ["code", "y"]))
query("capped_share", oracle("with c as (select code, type, year(date) as y, least(1.0, sum(share)) as share, arg_min(name, {'s': -share, 'n': name}) as name from source_rows group by 1, 2, 3) select *, case when share < 0.4999999 then 'low' else 'medium' end as confidence from c", "source_rows"))(
    lambda s, d: holidays.capped_share(src(s, d).withColumn("y", F.year("date")), ["code", "type", "y"])
)
query("child_coverage", oracle("select country, day, count(distinct s.code) / any_value(n) as covered from source_rows s join regions r using (code) join (select country, count(distinct code) as n from regions group by 1) using (country) group by 1, 2", "source_rows", "regions"))(lambda s, d: holidays.child_coverage(src(s, d), reg(s, d)))
#: Regions of the merge: all countries by region, but one as a single region of five children; three codes are renamed.
MERGE = f"""mr as (select code, country, 1 as n_children from regions where country <> 'R4' union all select 'R4', 'R4', 5),
 vr as (select * from source_rows where name = '1-URGENT'),
 sr as (select code, day, date, type, share from source_rows s where name <> '1-URGENT' and not exists (select 1 from vr where vr.code = s.code and vr.day = s.day and vr.type = s.type) union all select code, day, date, type, share from vr),
 rm as (select case when code in ('R0-5', 'R0-10') then 'R0-0' when code = 'R1-21' then 'RX-21' else code end as code, day, date, type, least(1.0, share * case code when 'R0-10' then 0.55 else 1.0 end)::double as share from sr),
 cm as (select code, day, any_value(date) as date, type, {EITHER} as share from rm group by 1, 2, 4),
 ow as (select m.code, m.country, day, date, type, share from cm join mr m using (code)),
 na as (select m.code, m.country, day, date, type, share from cm join mr m on m.country = cm.code where cm.code not in (select code from mr) and not contains(cm.code, '-')),
 be as (select m.code, m.country, day, any_value(date) as date, type, least(1 - 1e-9, sum(share / n_children)) as share from cm join mr m on m.code = m.country and m.country = split_part(cm.code, '-', 1) where cm.code not in (select code from mr) and contains(cm.code, '-') group by 1, 2, 3, 5),
 sp as (select * from ow union all select * from na union all select * from be)"""


def merge(s, d):
    regions = reg(s, d).where("country <> 'R4'").select("code", "country", F.lit(1).alias("n_children")).unionByName(s.sql("select 'R4' as code, 'R4' as country, 5 as n_children"))
    mapping = s.sql("select 'R0-5' as code, 'R0-0' as new_code, 1.0D as factor union all select 'R0-10', 'R0-0', 0.55D union all select 'R1-21', 'RX-21', 1.0D")
    return holidays.merge(src(s, d).where("name <> '1-URGENT'"), regions, mapping, verified=src(s, d).where("name = '1-URGENT'"))


query("calendar_merge", oracle(f"with {MERGE}, cc as (select code, day, type, {EITHER} as share from sp group by 1, 2, 3), w as (select code, day, {ROUND4.format('national')}, {ROUND4.format('school')} from cc group by 1, 2) select * from w where national > 1e-6 or school > 1e-6", "source_rows", "regions"))(lambda s, d: merge(s, d)["calendar"])
query(
    "calendar_coverage",
    oracle(
        f"""with {MERGE}, y as (select distinct year(date) as year from sr), b as (select country, year(date) as year, max((type = 'national')::int) as national, max((type = 'school')::int) as school from sp group by 1, 2),
        f as (select k.country, y.year, coalesce(b.national, 0) as national, coalesce(b.school, 0) as school from (select distinct country from mr) k cross join y left join b on b.country = k.country and b.year = y.year) select country, year, max(national) over (partition by country) as national, school from f""",
        "source_rows",
        "regions",
    ),
)(lambda s, d: merge(s, d)["coverage"])
query(
    "calendar_dropped",
    oracle(
        f"""with {MERGE}, r as (select code, split_part(code, '-', 1) as country from cm where code not in (select code from mr)) select country, count(*) as n from r
        where not case when contains(code, '-') then country in (select code from mr where code = country) else country in (select country from mr) end group by 1""",
        "source_rows",
        "regions",
    ),
)(lambda s, d: merge(s, d)["dropped"])

pts = lambda s, d: view(s, d, "points")
ents = lambda s, d: view(s, d, "entities")
HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(longitude)) / 2), 2))))"
query("haversine", oracle(f"select point_id, entity_id, {HAV} as km from points join entities on entity_id = home", "points", "entities"))(
    lambda s, d: pts(s, d).join(ents(s, d), F.col("entity_id") == F.col("home")).select("point_id", "entity_id", geo.haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")).alias("km"))
)
query("grid_cell", oracle("select point_id, round_even(lat / 0.25, 0)::bigint || '_' || round_even(lon / 0.25, 0)::bigint as cell from points", "points"))(lambda s, d: pts(s, d).select("point_id", geo.grid_cell(F.col("lat"), F.col("lon")).alias("cell")))
PRIOR = f"""kmed as (select e.entity_id, p.home as region_id, greatest(p.pop, 0) as pop, e.tier, coalesce(e.reach_km, case tier when 'local' then 150.0 when 'regional' then 600.0 when 'continental' then 2500.0 else 6000.0 end) as reach, {HAV} as km from points p cross join entities e),
 pulled as (select entity_id, region_id, sum(pop * case when tier = 'intercontinental' then 0.5 * exp(-km / reach) + 0.5 / pow(1 + km / reach, 3) else exp(-km / reach) end) as pull from kmed group by 1, 2),
 whole as (select home as region_id, sum(greatest(pop, 0)) as total from points group by 1),
 weighed as (select e.entity_id, a.region_id, {HAV} as distance_km, a.population * pull / greatest(total, 1e-9) * affluence * case when a.country = e.country then case tier when 'local' then 3 when 'regional' then 6 when 'continental' then 10 else 6 end else 1 end as w
   from pulled join whole using (region_id) join areas a using (region_id) join entities e using (entity_id)),
 prior as (select entity_id, region_id, distance_km, w / sum(w) over (partition by entity_id) as prior_weight from weighed)"""
prior = lambda s, d: geo.market_prior(ents(s, d), pts(s, d).select(F.col("home").alias("region_id"), "lat", "lon", F.greatest("pop", F.lit(0.0)).alias("pop")), view(s, d, "areas"))
#: The pyramid takes groups of places for one at 5 % between their nearest and farthest; compared in tenths of a percent.
query("market_prior_grouped", None)(lambda s, d: geo.market_prior(ents(s, d), pts(s, d).select(F.col("home").alias("region_id"), "lat", "lon", F.greatest("pop", F.lit(0.0)).alias("pop")), view(s, d, "areas"), error=0.05))
query("market_prior", oracle(f"with {PRIOR} select * from prior", "points", "entities", "areas"))(prior)
query(
    "top_mass",
    oracle(
        """with r as (select *, coalesce(sum(prior) over (o rows between unbounded preceding and 1 preceding), 0) as before, row_number() over o as rn from markets window o as (partition by entity_id order by prior desc, region_id)),
        k as (select entity_id, region_id, rn, floor(prior / sum(prior) over (partition by entity_id) * 1e8 + 0.5) / 1e8 as w from r where before < 0.9 and rn <= 20) select entity_id, region_id, case when rn = 1 then w + 1 - sum(w) over (partition by entity_id) else w end as weight from k""",
        "markets",
    ),
)(lambda s, d: geo.top_mass(view(s, d, "markets").withColumnRenamed("prior", "prior_weight"), 0.9, 20))
query(
    "geo_centroid",
    oracle(
        """with c as (select home, sum(cos(radians(lat)) * cos(radians(lon)) * pop) as x, sum(cos(radians(lat)) * sin(radians(lon)) * pop) as y, sum(sin(radians(lat)) * pop) as z from points where pop > 0 group by 1)
        select home, degrees(atan2(z, sqrt(x * x + y * y))) as lat, degrees(atan2(y, x)) as lon from c""",
        "points",
    ),
)(lambda s, d: geo.centroid(pts(s, d).where("pop > 0"), ["home"]))
query("rescale_to_total", oracle("with p as (select home, home % 5 as country, sum(greatest(pop, 0)) as pop from points group by 1, 2) select home, pop * (1000.0 + country) / sum(pop) over (partition by country) as rescaled from p", "points"))(
    lambda s, d: geo.rescale(pts(s, d).groupBy("home", (F.col("home") % 5).alias("country")).agg(F.sum(F.greatest("pop", F.lit(0.0))).alias("pop")).withColumn("total", 1000.0 + F.col("country")), "country", "pop", "total").select("home", "rescaled")
)
ASSIGN = """ins as (select point_id, min(rect_id) as rect_id, true as inside from points join rectangles on lon >= lon0 and lon < lon1 and lat >= lat0 and lat < lat1 group by 1),
 oth as (select point_id, rect_id, greatest(lon0 - lon, 0, lon - lon1) ** 2 + greatest(lat0 - lat, 0, lat - lat1) ** 2 as d from points cross join rectangles where point_id not in (select point_id from ins)),
 placed as (select * from ins union all select point_id, arg_min(rect_id, {'d': d, 'r': rect_id}) as rect_id, false from oth group by 1)"""
query("spatial_assign", oracle(f"with {ASSIGN} select * from placed", "points", "rectangles"))(lambda s, d: geo.assign_rectangles(pts(s, d), view(s, d, "rectangles")))


def areas(s, d):
    """The rectangles as areas of one ring, in the countries of the nations they are numbered by."""
    return geo.rings_of(view(s, d, "rectangles"), "rect_id").withColumn("country", F.concat(F.lit("R"), F.col("area_id") % 5))


query(
    "polygon_assign",
    oracle(
        """with ins as (select point_id, min(rect_id) as area_id, true as inside from points join rectangles on lon >= lon0 and lon < lon1 and lat >= lat0 and lat < lat1 group by 1),
        oth as (select point_id, rect_id, greatest(lon0 - lon, 0, lon - lon1) ** 2 + greatest(lat0 - lat, 0, lat - lat1) ** 2 as d from points cross join rectangles where point_id not in (select point_id from ins))
        select * from ins union all select point_id, arg_min(rect_id, {'d': d, 'r': rect_id}), false from oth group by 1""",
        "points",
        "rectangles",
    ),
)(lambda s, d: geo.assign_polygons(pts(s, d).select("point_id", "lon", "lat"), areas(s, d)))
#: Places of two countries go to areas of their own country, those of the others to their country.
PLACED = """pl as (select point_id, lon, lat, greatest(pop, 1) as w, 'R' || home % 5 as country from points), ar as (select *, 'R' || rect_id % 5 as country from rectangles where rect_id % 5 < 2),
 ri as (select point_id, min(rect_id) as r from pl join ar using (country) where lon >= lon0 and lon < lon1 and lat >= lat0 and lat < lat1 group by 1),
 ro as (select point_id, arg_min(rect_id, {'d': greatest(lon0 - lon, 0, lon - lon1) ** 2 + greatest(lat0 - lat, 0, lat - lat1) ** 2, 'r': rect_id}) as r from pl join ar using (country) where point_id not in (select point_id from ri) group by 1),
 co as (select pl.*, coalesce(r::varchar, country) as code from pl left join (select * from ri union all select * from ro) using (point_id)),
 pe as (select rect_id::varchar as code, (1 + rect_id) * case country when 'R0' then 3000.0 else 8000.0 end / sum(1 + rect_id) over (partition by country) as population from ar union all select * from (values ('R2', 500.0), ('R3', 1500.0), ('R4', 2500.0)) v(code, population)),
 ce as (select code, country, sum(cos(radians(lat)) * cos(radians(lon)) * w) as x, sum(cos(radians(lat)) * sin(radians(lon)) * w) as y, sum(sin(radians(lat)) * w) as z from co group by 1, 2),
 rt as (select code, country, floor(degrees(atan2(z, sqrt(x * x + y * y))) * 10000 + 0.5) / 10000 as lat, floor(degrees(atan2(y, x)) * 10000 + 0.5) / 10000 as lon, floor(population + 0.5) as population from ce join pe using (code) where population >= 1000)"""


def regions_and_places(s, d):
    places = pts(s, d).select("point_id", "lon", "lat", "pop", F.concat(F.lit("R"), F.col("home") % 5).alias("country"))
    split = s.sql("select explode(array('R0', 'R1')) as country")
    totals = s.sql("select * from values ('R0', 3000.0D), ('R1', 8000.0D), ('R2', 500.0D), ('R3', 1500.0D), ('R4', 2500.0D) as t(country, people)")
    return geo.build_regions(places, areas(s, d), split, totals, areas(s, d).select("area_id", (1.0 + F.col("area_id")).alias("people")))


query("regions_table", oracle(f"with {PLACED} select * from rt", "points", "rectangles"))(lambda s, d: regions_and_places(s, d)[0])
query("places_by_region", oracle(f"with {PLACED} select code, point_id, lat, lon, w as pop from co where code in (select code from rt)", "points", "rectangles"))(lambda s, d: regions_and_places(s, d)[1])
query(
    "entities_enriched",
    oracle(
        """with fixed as (select entity_id, name, country, tier, case when entity_id = 3 then 10.0 else latitude end as lat, case when entity_id = 3 then 20.0 else longitude end as lon from entities),
        ins as (select entity_id, min(rect_id) as rect_id, true as inside from fixed join rectangles on lon >= lon0 and lon < lon1 and lat >= lat0 and lat < lat1 group by 1),
        oth as (select entity_id, rect_id, greatest(lon0 - lon, 0, lon - lon1) ** 2 + greatest(lat0 - lat, 0, lat - lat1) ** 2 as d from fixed cross join rectangles where entity_id not in (select entity_id from ins)),
        pl as (select * from ins union all select entity_id, arg_min(rect_id, {'d': d, 'r': rect_id}) as rect_id, false from oth group by 1)
        select f.entity_id, f.name, f.lat as latitude, f.lon as longitude, pl.rect_id as area_id, 'R' || rect_id % 5 as area_country, pl.inside, 'R' || rect_id % 5 <> f.country as mismatch, tier,
          'by ' || tier || case when entity_id = 3 then ' [coords corrected]' else '' end as reason from fixed f join pl using (entity_id)""",
        "entities",
        "rectangles",
    ),
)(
    lambda s, d: geo.enrich(
        ents(s, d), s.sql("select 3 as entity_id, 10.0D as latitude, 20.0D as longitude"), areas(s, d), ents(s, d).select("entity_id", "tier", F.concat(F.lit("by "), "tier").alias("reason")), areas(s, d).select("area_id")
    ).select("entity_id", "name", "latitude", "longitude", "area_id", "area_country", "inside", "mismatch", "tier", "reason")
)
