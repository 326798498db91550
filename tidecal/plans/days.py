"""Queries on entity-day rows and history features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import days, history
from .adapters import oracle, view
from .registry import query

WINDOW = ("1997-03-01", "1998-12-31")
KEY = ["entity_id", "day"]

query("activity_index", oracle("select entity_id, day, greatest(1.0, 100.0 * (rank() over (partition by entity_id order by volume) + (count(*) over (partition by entity_id, volume) - 1) / 2.0) / count(*) over (partition by entity_id)) as idx from activity", "activity"))(
    lambda s, d: history.rank_index(view(s, d, "activity")).select(*KEY, F.col("index").alias("idx"))
)
query("crowd_calendar", oracle("select entity_id, day, label, status, predicted, opens, closes, events from calendar", "calendar"))(
    lambda s, d: view(s, d, "calendar").select(*KEY, "label", "status", "predicted", "opens", "closes", "events")
)
query("entities_table", oracle("select e.*, c.n from entities e left join (select entity_id, count(*) as n from calendar group by 1) c using (entity_id)", "calendar", "entities"))(
    lambda s, d: view(s, d, "entities").join(view(s, d, "calendar").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "entity_id", "left")
)
query("labelled_days", oracle("select entity_id, day, label from calendar where status = 'open' and label is not null and not predicted", "calendar"))(lambda s, d: days.labelled(view(s, d, "calendar")).select(*KEY, "label"))
query(
    "enhanced_calendar",
    oracle("with sc as (select entity_id, day, label / 100 as score from activity) select c.entity_id, c.day, c.status, c.label, sc.score from calendar c left join sc using (entity_id, day) where not (coalesce(c.status = 'closed', false) or coalesce(c.predicted, false)) and c.entity_id in (select entity_id from sc)", "calendar"),
)(lambda s, d: days.enhance(view(s, d, "calendar"), view(s, d, "activity").select(*KEY, (F.col("label") / 100).alias("score"))).select(*KEY, "status", "label", "score"))
query("exclusion_window", oracle(f"select entity_id, day, date between date '{WINDOW[0]}' and date '{WINDOW[1]}' as excluded from activity", "activity"))(lambda s, d: view(s, d, "activity").select(*KEY, days.between_days(*WINDOW).alias("excluded")))
query(
    "exclusion_by_group",
    oracle("select a.entity_id, a.day, a.date between date '1997-03-01' and coalesce(case e.country when 'R0' then date '1997-12-31' when 'R1' then date '1998-06-30' end, date '1998-03-31') as excluded from activity a join entities e using (entity_id)", "activity", "entities"),
)(
    lambda s, d: days.excluded_by_group(
        view(s, d, "activity").join(view(s, d, "entities").select("entity_id", "country"), "entity_id"), s.sql("select 'R0' as country, date'1997-12-31' as end_date union all select 'R1', date'1998-06-30'"), "1997-03-01", "1998-03-31"
    ).select(*KEY, "excluded")
)
query("time_split", oracle("select entity_id, day, case when date <= date '1998-12-31' then 'train' when date <= date '1999-12-31' then 'valid' else 'test' end as split from activity", "activity"))(
    lambda s, d: days.time_split(view(s, d, "activity"), "1998-12-31", "1999-12-31").select(*KEY, "split")
)
query("active_entities", oracle("with l as (select entity_id, max(day) as last_day from activity group by 1), e as (select max(last_day) as end_day from l) select entity_id, last_day, end_day from l, e where last_day > end_day - 60", "activity"))(
    lambda s, d: history.active_entities(view(s, d, "activity"))
)
query(
    "horizon_guard",
    oracle("select count(*) as n_rows, coalesce(sum(case when precip is null then 1 else 0 end), 0)::bigint as n_none, count(*) > 0 and count(*) = coalesce(sum(case when precip is null then 1 else 0 end), 0) as blind from station where day between 10000 and 10014", "station"),
)(lambda s, d: days.horizon_guard(view(s, d, "station").withColumn("wx_source", F.when(F.col("precip").isNull(), "none").otherwise("archive")), 10000))
query(
    "calendar_features",
    oracle(
        f"""select a.entity_id, a.day, isodow(date) - 1 as dow, case when isodow(date) >= 6 then 1 else 0 end as weekend, month(date) as month, weekofyear(date) as week, year(date) as year,
        sin(2 * pi() * dayofyear(date) / 365.25) as wave_sin, cos(2 * pi() * dayofyear(date) / 365.25) as wave_cos, (year(date) - first_year) * 12 + month(date) - first_month as months_open,
        case when latitude < 0 then 1 else 0 end as south, case when date between date '{WINDOW[0]}' and date '{WINDOW[1]}' then 1 else 0 end as in_window from activity a join entities e using (entity_id)""",
        "activity",
        "entities",
    ),
)(lambda s, d: days.calendar_features(view(s, d, "activity"), view(s, d, "entities"), WINDOW).drop("date", "volume", "label"))
HOURS = """h as (select entity_id, day, status, (split_part(opens, ':', 1)::int * 60 + split_part(opens, ':', 2)::int) as o, (split_part(closes, ':', 1)::int * 60 + split_part(closes, ':', 2)::int) as c from calendar),
 t as (select *, case when c < o then (c - o) / 60.0 + 24 else (c - o) / 60.0 end as dur from h)"""
query("hours_features", oracle(f"with {HOURS} select entity_id, day, coalesce(o, median(o) over w)::double as open_min, coalesce(c, median(c) over w)::double as close_min, coalesce(dur, median(dur) over w)::double as duration from t window w as (partition by entity_id)", "calendar"))(
    lambda s, d: days.hours_features(view(s, d, "calendar")).select(*KEY, "open_min", "close_min", "duration")
)
query("hhmm_format", oracle("select entity_id, day, lpad(((volume::int * 7 - 300) % 1440 + 1440) % 1440 // 60 || '', 2, '0') || ':' || lpad(((volume::int * 7 - 300) % 1440 + 1440) % 1440 % 60 || '', 2, '0') as hhmm from activity", "activity"))(
    lambda s, d: view(s, d, "activity").select(*KEY, cal.clock(F.col("volume") * 7 - 300).alias("hhmm"))
)
query(
    "event_flags",
    oracle("with t as (select entity_id, day, lower(coalesce(events, '')) as x from calendar) select entity_id, day, (x <> '')::int as has_event, regexp_matches(x, 'hot|red')::int as event_hot, regexp_matches(x, 'cold|blue')::int as event_cold, regexp_matches(x, 'ring\\b')::int as event_ring, regexp_matches(x, 'anvil')::int as event_anvil from t", "calendar"),
)(lambda s, d: days.event_flags(view(s, d, "calendar")).select(*KEY, "has_event", *[f"event_{k}" for k in days.EVENT_GROUPS]))

PRIOR = """p as (select a.entity_id, a.day, a.label, x.label as py357, y.label as py364, z.label as py371 from activity a
 left join activity x on x.entity_id = a.entity_id and x.day = a.day - 357 left join activity y on y.entity_id = a.entity_id and y.day = a.day - 364
 left join activity z on z.entity_id = a.entity_id and z.day = a.day - 371)"""
MEAN = "(coalesce(py357, 0) + coalesce(py364, 0) + coalesce(py371, 0)) / nullif((py357 is not null)::int + (py364 is not null)::int + (py371 is not null)::int, 0)"
query("prior_year", oracle(f"with {PRIOR} select entity_id, day, py357, py364, py371, {MEAN} as py_mean from p", "activity"))(lambda s, d: history.prior_year(view(s, d, "activity")).select(*KEY, "py357", "py364", "py371", "py_mean"))
DRIFTS = ", ".join(f"case when count(gap) over w{h} >= 7 then avg(gap) over w{h} end as drift{h}" for h in (1, 7, 14))
FRAMES = "window " + ", ".join(f"w{h} as (partition by entity_id order by day range between {27 + h} preceding and {h} preceding)" for h in (1, 7, 14))
query("drift", oracle(f"with {PRIOR}, g as (select *, label - py364 as gap from p) select entity_id, day, {DRIFTS} from g {FRAMES}", "activity"))(lambda s, d: history.drift(view(s, d, "activity")).select(*KEY, "drift1", "drift7", "drift14"))
query(
    "holiday_distance",
    oracle(
        """with f as (select entity_id, day, case when label / 100 > 0.95 then day end as f from activity),
        x as (select entity_id, day, min(f) over (partition by entity_id order by day rows between current row and unbounded following) - day as days_until, day - max(f) over (partition by entity_id order by day) as days_since from f)
        select *, case when days_until is not null then ln(1 + least(days_until, 180)) end as log_days_until, case when days_since is not null then ln(1 + least(days_since, 180)) end as log_days_since from x""",
        "activity",
    ),
)(lambda s, d: history.holiday_distance(view(s, d, "activity").withColumn("score", F.col("label") / 100), above=0.95).select(*KEY, "days_until", "days_since", "log_days_until", "log_days_since"))
query(
    "season_edges",
    oracle(
        """with n as (select entity_id, day, case when day - lag(day) over (partition by entity_id order by day) > 3 then 1 else 0 end as new from activity),
        s as (select entity_id, day, sum(new) over (partition by entity_id order by day) as season from n)
        select entity_id, day, season::bigint as season, row_number() over (partition by entity_id, season order by day) <= 3 as season_start, row_number() over (partition by entity_id, season order by day desc) <= 3 as season_end from s""",
        "activity",
    ),
)(lambda s, d: history.season_edges(view(s, d, "activity"), gap=3).select(*KEY, "season", "season_start", "season_end"))
query("time_folds", oracle("select entity_id, day, ntile(6) over (partition by entity_id order by day) as fold from activity", "activity"))(lambda s, d: history.time_folds(view(s, d, "activity")).select(*KEY, "fold"))
query("latest_attributes", oracle("select entity_id, max(day) as day, max_by(label, day) as label, max_by(volume, day) as volume from activity group by 1", "activity"))(lambda s, d: history.latest(view(s, d, "activity"), ["label", "volume"]))
SPINE = "l as (select entity_id, max(day) as last_day from activity group by 1), e as (select max(last_day) as end_day from l), sp as (select entity_id, last_day, unnest(range(end_day + 1, end_day + 31)) as day from l, e where last_day > end_day - 60)"
query("future_spine", oracle(f"with {SPINE} select entity_id, last_day, day, day - last_day as days_ahead from sp", "activity"))(lambda s, d: history.future_spine(view(s, d, "activity")))
query(
    "future_drift",
    oracle(
        f"""with {SPINE}, u as (select entity_id, day, label, null as last_day from activity union all select entity_id, day, null, last_day from sp),
        p as (select u.*, x.label as py357, y.label as py364, z.label as py371 from u left join activity x on x.entity_id = u.entity_id and x.day = u.day - 357
          left join activity y on y.entity_id = u.entity_id and y.day = u.day - 364 left join activity z on z.entity_id = u.entity_id and z.day = u.day - 371),
        g as (select *, label - py364 as gap from p), r as (select *, {DRIFTS} from g {FRAMES})
        select entity_id, day, py364, {MEAN} as py_mean, {', '.join(f'case when day - {h} <= last_day then drift{h} end as drift{h}' for h in (1, 7, 14))} from r where last_day is not null""",
        "activity",
    ),
)(lambda s, d: history.future_drift(view(s, d, "activity")))
