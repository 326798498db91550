"""Queries on scores, weights, status chains and composed frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import days, frames, history, holidays, models, scores, status, weather
from ..sources.contracts import Contract, report
from ..sources.scratch import together
from .adapters import is_sharing, oracle, shared, view
from .days import DRIFTS, FRAMES, KEY, MEAN, SPINE, WINDOW
from .registry import query
from .surroundings import EITHER, ROUND4, WEATHER

cal = lambda s, d: view(s, d, "calendar")
#: The calendar merge over all regions: urgent rows are verified and replace those of their code, day and type.
MERGED = f"""vr as (select * from source_rows where name = '1-URGENT'), ur as (select code, day, type, share from source_rows s where name <> '1-URGENT' and not exists (select 1 from vr where vr.code = s.code and vr.day = s.day and vr.type = s.type) union all select code, day, type, share from vr),
 cm as (select code, day, type, {EITHER} as share from ur group by 1, 2, 3), fn as (select cm.* from cm where code in (select code from regions) union all select r.code, day, type, share from cm join regions r on r.country = cm.code),
 cc as (select code, day, type, {EITHER} as share from fn group by 1, 2, 3), cw as (select code, day, {ROUND4.format('national')}, {ROUND4.format('school')} from cc group by 1, 2), mg as (select * from cw where national > 1e-6 or school > 1e-6)"""
SCORES = f"{MERGED}, sm as (select entity_id, day, sum(prior * national) as n, sum(prior * school) as s from markets join mg using (code) group by 1, 2), sc as (select a.entity_id, a.day, greatest(0, least(1, coalesce(n, 0)))::double as national_score, greatest(0, least(1, coalesce(s, 0)))::double as school_score from activity a left join sm using (entity_id, day))"


def merged(s, d):
    """Region calendars by the whole merge, with all regions and no code renamed; urgent rows are the verified ones."""
    return shared(d, "merged", lambda: _merged(s, d))


def _merged(s, d):
    regions = view(s, d, "regions").select("code", "country", F.lit(1).alias("n_children"))
    none = s.sql("select '' as code, '' as new_code, 1.0D as factor where false")
    if is_sharing():  # rows of a code, day and type are combined already
        src = view(s, d, "source_days")
        return holidays.merge(src.where("not urgent"), regions, none, verified=src.where("urgent"))["calendar"]
    src = view(s, d, "source_rows")
    return holidays.merge(src.where("name <> '1-URGENT'"), regions, none, verified=src.where("name = '1-URGENT'"))["calendar"]


def daily(s, d):
    return scores.daily_scores(view(s, d, "markets").withColumnRenamed("prior", "weight"), merged(s, d), view(s, d, "activity").select("entity_id", "day"))


query("holiday_scores", oracle(f"with {SCORES} select * from sc", "source_rows", "regions", "markets", "activity"))(daily)
query("holiday_features", oracle(f"with {SCORES} select a.entity_id, a.day, floor(national_score * 1000000000 + 0.5) / 1000000000 as national_score, floor(school_score * 1000000000 + 0.5) / 1000000000 as school_score from activity a left join sc on sc.entity_id = a.entity_id and sc.day = a.day", "source_rows", "regions", "markets", "activity"))(
    lambda s, d: scores.lookup(view(s, d, "activity").select(*KEY), daily(s, d), digits=9)
)
query("strength_scale", oracle("with t as (select quantile_cont(prior, 0.95) as top from markets where prior > 0) select entity_id, code, greatest(0, least(1, prior / top)) as strength, 100 * (exp(prior) - 1) as uplift_pct from markets, t", "markets"))(
    lambda s, d: scores.strength(view(s, d, "markets"), "prior").select("entity_id", "code", "strength", "uplift_pct")
)
query(
    "assemble_weights",
    oracle(
        """with x as (select entity_id, code, case when region_id % 2 = 0 then 'national' else 'school' end as type, prior as weight, (region_id % 10) / 10.0 as stability, region_id * 3 as n_obs from markets where prior >= 0.02)
        select entity_id, code, type, floor(weight / sum(weight) over (partition by entity_id, type) * 100000 + 0.5) / 100000 as weight, case when stability >= 0.8 and n_obs >= 30 then 'high' when stability >= 0.5 then 'medium' else 'low' end as confidence from x""",
        "markets",
    ),
)(
    lambda s, d: scores.assemble(view(s, d, "markets").select("entity_id", "code", F.when(F.col("region_id") % 2 == 0, "national").otherwise("school").alias("type"), F.col("prior").alias("weight"), ((F.col("region_id") % 10) / 10).alias("stability"), (F.col("region_id") * 3).alias("n_obs")), 0.02).select("entity_id", "code", "type", "weight", "confidence")
)
query(
    "prior_only_weights",
    oracle("with k as (select entity_id, code, prior, t as type from markets cross join (select unnest(['national', 'school']) as t) where t = 'national' or code in (select code from source_rows where type = 'school' and share >= 0.9)) select entity_id, code, type, prior / sum(prior) over (partition by entity_id, type) as weight from k", "markets", "source_rows"),
)(lambda s, d: scores.prior_only(view(s, d, "markets"), view(s, d, "source_rows").where("type = 'school' and share >= 0.9").select("code").distinct()).select("entity_id", "code", "type", "weight"))
#: The one level at which min(cap, level * mixed) sums to 1, among those that each row would give.
BLEND = """m0 as (select entity_id, code, prior, 0.6 * prior + 0.4 * prior * prior / sum(prior * prior) over (partition by entity_id) as w, 1.1 * prior + 0.004 as cap from markets),
 m1 as (select *, (1 - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (o rows between current row and unbounded following) as level, row_number() over o as k from m0 window o as (partition by entity_id order by cap / w, code)),
 m2 as (select entity_id, arg_min(level, k) as level from m1 where level * w <= cap * (1 + 1e-12) group by 1)"""
query("blend_weights", oracle(f"with {BLEND} select m0.entity_id, code, least(cap, level * w) as weight from m0 join m2 on m2.entity_id = m0.entity_id", "markets"))(
    lambda s, d: scores.blend(view(s, d, "markets").withColumn("fitted", F.col("prior") * F.col("prior")), 0.4, kappa=1.1).select("entity_id", "code", "weight")
)
query(
    "coverage_mass",
    oracle("with c as (select split_part(code, '-', 1) as country, year(date) as year, max((type = 'school' and share >= 0.9)::int) as covered from source_rows group by 1, 2) select m.entity_id, year, sum(prior * covered) / any_value(t) as mass from markets m join c using (country) join (select entity_id, sum(prior) as t from markets group by 1) a on a.entity_id = m.entity_id group by 1, 2", "markets", "source_rows"),
)(
    lambda s, d: scores.coverage_mass(view(s, d, "markets"), view(s, d, "source_rows").groupBy(F.split("code", "-")[0].alias("country"), F.year("date").alias("year")).agg(F.max(((F.col("type") == "school") & (F.col("share") >= 0.9)).cast("int")).alias("covered")))
)
query("placebo_shift", oracle("with s as (select min(day) as lo, max(day) - min(day) + 1 as n from source_rows) select row_id, code, lo + (day - lo + 180) % n as day from source_rows, s", "source_rows"))(lambda s, d: scores.placebo(view(s, d, "source_rows"), 180).select("row_id", "code", "day"))
query(
    "control_events",
    oracle("with e as (select entity_id, events, count(distinct day) as days from calendar where events is not null and not regexp_matches(lower(events), 'red|blue') group by 1, 2 having count(distinct day) >= 15), r as (select *, row_number() over (partition by entity_id order by events) as rn from e) select * from r where rn <= 12", "calendar"),
)(lambda s, d: scores.control_events(cal(s, d), "red|blue"))
CONTROLS = [(f"dow{k}", f"isodow(date) - 1 = {k}") for k in range(1, 7)] + [(f"{f}{k}", f"case when n_waves >= {k} then {f}({k} * 2 * pi() * dayofyear(date) / 365.25) else 0 end") for k in range(1, 9) for f in ("sin", "cos")]
CONTROLS += [("season_start", "season_start"), ("season_end", "season_end")]
NAMES, VALUES = ", ".join(f"'{n}'" for n, _ in CONTROLS), ", ".join(f"({v})::int::double" if n[0] in "d" or "season" in n else f"({v})::double" for n, v in CONTROLS)
EVENTS = "ce as (select entity_id, events, count(distinct day) as days from calendar where events is not null and not regexp_matches(lower(events), 'red|blue') group by 1, 2 having count(distinct day) >= 15), ev as (select entity_id, events, row_number() over (partition by entity_id order by events) as rn from ce)"
chosen = lambda s, d: cal(s, d).join(scores.control_events(cal(s, d), "red|blue").select("entity_id", "events", "rn"), ["entity_id", "events"])
query(
    "control_design",
    oracle(
        f"""with {EVENTS}, n as (select entity_id, day, date, count(*) over (partition by entity_id) as n_rows, case when day - lag(day) over (partition by entity_id order by day) > 14 then 1 else 0 end as new from activity),
        r as (select *, sum(new) over (partition by entity_id order by day) as season, case when n_rows >= 800 then 8 when n_rows >= 400 then 4 else 2 end as n_waves from n),
        w as (select *, row_number() over (partition by entity_id, season order by day) <= 3 as season_start, row_number() over (partition by entity_id, season order by day desc) <= 3 as season_end from r),
        p as (select entity_id, day, n_rows, unnest([{NAMES}]) as name, unnest([{VALUES}]) as value from w union all select entity_id, day, n_rows, 'year' || year(date), 1.0 from w where n_rows >= 300
          union all select distinct c.entity_id, c.day, n_rows, 'event ' || c.events, 1.0 from calendar c join ev on ev.entity_id = c.entity_id and ev.events = c.events and rn <= 12 join w on w.entity_id = c.entity_id and w.day = c.day),
        q as (select *, min(value) over k as low, max(value) over k as high, count(*) over k as m from p window k as (partition by entity_id, name)) select entity_id, day, name, value from q where high > low or (m < n_rows and high <> 0)""",
        "calendar",
    ),
)(lambda s, d: scores.control_design(view(s, d, "activity"), chosen(s, d).withColumnRenamed("events", "event")))
REPL = "rp as (select s_nationkey as entity_id, c_nationkey as region_id, year(l_shipdate) as y, sum(l_quantity) as q from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2, 3), rw as (select *, q / sum(q) over (partition by entity_id, y) as weight from rp)"
query("bootstrap_summary", f"with {REPL} select entity_id, region_id, quantile_cont(weight, 0.05) as ci_low, quantile_cont(weight, 0.95) as ci_high, avg((weight > 1e-4)::int) as stability from rw group by 1, 2")(
    lambda s, d: (view(s, d, "markets"), scores.bootstrap_summary(s.sql(f"with {REPL} select * from rw"), ["entity_id", "region_id"]))[1]
)
R2 = "avg(label) / 1000 * (1 + entity_id % 3 * rn * (1 - rn) + entity_id % 5 * rs * (1 - rs) / 4 + rn * rs / 7)"
query(
    "blend_choice",
    oracle(
        f"""with r as (select entity_id, rn, rs, {R2} as r2 from activity cross join (select unnest([0.0, 0.25, 0.5, 0.75])::double as rn) cross join (select unnest([0.0, 0.25, 0.5, 0.75])::double as rs) group by 1, 2, 3),
        t as (select entity_id, max(r2) - max(case when rn = 0 and rs = 0 then r2 end) as gain, (max({{'r2': r2, 'n': -rn, 's': -rs}})).n * -1 as best from r group by 1),
        u as (select r.entity_id, rs, r2 - max(case when rs = 0 then r2 end) over w as g from r join t on t.entity_id = r.entity_id and rn = best window w as (partition by r.entity_id)),
        v as (select entity_id, case when max(g) > 0.0005 then min(case when g >= 0.75 * top then rs end) else 0.0 end as school from (select *, max(g) over (partition by entity_id) as top from u) group by 1),
        x as (select r.entity_id, rn, r2 - max(case when rn = 0 then r2 end) over w as g from r join v on v.entity_id = r.entity_id and rs = school window w as (partition by r.entity_id)),
        y as (select entity_id, case when max(g) > 0.0005 then min(case when g >= 0.75 * top then rn end) else 0.0 end as national from (select *, max(g) over (partition by entity_id) as top from x) group by 1)
        select t.entity_id, case when gain > 0.001 then national else 0.0 end as national, case when gain > 0.001 then school else 0.0 end as school, gain from t join v on v.entity_id = t.entity_id join y on y.entity_id = t.entity_id""",
        "activity",
    ),
)(
    lambda s, d: scores.blend_choice(
        view(s, d, "activity").withColumn("rn", F.explode(F.array(*map(F.lit, scores.BLENDS)))).withColumn("rs", F.explode(F.array(*map(F.lit, scores.BLENDS)))).groupBy("entity_id", "rn", "rs").agg(F.expr(f"{R2} as r2")).withColumnsRenamed({"rn": "national", "rs": "school"})
    )
)

MIN = "split_part({0}, ':', 1)::int * 60 + split_part({0}, ':', 2)::int"


def chain_sql(name: str, source: str, value: str, how: str) -> str:
    return f"""{name}_e as (select entity_id, max(day) as e from {source} group by 1), {name}_r as (select r.* from {source} r join {name}_e using (entity_id) where day > e - 84),
 {name}_d as (select entity_id, (day + 3) % 7 as dow, {how}({value}) as v from {name}_r group by 1, 2), {name}_a as (select entity_id, {how}({value}) as v from {name}_r group by 1),
 {name} as (select p.entity_id, p.day, coalesce(y.{value}, d.v, a.v) as v from sp p left join {source} y on y.entity_id = p.entity_id and y.day = p.day - 364 left join {name}_d d on d.entity_id = p.entity_id and d.dow = (p.day + 3) % 7 left join {name}_a a on a.entity_id = p.entity_id)"""


OPEN = "op as (select entity_id, day, (status = 'open')::int::double as is_open from calendar where status in ('open', 'closed'))"
HOURS = f"hr as (select entity_id, day, ({MIN.format('opens')})::double as o, ({MIN.format('closes')})::double as c from calendar where status = 'open')"
LOOK = f"{SPINE}, {OPEN}, {chain_sql('io', 'op', 'is_open', 'avg')}"
FUT = f"{SPINE}, {HOURS}, {chain_sql('oo', 'hr', 'o', 'median')}, {chain_sql('co', 'hr', 'c', 'median')}, fh as (select oo.entity_id, oo.day, oo.v as open_min, co.v as close_min, case when co.v < oo.v then (co.v - oo.v) / 60 + 24 else (co.v - oo.v) / 60 end as duration from oo join co using (entity_id, day))"
spine = lambda s, d: history.future_spine(view(s, d, "activity"))
query("is_open_lookup", oracle(f"with {LOOK} select entity_id, day, coalesce(v, 1.0) as rate, coalesce(v, 1.0) >= 0.5 as is_open from io", "calendar", "activity"))(lambda s, d: status.is_open_lookup(cal(s, d), spine(s, d)))
query("future_hours", oracle(f"with {FUT} select * from fh", "calendar", "activity"))(lambda s, d: status.future_hours(cal(s, d), spine(s, d)))
KNOWN = f"kn as (select fh.*, k.status, {MIN.format('k.opens')} as ko, {MIN.format('k.closes')} as kc from fh left join calendar k on k.entity_id = fh.entity_id and k.day + 371 = fh.day), kk as (select *, coalesce(status = 'closed' or (status = 'open' and ko is not null and kc is not null), false) as known, coalesce(status = 'open' and ko is not null and kc is not null, false) as known_open from kn)"
known = lambda s, d: status.known_schedule(status.future_hours(cal(s, d), spine(s, d)), cal(s, d).withColumn("day", F.col("day") + 371))
query("known_schedule", oracle(f"with {FUT}, {KNOWN} select entity_id, day, known, known_open, ko as known_open_min, kc as known_close_min from kk", "calendar", "activity"))(lambda s, d: known(s, d).select(*KEY, "known", "known_open", "known_open_min", "known_close_min"))
query(
    "apply_known_hours",
    oracle(f"with {FUT}, {KNOWN}, ap as (select entity_id, day, case when known_open then ko else open_min end::double as open_min, case when known_open then kc else close_min end::double as close_min from kk) select *, case when close_min < open_min then (close_min - open_min) / 60 + 24 else (close_min - open_min) / 60 end as duration from ap", "calendar", "activity"),
)(lambda s, d: status.apply_known_hours(known(s, d)).select(*KEY, "open_min", "close_min", "duration"))
TER = f"ev as (select entity_id, day, (coalesce(events, '') <> '')::int as has_event, ({MIN.format('closes')})::double as close_min from calendar where status = 'open'), cu as (select entity_id, quantile_cont(close_min, 1 / 3) as a, quantile_cont(close_min, 2 / 3) as b from ev where has_event = 0 and close_min is not null group by 1), te as (select ev.*, case when close_min is null then null when has_event = 1 then 'event' when close_min <= a then 'early' when close_min <= b then 'middle' else 'late' end as category from ev left join cu using (entity_id))"
terciles = lambda s, d: status.closing_terciles(cal(s, d).where("status = 'open'").select(*KEY, (F.coalesce("events", F.lit("")) != "").cast("int").alias("has_event"), status.minutes(F.col("closes")).cast("double").alias("close_min")))
query("closing_terciles", oracle(f"with {TER} select entity_id, day, category from te", "calendar"))(lambda s, d: terciles(s, d).select(*KEY, "category"))
query(
    "closing_decode",
    oracle(
        f"""with {TER}, tr as (select * from te where category is not null and day < 10000), fi as (select entity_id, category, median(close_min) as v from tr group by 1, 2), en as (select entity_id, median(close_min) as v from tr group by 1),
        o as (select category, median(close_min - en.v) as v from tr join en using (entity_id) group by 1), al as (select median(close_min) as v from tr) select t.entity_id, t.day, coalesce(fi.v, en.v + o.v, al.v) as decoded from te t left join fi using (entity_id, category) left join en on en.entity_id = t.entity_id left join o on o.category = t.category, al where t.category is not null and t.day >= 10000""",
        "calendar",
    ),
)(lambda s, d: (lambda t: status.closing_decode(t.where("day < 10000"), t.where("day >= 10000")).select(*KEY, "decoded"))(terciles(s, d).where("category is not null")))
LABELS = "la as materialized (select entity_id, day, date, label, opens, closes, events, status from calendar where status = 'open' and label is not null and not predicted)"
AHEAD = f"{LABELS}, {SPINE.replace('from activity', 'from la')}"
#: Scores of all days of the calendar and of the future, with distances, as frames.holiday_columns() has them.
HOLIDAYS = f"""{MERGED}, kd as (select entity_id, day from calendar union select entity_id, day from sp), sm as (select entity_id, day, sum(prior * national) as n, sum(prior * school) as s from markets join mg using (code) group by 1, 2),
 sc as materialized (select k.entity_id, k.day, greatest(0, least(1, coalesce(n, 0)))::double as national_score, greatest(0, least(1, coalesce(s, 0)))::double as school_score from kd k left join sm using (entity_id, day)),
 hd as (select *, {', '.join(f"min(case when {k}_score > 0.200000001 then day end) over (partition by entity_id order by day rows between current row and unbounded following) - day as {k}_until, day - max(case when {k}_score > 0.200000001 then day end) over (partition by entity_id order by day) as {k}_since" for k in frames.KINDS)} from sc),
 ho as materialized (select *, {', '.join(f"case when {k}_{c} is not null then ln(1 + least({k}_{c}, 180)) end as {k}_log_{c}" for k in frames.KINDS for c in ('until', 'since'))} from hd)"""
#: Date features of a row with date d, and its entity e.
DATES = f"""company, tier, isodow(d) - 1 as dow, (isodow(d) >= 6)::int as weekend, month(d) as month, weekofyear(d) as week, year(d) as year, sin(2 * pi() * dayofyear(d) / 365.25) as wave_sin, cos(2 * pi() * dayofyear(d) / 365.25) as wave_cos,
 (year(d) - first_year) * 12 + month(d) - first_month as months_open, (latitude < 0)::int as south"""
IN_WINDOW = f"(d between date '{WINDOW[0]}' and date '{WINDOW[1]}')::int as in_window"
FLAGS = "(coalesce(events, '') <> '')::int as has_event, " + ", ".join(f"regexp_matches(lower(coalesce(events, '')), '{p}')::int as event_{k}" for k, p in days.EVENT_GROUPS.items())
BASES = ("calendar", "entities", "markets", "source_rows", "regions", "station")
STATION = f"{WEATHER}, wx as (select entity_id as station_id, * exclude (entity_id) from wf)"
WX = ", ".join(f"wx.{c}" for c in weather.FEATURES)
SEEN = ["company", "tier", *frames.CALENDAR]
EVENT_COLUMNS = ["has_event", *[f"event_{k}" for k in days.EVENT_GROUPS]]


def ready(s, d, station: bool = True) -> None:
    """In a query that shares, the tables that its frames read: lines by day, markets, and orders by day, made side by side."""
    if is_sharing():
        wanted = [lambda: view(s, d, "calendar"), lambda: view(s, d, "markets"), lambda: (merged(s, d), station and view(s, d, "station"))]
        together(s, wanted)  # no two of them need the same table


def holidays_of(s, d, calendar=None):
    """Holiday columns of all days of the calendar and of the future."""
    calendar = cal(s, d) if calendar is None else calendar
    keys = calendar.select(*KEY).unionByName(history.future_spine(days.labelled(calendar)).select(*KEY)).distinct()
    return frames.holiday_columns(scores.daily_scores(view(s, d, "markets").withColumnRenamed("prior", "weight"), merged(s, d), keys))


def stations(s, d, shift: int = 0):
    """Station days by entity, `shift` days later."""
    station = weather.features(view(s, d, "station")).withColumn("day", F.col("day") + shift).withColumnRenamed("entity_id", "station_id")
    return station.join(view(s, d, "entities").select("entity_id", (F.col("entity_id") % 5).alias("station_id")), "station_id").drop("station_id")


def features(s, d):
    ready(s, d)
    calendar = cal(s, d)
    return frames.feature_frame(calendar, view(s, d, "entities"), holidays_of(s, d, calendar), stations(s, d), window=WINDOW)


def statuses(s, d):
    ready(s, d, station=False)
    calendar = cal(s, d)
    return frames.status_frame(calendar, view(s, d, "entities"), holidays_of(s, d, calendar), window=WINDOW)


def ahead(s, d):
    """Future days; station days 140 days before stand in for forecasts."""
    ready(s, d)
    calendar = cal(s, d)
    return frames.future_rows(calendar, view(s, d, "entities"), holidays_of(s, d, calendar), stations(s, d, 140).withColumn("wx_source", F.lit("station")), window=WINDOW)


FEATURES = [*SEEN, "in_window", "open_min", "close_min", "duration", *EVENT_COLUMNS, *frames.HOLIDAYS, "py364", "py_mean", "drift1", "drift7", "drift14", *weather.FEATURES]
query(
    "feature_frame",
    oracle(
        f"""with {AHEAD}, {HOLIDAYS}, {STATION}, lm as (select *, {MIN.format('opens')} as o, {MIN.format('closes')} as c from la), ld as (select *, date as d, case when c < o then (c - o) / 60.0 + 24 else (c - o) / 60.0 end as du from lm),
        md as (select entity_id, median(o) as mo, median(c) as mc, median(du) as mdu from ld group by 1),
        p as (select a.*, x.label as py357, y.label as py364, z.label as py371 from ld a {' '.join(f'left join la {t} on {t}.entity_id = a.entity_id and {t}.day = a.day - {k}' for t, k in (('x', 357), ('y', 364), ('z', 371)))}),
        g as (select *, {MEAN} as py_mean, label - py364 as gap from p), f as (select *, {DRIFTS} from g {FRAMES})
        select f.entity_id, f.day, f.label, {DATES}, {IN_WINDOW}, coalesce(o, mo)::double as open_min, coalesce(c, mc)::double as close_min, coalesce(du, mdu)::double as duration, {FLAGS}, {', '.join('ho.' + c for c in frames.HOLIDAYS)}, py364, py_mean, drift1, drift7, drift14, {WX}
        from f join entities e using (entity_id) left join md using (entity_id) left join ho on ho.entity_id = f.entity_id and ho.day = f.day left join wx on wx.station_id = f.entity_id % 5 and wx.day = f.day""",
        *BASES,
    ),
)(lambda s, d: features(s, d).select(*KEY, "label", *FEATURES))
LAST = [f"{v}_{k}" for v in ("is_open", "open_min", "close_min") for k in (357, 364, 371, "mean")]
STAT = ", ".join(f"x{k}.{a} as {b}_{k}" for a, b in (("is_open", "is_open"), ("o", "open_min"), ("c", "close_min")) for k in (357, 364, 371))
query(
    "status_frame",
    oracle(
        f"""with {AHEAD}, {HOLIDAYS}, sf as materialized (select *, date as d, (status = 'open')::int::double as is_open, ({MIN.format('opens')})::double as o, ({MIN.format('closes')})::double as c from calendar where status in ('open', 'closed')),
        j as (select sf.*, {STAT} from sf {' '.join(f'left join sf x{k} on x{k}.entity_id = sf.entity_id and x{k}.day = sf.day - {k}' for k in (357, 364, 371))})
        select j.entity_id, j.day, is_open, o as open_min, c as close_min, {', '.join(x for x in LAST if not x.endswith('mean'))}, {', '.join(f'(coalesce({v}_357, 0) + coalesce({v}_364, 0) + coalesce({v}_371, 0)) / nullif(({v}_357 is not null)::int + ({v}_364 is not null)::int + ({v}_371 is not null)::int, 0) as {v}_mean' for v in ('is_open', 'open_min', 'close_min'))},
          {DATES}, {IN_WINDOW}, {FLAGS}, {', '.join('ho.' + c for c in frames.HOLIDAYS)} from j join entities e using (entity_id) left join ho on ho.entity_id = j.entity_id and ho.day = j.day where j.entity_id in (select entity_id from sc)""",
        *BASES,
    ),
)(lambda s, d: statuses(s, d).select(*KEY, "is_open", "open_min", "close_min", *LAST, *SEEN, "in_window", *EVENT_COLUMNS, *frames.HOLIDAYS))
query(
    "future_rows",
    oracle(
        f"""with {AHEAD}, {HOLIDAYS}, {STATION}, {OPEN}, {HOURS}, {chain_sql('io', 'op', 'is_open', 'avg')}, {chain_sql('oo', 'hr', 'o', 'median')}, {chain_sql('co', 'hr', 'c', 'median')},
        sd as (select entity_id, last_day, day, date '1970-01-01' + day::int as d from sp), u as (select entity_id, day, label, null as last_day from la union all select entity_id, day, null, last_day from sp),
        p as (select u.*, x.label as py357, y.label as py364, z.label as py371 from u {' '.join(f'left join la {t} on {t}.entity_id = u.entity_id and {t}.day = u.day - {k}' for t, k in (('x', 357), ('y', 364), ('z', 371)))}),
        g as (select *, label - py364 as gap from p), r as (select *, {DRIFTS} from g {FRAMES}),
        fd as (select entity_id, day, py364, {MEAN} as py_mean, {', '.join(f'case when day - {h} <= last_day then drift{h} end as drift{h}' for h in (1, 7, 14))} from r where last_day is not null),
        ev as (select entity_id, day, (coalesce(events, '') <> '')::int as has_event, case when status in ('open', 'closed') then (status = 'open')::int::double end as was_open from calendar)
        select sd.entity_id, sd.last_day, sd.day::int as day, (sd.day - sd.last_day)::int as days_ahead, d as date, {DATES}, 0 as in_window, (select max_by(label, day) from la where la.entity_id = sd.entity_id) as last_label, coalesce(ev.has_event, 0) as has_event, ev.was_open as open_last_year,
          py364, py_mean, drift1, drift7, drift14, coalesce(io.v, 1.0) as rate, coalesce(io.v, 1.0) >= 0.5 as is_open, oo.v as open_min, co.v as close_min, case when co.v < oo.v then (co.v - oo.v) / 60 + 24 else (co.v - oo.v) / 60 end as duration,
          {', '.join('ho.' + c for c in frames.HOLIDAYS)}, {WX}, case when wx.station_id is null then 'none' else 'station' end as wx_source
        from sd join fd using (entity_id, day) join io using (entity_id, day) join oo using (entity_id, day) join co using (entity_id, day) join entities e using (entity_id) left join ho on ho.entity_id = sd.entity_id and ho.day = sd.day
        left join ev on ev.entity_id = sd.entity_id and ev.day = sd.day - 364 left join wx on wx.station_id = sd.entity_id % 5 and wx.day + 140 = sd.day""",
        *BASES,
    ),
)(ahead)

def contracted(s, d):
    """The calendar's report; a list of values is null where all are allowed, as in SQL."""
    rules = report(cal(s, d), Contract(("entity_id", "day", "holiday"), ("entity_id", "day"), {"status": ("open", "closed")}, {"label": (5, 95)}))
    return rules.withColumn("found", F.when(~F.col("rule").startswith("allowed:") | (F.col("n") > 0), F.col("found")))


query(
    "contract_report",
    oracle(
        """with a as (select count(*) as n, array_to_string(list_sort(list(distinct status))[1:5], ', ') as found from calendar where status not in ('open', 'closed')), r as (select count(*) as n, concat_ws(' to ', min(label)::varchar, max(label)::varchar) as found from calendar where label < 5 or label > 95)
        select 'allowed:status' as rule, n, found from a union all select 'range:label', n, found from r union all select 'missing_columns', 1::bigint, 'holiday' union all select 'duplicate_keys', (count(*) - count(distinct (entity_id, day)))::bigint, '' from calendar""",
        "calendar",
    ),
)(contracted)
query(
    "training_blanks",
    oracle("select entity_id, day, [0, 1, 7, 14][1 + (entity_id * 7919 + day * 104729) % 1000003 % 4] as lag, (entity_id * 7919 + day * 104729) % 1000003 % 16 < 4 as no_weather from activity", "activity"),
)(lambda s, d: models.training_blanks(view(s, d, "activity")).select(*KEY, "lag", "no_weather"))
query(
    "backfill_schedule",
    oracle("select a.entity_id, a.day, k as lead, a.day - k as made_day, k + 1 as lag, case when k <= 3 then k - 1 when k <= 16 then k - 7 end as weather_lead, 10000 + ((a.day - k - 10000) // 90) * 90 as refit_day from activity a cross join (select unnest([1, 7, 14, 30]) as k) where a.day - k between 10000 and 10800", "activity"),
)(lambda s, d: models.backfill_schedule(view(s, d, "activity"), 10000, 10800).select(*KEY, "lead", "made_day", "lag", "weather_lead", "refit_day"))
