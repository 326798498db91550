"""Queries on baselines, metrics and the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from .adapters import oracle, view
from .registry import query

DOW = "f as (select *, isodow(date) - 1 as dow from activity), fine as (select entity_id, dow, avg(label) as m from f where day < 10957 group by 1, 2), coarse as (select entity_id, avg(label) as m from f where day < 10957 group by 1)"
BASE = f"{DOW}, base as (select f.entity_id, f.day, f.date, f.label, coalesce(fine.m, coarse.m, 50.0) as gm from f left join fine using (entity_id, dow) left join coarse on coarse.entity_id = f.entity_id)"
LAST = f"{BASE}, ly as (select b.entity_id, b.day, b.label, coalesce(y.label, b.gm) as prediction from base b left join activity y on y.entity_id = b.entity_id and y.day = b.day - 364)"


def rows(s, d):
    return view(s, d, "activity").withColumn("dow", F.weekday("date"))


def last(s, d):
    r = rows(s, d)
    return ev.last_year(r, r.where("day < 10957"), ["dow"])


query("baseline_group_mean", oracle(f"with {BASE} select entity_id, day, gm as prediction from base", "activity"))(lambda s, d: ev.group_mean(rows(s, d).where("day < 10957"), rows(s, d), ["dow"]).select("entity_id", "day", "prediction"))
query("baseline_global_mean", oracle("select entity_id, day, (select avg(label) from activity where day < 10957) as prediction from activity", "activity"))(lambda s, d: ev.global_mean(rows(s, d).where("day < 10957"), rows(s, d)).select("entity_id", "day", "prediction"))
query("baseline_last_year", oracle(f"with {LAST} select entity_id, day, prediction from ly", "activity"))(lambda s, d: last(s, d).select("entity_id", "day", "prediction"))
query("error_by_entity", oracle(f"with {LAST} select entity_id, count(*) as n, avg(abs(prediction - label)) as mae, sqrt(avg((prediction - label) ** 2)) as rmse, avg(prediction - label) as bias from ly group by 1", "activity"))(lambda s, d: ev.error_by(last(s, d), ["entity_id"]))
query(
    "regression_metrics",
    oracle(
        f"""with {LAST}, c as (select entity_id, label, greatest(0, least(100, prediction)) as p from ly),
        r as (select *, rank() over (order by label) + (count(*) over (partition by label) - 1) / 2.0 as rl, rank() over (order by floor(p * 100 + 0.5)) + (count(*) over (partition by floor(p * 100 + 0.5)) - 1) / 2.0 as rp from c)
        select count(*) as n, avg(abs(p - label)) as mae, sqrt(avg((p - label) ** 2)) as rmse, 1 - sum((p - label) ** 2) / (sum(label * label) - sum(label) * sum(label) / count(*)) as r2, corr(rl, rp) as spearman,
          (select median(m) from (select avg(abs(p - label)) as m from c group by entity_id)) as median_entity_mae from r""",
        "activity",
    ),
)(lambda s, d: ev.regression_metrics(last(s, d)))
OPEN = "o as (select c.entity_id, c.day, c.status = 'open' as actual, coalesce(p.status = 'open', true) as predicted from calendar c left join calendar p on p.entity_id = c.entity_id and p.day = c.day - 364)"


def is_open(s, d):
    from ..operators.history import at_lag

    c = view(s, d, "calendar").withColumn("actual", F.col("status") == "open").withColumn("_a", F.col("actual").cast("int"))
    return c.withColumn("predicted", F.coalesce(at_lag("_a", 364) == 1, F.lit(True)))


query(
    "confusion_metrics",
    oracle(
        f"""with {OPEN}, n as (select count(*) as n, sum((actual = predicted)::int) as ok, sum((actual and predicted)::int) as tp, sum((not actual and not predicted)::int) as tn, sum(predicted::int) as p, sum(actual::int) as a from o)
        select n, ok / n as accuracy, tp / nullif(p, 0) as open_precision, tp / nullif(a, 0) as open_recall, tn / nullif(n - p, 0) as closed_precision, tn / nullif(n - a, 0) as closed_recall, a / n as base_rate, greatest(a, n - a) / n as majority from n""",
        "calendar",
    ),
)(lambda s, d: ev.confusion(is_open(s, d), "actual", "predicted"))
query(
    "hours_metrics",
    oracle(
        """with h as (select entity_id, day, split_part(closes, ':', 1)::int * 60 + split_part(closes, ':', 2)::int as c from calendar), g as (select abs(a.c - b.c) as g from h a join h b on a.entity_id = b.entity_id and b.day = a.day - 364 where a.c is not null and b.c is not null)
        select count(*) as n, avg(g) as mae, median(g) as median_error, avg((g = 0)::int) as exact, avg((g <= 30)::int) as within_30 from g""",
        "calendar",
    ),
)(lambda s, d: ev.hours_metrics(_hours(s, d), "c", "c_last"))


def _hours(s, d):
    from ..functions.calendar import minutes
    from ..operators.history import at_lag

    c = view(s, d, "calendar").withColumn("c", minutes(F.col("closes")))
    return c.withColumn("c_last", at_lag("c", 364))


SCORED = """best as (select *, row_number() over (partition by entity_id, day, lead_days order by source desc, prediction) as k from log),
 sc as (select b.*, a.label as actual, b.prediction - a.label as error from best b join activity a using (entity_id, day) where k = 1 and day < 11000)"""


def scored(s, d):
    return ev.score_log(view(s, d, "log"), view(s, d, "activity").where("day < 11000"))


query("bucketed_error", oracle(f"with {SCORED} select case when lead_days <= 7 then '(0,7]' when lead_days <= 30 then '(7,30]' end as bucket, count(*) as n, avg(abs(error)) as mae from sc group by 1", "activity", "log"))(
    lambda s, d: scored(s, d).groupBy(ev.bucket(F.col("lead_days")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("error")).alias("mae"))
)
query("history_gate", oracle("select entity_id, count(*) / 365.25 as years, count(*) / 365.25 >= 1 as gated from activity where day <= 10700 and label is not null group by 1", "activity"))(lambda s, d: ev.history_gate(view(s, d, "activity"), 10700))
query(
    "gate_sweep",
    oracle(
        f"""with {LAST}, h as (select entity_id, count(*) / 365.25 as years from activity where day <= 10700 group by 1),
        per as (select entity_id, count(*) as n, sum(abs(prediction - label)) as e, sum(abs(50.0 - label)) as f from ly where day > 10700 group by 1),
        x as (select per.*, coalesce(years, 0) as years, t as threshold from per left join h using (entity_id) cross join (select unnest([0.0, 0.5, 1.0, 2.0, 3.0])::double as t))
        select threshold, 100.0 * sum((years >= threshold)::int) / count(*) as entities_pct, 100.0 * coalesce(sum(n) filter (years >= threshold), 0) / sum(n) as rows_pct, sum(e) filter (years >= threshold) / sum(n) filter (years >= threshold) as mae,
          sum(f) filter (years >= threshold) / sum(n) filter (years >= threshold) as mae_50, sum((years >= threshold and e / n > 20)::int)::bigint as over_20 from x group by 1""",
        "activity",
    ),
)(lambda s, d: ev.gate_sweep(last(s, d).where("day > 10700"), ev.history_gate(view(s, d, "activity"), 10700), (0, 0.5, 1, 2, 3)))
query("score_log", oracle(f"with {SCORED} select entity_id, day, lead_days, source, prediction, actual, error from sc", "activity", "log"))(lambda s, d: scored(s, d).select("entity_id", "day", "lead_days", "source", "prediction", "actual", "error"))
query(
    "log_append",
    oracle(
        """with nw as (select made_on, entity_id, day, lead_days, prediction + 1 as prediction, source from log where lead_days = 30 and source = 'live')
        select made_on, entity_id, day, lead_days, prediction, source from log l where not (made_on in (select made_on from nw) and source in (select source from nw)) union all select * from nw""",
        "log",
    ),
)(lambda s, d: ev.append_log(*(lambda g: (g, g.where("lead_days = 30 and source = 'live'").withColumn("prediction", F.col("prediction") + 1)))(view(s, d, "log").select("made_on", "entity_id", "day", "lead_days", "prediction", "source"))))
query("forecast_snapshot", oracle("select entity_id, day, day - 10500 as lead_days, last_year as prediction from lagged where day - 10500 in (1, 7, 14, 30) and last_year is not null", "lagged"))(
    lambda s, d: ev.snapshot(view(s, d, "lagged").withColumnRenamed("last_year", "prediction"), 10500, (1, 7, 14, 30)).select("entity_id", "day", "lead_days", "prediction")
)
STATS = "count(distinct day) as days, count(*) as n, 100 - avg(abs(error)) as accuracy, 100 * avg((abs(error) <= 10)::int) as within_10, avg(abs(error)) as mae, avg(error) as bias, avg((source = 'backtest')::int) as backtest_share"
RECENT = "rc as (select sc.*, w as window from sc cross join (select unnest([7, 14, 30, 90]) as w) where day > 10900 - w and day <= 10900)"
query("accuracy_summary", oracle(f"with {SCORED}, {RECENT} select \"window\", lead_days, {STATS} from rc group by 1, 2", "activity", "log"))(lambda s, d: ev.accuracy_summary(scored(s, d), 10900))
query(
    "accuracy_headline",
    oracle(
        f"""with {SCORED}, {RECENT}, su as (select "window", lead_days, {STATS} from rc group by 1, 2)
        select printf('Last 90 days at 7 days ahead, over %d days: accuracy %.0f, %.0f%% of rows off by 10 or less, mean error %.1f', days, round_even(accuracy, 0), round_even(within_10, 0), round_even(mae, 1)) as headline from su where "window" = 90 and lead_days = 7""",
        "activity",
        "log",
    ),
)(lambda s, d: ev.headline(ev.accuracy_summary(scored(s, d), 10900)))
query("accuracy_by_entity", oracle(f"with {SCORED}, {RECENT} select \"window\", lead_days, entity_id, {STATS} from rc group by 1, 2, 3", "activity", "log"))(lambda s, d: ev.accuracy_summary(scored(s, d), 10900, by=("entity_id",)))
LEADS = (1, 7, 14, 30)
WIDE = f"{SCORED}, wd as (select entity_id, day, any_value(actual) as actual, case when bool_or(source = 'live') then 'live' else 'backtest' end as source, {', '.join(f'max(prediction) filter (lead_days = {k}) as lead_{k}' for k in LEADS)} from sc group by 1, 2)"
query("accuracy_daily_wide", oracle(f"with {WIDE} select * from wd", "activity", "log"))(lambda s, d: ev.daily_wide(scored(s, d), LEADS))
query("accuracy_network", oracle(f"with {WIDE} select day, count(actual) as n_actual, avg(actual) as actual, {', '.join(f'avg(lead_{k}) as lead_{k}' for k in LEADS)} from wd group by 1", "activity", "log"))(lambda s, d: ev.network_daily(ev.daily_wide(scored(s, d), LEADS), LEADS))
query("matched_eval", oracle(f"with {LAST} select count(*) as n, avg(abs(a.prediction - a.label)) as mae_a, avg(abs(b.gm - a.label)) as mae_b from ly a join base b using (entity_id, day) where a.entity_id || '-' || a.day in (select entity_id || '-' || day from lagged where last_year is not null)", "activity", "lagged"))(
    lambda s, d: ev.matched(view(s, d, "lagged").where("last_year is not null").withColumnRenamed("last_year", "prediction"), ev.group_mean(rows(s, d).where("day < 10957"), rows(s, d), ["dow"]))
)
query(
    "history_buckets",
    oracle(
        f"""with {LAST}, h as (select entity_id, count(*) / 365.25 as years from activity where day <= 9600 group by 1),
        b as (select ly.*, case when years > 0 and years <= 0.5 then '(0,0.5]' when years > 0.5 and years <= 1 then '(0.5,1]' when years > 1 and years <= 2 then '(1,2]' when years > 2 and years <= 3 then '(2,3]' when years > 3 and years <= 100 then '(3,100]' end as bucket
          from ly join h using (entity_id) where day > 9600) select bucket, count(distinct entity_id) as entities, count(*) as n, avg(abs(prediction - label)) as mae from b where bucket is not null group by 1""",
        "activity",
    ),
)(lambda s, d: ev.history_buckets(last(s, d).where("day > 9600"), ev.history_gate(view(s, d, "activity"), 9600)))
AVERAGE = "rank() over (partition by fold order by {0}) + (count(*) over (partition by fold, {0}) - 1) / 2.0"
query(
    "fold_correlation",
    oracle(
        f"""with {LAST}, h as (select entity_id, count(*) / 365.25 as years from activity where day <= 9600 group by 1),
        p as (select ly.day // 365 as fold, entity_id, avg(abs(prediction - ly.label)) as mae from ly where day > 9600 group by 1, 2),
        r as (select p.*, years, {AVERAGE.format('mae')} as r_mae, {AVERAGE.format('years')} as r_years from p join h using (entity_id)) select fold::bigint as fold, count(*) as entities, corr(years, mae) as pearson, corr(r_years, r_mae) as spearman from r group by 1""",
        "activity",
    ),
)(lambda s, d: ev.fold_correlation(last(s, d).where("day > 9600").withColumn("fold", F.floor(F.col("day") / 365)), ev.history_gate(view(s, d, "activity"), 9600)))
