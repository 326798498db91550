"""Queries that train models; their rows have no SQL counterpart."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import days, evaluation, fitting, frames, models, scores, status, weather
from ..sources.scratch import materialise
from . import states
from .adapters import is_sharing, view
from .registry import query as registered

query = partial(registered, share=True)

KEY = ["entity_id", "day"]
CUT = 10_600
BASIC = ["dow", "month", "wave_sin", "wave_cos", "months_open", "has_event", "national_score", "school_score", "national_log_until", "school_log_until"]
HISTORY, WEATHER = ["py364", "py_mean", "drift1", "drift7", "drift14"], weather.FEATURES
COLUMNS = [*BASIC, *HISTORY, *WEATHER]
#: Both holidays; and what the ridge has as numbers: weekday and month are dummies there.
HOLIDAYS = ("national_score", "school_score")
MORE = ["weekend", "in_window", "open_min", "close_min", "duration", "national_log_since", "school_log_since"]
NUMBERS = [*[c for c in COLUMNS if c not in ("dow", "month")], *MORE]


_kept: list = []


def kept(df):
    """df, written once and in the cache, in place of what an earlier query left there; that is read again should anything still need it."""
    while _kept:
        _kept.pop().unpersist()
    _kept.append(materialise(df).cache())
    return _kept[0]


def frame(s, d, columns=("in_window", *COLUMNS)):
    """The feature frame's model columns, kept while a query's fits and scores read them."""
    return kept(states.features(s, d).select(*KEY, "date", "label", *columns))


def _gated(s, d):
    rows = frame(s, d)
    return models.GatedModel.fit(rows, COLUMNS, HISTORY, CUT, tuple(WEATHER), excluded="in_window"), rows.where(F.col("day") > CUT)


@query("gated_predictions")
def gated_predictions(s, d):
    model, rows = _gated(s, d)
    return model.predict(rows)


@query("backtest_report")
def backtest_report(s, d):
    """Error by horizon and by group of entities."""
    model, rows = _gated(s, d)
    return models.backtest(model, rows)


@query("backfill_log")
def backfill_log(s, d):
    """Back-dated predictions of 600 days, with a new fit every 300; what stations saw a day or a week before stands in for forecasts."""
    rows = frame(s, d)
    archived = states.stations(s, d).withColumn("weather_lead", F.explode(F.array(F.lit(1), F.lit(7)))).withColumn("day", F.col("day") + F.col("weather_lead"))
    return models.replay(rows, 10_100, 10_699, COLUMNS, HISTORY, WEATHER, archived, refit=300, iterations=4, excluded="in_window")


@query("rf_predictions")
def rf_predictions(s, d):
    rows = frame(s, d)
    return models.forest(rows.where(F.col("day") <= CUT), rows.where(F.col("day") > CUT), COLUMNS)


@query("ridge_predictions")
def ridge_predictions(s, d):
    rows = frame(s, d, NUMBERS)
    return models.ridge(rows.where(F.col("day") <= CUT), rows.where(F.col("day") > CUT), NUMBERS, holiday=HOLIDAYS)


@query("model_comparison")
def model_comparison(s, d):
    """Error on test days of the forest and the ridge that did best on validation days, and of their mean."""
    rows = days.time_split(frame(s, d), "1996-12-31", "1997-12-31")
    return models.compare(rows, COLUMNS, depths=(5, 7), penalties=(10.0, 100.0), holiday=HOLIDAYS)


@query("model_zoo")
def model_zoo(s, d):
    """Error of all kinds of models and baselines on validation and test days."""
    rows = days.time_split(frame(s, d), "1996-12-31", "1997-12-31")
    return models.compare_all(rows, COLUMNS, HISTORY, [c for c in BASIC if c.startswith(("national", "school"))], HOLIDAYS, "in_window", iterations=4)


@query("status_predictions")
def status_predictions(s, d):
    rows = kept(states.statuses(s, d))
    columns = ["dow", "month", "has_event", "school_score", "is_open_364", "is_open_mean", "close_min_364"]
    wanted = [*KEY, "date", "is_open", "open_min", "close_min", *columns]
    return models.status_model(rows.where(F.col("day") <= CUT).select(*wanted), rows.where(F.col("day") > CUT).select(*wanted), columns)


@query("closing_predictions")
def closing_predictions(s, d):
    rows = days.hours_features(days.event_flags(view(s, d, "calendar").where("status = 'open'")))
    rows = status.closing_terciles(rows).where("category is not null").withColumns({"dow": F.weekday("date"), "month": F.month("date")})
    wanted = kept(rows.select(*KEY, "category", "dow", "month", "open_min", "has_event", "close_min"))
    train, test = wanted.where(F.col("day") <= CUT), wanted.where(F.col("day") > CUT)
    found = models.closing_category(train, test, ["dow", "month", "open_min", "has_event"])
    return status.closing_decode(train, found).select(*KEY, "category", F.col("decoded").alias("close_min"))


def fit_inputs(s, d):
    """Labelled days outside the excluded window, events, markets, the whole region calendar, and the years of school calendars."""
    states.ready(s, d, station=False)
    rows = days.labelled(view(s, d, "calendar")).where(~days.between_days(*states.WINDOW)).select(*KEY, "date", "label")
    school = view(s, d, "source_days" if is_sharing() else "source_rows").where("type = 'school'").select(F.split("code", "-")[0].alias("country"), F.year("date").alias("year")).distinct().join(view(s, d, "regions"), "country").select("code", "year")
    return rows, states.chosen(s, d).select(*KEY, "rn"), view(s, d, "markets").select("entity_id", "code", "prior"), states.merged(s, d), school


def fitted(s, d):
    return fitting.market_weights(*fit_inputs(s, d), draws=20)


@query("region_weights")
def region_weights(s, d):
    return fitted(s, d)


@query("entity_strength")
def entity_strength(s, d):
    """How much each entity's labels follow its fitted holiday scores."""
    return fitting.strengths(fitted(s, d))


@query("placebo_ranks")
def placebo_ranks(s, d):
    """Gain of the real calendar among eight shifted ones."""
    return fitting.placebo_ranks(*fit_inputs(s, d), shifts=tuple(range(113, 113 * 9, 113)))


@query("fitted_scores")
def fitted_scores(s, d):
    """Daily scores by the fitted weights: each kind's weights meet that kind's share."""
    weights = scores.assemble(fitted(s, d).where("weight > 0"))
    shares = states.merged(s, d).select("code", "day", F.explode(F.create_map(*[x for k in frames.KINDS for x in (F.lit(k), F.col(k))])).alias("type", "share"))
    sums = weights.join(shares, ["code", "type"]).groupBy("entity_id", "day", "type").agg(F.least(F.lit(1.0), F.sum(F.col("weight") * F.col("share"))).alias("score"))
    return sums.where("score > 0")


@query("batch_predictions")
def batch_predictions(s, d):
    """Labelled days from the cut on, scored as if made 7 days ahead."""
    model, rows = _gated(s, d)
    return model.predict(rows, 7)


@query("sub_model_predictions")
def sub_model_predictions(s, d):
    model, rows = _gated(s, d)
    return model.raw(rows, "fallback")


@query("feature_importance")
def feature_importance(s, d):
    model, _ = _gated(s, d)
    return s.createDataFrame(model.importance(), "feature string, share double")


@query("feature_ablation")
def feature_ablation(s, d):
    rows = frame(s, d)
    sets = {"calendar": BASIC, "calendar and last year": [*BASIC, "py364", "py_mean"], "without weather": [*BASIC, *HISTORY], "all": COLUMNS}
    return models.ablation(rows.where(F.col("day") <= CUT), rows.where(F.col("day") > CUT), sets)


@query("yearly_backtest")
def yearly_backtest(s, d):
    """Error of the last three full years, each predicted from all days before it."""
    rows = frame(s, d)
    return evaluation.error_by(models.yearly_backtest(rows, COLUMNS, [1996, 1997, 1998]), ["year"])


@query("forecast_output")
def forecast_output(s, d):
    """Future days with predictions, hours and known schedules (those of 371 days before stand in)."""
    ahead = states.ahead(s, d)
    model, _ = _gated(s, d)
    found = model.predict(ahead.withColumn("label", F.lit(None).cast("double"))).drop("label")
    return status.forecast_output(ahead, found, view(s, d, "calendar").withColumn("day", F.col("day") + 371))
