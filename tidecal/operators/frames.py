"""The composed frames: features of labelled days, of open and closed days, and of future days.

All windows of a frame are over one entity's days, so they share one exchange by entity and one sort by day. Entities are joined
once; scores and weather are joined by entity and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import minutes
from . import status
from .days import calendar_features, event_flags, hours_features, labelled
from .history import at_lag, drift, future_drift, future_spine, holiday_distance, latest, mean_of, prior_year

KEY = ["entity_id", "day"]
KINDS = ("national", "school")
#: What a day has from scores: the score, days to the next and since the last holiday, and their capped logarithms.
HOLIDAYS = [f"{k}_{c}" for k in KINDS for c in ("score", "until", "since", "log_until", "log_since")]
CALENDAR = ["dow", "weekend", "month", "week", "year", "wave_sin", "wave_cos", "months_open", "south"]


#: Scores are sums over regions whose order differs from run to run: less than this over a limit is no difference.
SUM_ERROR = 1e-9


def holiday_columns(scores: DataFrame, kinds: tuple[str, ...] = KINDS, above: float = 0.2) -> DataFrame:
    """Scores of every entity-day with their distances to holidays; a day is a holiday where its unrounded score is above.

    A score at the limit is none, whatever the last digit of its sum (SUM_ERROR).
    scores (entity_id, day, <kind>_score) have a row for every day that is asked for, and for those between.
    """
    out = scores
    for kind in kinds:
        found = holiday_distance(out, f"{kind}_score", above + SUM_ERROR)
        out = found.withColumnsRenamed({"days_until": f"{kind}_until", "days_since": f"{kind}_since", "log_days_until": f"{kind}_log_until", "log_days_since": f"{kind}_log_since"})
    return out


def attributes(rows: DataFrame, entities: DataFrame, window: tuple[str, str] | None) -> DataFrame:
    """Rows with what their entity is and what their date is; window: the days that in_window marks."""
    return calendar_features(rows, entities, window, carry=("company", "tier"))


def feature_frame(calendar: DataFrame, entities: DataFrame, holidays: DataFrame, weather: DataFrame, window: tuple[str, str] | None = None) -> DataFrame:
    """One row for each labelled day: attributes, date, hours, events, holidays, last year, drift and weather."""
    rows = event_flags(hours_features(attributes(labelled(calendar), entities, window)))
    rows = prior_year(rows.join(holidays, KEY, "left"))
    return drift(rows).join(weather, KEY, "left")


def status_frame(calendar: DataFrame, entities: DataFrame, holidays: DataFrame, window: tuple[str, str] | None = None) -> DataFrame:
    """One row for each open or closed day of entities with scores: attributes, date, hours, events, holidays, and status and hours of last year."""
    rows = status.open_rows(calendar).join(holidays.select("entity_id").distinct(), "entity_id", "left_semi")
    rows = rows.withColumns({c: minutes(F.col(text)).cast("double") for c, text in (("open_min", "opens"), ("close_min", "closes"))})
    names = ("is_open", "open_min", "close_min")
    out = rows.withColumns({f"{v}_{k}": at_lag(v, k) for v in names for k in (357, 364, 371)})
    out = out.withColumns({f"{v}_mean": mean_of([F.col(f"{v}_{k}") for k in (357, 364, 371)]) for v in names})
    return event_flags(attributes(out, entities, window)).join(holidays, KEY, "left")


def future_rows(calendar: DataFrame, entities: DataFrame, holidays: DataFrame, weather: DataFrame | None = None, days: int = 30, asof: int | None = None, window: tuple[str, str] | None = None) -> DataFrame:
    """Features of future days of active entities, by what was known at the end of day `asof` (the last day of all if None).

    holidays may hold future days, as calendars are known ahead. weather: entity_id, day, wx_source and its columns; rows
    without any have wx_source 'none'. in_window is 0: a window of the past holds no future day.
    """
    if asof is not None:
        calendar = calendar.where(F.col("day") <= asof)
    known = labelled(calendar)
    spine = future_spine(known, days)
    past = event_flags(calendar, {}).withColumn("was_open", F.when(F.col("status").isin("open", "closed"), (F.col("status") == "open").cast("double")))
    lagged = status.with_future(past, spine, ["has_event", "was_open"]).withColumns({"_event": at_lag("has_event", 364), "open_last_year": at_lag("was_open", 364)})
    lagged = lagged.where("future").select(*KEY, F.coalesce("_event", F.lit(0)).alias("has_event"), "open_last_year")
    last = latest(known, ["label", "status"]).select("entity_id", F.col("label").alias("last_label"))
    out = attributes(spine.withColumn("date", F.date_from_unix_date("day")), entities, window).withColumn("in_window", F.lit(0)).join(last, "entity_id", "left")
    for part in (lagged, future_drift(known, days), status.is_open_lookup(calendar, spine), status.future_hours(calendar, spine)):
        out = out.join(part, KEY)
    out = out.join(holidays, KEY, "left")
    if weather is None:
        return out.withColumn("wx_source", F.lit("none"))
    return out.join(weather, KEY, "left").withColumn("wx_source", F.coalesce("wx_source", F.lit("none")))
