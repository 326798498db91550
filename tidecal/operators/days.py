"""Filters, flags and features of entity-day rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import hours_open, minutes

#: Keyword groups of event texts.
EVENT_GROUPS = {"hot": "hot|red", "cold": "cold|blue", "ring": r"ring\b", "anvil": "anvil"}


def labelled(df: DataFrame) -> DataFrame:
    """Rows to learn from: open, with a label that was observed."""
    return df.where((F.col("status") == "open") & F.col("label").isNotNull() & ~F.coalesce("predicted", F.lit(False)))


def enhance(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows with their scores; closed and predicted days and entities without any score are dropped.

    A null status is not closed, and a null flag is not predicted.
    """
    kept = df.where(~(F.coalesce(F.col("status") == "closed", F.lit(False)) | F.coalesce("predicted", F.lit(False))))
    return kept.join(scores.select("entity_id").distinct(), "entity_id", "left_semi").join(scores, ["entity_id", "day"], "left")


def without_score(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Entities that enhance() drops for want of any score, with their rows."""
    return df.join(scores.select("entity_id").distinct(), "entity_id", "left_anti").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_rows"))


def between_days(first: str, last: str, date: str = "date") -> Column:
    return F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def excluded_by_group(df: DataFrame, ends: DataFrame, first: str, default_end: str) -> DataFrame:
    """Adds excluded: whether a date lies in its group's window; ends: country, end_date."""
    joined = df.join(ends, "country", "left")
    return joined.withColumn("excluded", F.col("date").between(F.lit(first).cast("date"), F.coalesce("end_date", F.lit(default_end).cast("date")))).drop("end_date")


def time_split(df: DataFrame, train_end: str, valid_end: str) -> DataFrame:
    """Adds split: train, valid or test in time order."""
    if not train_end < valid_end:
        raise ValueError("split dates must increase strictly")
    return df.withColumn("split", F.when(F.col("date") <= F.lit(train_end).cast("date"), "train").when(F.col("date") <= F.lit(valid_end).cast("date"), "valid").otherwise("test"))


def calendar_features(df: DataFrame, entities: DataFrame, window: tuple[str, str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Weekday (Monday 0), weekend, month, ISO week, year, annual wave, months since opening, hemisphere, window flag.

    carry: columns of entities that the rows take along in the same join. Without a window no day is in it.
    """
    out = df.join(entities.select("entity_id", *carry, "latitude", "first_year", "first_month"), "entity_id", "left")
    wave = 2 * F.pi() * F.dayofyear("date") / 365.25
    return out.withColumns(
        {
            "dow": F.weekday("date"),
            "weekend": (F.weekday("date") >= 5).cast("int"),
            "month": F.month("date"),
            "week": F.weekofyear("date"),
            "year": F.year("date"),
            "wave_sin": F.sin(wave),
            "wave_cos": F.cos(wave),
            "months_open": (F.year("date") - F.col("first_year")) * 12 + F.month("date") - F.col("first_month"),
            "south": (F.col("latitude") < 0).cast("int"),
            "in_window": between_days(*window).cast("int") if window else F.lit(0),
        }
    ).drop("latitude", "first_year", "first_month")


def hours_features(df: DataFrame) -> DataFrame:
    """Adds open_min, close_min and duration; gaps take the entity's median, a window by entity like those of its history."""
    out = df.withColumns({"open_min": minutes(F.col("opens")), "close_min": minutes(F.col("closes"))}).withColumn("duration", hours_open(F.col("open_min"), F.col("close_min")))
    names = ("open_min", "close_min", "duration")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.median(c).over(Window.partitionBy("entity_id"))) for c in names})


def event_flags(df: DataFrame, groups: dict[str, str] | None = None) -> DataFrame:
    """Adds has_event and a flag for each keyword group."""
    text = F.lower(F.coalesce("events", F.lit("")))
    return df.withColumns({"has_event": (text != "").cast("int"), **{f"event_{k}": text.rlike(p).cast("int") for k, p in (groups or EVENT_GROUPS).items()}})


def require_horizon(df: DataFrame, first_day: int, days: int = 15) -> DataFrame:
    """The rows themselves; raises if the horizon holds rows and none of them has a weather source."""
    if horizon_guard(df, first_day, days).first().blind:
        raise ValueError(f"no row of days {first_day} to {first_day + days - 1} has a weather source")
    return df


def horizon_guard(df: DataFrame, first_day: int, days: int = 15) -> DataFrame:
    """Rows in the horizon, rows without a source, and whether the horizon is blind (rows, but none with a source)."""
    near = df.where(F.col("day").between(first_day, first_day + days - 1))
    return near.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum((F.col("wx_source") == "none").cast("long")), F.lit(0)).alias("n_none")).withColumn("blind", (F.col("n_rows") > 0) & (F.col("n_rows") == F.col("n_none")))
