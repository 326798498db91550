"""Open or closed, and opening hours, by fallback chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import clock, hours_open, minutes
from .history import at_lag


def open_rows(calendar: DataFrame) -> DataFrame:
    """Open and closed days only, as is_open 1.0 or 0.0; other statuses are unknown."""
    return calendar.where(F.col("status").isin("open", "closed")).withColumn("is_open", (F.col("status") == "open").cast("double"))


def recent(df: DataFrame, value: str, span: int, how) -> tuple[DataFrame, DataFrame]:
    """Aggregate of a value over each entity's last `span` days: by weekday, and over all of them."""
    end = df.groupBy("entity_id").agg(F.max("day").alias("_end"))
    last = df.join(end, "entity_id").where(F.col("day") > F.col("_end") - span)
    return last.groupBy("entity_id", F.pmod(F.col("day") + 3, F.lit(7)).alias("dow")).agg(how(value).alias(f"{value}_dow")), last.groupBy("entity_id").agg(how(value).alias(f"{value}_all"))


def with_future(df: DataFrame, spine: DataFrame, columns: list[str]) -> DataFrame:
    """Known rows and future rows together, so that lags reach back; future tells them apart."""
    return df.select("entity_id", "day", *columns).withColumn("future", F.lit(False)).unionByName(spine.select("entity_id", "day").withColumn("future", F.lit(True)), allowMissingColumns=True)


def chain(df: DataFrame, spine: DataFrame, value: str, how, span: int = 84) -> DataFrame:
    """Future rows with a value: 364 days before, else by weekday of the last days, else over all of them."""
    lagged = with_future(df, spine, [value]).withColumn("_lag", at_lag(value, 364)).where("future").select("entity_id", "day", "_lag", F.pmod(F.col("day") + 3, F.lit(7)).alias("dow"))
    by_dow, by_all = recent(df, value, span, how)
    out = lagged.join(by_dow, ["entity_id", "dow"], "left").join(by_all, "entity_id", "left")
    return out.select("entity_id", "day", F.coalesce("_lag", f"{value}_dow", f"{value}_all").alias(value))


def is_open_lookup(calendar: DataFrame, spine: DataFrame) -> DataFrame:
    """rate and is_open of future days; open without any history."""
    rate = chain(open_rows(calendar), spine, "is_open", F.avg)
    return rate.select("entity_id", "day", F.coalesce("is_open", F.lit(1.0)).alias("rate")).withColumn("is_open", F.col("rate") >= 0.5)


def future_hours(calendar: DataFrame, spine: DataFrame) -> DataFrame:
    """Opening and closing minutes of future days."""
    known = calendar.where("status = 'open'").withColumns({"open_min": minutes(F.col("opens")).cast("double"), "close_min": minutes(F.col("closes")).cast("double")})
    parts = [chain(known, spine, c, F.median) for c in ("open_min", "close_min")]
    return parts[0].join(parts[1], ["entity_id", "day"]).withColumn("duration", hours_open(F.col("open_min"), F.col("close_min")))


def known_schedule(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """Adds known (closed, or open with both hours) and known_open."""
    named = schedule.select("entity_id", "day", "status", minutes(F.col("opens")).alias("known_open_min"), minutes(F.col("closes")).alias("known_close_min"))
    out = rows.join(named, ["entity_id", "day"], "left")
    both = F.col("known_open_min").isNotNull() & F.col("known_close_min").isNotNull()
    known = F.coalesce((F.col("status") == "closed") | ((F.col("status") == "open") & both), F.lit(False))
    return out.withColumns({"known": known, "known_open": F.coalesce(known & (F.col("status") == "open"), F.lit(False))}).drop("status")


def apply_known_hours(rows: DataFrame) -> DataFrame:
    """Known hours in place of predicted ones where the day is known to be open."""
    out = rows.withColumns({c: F.when(F.col("known_open"), F.col(f"known_{c}").cast("double")).otherwise(F.col(c)) for c in ("open_min", "close_min")})
    return out.withColumn("duration", hours_open(F.col("open_min"), F.col("close_min")))


def forecast_output(rows: DataFrame, predictions: DataFrame, schedule: DataFrame) -> DataFrame:
    """Future rows as they are published: known schedules win; a day known to be closed has neither prediction nor hours."""
    out = apply_known_hours(known_schedule(rows.join(predictions, ["entity_id", "day"]), schedule))
    shut = F.col("known") & ~F.col("known_open")
    unless_shut = lambda c: F.when(~shut, c)
    return out.select(
        "entity_id", "day", "date", "days_ahead", F.when(F.col("known"), F.col("known_open")).otherwise(F.col("is_open")).alias("is_open"), "known",
        *[unless_shut(F.col(c)).alias(c) for c in ("prediction", "drift_effect")], "low_confidence",
        unless_shut(clock(F.col("open_min"))).alias("opens"), unless_shut(clock(F.col("close_min"))).alias("closes"), "wx_source",
    )


def closing_terciles(df: DataFrame) -> DataFrame:
    """Adds category: event days, else early, middle or late by the terciles of the entity's other days."""
    cuts = df.where("has_event = 0 and close_min is not null").groupBy("entity_id").agg(F.expr("percentile(close_min, array(1/3D, 2/3D))").alias("cuts"))
    out = df.join(cuts, "entity_id", "left")
    late = F.when(F.col("close_min") <= F.col("cuts")[0], "early").when(F.col("close_min") <= F.col("cuts")[1], "middle").otherwise("late")
    return out.withColumn("category", F.when(F.col("close_min").isNull(), None).when(F.col("has_event") == 1, "event").otherwise(late)).drop("cuts")


def closing_decode(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Closing minutes of a category: the entity's median for it, else the entity's median plus the category's offset, else the median of all."""
    fine = train.groupBy("entity_id", "category").agg(F.median("close_min").alias("_fine"))
    entity = train.groupBy("entity_id").agg(F.median("close_min").alias("_entity"))
    offset = train.join(entity, "entity_id").groupBy("category").agg(F.median(F.col("close_min") - F.col("_entity")).alias("_offset"))
    everything = train.agg(F.median("close_min").alias("_all"))
    out = rows.join(fine, ["entity_id", "category"], "left").join(entity, "entity_id", "left").join(offset, "category", "left").crossJoin(F.broadcast(everything))
    return out.withColumn("decoded", F.coalesce("_fine", F.col("_entity") + F.col("_offset"), "_all")).drop("_fine", "_entity", "_offset", "_all")
