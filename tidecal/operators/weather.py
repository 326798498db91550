"""Station weather: hourly to daily, flags, look-back, climatology, source preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import by_day


def hourly_to_daily(hourly: DataFrame) -> DataFrame:
    """Per station, date and lead: max and min temperature, rain (null without any value), wet hours (>= 0.1)."""
    return hourly.groupBy("station", F.to_date("hour").alias("date"), "lead").agg(
        F.max("temp").alias("temp_max"), F.min("temp").alias("temp_min"), F.sum("precip").alias("rain"), F.sum(F.when(F.col("precip") >= 0.1, 1).when(F.col("precip").isNotNull(), 0)).alias("wet_hours")
    )


def flag(condition: Column) -> Column:
    """1.0, 0.0, or null where the condition is unknown."""
    return condition.cast("double")


FLAGS = ["wet", "very_wet", "hot", "cold", "frost"]


def weather_flags(df: DataFrame) -> DataFrame:
    """Adds the five flags and sun_hours, each as far as its value is a column."""
    found = {"wet": ("precip", lambda x: x >= 1), "very_wet": ("precip", lambda x: x >= 10), "hot": ("temp_max", lambda x: x >= 30), "cold": ("temp_max", lambda x: x <= 5), "frost": ("temp_min", lambda x: x <= 0)}
    flags = {name: flag(test(F.col(c))) for name, (c, test) in found.items() if c in df.columns}
    return df.withColumns(flags | ({"sun_hours": F.col("sunshine") / 3600.0} if "sunshine" in df.columns else {}))


def _guarded(value: Column, frame, least: int) -> Column:
    return F.when(F.count(value).over(frame) >= least, F.sum(value).over(frame))


def look_back(df: DataFrame) -> DataFrame:
    """Rain of the previous 3 rows (2 values at least) and wet days of the previous 7 (5 at least); rows, not days."""
    return df.withColumns({"rain_prev3": _guarded(F.col("precip"), by_day().rowsBetween(-3, -1), 2), "wet_prev7": _guarded(flag(F.col("precip") >= 1), by_day().rowsBetween(-7, -1), 5)})


def look_ahead(df: DataFrame) -> DataFrame:
    """Rain of the next 3 rows (2 values at least) and the next row's values."""
    return df.withColumns({"rain_next3": _guarded(F.col("precip"), by_day().rowsBetween(1, 3), 2), "temp_next": F.lead("temp_max").over(by_day()), "rain_next": F.lead("precip").over(by_day())})


def climatologies(df: DataFrame, values: dict[str, str], reach: int = 7) -> DataFrame:
    """Means of values (value -> name) by entity and day of the year (366 counts as 365), over +-reach days around the year.

    A mean is null unless all days are there. All values take one aggregation by day and one around it.
    """
    daily = df.groupBy("entity_id", F.least(F.dayofyear("date"), F.lit(365)).alias("doy")).agg(*[F.avg(v).alias(name) for v, name in values.items()])
    spread = daily.withColumn("doy", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.pmod(F.col("doy") - 1 + k, F.lit(365)) + 1)))
    return spread.groupBy("entity_id", "doy").agg(*[F.when(F.count(name) == 2 * reach + 1, F.avg(name)).alias(name) for name in values.values()])


def climatology(df: DataFrame, value: str, reach: int = 7) -> DataFrame:
    """climatologies() of one value, as usual."""
    return climatologies(df, {value: "usual"}, reach)


def anomaly(df: DataFrame, value: str, reach: int = 7) -> DataFrame:
    """Adds usual and anomaly."""
    usual = climatology(df, value, reach)
    return df.withColumn("doy", F.least(F.dayofyear("date"), F.lit(365))).join(usual, ["entity_id", "doy"], "left").withColumn("anomaly", F.col(value) - F.col("usual"))


#: What a day's weather is to models: values, flags, what the days before were like, and how unusual the day is.
FEATURES = ["temp_max", "temp_min", "precip", "sun_hours", "wet", "very_wet", "hot", "cold", "frost", "rain_prev3", "wet_prev7", "temp_anomaly", "rain_anomaly"]


def features(station: DataFrame) -> DataFrame:
    """FEATURES of every station day (entity_id, day, date, temp_max, temp_min, precip, sunshine); look-ahead is left out."""
    out = look_back(weather_flags(station)).withColumn("doy", F.least(F.dayofyear("date"), F.lit(365)))
    out = out.join(climatologies(station, {"temp_max": "_temp", "precip": "_rain"}), ["entity_id", "doy"], "left")
    out = out.withColumns({"temp_anomaly": F.col("temp_max") - F.col("_temp"), "rain_anomaly": F.col("precip") - F.col("_rain")})
    return out.select("entity_id", "day", *FEATURES)


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of `first` of the entities in `second`, then the rows of `second` for other days; wx_source tells which."""
    inside = first.join(second.select("entity_id").distinct(), "entity_id", "left_semi").withColumn("wx_source", F.lit("archive"))
    rest = second.join(first.select("entity_id", "day"), ["entity_id", "day"], "left_anti").withColumn("wx_source", F.lit("forecast"))
    return inside.unionByName(rest)


def swap_forecast(df: DataFrame, forecast: DataFrame, values: list[str], missing_flag: float | None = None, anomalies: dict[str, str] | None = None) -> DataFrame:
    """Replaces all values by the forecast's where every one is there; recomputes flags and sun hours. swapped tells where.

    anomalies (column -> value column) keep their climatology: what was subtracted from the old value is from the new one.
    missing_flag stands where a flag's value is unknown. Columns on the days before stay as observed.
    """
    anomalies = anomalies or {}
    df = df.withColumns({f"_c_{a}": F.col(v) - F.col(a) for a, v in anomalies.items()})
    named = forecast.select("entity_id", "day", *[F.col(v).alias(f"_f_{v}") for v in values])
    out = df.join(named, ["entity_id", "day"], "left")
    there = F.lit(True)
    for v in values:
        there = there & F.col(f"_f_{v}").isNotNull()
    out = out.withColumn("swapped", there).withColumns({v: F.when(F.col("swapped"), F.col(f"_f_{v}")).otherwise(F.col(v)) for v in values}).drop(*[f"_f_{v}" for v in values])
    out = out.withColumns({a: F.col(v) - F.col(f"_c_{a}") for a, v in anomalies.items()}).drop(*[f"_c_{a}" for a in anomalies])
    out = weather_flags(out)
    return out if missing_flag is None else out.fillna(missing_flag, FLAGS)


def without_weather(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows without any weather."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})


def blank_drift(df: DataFrame, lag: int, horizons: tuple[int, ...] = (1, 7, 14)) -> DataFrame:
    """Drift columns as known `lag` days ahead: those with a shorter horizon are blank."""
    return df.withColumns({f"drift{h}": F.col(f"drift{h}") if h >= lag else F.lit(None).cast("double") for h in horizons})
