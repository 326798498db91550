"""Leakage-safe history features: exact-lag lookups, drift, runs and distances on entity-day tables.

day is the integer day number, so that calendar-day frames are integer ranges. Groups are one entity's days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAGS = (357, 364, 371)


def by_day() -> Window:
    """One entity's days in order."""
    return Window.partitionBy("entity_id").orderBy("day")


def at_lag(value: str, lag: int) -> Column:
    """The value exactly `lag` days before, null where there is none."""
    return F.max(value).over(by_day().rangeBetween(-lag, -lag))


def mean_of(columns: list[Column]) -> Column:
    """Mean of the values that are not null."""
    known = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)) / F.nullif(known, F.lit(0))


def prior_year(df: DataFrame, value: str = "label") -> DataFrame:
    """Adds py357, py364, py371 and py_mean (the mean of those there)."""
    out = df.withColumns({f"py{k}": at_lag(value, k) for k in LAGS})
    return out.withColumn("py_mean", mean_of([F.col(f"py{k}") for k in LAGS]))


def drift(df: DataFrame, horizons: tuple[int, ...] = (1, 7, 14), span: int = 28, least: int = 7) -> DataFrame:
    """Adds drift<h>: the mean gap to the value 364 days before, over `span` calendar days that end h days ago."""
    out = df.withColumn("_gap", F.col("label") - at_lag("label", 364))
    frames = {h: by_day().rangeBetween(-span + 1 - h, -h) for h in horizons}
    return out.withColumns({f"drift{h}": F.when(F.count("_gap").over(w) >= least, F.avg("_gap").over(w)) for h, w in frames.items()}).drop("_gap")


def rank_index(df: DataFrame, value: str = "volume") -> DataFrame:
    """Adds index: the average-rank percentile of a value within its entity, times 100, at least 1."""
    ties = F.count(F.lit(1)).over(Window.partitionBy("entity_id", value))
    rank = F.rank().over(Window.partitionBy("entity_id").orderBy(value)) + (ties - 1) / 2
    return df.withColumn("index", F.greatest(F.lit(1.0), 100.0 * rank / F.count(F.lit(1)).over(Window.partitionBy("entity_id"))))


def holiday_distance(df: DataFrame, score: str = "score", above: float = 0.2, most: int = 180) -> DataFrame:
    """Adds days_until, days_since (0 on the day, null without one) and their capped logarithms.

    Both look back, one of them along falling days: a frame that reaches to the end would be summed anew for each row, which
    is the square of an entity's days. Rows of one day see each other.
    """
    flagged = F.when(F.col(score) > above, F.col("day"))
    ahead, back = (w.rangeBetween(Window.unboundedPreceding, 0) for w in (Window.partitionBy("entity_id").orderBy(F.desc("day")), by_day()))
    out = df.withColumns({"days_until": F.min(flagged).over(ahead) - F.col("day"), "days_since": F.col("day") - F.max(flagged).over(back)})
    return out.withColumns({f"log_{c}": F.when(F.col(c).isNotNull(), F.log1p(F.least(F.col(c), F.lit(most)))) for c in ("days_until", "days_since")})


def season_edges(df: DataFrame, gap: int = 14, rows: int = 3) -> DataFrame:
    """Adds season (runs split by gaps of more than `gap` days), season_start and season_end (first and last rows)."""
    new = (F.col("day") - F.lag("day").over(by_day()) > gap).cast("int")
    out = df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("season", F.sum("_new").over(by_day().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("entity_id", "season")
    return out.withColumns({"season_start": F.row_number().over(run.orderBy("day")) <= rows, "season_end": F.row_number().over(run.orderBy(F.desc("day"))) <= rows}).drop("_new")


def time_folds(df: DataFrame, folds: int = 6) -> DataFrame:
    """Adds fold: contiguous blocks of nearly equal size in date order, per entity."""
    return df.withColumn("fold", F.ntile(folds).over(by_day()))


def latest(df: DataFrame, columns: list[str]) -> DataFrame:
    """The last row of every entity."""
    return df.groupBy("entity_id").agg(F.max_by(F.struct("day", *columns), "day").alias("row")).select("entity_id", "row.*")


def active_entities(df: DataFrame, within: int = 60) -> DataFrame:
    """Entities with a labelled day in the last `within` days before the last label of all."""
    last = df.where("label is not null").groupBy("entity_id").agg(F.max("day").alias("last_day"))
    return last.crossJoin(F.broadcast(last.agg(F.max("last_day").alias("end_day")))).where(F.col("last_day") > F.col("end_day") - within)


def future_spine(labels: DataFrame, days: int = 30, within: int = 60) -> DataFrame:
    """Every active entity on each of the `days` days after the last label of all, with the days since its own last label."""
    active = active_entities(labels, within)
    return active.select("entity_id", "last_day", F.explode(F.sequence(F.col("end_day") + 1, F.col("end_day") + days)).alias("day")).withColumn("days_ahead", F.col("day") - F.col("last_day"))


def future_drift(labels: DataFrame, days: int = 30, horizons: tuple[int, ...] = (1, 7, 14)) -> DataFrame:
    """Drift for future days; null where the window would end after the entity's last label."""
    spine = future_spine(labels, days)
    both = labels.select("entity_id", "day", "label").withColumn("last_day", F.lit(None).cast("int")).unionByName(spine.select("entity_id", "day", F.lit(None).cast("double").alias("label"), "last_day"))
    out = drift(prior_year(both), horizons).where("last_day is not null")
    return out.select("entity_id", "day", "py364", "py_mean", *[F.when(F.col("day") - h <= F.col("last_day"), F.col(f"drift{h}")).alias(f"drift{h}") for h in horizons])
