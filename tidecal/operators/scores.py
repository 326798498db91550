"""Holiday scores of entities from market weights, and the assembly and blending of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import season_edges


#: The least weight that counts; the cap, so many times the prior and a floor; the gain that a blend needs and
#: the part of it to keep; the parts of the fit in a blend; the rows from which on 8 or 4 waves and year effects are used.
LEAST_WEIGHT, CAP_TIMES, CAP_FLOOR, LEAST_GAIN, GAIN_PART = 1e-4, 5.0, 0.004, 0.001, 0.75
BLENDS = (0.0, 0.25, 0.5, 0.75)
MANY_ROWS, SOME_ROWS, YEAR_ROWS = 800, 400, 300


def entity_window() -> Window:
    return Window.partitionBy("entity_id")

def daily_scores(weights: DataFrame, calendar: DataFrame, spine: DataFrame, kinds: tuple[str, ...] = ("national", "school")) -> DataFrame:
    """Score of every entity-day of the spine: sum of weight times share over regions, in 0-1; absent pairs count 0.

    Weights meet only the calendar rows that are not zero, and are summed before the spine is joined.
    """
    sums = weights.join(calendar, "code").groupBy("entity_id", "day").agg(*[F.sum(F.col("weight") * F.col(k)).alias(k) for k in kinds])
    out = spine.join(sums, ["entity_id", "day"], "left")
    return out.select("entity_id", "day", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(k, F.lit(0.0)))).alias(f"{k}_score") for k in kinds])


def lookup(rows: DataFrame, scores: DataFrame, strict: bool = False, digits: int = 4) -> DataFrame:
    """Rows with their scores rounded to `digits`; strict: a row without scores fails the query."""
    out = rows.join(scores, ["entity_id", "day"], "left")
    names = [c for c in scores.columns if c not in ("entity_id", "day")]

    def value(c: str) -> Column:
        found = F.floor(F.col(c) * 10**digits + 0.5) / 10**digits
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"no {c} for an entity-day")).cast("double")).otherwise(found) if strict else found

    return out.withColumns({c: value(c) for c in names})


def strength(df: DataFrame, value: str) -> DataFrame:
    """Adds strength (value over the 95th percentile of the positive values, in 0-1) and uplift_pct."""
    top = df.where(F.col(value) > 0).agg(F.percentile(value, F.lit(0.95)).alias("_top"))
    out = df.crossJoin(F.broadcast(top))
    return out.withColumns({"strength": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value) / F.col("_top"))), "uplift_pct": 100 * (F.exp(value) - 1)}).drop("_top")


def assemble(df: DataFrame, least: float = LEAST_WEIGHT) -> DataFrame:
    """Weights from `least` on, renormalised by entity and type, rounded to 5, with a confidence from stability and observations."""
    group = Window.partitionBy("entity_id", "type")
    out = df.where(F.col("weight") >= least).withColumn("weight", F.floor(F.col("weight") / F.sum("weight").over(group) * 100_000 + 0.5) / 100_000)
    return out.withColumn("confidence", F.when((F.col("stability") >= 0.8) & (F.col("n_obs") >= 30), "high").when(F.col("stability") >= 0.5, "medium").otherwise("low"))


def prior_only(prior: DataFrame, mask: DataFrame) -> DataFrame:
    """Prior weights of both kinds; school weights only for regions with school data. 1 for each entity and kind."""
    kinds = prior.withColumn("type", F.explode(F.array(F.lit("national"), F.lit("school"))))
    kept = kinds.join(mask.withColumn("type", F.lit("school")).withColumn("_in", F.lit(True)), ["code", "type"], "left").where("type = 'national' or _in").drop("_in")
    return kept.withColumn("weight", F.col("prior") / F.sum("prior").over(Window.partitionBy("entity_id", "type")))


def blend(df: DataFrame, rho: float, kappa: float = CAP_TIMES, floor: float = CAP_FLOOR) -> DataFrame:
    """A part rho of the fit (scaled to 1 by entity) and the rest of the prior, capped at kappa * prior + floor; the prior without a fit.

    Weights are min(cap, level * mixed) for the one level at which an entity's sum to 1. In the order of cap over mixed,
    each row gives the level that is right if all before it are capped and none from it on; the first that keeps its own
    row below the cap is right. Caps that sum to 1 or less are the weights, as shares.
    """
    entity, fit = entity_window(), F.coalesce("fitted", F.lit(0.0))
    total = F.sum(fit).over(entity)
    out = df.withColumn("_w", F.when(total > 1e-9, (1 - rho) * F.col("prior") + rho * fit / total).otherwise(F.col("prior"))).withColumn("_cap", kappa * F.col("prior") + floor)
    ratio = F.col("_cap") / F.nullif("_w", F.lit(0.0))
    before = entity.orderBy(ratio.asc_nulls_last(), "code").rowsBetween(Window.unboundedPreceding, -1)
    after = entity.orderBy(ratio.desc_nulls_first(), F.desc("code")).rowsBetween(Window.unboundedPreceding, 0)
    level = (1 - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.nullif(F.sum("_w").over(after), F.lit(0.0))
    out = out.withColumns({"_level": level, "_fitted": total > 1e-9, "_caps": F.sum("_cap").over(entity)})
    right = F.min(F.when((F.col("_w") > 0) & (F.col("_level") * F.col("_w") <= F.col("_cap") * (1 + 1e-12)), F.struct(ratio.alias("r"), "code", "_level"))).over(entity)["_level"]
    weight = F.when(~F.col("_fitted"), F.col("prior")).when(F.col("_caps") <= 1, F.col("_cap") / F.col("_caps")).otherwise(F.least("_cap", right * F.col("_w")))
    return out.withColumn("weight", weight).drop("_w", "_cap", "_level", "_fitted", "_caps")


def coverage_mass(prior: DataFrame, covered: DataFrame, by: str = "country") -> DataFrame:
    """Prior weight of what is covered (by, year, covered) over all of the entity's, by entity and year of the table."""
    total = prior.groupBy("entity_id").agg(F.sum("prior").alias("_all"))
    found = prior.join(covered, by).groupBy("entity_id", "year").agg(F.sum(F.col("prior") * F.col("covered")).alias("_in"))
    return found.join(total, "entity_id").select("entity_id", "year", (F.col("_in") / F.col("_all")).alias("mass"))


def placebo(calendar: DataFrame, shift: int) -> DataFrame:
    """The calendar moved by a number of days around its own span."""
    span = calendar.agg(F.min("day").alias("_lo"), (F.max("day") - F.min("day") + 1).alias("_n"))
    return calendar.crossJoin(F.broadcast(span)).withColumn("day", F.col("_lo") + F.pmod(F.col("day") - F.col("_lo") + shift, F.col("_n"))).drop("_lo", "_n")


def control_events(df: DataFrame, seasonal: str, least_days: int = 15, most: int = 12) -> DataFrame:
    """Names of events to control for: not seasonal, on enough distinct days; the first by name."""
    named = df.where(F.col("events").isNotNull() & ~F.lower("events").rlike(seasonal)).groupBy("entity_id", "events").agg(F.count_distinct("day").alias("days")).where(F.col("days") >= least_days)
    return named.withColumn("rn", F.row_number().over(Window.partitionBy("entity_id").orderBy("events"))).where(F.col("rn") <= most)


def control_design(df: DataFrame, events: DataFrame | None = None, gap: int = 14) -> DataFrame:
    """Controls of every entity-day in long form: entity_id, day, name and value, for the columns that vary within the entity.

    Weekday dummies, yearly waves as many as the rows allow (8, 4 or 2), year effects from 300 rows on, first and last rows of
    a season, and a flag for each control event (events: entity_id, day, event; those that control_events() chose). A column
    that is constant for an entity is left out of its rows.
    """
    n = F.count(F.lit(1)).over(entity_window())
    out = season_edges(df.select("entity_id", "day", "date"), gap).withColumn("n_rows", n)
    waves = F.when(F.col("n_rows") >= MANY_ROWS, 8).when(F.col("n_rows") >= SOME_ROWS, 4).otherwise(2)
    angle = 2 * F.pi() * F.dayofyear("date") / 365.25
    one = lambda name, value: F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), value.cast("double").alias("value"))
    columns = [one(f"dow{k}", F.weekday("date") == k) for k in range(1, 7)]
    columns += [one(f"{f}{k}", F.when(waves >= k, (F.sin if f == "sin" else F.cos)(k * angle)).otherwise(0.0)) for k in range(1, 9) for f in ("sin", "cos")]
    columns += [one(c, F.col(c)) for c in ("season_start", "season_end")]
    fixed = out.select("entity_id", "day", "n_rows", F.explode(F.array(*columns)).alias("x")).select("entity_id", "day", "n_rows", "x.*")
    years = out.where(F.col("n_rows") >= YEAR_ROWS).select("entity_id", "day", "n_rows", F.concat(F.lit("year"), F.year("date")).alias("name"), F.lit(1.0).alias("value"))
    parts = fixed.unionByName(years)
    if events is not None:
        flagged = events.select("entity_id", "day", F.concat(F.lit("event "), "event").alias("name")).distinct().join(out.select("entity_id", "day", "n_rows"), ["entity_id", "day"])
        parts = parts.unionByName(flagged.withColumn("value", F.lit(1.0)).select(*parts.columns))
    # Dummies and events have rows where they are 1 only: such a column is constant if it has a row on every day.
    column = Window.partitionBy("entity_id", "name")
    spread = parts.withColumns({"_low": F.min("value").over(column), "_high": F.max("value").over(column), "_n": F.count(F.lit(1)).over(column)})
    return spread.where((F.col("_high") > F.col("_low")) | ((F.col("_n") < F.col("n_rows")) & (F.col("_high") != 0))).select("entity_id", "day", "name", "value")


def bootstrap_summary(replicates: DataFrame, keys: list[str]) -> DataFrame:
    """5th and 95th percentile of a weight over replicates, and the share of replicates in which it counts."""
    return replicates.groupBy(*keys).agg(F.percentile("weight", F.lit(0.05)).alias("ci_low"), F.percentile("weight", F.lit(0.95)).alias("ci_high"), F.avg((F.col("weight") > LEAST_WEIGHT).cast("double")).alias("stability"))


def blend_choice(r2: DataFrame, gain: float = LEAST_GAIN, part: float = GAIN_PART) -> DataFrame:
    """Blends of each entity from a table (entity_id, national, school, r2; 0 is the prior): entity_id, national, school, gain.

    The prior of both where no blend gains more than `gain`. Else school is decided beside the best blend's national part,
    and national beside the school part decided: each takes its least part that keeps `part` of its own best gain over
    none, if that gain is more than half of `gain`.
    """
    entity = entity_window()
    none = lambda c, where: F.max(F.when(where & (F.col(c) == 0), F.col("r2"))).over(entity)

    both = (F.col("national") == 0) & (F.col("school") == 0)
    out = r2.withColumns({"_gain": F.max("r2").over(entity) - F.max(F.when(both, F.col("r2"))).over(entity), "_best": F.max(F.struct("r2", (-F.col("national")).alias("n"), (-F.col("school")).alias("s"))).over(entity)})
    for c, fixed in (("school", F.col("national") == -F.col("_best")["n"]), ("national", F.col("school") == F.col("_school"))):
        out = out.withColumn("_own", F.when(fixed, F.col("r2") - none(c, fixed))).withColumn("_top", F.max("_own").over(entity))
        kept = F.min(F.when(F.col("_own") >= part * F.col("_top"), F.col(c))).over(entity)
        out = out.withColumn(f"_{c}", F.when((F.col("_gain") > gain) & (F.col("_top") > gain / 2), kept).otherwise(F.lit(0.0)))
    return out.groupBy("entity_id").agg(F.max("_national").alias("national"), F.max("_school").alias("school"), F.max("_gain").alias("gain"))
