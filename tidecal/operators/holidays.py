"""Holiday calendars: supersession, hierarchy, overlaps, coverage, intervals and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import easter

CEILING = 1 - 1e-9


def supersede(rows: DataFrame, replaced: DataFrame, verified: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those that a key in `replaced` supersedes, plus the verified rows."""
    return rows.join(replaced.select(*keys).distinct(), keys, "left_anti").unionByName(verified)


def spared(share: Column) -> Column:
    """Logarithm of the part of people without a break; a share is cut to 0-1 (just below), a null one is 0."""
    return F.log1p(-F.least(F.greatest(share, F.lit(0.0)), F.lit(CEILING)))


def either(shares: Column) -> Column:
    """Share of people with any of several independent breaks, as an aggregate."""
    return 1 - F.exp(F.sum(spared(shares)))


def overlap_combine(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(either(F.col("share")).alias("share"))


def fan_out(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows on regions: exact codes, and country codes for all their regions; codes of neither are left out."""
    exact = rows.join(regions.select("code"), "code", "left_semi")
    country = rows.withColumnRenamed("code", "country").join(regions.select("code", "country"), "country").drop("country")
    return exact.unionByName(country.select(*exact.columns))


def unknown_codes(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Codes that are neither a region nor a country, with their rows."""
    known = regions.select("code").unionAll(regions.select("country")).distinct()
    return rows.join(known, "code", "left_anti").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def child_fraction(rows: DataFrame, children: DataFrame) -> DataFrame:
    """Children of a unit add share / number of children to it, at most 1; the sum meets the unit's own rows by overlap."""
    sums = rows.join(children, "code").groupBy("country", "day", "type").agg(F.least(F.lit(1.0), F.sum(F.col("share") / F.col("n_children"))).alias("share"))
    own = rows.withColumnRenamed("code", "country").join(children.select("country").distinct(), "country", "left_semi").select("country", "day", "type", "share")
    return overlap_combine(own.unionByName(sums), ["country", "day", "type"])


def coverage(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Whether a country has rows of a kind, by year; any national year counts for all years of the data."""
    years = rows.select(F.year("date").alias("year")).distinct()
    by = rows.withColumn("country", F.split("code", "-")[0]).groupBy("country", F.year("date").alias("year")).agg(F.max((F.col("type") == "school").cast("int")).alias("school"), F.max((F.col("type") == "national").cast("int")).alias("national"))
    spine = regions.select("country").distinct().crossJoin(F.broadcast(years))  # one row a calendar year
    out = spine.join(by, ["country", "year"], "left").fillna(0, ["school", "national"])
    return out.withColumn("national", F.max("national").over(Window.partitionBy("country")))


def sparse(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One column for each kind, 0 where there is none, rounded to 4; rows of zeros are left out."""
    return not_zero(rows.groupBy(*keys).pivot("type", ["national", "school"]).agg(F.max("share")).fillna(0.0, ["national", "school"]))


def not_zero(wide: DataFrame) -> DataFrame:
    """national and school rounded to 4; rows of zeros are left out."""
    return wide.withColumns({c: F.floor(F.col(c) * 10_000 + 0.5) / 10_000 for c in ("national", "school")}).where("national > 1e-6 or school > 1e-6")


def remap(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Codes renamed by a table (code, new_code, factor); shares times the factor, at most 1; a null share stays null."""
    out = rows.join(mapping, "code", "left")
    scaled = F.col("share") * F.coalesce("factor", F.lit(1.0))
    return out.withColumns({"share": F.when(scaled.isNotNull(), F.least(F.lit(1.0), scaled)), "code": F.coalesce("new_code", "code")}).drop("new_code", "factor")


def interval_days(df: DataFrame) -> DataFrame:
    """One row for each day of an interval."""
    return df.withColumn("day", F.explode(F.sequence("start_day", "end_day")))


def interval_share(intervals: DataFrame) -> DataFrame:
    """Share of a state's weight whose intervals cover a day. An interval is counted at its two ends and summed along days."""
    ends = F.array(F.struct(F.col("start_day").alias("day"), F.col("weight").alias("w"), F.lit(1).alias("n")), F.struct((F.col("end_day") + 1).alias("day"), (-F.col("weight")).alias("w"), F.lit(-1).alias("n")))
    steps = intervals.where("end_day >= start_day").select("state", F.explode(ends).alias("x")).groupBy("state", "x.day").agg(F.sum("x.w").alias("w"), F.sum("x.n").alias("n"))
    order = Window.partitionBy("state").orderBy("day")
    along = order.rowsBetween(Window.unboundedPreceding, 0)
    level = steps.select("state", "day", F.sum("w").over(along).alias("w"), F.sum("n").over(along).alias("n"), F.lead("day").over(order).alias("until"))
    total = intervals.groupBy("state").agg(F.sum("weight").alias("total"))
    held = level.where("n > 0").withColumn("day", F.explode(F.sequence("day", F.col("until") - 1)))
    return held.join(total, "state").select("state", "day", (F.col("w") / F.col("total")).alias("share"))


def nearest_year(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The known year nearest to the wanted one, the earlier on ties, with its value (the least of a year with several).

    Wanted and known years of a key lie in one order of years: each wanted one looks at the last known before or at it and
    the first after, so no two years are paired. Wanted years of a key without known ones have no row.
    """
    value = F.struct(F.col("year").alias("known_year"), "value")
    both = wanted.select(*keys, "year").distinct().withColumn("_known", F.lit(None).cast(known.select(value).schema[0].dataType)).unionByName(known.groupBy(*keys, "year").agg(F.min("value").alias("value")).select(*keys, "year", value.alias("_known")))
    rising, falling = (Window.partitionBy(*keys).orderBy(year).rangeBetween(Window.unboundedPreceding, 0) for year in (F.asc("year"), F.desc("year")))
    found = both.withColumns({"_back": F.max("_known").over(rising), "_ahead": F.min("_known").over(falling)})
    back, ahead = F.col("year") - F.col("_back.known_year"), F.col("_ahead.known_year") - F.col("year")
    best = F.when(back.isNull() | (ahead < back), F.col("_ahead")).otherwise(F.col("_back"))
    return found.where("_known is null and (_back is not null or _ahead is not null)").select(*keys, "year", best.alias("b")).select(*keys, "year", "b.known_year", "b.value")


def disagreements(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of only one of two sources."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full_outer")
    return both.where("_a is null or _b is null").select(*keys, F.when(F.col("_a").isNull(), "b").otherwise("a").alias("only_in"))


def supplement(a: DataFrame, b: DataFrame, group: list[str], sundays: DataFrame | None = None) -> DataFrame:
    """a, and the rows of b for groups that a lacks, without Sundays but those that `sundays` names by some columns of b."""
    lacking = b.join(a.select(*group).distinct(), group, "left_anti")
    kept = lacking.where(F.weekday("date") != 6)
    if sundays is not None:
        kept = kept.unionByName(lacking.where(F.weekday("date") == 6).join(sundays.distinct(), sundays.columns, "left_semi").select(*kept.columns))
    return a.unionByName(kept)


def term_gaps(terms: DataFrame) -> DataFrame:
    """Breaks between a term's end and the next start, by state."""
    order = Window.partitionBy("state").orderBy("start_day", "end_day")
    out = terms.withColumn("next_start", F.lead("start_day").over(order))
    return out.where(F.col("next_start") > F.col("end_day") + 1).select("state", (F.col("end_day") + 1).alias("start_day"), (F.col("next_start") - 1).alias("end_day"))


def weekend_inherit(days: DataFrame, keys: list[str]) -> DataFrame:
    """Adds weekends: Saturday and Sunday take the larger share of the Friday before and the Monday after, or keep their own if larger."""
    dow = F.pmod(F.col("day") + 3, F.lit(7))
    friday = days.where(dow == 4).select(*keys, F.explode(F.array(F.col("day") + 1, F.col("day") + 2)).alias("day"), "share")
    monday = days.where(dow == 0).select(*keys, F.explode(F.array(F.col("day") - 1, F.col("day") - 2)).alias("day"), "share")
    return days.select(*keys, "day", "share").unionByName(friday).unionByName(monday).groupBy(*keys, "day").agg(F.max("share").alias("share"))


def ramps(df: DataFrame, rise: int = 3, fall: int = 3) -> DataFrame:
    """Days of an interval with a share that rises to 1 over the first days and falls over the last."""
    out = interval_days(df)
    up, down = (F.col("day") - F.col("start_day") + 1) / rise, (F.col("end_day") - F.col("day") + 1) / fall
    return out.withColumn("share", F.least(F.lit(1.0), up, down))


def shift_year(df: DataFrame, years: int = 1) -> DataFrame:
    """A date moved to another year: relative to Easter, on the same date, or 364 days a year."""
    year = F.year("date")
    relative = F.date_add(easter(year + years), F.datediff("date", easter(year)))
    # February 29 has no counterpart in most years and moves to March 1.
    same = F.date_add(F.make_date(year + years, F.month("date"), F.lit(1)), F.dayofmonth("date") - 1)
    return df.withColumn("shifted", F.when(F.col("rule") == "easter", relative).when(F.col("rule") == "same", same).otherwise(F.date_add("date", 364 * years)))


def extend_to_weekend(df: DataFrame) -> DataFrame:
    """Intervals that start on Monday begin on Saturday before; those that end on Friday end on Sunday."""
    first, last = F.pmod(F.col("start_day") + 3, F.lit(7)), F.pmod(F.col("end_day") + 3, F.lit(7))
    return df.withColumns({"start_day": F.when(first == 0, F.col("start_day") - 2).otherwise(F.col("start_day")), "end_day": F.when(last == 4, F.col("end_day") + 2).otherwise(F.col("end_day"))})


def block_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per block: differences of first and last day, Jaccard of days, and the sum of absolute share differences."""
    both = a.select(*keys, "day", F.col("share").alias("sa")).join(b.select(*keys, "day", F.col("share").alias("sb")), [*keys, "day"], "full_outer")
    in_a, in_b = F.when(F.col("sa").isNotNull(), F.col("day")), F.when(F.col("sb").isNotNull(), F.col("day"))
    return both.groupBy(*keys).agg(
        (F.min(in_b) - F.min(in_a)).alias("start_error"),
        (F.max(in_b) - F.max(in_a)).alias("end_error"),
        (F.count(F.when(F.col("sa").isNotNull() & F.col("sb").isNotNull(), 1)) / F.count(F.lit(1))).alias("jaccard"),
        F.sum(F.abs(F.coalesce("sa", F.lit(0.0)) - F.coalesce("sb", F.lit(0.0)))).alias("difference"),
    )


def capped_share(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of shares up to 1, the name with the largest share (then the first name), and low confidence below one half."""
    out = rows.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum("share")).alias("share"), F.min_by("name", F.struct(-F.col("share"), F.col("name"))).alias("name"))
    return out.withColumn("confidence", F.when(F.col("share") < 0.4999999, "low").otherwise("medium"))


def child_coverage(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Share of a country's regions that are listed on a day."""
    total = regions.groupBy("country").agg(F.count_distinct("code").alias("n"))
    listed = rows.join(regions.select("code", "country"), "code").groupBy("country", "day").agg(F.count_distinct("code").alias("k"))
    return listed.join(total, "country").select("country", "day", (F.col("k") / F.col("n")).alias("covered"))


def merge(rows: DataFrame, regions: DataFrame, mapping: DataFrame, filled: DataFrame | None = None, verified: DataFrame | None = None) -> dict[str, DataFrame]:
    """Region calendars from source rows (code, date, day, type, share): calendar, coverage and dropped.

    In order: `verified` rows supersede those of their code, day and type; `filled` adds national rows for countries without
    any; codes are remapped; rows of one code, day and type are combined. Rows then reach regions (code, country,
    n_children): a region's own code, a country's code on all its regions, and codes below a country that is one region by
    an equal fraction of its n_children. A region's rows and its children's sum meet by overlap. Other codes are dropped and
    counted by country. coverage: country, year, national and school; a national row covers all years.
    """
    rows = rows.select("code", "date", "day", "type", "share")
    if verified is not None:
        rows = supersede(rows, verified, verified.select(*rows.columns), ["code", "day", "type"])
    if filled is not None:
        has = rows.where("type = 'national'").select(country_of(F.col("code")).alias("country")).distinct()
        rows = rows.unionByName(filled.withColumn("country", country_of(F.col("code"))).join(has, "country", "left_anti").select(*rows.columns))
    combined = overlap_combine(remap(rows, mapping), ["code", "date", "day", "type"])
    # Where a code leads: a region to itself, a country that is no region to all its regions.
    here = regions.select("code", F.col("code").alias("region"), "country")
    nationwide = here.where(~F.col("country").contains("-")).withColumn("code", F.col("country")).join(here.select("code"), "code", "left_anti")
    whole = regions.where("code = country").select(F.col("code").alias("_parent"), F.col("code").alias("_whole"), "n_children")
    # Only a code that leads nowhere looks for its parent; all others look for themselves, so that no key is shared by most rows.
    parent = F.when(F.col("region").isNull() & F.col("code").contains("-"), country_of(F.col("code"))).otherwise(F.col("code"))
    routed = combined.join(here.unionByName(nationwide), "code", "left").withColumn("_parent", parent).join(whole, "_parent", "left")
    routed = routed.withColumns({"_own": F.col("region").isNotNull(), "region": F.coalesce("region", "_whole"), "country": F.coalesce("country", "_whole")})
    reached = routed.where("region is not null")

    def share_of(kind: str) -> Column:
        own = F.sum(F.when((F.col("type") == kind) & F.col("_own"), spared(F.col("share"))))
        children = F.sum(F.when((F.col("type") == kind) & ~F.col("_own"), F.col("share") / F.col("n_children")))
        return (1 - F.exp(F.coalesce(own, F.lit(0.0)) + spared(children))).alias(kind)

    kinds = ("national", "school")
    calendar = not_zero(reached.groupBy(F.col("region").alias("code"), "day").agg(*map(share_of, kinds)))
    dropped = routed.where("region is null").groupBy(country_of(F.col("code")).alias("country")).agg(F.count(F.lit(1)).alias("n"))
    years = rows.select(F.year("date").alias("year")).distinct()
    by = reached.groupBy("country", F.year("date").alias("year")).agg(*[F.max((F.col("type") == t).cast("int")).alias(t) for t in kinds])
    flags = regions.select("country").distinct().crossJoin(years).join(by, ["country", "year"], "left").fillna(0, list(kinds))
    flags = flags.withColumn("national", F.max("national").over(Window.partitionBy("country")))
    return {"calendar": calendar, "coverage": flags, "dropped": dropped}


def country_of(code: Column) -> Column:
    return F.split(code, "-")[0]
