"""Readers and sinks for calendars, stations and reference files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALENDAR = "entity_id int, date date, status string, label double, predicted string, opens string, closes string, events string"


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV; predicted is true for any spelling of 'true'."""
    out = spark.read.schema(CALENDAR).option("header", True).csv(path)
    return out.withColumns({"predicted": F.coalesce(F.lower("predicted") == "true", F.lit(False)), "day": F.unix_date("date")})


def read_tiers(spark: SparkSession, path: str, allowed: tuple[str, ...]) -> DataFrame:
    out = spark.read.schema("entity_id int, tier string, reason string, decay_km double").option("header", True).csv(path)
    wrong = [r.tier for r in out.where(~F.col("tier").isin(*allowed)).select("tier").distinct().limit(5).collect()]
    if wrong:
        raise ValueError(f"unknown tiers: {', '.join(wrong)}")
    return out


def read_stations(spark: SparkSession, path: str, legacy: tuple[str, ...] = ()) -> DataFrame:
    """Many files of one station archive as one table, without legacy columns.

    Columns come from the header alone; entity_id is an integer, date and day are read from the date, all others are numbers.
    """
    out = spark.read.option("header", True).csv(path).drop(*legacy)
    numbers = [c for c in out.columns if c not in ("entity_id", "date")]
    out = out.select(F.col("entity_id").cast("int"), F.to_date("date").alias("date"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in numbers])
    out = out.withColumn("day", F.unix_date("date"))
    if out.isEmpty():
        raise ValueError(f"no station rows in {path}")
    return out


def read_forecasts(spark: SparkSession, path: str, variables: tuple[str, ...], cells: DataFrame) -> DataFrame:
    """JSON with parallel arrays (cell, time, one array a variable) as rows, for every entity of the cell."""
    fields = ", ".join(f"{v} array<double>" for v in variables)
    rows = spark.read.schema(f"cell string, time array<string>, {fields}").json(path)
    flat = rows.select("cell", F.explode(F.arrays_zip("time", *variables)).alias("x")).select("cell", F.to_date("x.time").alias("date"), *[f"x.{v}" for v in variables])
    return flat.join(cells, "cell").drop("cell")


def read_places(spark: SparkSession, path: str, countries: tuple[str, ...]) -> DataFrame:
    """Tab-separated places without header: latitude, longitude, country and population by position; a bad population is 0."""
    out = spark.read.option("sep", "\t").option("quote", "").csv(path)
    chosen = out.select(F.col("_c4").cast("double").alias("lat"), F.col("_c5").cast("double").alias("lon"), F.col("_c8").alias("country"), F.coalesce(F.expr("try_cast(_c14 as bigint)"), F.lit(0)).alias("pop"))
    return chosen.where(F.col("country").isin(*countries))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON areas of one or many parts: all rings (holes too) as arrays of struct<lon, lat>, with their bounding box.

    The coordinates of the two kinds nest differently, so they are read as text and parsed by kind.
    """
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring = "array<array<double>>"
    one = F.from_json("f.geometry.coordinates", f"array<{ring}>")
    many = F.flatten(F.from_json("f.geometry.coordinates", f"array<array<{ring}>>"))
    parts = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
    rings = F.transform(parts, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    out = rows.select(F.col("f.properties").alias("properties"), rings.alias("rings")).where("rings is not null")
    whole = F.flatten("rings")
    box = {f"{name}_{c}": pick(whole[c]) for name, pick in (("min", F.array_min), ("max", F.array_max)) for c in ("lon", "lat")}
    return out.withColumns(box)


def read_holidays(spark: SparkSession, path: str, kind: str = "Public") -> DataFrame:
    """Holiday records of one kind (Public, School) as rows: whole-day ones, one row for each subdivision (or the country), English name first."""
    text = "array<struct<language: string, text: string>>"
    schema = f"country string, startDate string, endDate string, type string, temporalScope string, name {text}, subdivisions array<struct<code: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).where((F.col("type") == kind) & (F.coalesce("temporalScope", F.lit("FullDay")) == "FullDay"))
    rows = rows.withColumn("sub", F.explode_outer("subdivisions"))
    english = F.get(F.filter("name", lambda x: x["language"] == "EN"), F.lit(0))["text"]
    return rows.select(F.coalesce("sub.code", "country").alias("code"), F.to_date("startDate").alias("start"), F.to_date("endDate").alias("end"), F.coalesce(english, F.get("name", F.lit(0))["text"]).alias("name"))


def write_stage(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One stage's table, replaced as a whole."""
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities by an id, with place, tier, country and opening month."""
    return spark.read.schema("id int, name string, company string, latitude double, longitude double, first_year int, first_month int, tier string, country string").option("header", True).csv(path).withColumnRenamed("id", "entity_id")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of entity-days: symbol and text; a day may hold several."""
    out = spark.read.schema("entity_id int, date date, symbol string, event string").option("header", True).csv(path)
    return out.withColumn("day", F.unix_date("date"))


def write_log(df: DataFrame, path: str) -> None:
    """The log by (made_on, source): the partitions that df holds are replaced as pairs, all others stay.

    A plain table for readers that know no versions. The log's own meaning, by which every row goes whose made_on and whose
    source occur in a batch, be it in different rows, is that of append_log() and of versions.VersionedLog, its atomic sink.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("made_on", "source").parquet(path)
