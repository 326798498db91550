"""Distances, source markets and spatial assignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean radius of the earth; by tier, the kilometres over which pull falls to 1/e, and the factor at home.
EARTH_KM = 6371.0088
REACH = {"local": 150.0, "regional": 600.0, "continental": 2500.0, "intercontinental": 6000.0}
AT_HOME = {"local": 3.0, "regional": 6.0, "continental": 10.0, "intercontinental": 6.0}


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def grid_cell(lat: Column, lon: Column, step: float = 0.25) -> Column:
    return F.concat_ws("_", F.bround(lat / step).cast("long").cast("string"), F.bround(lon / step).cast("long").cast("string"))


def by_tier(tier: Column, values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), tier)


def decay(km: Column, tier: Column, reach: Column) -> Column:
    """Pull of a place at a distance: exponential; for intercontinental entities half of it falls only with the distance cubed."""
    near = F.exp(-km / reach)
    return F.when(tier == "intercontinental", 0.5 * near + 0.5 / F.pow(1 + km / reach, 3)).otherwise(near)


#: Levels of the pyramid over places, coarse to fine: a cell of level k is 2 ** k grid cells wide.
LEVELS = (6, 3, 0)


def _pull(km: Column) -> Column:
    return decay(km, F.col("tier"), F.col("_reach"))


def exact_pulls(entities: DataFrame, places: DataFrame) -> DataFrame:
    """entity_id, region_id, _pull: people of a region's places times their decay, every entity with every place."""
    pairs = places.select("region_id", "lat", "lon", "pop").crossJoin(entities)
    return pairs.groupBy("entity_id", "region_id").agg(F.sum(F.col("pop") * _pull(haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")))).alias("_pull"))


def pulls_within(entities: DataFrame, places: DataFrame, error: float, cell: float = 0.5, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """exact_pulls() but for a relative error: far groups of places count as if they were at their middle.

    A region's places lie in a pyramid of cells. Within a cell no distance is more than its radius (half the diagonal of
    what it holds) from the one to its middle, so the decay lies between two values; where these are at most 1 + error
    apart, the middle stands for all. Else the cell is taken apart, in the end into places, which count exactly. An entity
    so meets the places around it and a few cells of the rest.
    """
    keyed = places.where("pop > 0").select("region_id", "lat", "lon", "pop", F.floor(F.col("lon") / cell).alias("x"), F.floor(F.col("lat") / cell).alias("y"))

    def nodes(level: int) -> DataFrame:
        box = [f(c).alias(f"_{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
        held = keyed.groupBy("region_id", *[F.shiftright(c, level).alias(c) for c in "xy"]).agg(F.sum("pop").alias("pop"), *box)
        middle = {c: (F.col(f"_min_{c}") + F.col(f"_max_{c}")) / 2 for c in ("lat", "lon")}
        half = [F.radians(F.col(f"_max_{c}") - F.col(f"_min_{c}")) / 2 for c in ("lat", "lon")]
        return held.withColumns(middle | {"_radius": EARTH_KM * F.sqrt(half[0] * half[0] + half[1] * half[1])}).drop(*[f"_{n}_{c}" for n in ("min", "max") for c in ("lat", "lon")])

    front, done = entities.crossJoin(nodes(levels[0])), []
    for level, below in zip(levels, [*levels[1:], None]):
        km = haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
        met = front.withColumn("_km", km)
        close = _pull(F.greatest(F.lit(0.0), F.col("_km") - F.col("_radius"))) <= (1 + error) * _pull(F.col("_km") + F.col("_radius"))
        done.append(met.where(close).groupBy("entity_id", "region_id").agg(F.sum(F.col("pop") * _pull(F.col("_km"))).alias("_pull")))
        rest = met.where(~close).drop("_km", "_radius", "lat", "lon", "pop").withColumnsRenamed({"x": "_x", "y": "_y"})
        step = level - (below if below is not None else 0)
        parts = nodes(below) if below is not None else keyed
        front = rest.join(parts.withColumns({"_x": F.shiftright("x", step), "_y": F.shiftright("y", step)}), ["region_id", "_x", "_y"]).drop("_x", "_y")
    last = front.groupBy("entity_id", "region_id").agg(F.sum(F.col("pop") * _pull(haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")))).alias("_pull"))
    return reduce(DataFrame.unionByName, [*done, last]).groupBy("entity_id", "region_id").agg(F.sum("_pull").alias("_pull"))


def market_prior(entities: DataFrame, places: DataFrame, regions: DataFrame, error: float = 0.0) -> DataFrame:
    """Weight of every region for every entity (1 for each entity), and the distance to the region's centre.

    entities: entity_id, latitude, longitude, tier, country and reach_km (its own reach, or null); places: region_id, lat,
    lon, pop; regions: region_id, country, population, lat, lon, affluence. A region pulls with its population times the
    mean decay of its places by their population, its affluence, and the tier's factor in the entity's own country.

    error 0: every entity meets every place once, and pairs are summed in the task that makes them; the work is entities
    times places. Else far places count by groups (pulls_within()), each pull to within the relative error.
    """
    reach = F.coalesce("reach_km", by_tier(F.col("tier"), REACH))
    narrow = entities.select("entity_id", "latitude", "longitude", "tier", reach.alias("_reach"))
    pulled = pulls_within(narrow, places, error) if error > 0 else exact_pulls(narrow, places)
    total = places.groupBy("region_id").agg(F.sum("pop").alias("_total"))
    # A region without people still has a row: its pull is 0.
    every = pulled if error == 0 else total.select("region_id").crossJoin(narrow.select("entity_id")).join(pulled, ["entity_id", "region_id"], "left").fillna(0.0, ["_pull"])
    named = every.join(total, "region_id").join(regions.withColumnRenamed("country", "_country"), "region_id").join(entities.select("entity_id", "latitude", "longitude", "tier", "country"), "entity_id")
    home = F.when(F.col("_country") == F.col("country"), by_tier(F.col("tier"), AT_HOME)).otherwise(1.0)
    out = named.withColumn("w", F.col("population") * F.col("_pull") / F.greatest("_total", F.lit(1e-9)) * F.col("affluence") * home)
    centre = haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    return out.select("entity_id", "region_id", centre.alias("distance_km"), (F.col("w") / F.sum("w").over(Window.partitionBy("entity_id"))).alias("prior_weight"))


def top_mass(prior: DataFrame, mass: float = 0.99, most: int = 150) -> DataFrame:
    """Largest weights of an entity up to a cumulative mass (the row that reaches it included), renormalised to sum 1 after rounding to 8."""
    order = Window.partitionBy("entity_id").orderBy(F.desc("prior_weight"), "region_id")
    ranked = prior.withColumns({"before": F.coalesce(F.sum("prior_weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "rn": F.row_number().over(order)})
    kept = ranked.where((F.col("before") < mass) & (F.col("rn") <= most))
    entity = Window.partitionBy("entity_id")
    rounded = kept.withColumn("w", F.floor(F.col("prior_weight") / F.sum("prior_weight").over(entity) * 1e8 + 0.5) / 1e8)
    return rounded.select("entity_id", "region_id", F.when(F.col("rn") == 1, F.col("w") + 1 - F.sum("w").over(entity)).otherwise(F.col("w")).alias("weight"))


def centroid(points: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted spherical centre."""
    la, lo, w = F.radians("lat"), F.radians("lon"), F.col("pop")
    sums = points.groupBy(*keys).agg(F.sum(F.cos(la) * F.cos(lo) * w).alias("x"), F.sum(F.cos(la) * F.sin(lo) * w).alias("y"), F.sum(F.sin(la) * w).alias("z"))
    return sums.select(*keys, F.degrees(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))).alias("lat"), F.degrees(F.atan2("y", "x")).alias("lon"))


def rescale(df: DataFrame, group: str, value: str, total: str) -> DataFrame:
    """value as its share of the group, times the group's known total."""
    return df.withColumn("rescaled", F.col(value) * F.col(total) / F.sum(value).over(Window.partitionBy(group)))


def rings_of(rectangles: DataFrame, key: str) -> DataFrame:
    """Rectangles (lon0, lon1, lat0, lat1) as areas: area_id, and one ring of their corners."""
    corners = [("lon0", "lat0"), ("lon1", "lat0"), ("lon1", "lat1"), ("lon0", "lat1"), ("lon0", "lat0")]
    ring = F.array(*[F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in corners])
    return rectangles.withColumnRenamed(key, "area_id").withColumn("rings", F.array(ring)).drop("lon0", "lon1", "lat0", "lat1")


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting over a closed ring of struct<lon, lat>: odd crossings are inside."""

    def step(state: Column, p: Column) -> Column:
        a, b = state["last"], p
        crosses = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) * (b["lon"] - a["lon"])
        return F.struct(p.alias("last"), (state["n"] + F.when(crosses & (lon < at), 1).otherwise(0)).alias("n"))

    return F.aggregate(ring, F.struct(F.element_at(ring, -1).alias("last"), F.lit(0).alias("n")), step, lambda s: s["n"] % 2 == 1)


def segments(areas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x1, y1, x2, y2: the segments of all rings; an unclosed ring is closed."""
    ring = areas.select(*keys, F.explode("rings").alias("ring")).where(F.size("ring") > 0)
    pairs = F.transform("ring", lambda p, k: F.struct(F.when(k > 0, F.get("ring", k - 1)).otherwise(F.element_at("ring", -1)).alias("a"), p.alias("b")))
    flat = ring.select(*keys, F.explode(pairs).alias("s"))
    return flat.select(*keys, F.col("s.a.lon").alias("x1"), F.col("s.a.lat").alias("y1"), F.col("s.b.lon").alias("x2"), F.col("s.b.lat").alias("y2"))


def squared_distance(x: Column, y: Column, s: Column) -> Column:
    """Squared degree distance of a point to the segment s (x1, y1, x2, y2)."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    along = F.coalesce(((x - s["x1"]) * dx + (y - s["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    a, b = s["x1"] + t * dx - x, s["y1"] + t * dy - y
    return a * a + b * b


def _cells_between(a: str, b: str, cell: float) -> Column:
    return F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))


def segment_cells(edges: DataFrame, cell: float) -> DataFrame:
    """The segments with each grid cell (cx, cy) that a part of them may lie in; long ones are followed part by part."""
    parts = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / cell).cast("int"))
    cut = edges.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    for c, (one, two) in {"x": ("x1", "x2"), "y": ("y1", "y2")}.items():
        step = (F.col(two) - F.col(one)) / F.col("parts")
        cut = cut.withColumns({f"{c}a": F.col(one) + F.col("part") * step, f"{c}b": F.when(F.col("part") == F.col("parts") - 1, F.col(two)).otherwise(F.col(one) + (F.col("part") + 1) * step)})
    for c in "xy":
        cut = cut.withColumn(f"c{c}", F.explode(_cells_between(f"{c}a", f"{c}b", cell)))
    return cut.select(*edges.columns, "cx", "cy").distinct()


def nearest_cells(wanted: DataFrame, held: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """px, py, cx, cy: for each wanted cell (px, py), all held cells (cx, cy) that may hold what is nearest to a point in it.

    Both are distinct grid cells, so their numbers are bounded by the map and not by the rows on it. The search goes down
    a pyramid of cells, eight times as wide from level to level: from each it keeps the cells whose least distance isn't beyond the best
    greatest distance, and goes on with their parts that are held. Each step is a join on the larger cell. within: columns
    of both that must agree.
    """
    keys = list(within)
    reach = [frame.agg(F.greatest(F.max(F.abs(x)), F.max(F.abs(y)))).first()[0] or 0 for frame, x, y in ((wanted, "px", "py"), (held, "cx", "cy"))]
    top = (int(max(reach)) + 1).bit_length()
    at = lambda level: held.select(*keys, *[F.shiftright(c, level).alias(c) for c in ("cx", "cy")]).distinct()
    # Cells of the top level are -1 or 0 both ways: four at most for each of the keys.
    found = wanted.join(at(top), keys) if keys else wanted.crossJoin(F.broadcast(at(top)))
    levels = [top, *range((top - 1) // 3 * 3, -1, -3)]
    for above, level in zip([top, *levels], levels):
        if level < top:
            parts = at(level).withColumns({"_x": F.shiftright("cx", above - level), "_y": F.shiftright("cy", above - level)})
            found = found.withColumnsRenamed({"cx": "_x", "cy": "_y"}).join(parts, [*keys, "_x", "_y"]).drop("_x", "_y")
        size = float(1 << level)
        near, far = [], []
        for c, p in (("cx", "px"), ("cy", "py")):
            low, high, own = F.col(c) * size, F.col(c) * size + size, F.col(p).cast("double")
            near.append(F.greatest(F.lit(0.0), low - own - 1, own - high))
            far.append(F.greatest(F.abs(own + 1 - low), F.abs(high - own)))
        least, greatest = (a * a + b * b for a, b in (near, far))
        bound = F.min(greatest).over(Window.partitionBy(*keys, "px", "py"))
        found = found.withColumns({"_least": least, "_bound": bound}).where("_least <= _bound").select(*keys, "px", "py", "cx", "cy")
    return found


def assign_polygons(points: DataFrame, areas: DataFrame, cell: float = 2.0, within: tuple[str, ...] = ()) -> DataFrame:
    """The area that a point (point_id, lon, lat) lies in, else the nearest one, at any distance. inside tells which.

    areas: area_id and rings (outer rings and holes alike; odd crossings over all of them are inside), as read_polygons()
    gives. within: columns that a point and its area must share, such as the country. Degrees are a plane, as on the map:
    nothing wraps around. A grid cell has a list of the areas whose box has it, each with the segments that a line of
    latitude through the cell can cross, and a list of the segments of all cells that can hold what is nearest to a point
    in it (nearest_cells()). A point meets the lists of its cell, one row all the way: no table of points and segments is
    made, sorted or grouped. Ties go to the least area_id. A point without coordinates has a
    null area; where there is no area to choose from, a point has no row.
    """
    lon, lat, keys = F.col("lon"), F.col("lat"), list(within)
    cells = [*keys, "px", "py"]
    located = points.where("lon is not null and lat is not null").select("point_id", "lon", "lat", *keys).withColumns({"px": F.floor(lon / cell), "py": F.floor(lat / cell)})
    edges = segments(areas, ["area_id", *keys])
    box = edges.groupBy("area_id", *keys).agg(*[f(g(f"{c}1", f"{c}2")).alias(f"{name}_{c}") for c in "xy" for name, f, g in (("min", F.min, F.least), ("max", F.max, F.greatest))])
    for c in "xy":
        box = box.withColumn(f"p{c}", F.explode(_cells_between(f"min_{c}", f"max_{c}", cell)))
    segment = F.struct("x1", "y1", "x2", "y2")
    rows = edges.where("y1 <> y2").withColumn("py", F.explode(_cells_between("y1", "y2", cell)))
    # A segment that ends well to the left of a cell isn't crossed by a ray to the right.
    rayed = box.select("area_id", *cells).join(rows, ["area_id", *keys, "py"]).where(F.greatest("x1", "x2") >= (F.col("px") - 1) * cell)
    boxed = rayed.groupBy(*cells, "area_id").agg(F.collect_list(segment).alias("s")).groupBy(*cells).agg(F.collect_list(F.struct("area_id", "s")).alias("boxed"))

    def crossing(s: Column) -> Column:
        return ((s["y1"] > lat) != (s["y2"] > lat)) & (lon < s["x1"] + (lat - s["y1"]) / (s["y2"] - s["y1"]) * (s["x2"] - s["x1"]))

    odd = F.filter("boxed", lambda a: F.size(F.filter(a["s"], crossing)) % 2 == 1)
    asked = located.join(boxed, cells, "left").withColumn("_in", F.array_min(F.transform(odd, lambda a: a["area_id"]))).drop("boxed")
    celled = segment_cells(edges, cell)
    search = nearest_cells(located.select(*cells).distinct(), celled.select(*keys, "cx", "cy").distinct(), within)
    near = search.join(celled, [*keys, "cx", "cy"]).select(*cells, F.struct("area_id", "x1", "y1", "x2", "y2").alias("s")).distinct().groupBy(*cells).agg(F.collect_list("s").alias("near"))
    best = F.array_min(F.transform("near", lambda s: F.struct(squared_distance(lon, lat, s).alias("d"), s["area_id"].alias("area_id"))))["area_id"]
    found = asked.join(near, cells, "left").withColumn("area_id", F.when(F.col("_in").isNotNull(), F.col("_in")).otherwise(best)).where("area_id is not null")
    nowhere = points.where("lon is null or lat is null").select("point_id", F.lit(None).cast(areas.schema["area_id"].dataType).alias("area_id"), F.lit(False).alias("inside"))
    return found.select("point_id", "area_id", F.col("_in").isNotNull().alias("inside")).unionByName(nowhere)


def assign_rectangles(points: DataFrame, rectangles: DataFrame) -> DataFrame:
    """The rectangle a point lies in (half open), else the one at the least degree distance, then the least id."""
    return assign_polygons(points, rings_of(rectangles, "rect_id")).withColumnRenamed("area_id", "rect_id")


def build_regions(places: DataFrame, areas: DataFrame, split: DataFrame, totals: DataFrame, known: DataFrame, least: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """(regions, places by region). places: point_id, country, lon, lat, pop; areas: area_id, country, rings.

    A place of a country in `split` (country) belongs to the area of its country that it lies in or is nearest to, any
    other place to its country. A region's centre is weighted by population (1 at least for each place). Its population
    is its country's of `totals` (country, people), for areas its share of what `known` (area_id, people) gives its
    country. Regions of fewer than `least` people go, and their places with them.
    """
    divided = split.select("country").distinct().withColumn("_split", F.lit(True))
    marked = places.join(divided, "country", "left").withColumn("w", F.greatest("pop", F.lit(1.0)))
    keyed = areas.join(divided, "country", "left_semi")
    placed = assign_polygons(marked.where("_split"), keyed, within=("country",)).select("point_id", F.col("area_id").cast("string").alias("_area"))
    coded = marked.join(placed, "point_id", "left").withColumn("code", F.coalesce("_area", "country"))
    sizes = known.join(keyed.select("area_id", "country"), "area_id").join(totals.withColumnRenamed("people", "_all"), "country")
    share = F.col("people") * F.col("_all") / F.sum("people").over(Window.partitionBy("country"))
    people = sizes.select(F.col("area_id").cast("string").alias("code"), share.alias("population")).unionByName(totals.join(divided, "country", "left_anti").select(F.col("country").alias("code"), F.col("people").cast("double").alias("population")))
    centres = centroid(coded.select("code", "country", "lat", "lon", F.col("w").alias("pop")), ["code", "country"]).join(people, "code").where(F.col("population") >= least)
    regions = centres.select("code", "country", *[(F.floor(F.col(c) * 10_000 + 0.5) / 10_000).alias(c) for c in ("lat", "lon")], F.floor(F.col("population") + 0.5).alias("population"))
    return regions, coded.join(regions.select("code"), "code", "left_semi").select("code", "point_id", "lat", "lon", F.col("w").alias("pop"))


def enrich(entities: DataFrame, fixes: DataFrame, areas: DataFrame, tiers: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Entities (entity_id, country, latitude, longitude, more) with corrected coordinates, area, its country, tier and reason.

    areas: area_id, country, rings; tiers: entity_id, tier, reason. mismatch: the area's country isn't the entity's own (or
    that is null). The reason says where coordinates were corrected. With regions (area_id) an entity whose area isn't
    among them fails the query.
    """
    fixed = entities.drop("tier", "reason").join(fixes.select("entity_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")), "entity_id", "left")
    fixed = fixed.withColumns({"corrected": F.col("_lat").isNotNull() & F.col("_lon").isNotNull(), "latitude": F.coalesce("_lat", "latitude"), "longitude": F.coalesce("_lon", "longitude")}).drop("_lat", "_lon")
    placed = assign_polygons(fixed.select(F.col("entity_id").alias("point_id"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat")), areas)
    named = placed.join(areas.select("area_id", F.col("country").alias("area_country")), "area_id", "left").withColumnRenamed("point_id", "entity_id")
    out = fixed.join(named, "entity_id", "left").join(tiers.select("entity_id", "tier", "reason"), "entity_id", "left")
    out = out.withColumns({"mismatch": ~F.col("area_country").eqNullSafe(F.col("country")), "reason": F.concat(F.coalesce("reason", F.lit("")), F.when(F.col("corrected"), " [coords corrected]").otherwise(""))})
    if regions is not None:
        out = out.join(regions.select("area_id").distinct().withColumn("_known", F.lit(True)), "area_id", "left")
        out = out.withColumn("area_id", F.when(F.col("_known"), F.col("area_id")).otherwise(F.raise_error(F.concat(F.lit("no region for entity "), F.col("entity_id").cast("string"))).cast(out.schema["area_id"].dataType))).drop("_known")
    return out


def target_regions(features: DataFrame, countries: list[str], split: list[str], rules: DataFrame, dropped: list[str]) -> DataFrame:
    """Region code and name of first-level areas (country, source_code, source_name).

    A country that isn't split is one region by its own code. In the others a rule (country, source_code, code, name)
    decides, else the area's own code. Codes in dropped, provisional ones (with "~") and other countries go.
    """
    out = features.where(F.col("country").isin(*countries)).join(rules, ["country", "source_code"], "left")
    whole = ~F.col("country").isin(*split)
    out = out.withColumns({"code": F.when(whole, F.col("country")).otherwise(F.coalesce("code", "source_code")), "name": F.when(~whole, F.coalesce("name", "source_name"))})
    return out.where(~F.col("code").isin(*dropped) & ~F.col("code").contains("~"))
