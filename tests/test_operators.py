import datetime

import math
import random
import threading

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidecal.functions import calendar as cal
from tidecal.operators import evaluation, geo, history, holidays, models, status, weather
from tidecal.plans import adapters, learning, registry, states
from tidecal.plans.adapters import view
from tidecal.sources import contracts, files


def days(spark, values, entity=1):
    return spark.createDataFrame([(entity, k, float(v)) for k, v in values], "entity_id int, day int, label double")


def test_distances(spark):
    df = days(spark, [(k, v) for k, v in enumerate([0, 0, 0.5, 0, 0, 0, 0.9, 0.0])]).withColumnRenamed("label", "score")
    rows = history.holiday_distance(df).orderBy("day").collect()
    assert [r.days_until for r in rows] == [2, 1, 0, 3, 2, 1, 0, None]
    assert [r.days_since for r in rows] == [None, None, 0, 1, 2, 3, 0, 1]
    assert rows[0].log_days_until == pytest.approx(1.0986, abs=1e-3)


def test_drift_and_prior_year_never_look_ahead(spark):
    base = [(k, float(k % 17)) for k in range(0, 460)]
    changed = [(k, v + (50 if k >= 430 else 0)) for k, v in base]
    a, b = (history.drift(history.prior_year(days(spark, x))).orderBy("day").collect() for x in (base, changed))
    for x, y in zip(a, b):
        if x.day <= 430:
            assert (x.py364, x.drift1, x.drift7) == (y.py364, y.drift1, y.drift7)
    assert any(x.drift1 != y.drift1 for x, y in zip(a, b) if x.day > 430)
    assert a[400].py364 == float(36 % 17) and a[400].drift7 is not None


def test_future_drift_is_blank_beyond_the_last_label(spark):
    rows = history.future_drift(days(spark, [(k, float(k % 5)) for k in range(0, 500)]), days=10).orderBy("day").collect()
    assert [r.drift1 is None for r in rows] == [False] + [True] * 9
    assert [r.drift7 is None for r in rows] == [False] * 7 + [True] * 3


def test_clock(spark):
    df = spark.createDataFrame([("07:15", "11:45"), ("21:30", "03:00"), ("06:00", None), ("7:70", "8:2"), ("24:00", "23:59")], "o string, c string")
    rows = df.select(cal.hours_open(cal.minutes(F.col("o")), cal.minutes(F.col("c"))).alias("h"), cal.minutes(F.col("c")).alias("c")).collect()
    assert [r.h for r in rows] == [4.5, 5.5, None, None, None] and [r.c for r in rows] == [705, 180, None, 482, 1439]
    back = spark.createDataFrame([(705.0,), (1439.0,), (1445.0,), (-10.0,), (None,)], "m double").select(cal.clock(F.col("m")).alias("t")).collect()
    assert [r.t for r in back] == ["11:45", "23:59", "00:05", "23:50", None]


def test_date_anchors(spark):
    r = spark.range(1).select(cal.easter(F.lit(2024)).alias("e"), cal.nth_weekday(F.lit(2024), 5, 0, -1).alias("m"), cal.iso_monday(F.lit(2021), 1).alias("w")).first()
    assert (r.e, r.m, r.w) == (datetime.date(2024, 3, 31), datetime.date(2024, 5, 27), datetime.date(2021, 1, 4))


def test_overlaps_and_hierarchy(spark):
    rows = spark.createDataFrame([("A", 1, "school", 0.5), ("A-1", 1, "school", 0.5)], "code string, day int, type string, share double")
    regions = spark.createDataFrame([("A-1", "A"), ("A-2", "A")], "code string, country string")
    got = {r.code: r.share for r in holidays.overlap_combine(holidays.fan_out(rows, regions), ["code", "day", "type"]).collect()}
    assert got["A-1"] == pytest.approx(0.75) and got["A-2"] == pytest.approx(0.5)


def test_rain_look_back(spark):
    df = days(spark, [(k, 20.0 if k == 5 else 0.0) for k in range(12)]).withColumnRenamed("label", "precip").withColumns({"temp_max": F.lit(1.0)})
    got = [r.rain_prev3 for r in weather.look_back(df).orderBy("day").collect()]
    assert got[5] == 0 and got[6:9] == [20.0] * 3 and got[9] == 0


def test_known_schedule(spark):
    rows = spark.createDataFrame([(1, k) for k in range(5)], "entity_id int, day int")
    plan = spark.createDataFrame([(1, 0, "closed", None, None), (1, 1, "open", "08:00", "01:00"), (1, 2, "open", None, "20:00"), (1, 3, "unknown", None, None)], "entity_id int, day int, status string, opens string, closes string")
    got = status.known_schedule(rows, plan).orderBy("day").collect()
    assert [r.known for r in got] == [True, True, False, False, False]
    r = status.apply_known_hours(status.known_schedule(rows, plan).withColumns({"open_min": F.lit(600.0), "close_min": F.lit(1200.0)})).where("day = 1").first()
    assert (r.open_min, r.close_min, r.duration) == (480.0, 60.0, 17.0)


def test_log(spark):
    log = spark.createDataFrame([(1, 10, 1, 50.0, "backtest"), (1, 10, 1, 45.0, "live"), (1, 10, 7, 50.0, "backtest")], "entity_id int, day int, lead_days int, prediction double, source string")
    actual = spark.createDataFrame([(1, 10, 40.0)], "entity_id int, day int, label double")
    got = {r.lead_days: (r.source, r.error) for r in evaluation.score_log(log, actual).collect()}
    assert got == {1: ("live", 5.0), 7: ("backtest", 10.0)}
    s = evaluation.accuracy_summary(evaluation.score_log(log, actual), 10, windows=(7,)).where("lead_days = 7").first()
    assert (s.accuracy, s.within_10, s.mae, s.bias) == (90.0, 100.0, 10.0, 10.0)


def test_distance_and_ring(spark):
    degree = 3.141592653589793 * geo.EARTH_KM / 180
    r = spark.range(1).select(geo.haversine(F.lit(12.0), F.lit(30.0), F.lit(19.0), F.lit(30.0)).alias("north"), geo.haversine(F.lit(0.0), F.lit(-170.0), F.lit(0.0), F.lit(175.0)).alias("east"), geo.haversine(F.lit(60.0), F.lit(5.0), F.lit(60.0), F.lit(5.0)).alias("none")).first()
    assert (r.north, r.east, r.none) == (pytest.approx(7 * degree), pytest.approx(15 * degree), 0.0)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])
    got = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (-1.0, 2.0)], "lon double, lat double").select(geo.in_ring(F.col("lon"), F.col("lat"), ring).alias("i")).collect()
    assert [x.i for x in got] == [True, False, False]


def test_contract(spark):
    df = spark.createDataFrame([(1, 1, "open", 120.0), (1, 1, "odd", 5.0)], "entity_id int, day int, status string, label double")
    with pytest.raises(contracts.ContractError) as e:
        contracts.check(df, contracts.Contract(("entity_id", "holiday"), ("entity_id", "day"), {"status": ("open",)}, {"label": (0, 100)}))
    for part in ("allowed:status: 1 (odd)", "range:label: 1 (120.0 to 120.0)", "missing_columns: 1 (holiday)", "duplicate_keys: 1"):
        assert part in str(e.value)


def test_allowed_values_name_none_in_the_query(spark, sf, monkeypatch):
    """All days are open or closed: SQL's list of no values is null."""
    calendar = view(spark, sf, "calendar").where("status <> 'unknown'")
    monkeypatch.setattr(states, "cal", lambda s, d: calendar)
    found = {r.rule: (r.n, r.found) for r in registry.queries()["contract_report"](spark, sf).collect()}
    assert found["allowed:status"] == (0, None) and found["duplicate_keys"] == (0, "") and found["missing_columns"] == (1, "holiday") and found["range:label"][0] > 0


def test_points_meet_areas_without_being_grouped(spark):
    ring = [[Row(lon=float(x), lat=float(y)) for x, y in ((0, 0), (5, 0), (5, 5), (0, 5), (0, 0))]]
    areas = spark.createDataFrame([(1, ring)], "area_id int, rings array<array<struct<lon double, lat double>>>")
    out = geo.assign_polygons(spark.range(100).selectExpr("id as point_id", "id % 10 + 0.5D as lon", "id / 20 as lat"), areas)
    assert "keys=[point_id" not in plan_of(out) and out.count() == 100 and out.where("inside").count() == 50


def test_no_line_of_the_large_table_is_sorted_for_the_calendar(spark, sf):
    """Aggregates of lines keep numbers only, which are hashed; event names are compared once a day and name."""
    plan = view(spark, sf, "calendar")._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" in plan and not [line for line in plan.splitlines() if "SortAggregate" in line and "l_tax" in line]


def test_closing_rows_are_written_once(spark, sf):
    """The indexer, the entities' means, the fit and the scores read one table, not the plan of medians and terciles."""
    registry.queries()["closing_predictions"](spark, sf)
    assert "category" in learning._kept[0].columns and not [f for f in learning._kept[0].inputFiles() if "lineitem" in f]


def test_a_model_query_reads_the_large_tables_once(spark, sf):
    """Within a query that shares, frames and fits read the written aggregates; outside each plan reads its tables."""
    rows = lambda df: sorted(map(str, df.collect()))
    plain = {name: rows(view(spark, sf, name)) for name in ("calendar", "markets")}
    with adapters.sharing(True):
        for df in (states.features(spark, sf), states.merged(spark, sf)):
            assert not [f for f in df.inputFiles() if any(t in f for t in ("lineitem", "orders", "customer", "supplier"))]
        assert view(spark, sf, "calendar") is view(spark, sf, "calendar") and {name: rows(view(spark, sf, name)) for name in plain} == plain
    assert any("lineitem" in f for f in view(spark, sf, "calendar").inputFiles())


@pytest.fixture(scope="module")
def odd_sf(spark, sf, tmp_path_factory):
    """The small tables with parts that occur twice or not at all, and orders without a priority, a status or a customer."""
    out = str(tmp_path_factory.mktemp("odd"))
    for name in adapters.TABLES:
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "part":
            df = df.where("p_partkey % 7 <> 0").unionByName(df.where("p_partkey % 5 = 0").withColumns({"p_type": F.lit("PROMO"), "p_name": F.concat(F.lit("z "), "p_name")}))
        if name == "orders":
            odd = lambda k, c: F.when(F.col("o_orderkey") % k != 0, F.col(c))
            df = df.withColumns({"o_orderpriority": odd(11, "o_orderpriority"), "o_orderstatus": odd(13, "o_orderstatus"), "o_custkey": odd(17, "o_custkey")})
        df.write.parquet(f"{out}/{name}.parquet")
    return out


def test_shared_aggregates_are_those_of_their_views(spark, odd_sf):
    """What a sharing query makes in common passes is what each view makes by itself, on odd rows as well."""
    names = ("activity", "calendar", "station", "markets")
    made = lambda: {name: sorted(map(str, view(spark, odd_sf, name).collect())) for name in names} | {"merged": sorted(map(str, states.merged(spark, odd_sf).collect()))}
    plain, types = made(), {name: view(spark, odd_sf, name).dtypes for name in names}
    with adapters.sharing(True):
        assert made() == plain and {name: view(spark, odd_sf, name).dtypes for name in names} == types


def test_a_sharing_query_passes_over_the_large_tables_few_times(spark, sf, monkeypatch):
    """Lines and orders are each read for their table of days and for the markets, which sort no line."""
    plans, write = [], adapters.materialise

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(adapters, "materialise", seen)
    with adapters.sharing(True):
        learning.fit_inputs(spark, sf), states.features(spark, sf)
    large = [p for p in plans if "/lineitem.parquet" in p]
    assert sum(p.count("/lineitem.parquet") for p in plans) == 2 and sum(p.count("/orders.parquet") for p in plans) == 2
    assert [p for p in large if "/orders.parquet" in p and "ShuffledHashJoin" in p] and not [p for p in large if "SortMergeJoin" in p]


def test_fits_that_do_not_need_each_other_run_side_by_side(spark, monkeypatch):
    """Models of one table, refits of a replay and the targets of the status model meet at a barrier that one alone never passes."""
    rows = days(spark, [(k, k) for k in range(30)])

    class Fit:
        def __init__(self, barrier):
            self.barrier = barrier

        def fit(self, held):
            self.barrier.wait(60)
            return held.count()

    barrier = threading.Barrier(2)
    assert models.fit_on(rows, Fit(barrier), Fit(barrier)) == [30, 30]
    barrier = threading.Barrier(2)

    class Gated:
        def predict(self, made, lag):
            return made.withColumns({"prediction": F.lit(1.0), "low_confidence": F.lit(False)})

    monkeypatch.setattr(models.GatedModel, "fit", lambda *a, **k: barrier.wait(60) >= 0 and Gated())
    assert models.replay(rows, 0, 19, [], [], [], leads=(1,), refit=10).count() == 20
    barrier = threading.Barrier(3)
    monkeypatch.setattr(models, "learned_by", lambda *a, **k: barrier.wait(60) >= 0 and None)
    monkeypatch.setattr(models, "_score", lambda model, df, columns, out, **k: df.withColumn(out, F.lit(1.0)))
    frame = rows.withColumns({"is_open": F.lit(1), "open_min": F.lit(1.0), "close_min": F.lit(1.0)})
    assert models.status_model(frame, rows, []).count() == 30


def nearest_by_hand(lon, lat, areas):
    """(area, inside) over all segments of all areas."""
    best = None
    for name, rings in areas:
        odd, least = 0, float("inf")
        for ring in rings:
            for (ax, ay), (bx, by) in zip([ring[-1], *ring], ring):
                odd += (ay > lat) != (by > lat) and lon < ax + (lat - ay) / (by - ay) * (bx - ax)
                dx, dy = bx - ax, by - ay
                t = max(0.0, min(1.0, ((lon - ax) * dx + (lat - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                least = min(least, (ax + t * dx - lon) ** 2 + (ay + t * dy - lat) ** 2)
        found = (0, -1.0, name) if odd % 2 else (1, least, name)
        best = found if best is None or found < best else best
    return (best[2], best[0] == 0) if best else None


@pytest.mark.parametrize("cell", [0.7, 2.0, 25.0])
def test_every_point_has_the_area_it_is_in_or_nearest_to(spark, cell):
    rng = random.Random(int(cell * 10))
    areas = []
    for k in range(25):
        x, y, size = rng.uniform(-170, 170) if k % 5 else rng.uniform(160, 185), rng.uniform(-80, 20), rng.choice([0.2, 3, 30])
        ring = [(x + size * rng.uniform(0.4, 1) * math.cos(a), y + size * rng.uniform(0.4, 1) * math.sin(a)) for a in sorted(rng.uniform(0, 6.28) for _ in range(rng.randint(3, 9)))]
        hole = [(x + 0.1 * size * math.cos(a), y + 0.1 * size * math.sin(a)) for a in (0, 2, 4)]
        areas.append((k, [[*ring, ring[0]], *([hole] if k % 3 == 0 else []), *([[(x + 50, y), (x + 51, y), (x + 50.5, y + 1)]] if k % 4 == 0 else [])]))
    areas.append((90, []))
    points = [(k, rng.uniform(-180, 180), rng.uniform(-90, 90)) for k in range(150)] + [(k, rng.choice([179.9, -179.9, 0.0]), rng.choice([89.9, 60.0, -90.0])) for k in range(150, 180)]
    # On the grid's own lines, and on a corner of an area.
    points += [(180, 2.0, 4.0), (181, -50.0, -25.0), (182, *areas[1][1][0][0]), (183, None, 3.0), (184, 1.0, None)]
    schema = "area_id int, rings array<array<struct<lon:double,lat:double>>>"
    table = spark.createDataFrame(areas, schema)
    got = {r.point_id: (r.area_id, r.inside) for r in geo.assign_polygons(spark.createDataFrame(points, "point_id int, lon double, lat double"), table, cell=cell).collect()}
    assert len(got) == len(points) and got.pop(183) == got.pop(184) == (None, False)
    assert got == {k: nearest_by_hand(x, y, areas) for k, x, y in points if x is not None and y is not None}
    assert sum(not i for _, i in got.values()) > 60
    assert geo.assign_polygons(spark.createDataFrame(points, "point_id int, lon double, lat double"), table.limit(0)).where("area_id is not null").count() == 0


def test_areas_of_the_own_country_only(spark):
    areas = [(k, "AB"[k % 2], [[(10.0 * k, 0.0), (10.0 * k + 4, 0.0), (10.0 * k + 4, 4.0), (10.0 * k, 4.0)]]) for k in range(6)]
    points = [(k, "AB"[k % 2] if k % 7 else "C", float(k), 2.0 * (k % 5)) for k in range(60)]
    schema = "area_id int, country string, rings array<array<struct<lon:double,lat:double>>>"
    got = {r.point_id: (r.area_id, r.inside) for r in geo.assign_polygons(spark.createDataFrame(points, "point_id int, country string, lon double, lat double"), spark.createDataFrame(areas, schema), within=("country",)).collect()}
    assert got == {k: nearest_by_hand(x, y, [(a, r) for a, own, r in areas if own == c]) for k, c, x, y in points if c != "C"}


def test_enriched_entities(spark):
    square = lambda x: [[{"lon": a, "lat": b} for a, b in ((x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0))]]
    areas = spark.createDataFrame([(1, "AA", square(0.0)), (2, "BB", square(5.0))], "area_id int, country string, rings array<array<struct<lon:double,lat:double>>>")
    entities = spark.createDataFrame([(7, "AA", 0.5, 0.5), (8, "AA", 0.5, 60.0), (9, None, 0.5, 5.5)], "entity_id int, country string, latitude double, longitude double")
    fixes = spark.createDataFrame([(9, 0.2, 0.2)], "entity_id int, latitude double, longitude double")
    tiers = spark.createDataFrame([(7, "local", "by hand"), (8, "regional", None)], "entity_id int, tier string, reason string")
    got = {r.entity_id: (r.area_id, r.area_country, r.inside, r.mismatch, r.tier, r.reason) for r in geo.enrich(entities, fixes, areas, tiers).collect()}
    assert got == {7: (1, "AA", True, False, "local", "by hand"), 8: (2, "BB", False, True, "regional", ""), 9: (1, "AA", True, True, None, " [coords corrected]")}
    with pytest.raises(Exception, match="no region for entity 8"):
        geo.enrich(entities, fixes, areas, tiers, areas.where("area_id = 1").select("area_id")).collect()


def joined_rows(df):
    """Rows that the joins of the plan that ran have put out."""
    def walk(node):
        inner = node.executedPlan() if hasattr(node, "executedPlan") and "AdaptiveSparkPlan" in node.nodeName() else node.plan() if "QueryStage" in node.nodeName() else None
        if inner is not None:
            yield from walk(inner)
            return
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            yield node.metrics().apply("numOutputRows").value()
        for k in range(node.children().size()):
            yield from walk(node.children().apply(k))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_grouped_pulls_keep_their_error_and_save_work(spark):
    """Against every place, for all tiers and regions; with ten times the places the pairs hardly grow."""
    rng = random.Random(2)
    towns = [(k % 6, rng.uniform(-60, 60), rng.uniform(-170, 170)) for k in range(60)]

    def places(n):
        return [(r, max(-90.0, min(90.0, la + rng.gauss(0, 0.3))), lo + rng.gauss(0, 0.3), float(rng.choice([0, 1, 50, 4000]))) for r, la, lo in rng.choices(towns, k=n)]

    entities = spark.createDataFrame([(k, la + 0.01, lo, t, None if k % 2 else 300.0) for k, ((_, la, lo), t) in enumerate(zip(towns, 10 * list(geo.REACH)))], "entity_id int, latitude double, longitude double, tier string, _reach double").withColumn("_reach", F.coalesce("_reach", geo.by_tier(F.col("tier"), geo.REACH)))
    work = []
    for n in (600, 6000):
        table = spark.createDataFrame(places(n), "region_id int, lat double, lon double, pop double")
        want = {(r.entity_id, r.region_id): r["_pull"] for r in geo.exact_pulls(entities, table).collect()}
        for error in (0.2, 0.02):
            got = {(r.entity_id, r.region_id): r["_pull"] for r in geo.pulls_within(entities, table, error).collect()}
            assert set(got) == {k for k, v in want.items()} and all(want[k] / (1 + error) <= v <= want[k] * (1 + error) + 1e-12 for k, v in got.items())
        grouped = geo.pulls_within(entities, table, 0.2)
        grouped.collect()
        work.append(sum(joined_rows(grouped)))
    assert work[1] < 60 * 6000 / 2 and work[1] < 6 * work[0]
    areas = spark.createDataFrame([(k, "AA", 1000.0, 0.0, 0.0, 1.0) for k in range(7)], "region_id int, country string, population double, lat double, lon double, affluence double")
    named = entities.withColumnRenamed("_reach", "reach_km").withColumn("country", F.lit("AA"))
    table = table.unionAll(spark.createDataFrame([(6, 1.0, 1.0, 0.0)], table.schema))
    a, b = ({(r.entity_id, r.region_id): r.prior_weight for r in geo.market_prior(named, table, areas, error).collect()} for error in (0.0, 0.01))
    assert set(a) == set(b) and all(b[k] == pytest.approx(v, rel=0.021, abs=1e-12) for k, v in a.items()) and a[0, 6] == b[0, 6] == 0


def test_days_kept_by_year_and_entity_need_no_exchange(spark):
    from tidecal.sources import layout

    days_ = spark.range(4000).selectExpr("cast(id % 20 as int) as entity_id", "cast(9000 + id div 20 * 5 as int) as day", "cast(id % 83 as double) as label").withColumn("date", F.date_from_unix_date("day"))
    layout.write_days(days_, "kept_days", 4)
    try:
        kept = layout.read_days(spark, "kept_days")
        framed = history.drift(history.prior_year(kept))
        assert "Exchange" not in plan_of(framed) and "Window" in plan_of(framed)
        key = lambda df: sorted((r.entity_id, r.day, r.py364, r.drift7) for r in df.select("entity_id", "day", "py364", "drift7").collect() if r.py364 is not None)
        assert key(framed) == key(history.drift(history.prior_year(days_)))
        one = layout.read_days(spark, "kept_days", (1996, 1996))
        assert one.count() == days_.where("year(date) = 1996").count() and all("year=1996" in f for f in one.inputFiles()) and len(one.inputFiles()) == 4
    finally:
        spark.sql("drop table kept_days")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("each", [100_000, 40, 1])
def test_average_ranks_are_summed_over_ranges(spark, each):
    rng = random.Random(each)
    values = [rng.choice([None, -0.5, 0.0, 1e9, rng.random(), rng.randint(0, 30) / 3]) for _ in range(600)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    ranked = evaluation.average_ranks(df, "v", "r", each)
    known = sorted(v for v in values if v is not None)
    want = {v: (known.index(v) + 1 + len(known) - known[::-1].index(v)) / 2 for v in set(known)}
    assert {r.k: r.r for r in ranked.collect()} == {k: None if v is None else want[v] for k, v in enumerate(values)}
    assert ("SinglePartition" in plan_of(ranked)) == (each > 600)  # one range of bounded size, else none
    assert evaluation.average_ranks(df.limit(0), "v", "r").count() == 0


def test_wrong_values_are_bounded_before_they_meet(spark):
    df = spark.range(50_000).selectExpr("id", "concat('v', lpad(id, 6, '0')) as a", "if(id % 2 = 0, 'ok', null) as b", "if(id = 7, 'odd', 'ok') as c")
    out = contracts.report(df, contracts.Contract(("id",), (), {"a": ("x",), "b": ("ok",), "c": ("ok",)}))
    found = {r.rule: (r.n, r.found) for r in out.collect()}
    assert found["allowed:a"] == (50_000, ", ".join(f"v{k:06d}" for k in range(5))) and found["allowed:b"] == (0, "") and found["allowed:c"] == (1, "odd")
    assert "WindowGroupLimit" in plan_of(out) and "collect_set" not in plan_of(out)


def test_nearest_known_year_by_one_order(spark):
    rng = random.Random(6)
    known = [(c, rng.randint(1990, 2030), rng.random()) for c in "abcd" for _ in range(5)]
    wanted = [(c, y) for c in "abcde" for y in range(1985, 2035, 1)] + [("a", 2000)]
    out = holidays.nearest_year(spark.createDataFrame(wanted, "code string, year int"), spark.createDataFrame(known, "code string, year int, value double"), ["code"])
    got = {(r.code, r.year): (r.known_year, r.value) for r in out.collect()}
    assert got == {(c, y): min(((abs(k - y), k, v) for code, k, v in known if code == c))[1:] for c, y in set(wanted) if c != "e"}
    assert "Join" not in plan_of(out)


def test_sundays_named_as_exceptions_stay(spark):
    a = spark.createDataFrame([(1, "x", datetime.date(2024, 5, 4))], "row int, code string, date date")
    b = spark.createDataFrame([(2, "x", datetime.date(2024, 5, 5)), (3, "y", datetime.date(2024, 5, 5)), (4, "y", datetime.date(2024, 5, 6)), (5, "z", datetime.date(2024, 5, 12))], "row int, code string, date date")
    named = spark.createDataFrame([("y",), ("x",)], "code string")
    assert sorted(r.row for r in holidays.supplement(a, b, ["code"]).collect()) == [1, 4]
    assert sorted(r.row for r in holidays.supplement(a, b, ["code"], named).collect()) == [1, 3, 4]


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("entity_id,date,status,label,predicted,opens,closes,events\n1,2020-01-02,open,50,TRUE,10:00,18:00,\n1,2020-01-03,open,,x,,,\n")
    rows = files.read_calendar(spark, str(tmp_path / "c.csv")).orderBy("day").collect()
    assert [r.predicted for r in rows] == [True, False] and rows[0].day == 18263
    (tmp_path / "f.json").write_text('{"cell":"1_1","time":["2020-01-01","2020-01-02"],"rain":[1.0,null]}\n')
    cells = spark.createDataFrame([("1_1", 7), ("1_1", 8)], "cell string, entity_id int")
    assert files.read_forecasts(spark, str(tmp_path / "f.json"), ("rain",), cells).count() == 4
    (tmp_path / "g.json").write_text('{"features":[{"properties":{"name":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,3],[0,0]]]}},{"properties":{"name":"two"},"geometry":{"type":"MultiPolygon","coordinates":[[[[10,0],[20,0],[20,10],[10,10],[10,0]],[[14,4],[16,4],[16,6],[14,6],[14,4]]],[[[30,0],[31,0],[31,1],[30,1],[30,0]]]]}},{"properties":{"name":"none"},"geometry":null}]}')
    areas = files.read_polygons(spark, str(tmp_path / "g.json"))
    p, two = areas.orderBy("min_lon").collect()
    assert (p.min_lon, p.max_lat, p.properties["name"]) == (0.0, 3.0, "x") and (len(two.rings), two.min_lon, two.max_lon) == (3, 10.0, 31.0)
    points = spark.createDataFrame([(1, 12.0, 2.0), (2, 15.0, 5.0), (3, 30.5, 0.5), (4, 21.5, 5.0), (5, 1.5, 0.5), (6, 60.0, 60.0), (7, 25.5, 0.5)], "point_id int, lon double, lat double")
    placed = {r.point_id: (r.area_id, r.inside) for r in geo.assign_polygons(points, areas.select(F.col("properties")["name"].alias("area_id"), "rings")).collect()}
    assert placed == {1: ("two", True), 2: ("two", False), 3: ("two", True), 4: ("two", False), 5: ("x", True), 6: ("two", False), 7: ("two", False)}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.csv").write_text("entity_id,date,rain,old\n3,2020-01-02,1.5,9\n3,2020-01-03,,9\n")
    got = files.read_stations(spark, str(tmp_path / "s"), ("old",)).orderBy("day").collect()
    assert [(r.entity_id, r.rain, r.day) for r in got] == [(3, 1.5, 18263), (3, None, 18264)] and "old" not in got[0].asDict()
    (tmp_path / "empty.csv").write_text("entity_id,date,rain\n")
    with pytest.raises(ValueError):
        files.read_stations(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "t.csv").write_text("entity_id,tier,reason,decay_km\n1,local,,\n2,cosmic,,\n")
    with pytest.raises(ValueError, match="cosmic"):
        files.read_tiers(spark, str(tmp_path / "t.csv"), ("local",))
    (tmp_path / "p.tsv").write_text("\t".join(["1", "n", "", "", "10.5", "20.5", "P", "", "AA", "", "", "", "", "", "700"]) + "\n" + "\t".join(["2", "m", "", "", "1", "2", "P", "", "BB", "", "", "", "", "", "x"]) + "\n")
    assert [(r.lat, r.lon, r.country, r.pop) for r in files.read_places(spark, str(tmp_path / "p.tsv"), ("AA", "CC")).collect()] == [(10.5, 20.5, "AA", 700)]
    (tmp_path / "e.csv").write_text("entity_id,date,symbol,event\n1,2020-01-02,*,Parade\n1,2020-01-02,+,Show\n")
    assert files.read_events(spark, str(tmp_path / "e.csv")).count() == 2
    files.write_stage(spark.range(3), str(tmp_path / "stage"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "stage")).count() == 3
    files.write_log(spark.createDataFrame([Row(made_on="a", source="live", v=1), Row(made_on="b", source="live", v=2)]), str(tmp_path / "log"))
    files.write_log(spark.createDataFrame([Row(made_on="b", source="live", v=3)]), str(tmp_path / "log"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 3]


def test_stream_equals_batch(spark, sf, tmp_path):
    from tidecal.plans.adapters import view
    from tidecal.streaming.weather import daily_stream

    hourly = view(spark, sf, "hourly").withColumn("hour", F.col("hour").cast("timestamp"))
    hourly.write.parquet(str(tmp_path / "in"))
    q = daily_stream(spark.readStream.schema(hourly.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.station, r.date, r.lead, r.temp_max, r.rain, r.wet_hours)
    assert sorted(map(repr, map(key, spark.table("daily").collect()))) == sorted(map(repr, map(key, weather.hourly_to_daily(hourly).collect())))


def test_registry(spark, sf):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.flagship(spark, sf).count() > 0


def test_leads():
    assert evaluation.parse_leads(" 21,3 ,, 3,0") == (0, 3, 21)
    for wrong in (" , ", "4,-2", "2.5", "5,two"):
        with pytest.raises(ValueError):
            evaluation.parse_leads(wrong)


def test_headline_is_one_line_or_none(spark):
    summary = spark.createDataFrame([(30, 14, 25, 71.5, 33.8, 9.25), (90, 7, 80, 90.0, 60.0, 5.0)], "window int, lead_days int, days long, accuracy double, within_10 double, mae double")
    text = "Last 30 days at 14 days ahead, over 25 days: accuracy 72, 34% of rows off by 10 or less, mean error 9.2"
    assert [r.headline for r in evaluation.headline(summary, 30, 14).collect()] == [text]
    assert evaluation.headline(summary, 30, 1).count() == 0


def test_target_regions(spark):
    areas = spark.createDataFrame([("A", "A-1", "one"), ("A", "A-2", "two"), ("A", "A-9", "far"), ("A", "A-X~", "none"), ("B", "B-1", "bee"), ("C", "C-1", "see"), ("A", None, "gone")], "country string, source_code string, source_name string")
    rules = spark.createDataFrame([("A", "A-2", "A-22", "renamed")], "country string, source_code string, code string, name string")
    got = {(r.code, r.name) for r in geo.target_regions(areas, ["A", "B"], ["A"], rules, ["A-9"]).collect()}
    assert got == {("A-1", "one"), ("A-22", "renamed"), ("B", None)}


def test_school_holidays(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"country": "A", "startDate": "2024-01-01", "endDate": "2024-01-05", "type": "School", "name": [{"language": "DE", "text": "x"}, {"language": "EN", "text": "y"}], "subdivisions": [{"code": "A-1"}, {"code": "A-2"}]}, {"country": "A", "startDate": "2024-02-01", "endDate": "2024-02-01", "type": "Public", "temporalScope": "HalfDay", "name": []}]')
    school = files.read_holidays(spark, str(tmp_path / "h.json"), "School").collect()
    assert {(r.code, r.name) for r in school} == {("A-1", "y"), ("A-2", "y")}
    assert files.read_holidays(spark, str(tmp_path / "h.json")).count() == 0


@pytest.fixture(scope="module")
def forecast(spark, sf):
    return registry.queries()["forecast_output"](spark, sf).collect()


def test_forecasts_are_blank_on_days_known_to_be_closed(forecast):
    assert forecast and len({(r.entity_id, r.day) for r in forecast}) == len(forecast)
    for r in forecast:
        shut = r.known and not r.is_open
        assert (r.prediction is None) == shut and (not shut or r.opens is None and r.closes is None)
        assert r.prediction is None or 0 <= r.prediction <= 100
