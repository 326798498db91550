"""Composed frames, calendar merge, models and weight fits on small made-up tables."""

import itertools

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecal.operators import days, evaluation, fitting, frames, geo, history, holidays, models, scores, weather
from tidecal.sources.scratch import materialise

ENTITIES = "entity_id int, company string, tier string, latitude double, first_year int, first_month int"
CALENDAR = "entity_id int, day int, label double, status string, predicted boolean, opens string, closes string, events string"


def calendar(spark, change=None):
    rows = []
    for e in (1, 2):
        for k in range(9000, 9460):
            label = float((k * (3 + e)) % 90 + 1)
            rows.append([e, k, None if k % 11 == 0 else label, "closed" if k % 13 == 0 else "open", False, "09:00", "18:30" if k % 5 else "20:00", "Parade" if k % 17 == 0 else None])
    for row in rows:
        if change:
            change(row)
    return spark.createDataFrame([tuple(r) for r in rows], CALENDAR).withColumn("date", F.date_from_unix_date("day"))


def parts(spark):
    entities = spark.createDataFrame([(1, "A", "local", 10.0, 1990, 5), (2, "B", "regional", -3.0, 1991, 1)], ENTITIES)
    keys = spark.range(9000, 9520).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("entity_id"), F.col("id").cast("int").alias("day"))
    scored = keys.withColumns({"national_score": (F.col("day") % 30 == 0).cast("double"), "school_score": F.when(F.col("day") % 90 < 10, 0.6).otherwise(0.1)})
    return entities, frames.holiday_columns(scored), keys.withColumns({"temp_max": (F.col("day") % 35).cast("double"), "wet": (F.col("day") % 4 == 0).cast("double")})


def rows_of(df, *columns):
    return {(r.entity_id, r.day): tuple(r[c] for c in columns) for r in df.collect()}


def test_feature_frame_never_looks_ahead(spark):
    entities, holiday, wx = parts(spark)

    def later(row):
        if row[1] >= 9440 and row[2] is not None:
            row[2] = 100.0 - row[2]

    a, b = (rows_of(frames.feature_frame(calendar(spark, x), entities, holiday, wx), "py364", "py_mean", "drift1", "drift7", "national_until", "school_log_since", "temp_max", "months_open") for x in (None, later))
    assert set(a) == set(b) and all(a[k] == b[k] for k in a if k[1] <= 9440)
    assert any(a[k] != b[k] for k in a if k[1] > 9441) and any(v[0] is not None and v[2] is not None for v in a.values())


def test_future_rows_know_nothing_after_their_day(spark):
    entities, holiday, wx = parts(spark)

    def later(row):
        if row[1] > 9430:
            row[2], row[3], row[5] = 1.0, "open", "05:00"

    columns = ("days_ahead", "py364", "drift14", "rate", "open_min", "last_label", "has_event", "open_last_year", "national_score", "tier", "wx_source")
    a, b = (rows_of(frames.future_rows(calendar(spark, x), entities, holiday, wx.withColumn("wx_source", F.lit("x")).where("day < 9440"), days=20, asof=9430), *columns) for x in (None, later))
    assert a == b and len(a) == 40 and {v[-1] for v in a.values()} == {"x", "none"}
    # Known days built as if they were to come have what the labelled frame has.
    known = rows_of(frames.feature_frame(calendar(spark), entities, holiday, wx), "py364", "national_score", "tier", "drift14")
    for key, (_, py364, drift14, *_, score, tier, _) in a.items():
        if key in known:
            assert (py364, score, tier) == known[key][:3]
            assert drift14 is None or drift14 == pytest.approx(known[key][3])
    everything = rows_of(frames.future_rows(calendar(spark), entities, holiday, days=3), "days_ahead")
    assert min(k[1] for k in everything) == 9460


def test_status_frame_leaves_out_unknown_days_and_unscored_entities(spark):
    entities, holiday, _ = parts(spark)
    got = rows_of(frames.status_frame(calendar(spark), entities, holiday.where("entity_id = 1"), ("2000-01-01", "2000-01-02")), "is_open", "is_open_364", "is_open_mean", "close_min", "dow", "school_score")
    assert {k[0] for k in got} == {1} and len(got) == 460
    closed = next(k for k in got if k[1] % 13 == 0 and k[1] >= 9364)
    assert got[closed][0] == 0.0 and got[closed][1] == float((closed[1] - 364) % 13 != 0)


def test_scored_rows_keep_unknown_status_and_count_the_rest(spark):
    df = spark.createDataFrame([(1, 1, None, None), (1, 2, "closed", False), (1, 3, "open", True), (1, 4, "no_data", False), (2, 1, "open", False)], "entity_id int, day int, status string, predicted boolean")
    known = spark.createDataFrame([(1, 1, 0.5)], "entity_id int, day int, score double")
    assert {(r.entity_id, r.day, r.score) for r in days.enhance(df, known).collect()} == {(1, 1, 0.5), (1, 4, None)}
    assert [tuple(r) for r in days.without_score(df, known).collect()] == [(2, 1)]
    blind = spark.createDataFrame([(1, 5, "none")], "entity_id int, day int, wx_source string")
    assert days.require_horizon(blind, 6).count() == 1
    with pytest.raises(ValueError):
        days.require_horizon(blind, 0)


def test_interval_share_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)), float(rng.integers(1, 9)), int(a), int(a + rng.integers(-1, 6))) for a in rng.integers(0, 40, 60)]
    got = {(r.state, r.day): r.share for r in holidays.interval_share(spark.createDataFrame(rows, "state int, weight double, start_day int, end_day int")).collect()}
    total = {s: sum(r[1] for r in rows if r[0] == s) for s in range(3)}
    want = {}
    for s, w, a, b in rows:
        for k in range(a, b + 1):
            want[s, k] = want.get((s, k), 0.0) + w / total[s]
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_calendar_merge(spark):
    def table(*rows):
        return spark.createDataFrame([(c, k, t, s) for c, k, t, s in rows], "code string, day int, type string, share double").withColumn("date", F.date_from_unix_date("day")).select("code", "date", "day", "type", "share")

    source = table(("A-1", 1, "school", 0.5), ("A", 1, "school", 0.5), ("B-7", 1, "school", 1.0), ("B-8", 1, "school", 1.0), ("B", 1, "school", 0.2), ("A-old", 2, "school", 0.8), ("Z", 1, "school", 1.0), ("A-9", 1, "school", 1.0), ("A", 400, "national", 1.0), ("A-1", 3, "school", 0.9))
    regions = spark.createDataFrame([("A-1", "A", 1), ("A-2", "A", 1), ("B", "B", 4)], "code string, country string, n_children int")
    mapping = spark.createDataFrame([("A-old", "A-2", 0.5)], "code string, new_code string, factor double")
    found = holidays.merge(source, regions, mapping, filled=table(("A", 5, "national", 1.0), ("B", 5, "national", 1.0)), verified=table(("A-1", 3, "school", 0.1)))
    got = {(r.code, r.day): (r.national, r.school) for r in found["calendar"].collect()}
    assert got == {("A-1", 1): (0, 0.75), ("A-2", 1): (0, 0.5), ("B", 1): (0, 0.6), ("A-2", 2): (0, 0.4), ("A-1", 3): (0, 0.1), ("A-1", 400): (1, 0), ("A-2", 400): (1, 0), ("B", 5): (1, 0)}
    assert {r.country: r.n for r in found["dropped"].collect()} == {"Z": 1, "A": 1}
    cover = {(r.country, r.year): (r.national, r.school) for r in found["coverage"].collect()}
    assert cover == {("A", 1970): (1, 1), ("A", 1971): (1, 0), ("B", 1970): (1, 1), ("B", 1971): (1, 0)}


def test_merge_of_null_shares_and_regions_named_like_countries(spark):
    rows = [("A-1", 1, "school", None), ("B-7", 1, "school", None), ("B-8", 2, "school", 1.0), (None, 1, "school", 1.0), ("C", 3, "national", 1.0), ("A", 4, "other", 1.0)]
    source = spark.createDataFrame(rows, "code string, day int, type string, share double").withColumn("date", F.date_from_unix_date("day"))
    # C is a region of A and the country of C-1 as well: its code means the region.
    regions = spark.createDataFrame([("A-1", "A", 1), ("B", "B", 4), ("C", "A", 1), ("C-1", "C", 1)], "code string, country string, n_children int")
    found = holidays.merge(source, regions, spark.createDataFrame([], "code string, new_code string, factor double"))
    assert {tuple(r) for r in found["calendar"].collect()} == {("B", 2, 0.0, 0.25), ("C", 3, 1.0, 0.0)}
    assert [tuple(r) for r in found["dropped"].collect()] == [(None, 1)]


def test_a_score_at_the_limit_is_no_holiday_whatever_its_last_digit(spark):
    rows = [(1, k, s, 0.0) for k, s in enumerate((0.2, float(np.nextafter(0.2, 1)), 0.1, 0.2001))]
    found = frames.holiday_columns(spark.createDataFrame(rows, "entity_id int, day int, national_score double, school_score double"))
    assert [(r.national_until, r.national_since, r.school_until) for r in found.orderBy("day").collect()] == [(3, None, None), (2, None, None), (1, None, None), (0, 0, None)]


def test_no_frame_reaches_to_the_end_of_its_rows(spark):
    days = spark.range(2000).selectExpr("1 as entity_id", "cast(id as int) as day", "case when id % 500 = 0 then 1.0 else 0.0 end as score", "0.3 as prior", "0.2 as fitted", "concat('c', id) as code", "cast(id as int) as year", "1.0 as value")
    for df in (history.holiday_distance(days), scores.blend(days, 0.5), holidays.nearest_year(days, days, ["entity_id"])):
        assert "currentrow$(), unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString()
    far = {r.day: (r.days_until, r.days_since) for r in history.holiday_distance(days).collect()}
    assert far == {k: (-k % 500 if k <= 1500 else None, k % 500) for k in range(2000)}


def test_market_prior_follows_its_rule(spark):
    entities = spark.createDataFrame([(1, 0.0, 0.0, "local", "X", None), (2, 0.0, 0.0, "intercontinental", "Q", 100.0)], "entity_id int, latitude double, longitude double, tier string, country string, reach_km double")
    places = spark.createDataFrame([(1, 0.0, 1.0, 10.0), (1, 0.0, 3.0, 30.0), (2, 0.0, 2.0, 5.0)], "region_id int, lat double, lon double, pop double")
    regions = spark.createDataFrame([(1, "X", 100.0, 0.0, 2.0, 1.0), (2, "Y", 300.0, 0.0, 2.0, 0.5)], "region_id int, country string, population double, lat double, lon double, affluence double")
    got = {(r.entity_id, r.region_id): r.prior_weight for r in geo.market_prior(entities, places, regions).collect()}
    km = [np.pi * geo.EARTH_KM / 180 * k for k in (1, 3, 2)]
    near = [np.exp(-k / 150) for k in km]
    a, b = 100 * (10 * near[0] + 30 * near[1]) / 40 * 3, 300 * near[2] * 0.5
    assert got[1, 1] == pytest.approx(a / (a + b)) and got[1, 1] + got[1, 2] == pytest.approx(1)
    far = [0.5 * np.exp(-k / 100) + 0.5 / (1 + k / 100) ** 3 for k in km]
    a, b = 100 * (10 * far[0] + 30 * far[1]) / 40, 300 * far[2] * 0.5
    assert got[2, 1] == pytest.approx(a / (a + b))


def test_controls_that_never_vary_are_left_out(spark):
    df = spark.createDataFrame([(1, 9000 + 7 * k) for k in range(40)], "entity_id int, day int").withColumn("date", F.date_from_unix_date("day"))
    events = df.where("day % 2 = 0").withColumn("event", F.lit("fair")).unionByName(df.withColumn("event", F.lit("always")))
    names = {r.name for r in scores.control_design(df, events).select("name").distinct().collect()}
    assert "event fair" in names and "event always" not in names and not any(n.startswith(("dow", "year")) for n in names)
    assert {"season_start", "season_end", "sin1", "cos2"} <= names and "sin3" not in names


def labelled_frame(spark, entities=3, n=500):
    rng = np.random.default_rng(1)
    rows = []
    for e, k in itertools.product(range(entities), range(n)):
        if e < 2 or k > n - 60:
            drift = float(rng.normal(0, 5))
            rows.append((e, 9000 + k, float(50 + 20 * (e - 1) + drift + 10 * (k % 7 == 0)), k % 7, drift, drift, drift, float(k % 30)))
    return spark.createDataFrame(rows, "entity_id int, day int, label double, dow int, drift1 double, drift7 double, drift14 double, temp_max double").withColumn("date", F.date_from_unix_date("day"))


COLUMNS, HISTORY = ["dow", "drift1", "drift7", "drift14", "temp_max"], ["drift1", "drift7", "drift14"]


def test_blanks_follow_lags_and_take_a_quarter_of_the_weather(spark):
    df = labelled_frame(spark)
    got = models.blanked(df, ["temp_max"]).collect()
    assert 0.2 < np.mean([r.temp_max is None for r in got]) < 0.3
    share = [np.mean([r[c] is None for r in got]) for c in HISTORY]
    assert share[0] == pytest.approx(0.75, abs=0.05) and share[1] == pytest.approx(0.5, abs=0.05) and share[2] == pytest.approx(0.25, abs=0.05)
    row = models.as_of(df.limit(1), 2).first()
    assert row.drift1 is None and row.drift7 is not None and models.as_of(df.limit(1), None).first().drift14 is None
    assert weather.without_weather(df.limit(1), ["temp_max"]).first().temp_max is None


@pytest.fixture(scope="module")
def gated(spark):
    frame = labelled_frame(spark).cache()
    return frame, models.GatedModel.fit(frame, COLUMNS, HISTORY, 9440, ("temp_max",), iterations=3)


def test_gate_and_drift_effect(spark, gated):
    frame, model = gated
    rows = frame.where("day > 9440").unionByName(frame.where("day = 9450"))
    got = model.predict(rows, 1).collect()
    assert len(got) == rows.count() and all((r.entity_id == 2) == r.low_confidence and (r.drift_effect is None) == r.low_confidence and 0 <= r.prediction <= 100 for r in got)
    assert any(abs(r.drift_effect) > 0 for r in got if r.drift_effect is not None)
    assert all(r.drift_effect == 0 for r in model.predict(rows, None).collect() if r.drift_effect is not None)
    assert sum(x for _, x in model.importance()) == pytest.approx(1)
    assert model.raw(rows, "fallback").count() == rows.count()


def test_backtest_has_all_horizons_and_groups(spark, gated):
    frame, model = gated
    got = {(r.section, r.name): r for r in models.backtest(model, frame.where("day > 9440")).collect()}
    assert sum(k[0] == "horizon" for k in got) == 4 and sum(k[0] != "horizon" for k in got) == 7
    assert got["horizon", "labels up to 1 days before"].mae <= got["horizon", "no recent labels"].mae
    assert got["not gated", "constant 50"].n + got["gated", "fallback"].n == got["all entities", "gated system"].n


def test_replay_never_sees_labels_of_its_own_days(spark):
    frame = labelled_frame(spark, n=430)
    later = frame.withColumn("label", F.when(F.col("day") >= 9410, 0.0).otherwise(F.col("label")))
    archived = frame.select("entity_id", "day", F.explode(F.array(F.lit(1), F.lit(7))).alias("weather_lead"), F.lit(5.0).alias("temp_max"))
    a, b = (models.replay(x, 9400, 9414, COLUMNS, HISTORY, ["temp_max"], archived, leads=(1, 7, 30), refit=10, iterations=2).collect() for x in (frame, later))
    a, b = ({(r.made_day, r.entity_id, r.day, r.lead_days): r.prediction for r in x} for x in (a, b))
    assert set(a) == set(b) and all(k[2] - k[0] == k[3] and 9400 <= k[0] <= 9414 for k in a)
    # The first fit knows days up to 9399, the second up to 9409: neither may move.
    assert a == b
    rows = models.weather_of_lead(frame.where("day = 9410").withColumn("lead", F.explode(F.array(F.lit(1), F.lit(30)))), archived, ["temp_max"]).collect()
    assert {(r.lead, r.temp_max) for r in rows} == {(1, 5.0), (30, None)}


def dense_ridge(train, asked, numbers, scores, penalty=10.0):
    """Predictions by (entity, day) of a ridge on one dense matrix: scaled numbers, and dummies of entity, weekday, month and the entity's weekdays, months and holidays."""
    def groups(r):
        e, week, month = r.entity_id, r.date.weekday(), r.date.month
        return [("e", e), ("w", week), ("m", month), ("ew", e, week), ("em", e, month), *[(c, e, (r[c] or 0) > 0.2 + frames.SUM_ERROR) for c in scores]]

    known = {g: k for k, g in enumerate(sorted({g for r in train for g in groups(r)}, key=str))}
    values = lambda found: np.array([[v for c in numbers for v in (float(r[c] or 0), float(r[c] is None))] for r in found])
    mean, spread = values(train).mean(0), values(train).std(0)

    def matrix(found):
        dummies = np.zeros((len(found), len(known)))
        for i, r in enumerate(found):
            dummies[i, [known[g] for g in groups(r) if g in known]] = 1
        return np.hstack([(values(found) - mean) / np.where(spread > 0, spread, 1), dummies])

    x, y = matrix(train), np.array([r.label for r in train])
    centre = x.mean(0)
    w = np.linalg.solve((x - centre).T @ (x - centre) + penalty * np.eye(x.shape[1]), (x - centre).T @ (y - y.mean()))
    return {(r.entity_id, r.day): p for r, p in zip(asked, (matrix(asked) - centre) @ w + y.mean())}


def test_ridge_is_the_exact_solution_with_all_its_dummies(spark):
    frame = labelled_frame(spark).withColumns({"label": F.col("label") + F.when((F.col("day") % 9 == 0) & (F.col("entity_id") == 1), 15).otherwise(0), "temp_max": F.when(F.col("day") % 8 > 0, F.col("temp_max"))})
    frame = frame.withColumns({"national": (F.col("day") % 9 == 0).cast("double"), "school": F.when(F.col("day") % 50 < 9, 0.6), "fixed": F.lit(0.1)})
    train, asked = frame.where("day < 9455"), frame.where("day >= 9455")
    asked = asked.unionByName(asked.where("entity_id = 1").withColumn("entity_id", F.lit(9)))  # an entity without a training row
    numbers = ["temp_max", "drift1", "national", "fixed"]
    for scores_, penalty in (("national", 0.1), (("national", "school"), 10.0), (None, 10.0)):
        got = models.ridge(train, asked, numbers, penalty, scores_).collect()
        want = dense_ridge(train.collect(), asked.collect(), numbers, [scores_] if isinstance(scores_, str) else scores_ or (), penalty)
        assert len(got) == len(want) == asked.count() and all(r.prediction == pytest.approx(want[r.entity_id, r.day], abs=1e-7) for r in got)


def test_ridge_query_has_entities_holidays_and_hours(spark, sf):
    from tidecal.plans import learning, registry, states

    rows = states.features(spark, sf).collect()
    train, asked = [r for r in rows if r.day <= learning.CUT], [r for r in rows if r.day > learning.CUT]
    want = dense_ridge(train, asked, learning.NUMBERS, ("national_score", "school_score"))
    got = registry.queries()["ridge_predictions"](spark, sf).collect()
    assert {"open_min", "close_min", "duration", "has_event", "in_window", "national_log_since", "school_log_until"} <= set(learning.NUMBERS)
    assert len(got) == len(want) > 0 and all(r.prediction == pytest.approx(want[r.entity_id, r.day], abs=1e-6) for r in got)


def test_comparison_chooses_on_validation_days(spark):
    frame = labelled_frame(spark, entities=2, n=400).withColumn("split", F.when(F.col("day") < 9250, "train").when(F.col("day") < 9320, "valid").otherwise("test"))
    got = {r.model: r for r in models.compare(frame, ["dow", "temp_max"], depths=(3,), penalties=(0.1, 100.0)).collect()}
    assert {k.split(",")[0] for k in got} == {"forest", "ridge", "mean"} and "ridge, penalty 0.1" in got and len({r.n for r in got.values()}) == 1


def test_all_models_are_compared_on_the_same_rows(spark):
    frame = labelled_frame(spark, entities=3, n=400).withColumn("split", F.when(F.col("day") < 9250, "train").when(F.col("day") < 9320, "valid").otherwise("test"))
    frame = frame.withColumns({"month": F.month("date"), "py364": F.when(F.col("day") % 2 == 0, F.col("label")), "score": (F.col("day") % 9 == 0).cast("double"), "out": F.col("day") < 9020})
    got = {(r.split, r.model): r for r in models.compare_all(frame, [*COLUMNS, "score"], HISTORY, ["score"], "score", "out", depth=4, iterations=2).collect()}
    names = {"global mean", "entity mean", "entity x weekday mean", "entity x weekday x month mean", "same weekday last year", "boosted", "boosted, no last year", "boosted, no identity", "boosted, no holidays", "forest", "ridge", "mean of forest and boosted"}
    assert set(got) == {(split, name) for split in ("valid", "test") for name in names}
    for split in ("valid", "test"):
        assert len({r.n for k, r in got.items() if k[0] == split}) == 1
    rows = frame.collect()
    seen = [r.label for r in rows if r.split == "train"]
    mean = sum(seen) / len(seen)
    asked = [r for r in rows if r.split == "valid"]
    assert got["valid", "global mean"].mae == pytest.approx(sum(abs(r.label - mean) for r in asked) / len(asked)) and got["valid", "global mean"].r2 <= 1e-9
    weekday = {k: [r.label for r in rows if r.split == "train" and (r.entity_id, r.dow) == k] for k in {(r.entity_id, r.dow) for r in rows}}
    want = [abs(r.label - (r.py364 if r.py364 is not None else sum(weekday[r.entity_id, r.dow]) / len(weekday[r.entity_id, r.dow]))) for r in asked]
    assert got["valid", "same weekday last year"].mae == pytest.approx(sum(want) / len(want))


def test_history_goes_with_error_by_fold(spark):
    rows = [(f, e, 50.0 + e, 50.0) for f in (1, 2) for e in range(1, 5)]
    errors = spark.createDataFrame(rows, "fold int, entity_id int, prediction double, label double")
    history = spark.createDataFrame([(e, 1.0 / e) for e in range(1, 5)], "entity_id int, years double")
    got = evaluation.fold_correlation(errors, history).collect()
    assert len(got) == 2 and all(r.spearman == pytest.approx(-1) and r.entities == 4 and -1 < r.pearson < -0.8 for r in got)
    by = {r.bucket: (r.entities, r.n) for r in evaluation.history_buckets(errors, history).collect()}
    assert by == {"(0,0.5]": (3, 6), "(0.5,1]": (1, 2)}


def test_equal_histories_have_no_correlation(spark):
    rows = [(f, e, 50.0, 50.0 + e, e) for f, n in ((1, 4), (2, 1)) for e in range(1, n + 1)]
    errors = spark.createDataFrame(rows, "fold int, entity_id int, prediction double, label double, day int")
    history = spark.createDataFrame([(e, 2.0) for e in range(1, 5)], "entity_id int, years double")
    got = {r.fold: r for r in evaluation.fold_correlation(errors, history).collect()}
    assert {f: r.entities for f, r in got.items()} == {1: 4, 2: 1} and all(np.isnan([r.pearson, r.spearman]).all() for r in got.values())
    assert np.isnan(evaluation.regression_metrics(errors).first().spearman)
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, 9.0), (7.0, None)], "a double, b double")
    assert pairs.agg(evaluation.correlation("a", "b").alias("r")).first().r == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1])
    assert pairs.where("a > 8").agg(evaluation.correlation("a", "b").alias("r")).first().r is None


def planted(spark, lift):
    """Two entities with four regions of equal prior; only region r0's national days lift labels, by `lift`."""
    rng = np.random.default_rng(7)
    days_, shares = [], []
    on = {c: sorted(set(rng.integers(9000, 10100, 60).tolist())) for c in ("r0", "r1", "r2", "r3")}
    for e, k in itertools.product((1, 2), range(9000, 10100)):
        days_.append((e, k, float(np.clip(40 * np.exp(lift * (k in on["r0"]) + rng.normal(0, 0.1)), 1, 100))))
    shares = [(c, k, 1.0, 0.0) for c, found in on.items() for k in found]
    frame = spark.createDataFrame(days_, "entity_id int, day int, label double").withColumn("date", F.date_from_unix_date("day"))
    markets = spark.createDataFrame([(e, c, 0.25) for e in (1, 2) for c in on], "entity_id int, code string, prior double")
    none = spark.createDataFrame([], "entity_id int, day int, rn int"), markets, spark.createDataFrame(shares, "code string, day int, national double, school double")
    got = fitting.market_weights(frame, *none, spark.createDataFrame([("r1", y) for y in range(1994, 1999)], "code string, year int"), draws=12).collect()
    return {(r.entity_id, r.code, r.type): r for r in got}


def test_planted_market_is_found_and_noise_keeps_the_prior(spark):
    got = planted(spark, 0.5)
    national = {c: got[1, c, "national"] for c in ("r0", "r1", "r2", "r3")}
    assert sum(r.weight for r in national.values()) == pytest.approx(1) and national["r0"].weight > 0.6 and national["r0"].rho > 0
    assert national["r0"].ci_low <= national["r0"].weight <= national["r0"].ci_high + 1e-9 and national["r0"].stability == 1 and national["r0"].n_obs > 50
    assert national["r0"].weight <= fitting.CAP_TIMES * 0.25 + fitting.CAP_FLOOR and national["r0"].r2 > 0.1 and national["r0"].agree_rank > 0.8
    assert all(r.prior_only and r.weight == (1.0 if r.code == "r1" else 0.0) for k, r in got.items() if k[2] == "school")
    quiet = planted(spark, 0.0)
    assert all(r.prior_only and r.weight == pytest.approx(0.25) and r.ci_low is None for k, r in quiet.items() if k[2] == "national")


def table_of(r2):
    return np.array([[r2(a, b) for b in fitting.BLENDS] for a in fitting.BLENDS])


def test_blends_need_a_gain(spark):
    flat, national, both = (lambda a, b: 0.1, lambda a, b: 0.1 + 0.2 * min(a, 0.5), lambda a, b: 0.1 + 0.25 * min(a, 0.8) + 0.1 * (b >= 0.25))
    small, school = lambda a, b: 0.1 + 0.001 * a, lambda a, b: 0.1 + 0.3 * (b > 0.3) - 0.1 * a
    want = [(0.0, 0.0), (0.5, 0.0), (0.75, 0.25), (0.0, 0.0), (0.0, 0.5)]
    for r2, pair in zip((flat, national, both, small, school), want):
        assert tuple(fitting.BLENDS[k] for k in fitting.blends_by_gain(table_of(r2))) == pair
    rng = np.random.default_rng(3)
    tables = [table_of(r2) for r2 in (flat, national, both, small, school)] + [rng.normal(0, 0.002 if k % 2 else 0.2, (4, 4)) for k in range(40)]
    rows = [(k, fitting.BLENDS[a], fitting.BLENDS[b], float(t[a, b])) for k, t in enumerate(tables) for a, b in np.ndindex(4, 4)]
    got = {r.entity_id: (r.national, r.school) for r in scores.blend_choice(spark.createDataFrame(rows, "entity_id int, national double, school double, r2 double")).collect()}
    assert got == {k: tuple(fitting.BLENDS[x] for x in fitting.blends_by_gain(t)) for k, t in enumerate(tables)}


def test_capped_blend_is_one_level(spark):
    """min(cap, level * mixed): sums to 1, no weight over its cap, all others in one proportion; table and array agree."""
    rng, rows, want = np.random.default_rng(5), [], {}
    for e in range(60):
        prior = rng.dirichlet(np.full(7, rng.choice([0.05, 0.5, 3])))
        fitted = rng.choice([0.0, 1.0], 7) * rng.exponential(1, 7) * (e % 6 != 0)
        w = fitting.mixture(fitted, prior, 0.75)
        want |= {(e, f"c{k}"): w[k] for k in range(7)}
        rows += [(e, f"c{k}", float(prior[k]), float(fitted[k]) if k or e % 2 else None if fitted[k] == 0 else float(fitted[k])) for k in range(7)]
        assert w.sum() == pytest.approx(1)
        if fitted.sum() > 0:
            mixed, cap = 0.25 * prior + 0.75 * fitted / fitted.sum(), fitting.CAP_TIMES * prior + fitting.CAP_FLOOR
            free = w < cap * (1 - 1e-9)
            assert (w <= cap * (1 + 1e-9)).all() and np.ptp(w[free] / mixed[free]) < 1e-9 and (w[~free] <= mixed[~free] * (w[free] / mixed[free]).max(initial=1) + 1e-9).all()
        else:
            assert w is prior
    got = scores.blend(spark.createDataFrame(rows, "entity_id int, code string, prior double, fitted double"), 0.75).collect()
    assert {(r.entity_id, r.code): r.weight for r in got} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    assert fitting.poured(np.array([0.5, 0.5]), np.array([0.1, 0.3])).tolist() == pytest.approx([0.25, 0.75])


def test_shifted_calendars_are_dealt_by_day_before_they_meet_markets(spark):
    """The join with markets multiplies rows, so these stay in the partition of their day; lists hold what they held."""
    markets = materialise(spark.createDataFrame([(e, f"c{k}", k) for e in (1, 2) for k in range(3)], "entity_id int, code string, idx int"))
    calendar = spark.createDataFrame([(f"c{k}", d, (d + k) % 3 / 2, d % 2 / 2) for k in range(3) for d in range(10)], "code string, day int, national double, school double")
    got = fitting.feature_days(markets, calendar, (0, 4))
    assert "hashpartitioning(entity_id" not in got._jdf.queryExecution().executedPlan().toString()
    held = {(r.entity_id, r.day, *f) for r in got.collect() for f in zip(r.f_shift, r.f_school, r.f_idx, r.f_x)}
    wanted = {(e, (d + s) % 10, i, kind, k, x) for e in (1, 2) for k in range(3) for d in range(10) for i, s in enumerate((0, 4)) for kind, x in enumerate(((d + k) % 3 / 2, d % 2 / 2)) if x}
    assert held == wanted


def test_gram_blocks_are_the_sums_of_dense_products(spark):
    """Controls, features and targets, by fold and month or year, against a dense matrix product; shifts move features alone."""
    rng = np.random.default_rng(9)
    days_ = [(1, 9000 + k, float(rng.integers(1, 100))) for k in range(0, 420, 2)]
    frame = spark.createDataFrame(days_, "entity_id int, day int, label double").withColumn("date", F.date_from_unix_date("day"))
    calendar = spark.createDataFrame([(c, int(d), float(rng.choice([0.3, 1.0])), float(rng.choice([0.0, 0.8]))) for c in ("a", "b") for d in sorted(set(rng.integers(9000, 9420, 90).tolist()))], "code string, day int, national double, school double")
    markets = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "entity_id int, code string, idx int")
    events = spark.createDataFrame([(1, 9000 + k, 1) for k in range(0, 200, 10)], "entity_id int, day int, rn int")
    rows, nc = fitting.sparse_days(frame.withColumn("use_school", F.col("day") % 4 == 0), events, (1994, 1995))
    sizes, features = spark.createDataFrame([(1, 2)], "entity_id int, k int"), fitting.feature_days(markets, calendar, (0, 5))
    held = calendar.collect()
    low, span = min(r.day for r in held), max(r.day for r in held) - min(r.day for r in held) + 1
    for by_month in (True, False):
        got = {(r.fold, r.month if by_month else r.month // 100, r.shift): r for r in fitting.gram_blocks(rows, features, sizes, nc, 2, by_month).collect()}
        for k, shift in enumerate((0, 5)):
            dense = {}
            for r in rows.collect():
                x = np.zeros(nc + 3 + 4)
                x[r.base_i] = r.base_x
                for c in held:
                    if low + (c.day - low + shift) % span == r.day:
                        i = nc + 3 + "ab".index(c.code)
                        x[i], x[i + 2] = c.national, c.school * r.use_school
                dense.setdefault((r.fold, r.month if by_month else r.month // 100), []).append(x)
            assert {key[:2] for key in got} == set(dense)
            for key, x in dense.items():
                gram = np.stack(x).T @ np.stack(x)
                assert np.array(got[*key, -1].sums) == pytest.approx(gram[: nc + 3, : nc + 3].ravel(), abs=1e-9)
                assert np.array(got[*key, k].sums) == pytest.approx(gram[nc + 3 :].ravel(), abs=1e-9)
                assert got[*key, k].intense == (np.stack(x)[:, nc + 3 :] > 0.5).sum(0).tolist()
    p = [0.0001, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.98, 0.99999]
    found = spark.createDataFrame([(x,) for x in p], "p double").select(fitting.normal_score(F.col("p")).alias("z")).collect()
    assert [r.z for r in found] == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-7)


def test_years_without_school_calendars_are_left_out(spark):
    """In one of three years no school calendar is known, and labels rise in it on the days that would be holidays."""
    rng, days_, shares = np.random.default_rng(1), [], []
    on = {y: [9131 + 365 * y + int(k) for k in rng.choice(365, 70, replace=False)] for y in range(3)}
    off = {9131 + 365 * 2 + int(k) for k in rng.choice(365, 120, replace=False)}
    for k in range(9131, 9131 + 1095):
        year = (k - 9131) // 365
        lift = 0.5 * (k in on[year]) if year < 2 else 1.5 * (k in off)
        days_.append((1, k, float(np.clip(30 * np.exp(lift + rng.normal(0, 0.1)), 1, 100))))
    shares = [("a", k, 0.0, 1.0) for y in (0, 1) for k in on[y]] + [("b", k, 0.0, 1.0) for y in (0, 1) for k in rng.choice(on[y], 20).tolist()]
    frame = spark.createDataFrame(days_, "entity_id int, day int, label double").withColumn("date", F.date_from_unix_date("day"))
    markets = spark.createDataFrame([(1, "a", 0.7), (1, "b", 0.3)], "entity_id int, code string, prior double")
    events = spark.createDataFrame([], "entity_id int, day int, rn int")
    calendar = spark.createDataFrame(shares, "code string, day int, national double, school double").groupBy("code", "day").agg(F.max("national").alias("national"), F.max("school").alias("school"))
    years = spark.createDataFrame([(c, y) for c in "ab" for y in (1995, 1996)], "code string, year int")
    got = {r.code: r for r in fitting.market_weights(frame, events, markets, calendar, years, draws=4).where("type = 'school'").collect()}
    assert got["a"].n_days == 731 and got["a"].effect == pytest.approx(0.5, abs=0.1) and got["a"].effect_low <= got["a"].effect <= got["a"].effect_high + 0.05
    assert fitting.covered_days(frame, markets, years.where("code = 'b'")).where("use_school").isEmpty()
    every = fitting.covered_days(frame, markets, years.limit(0))
    assert every.count() == 1095 and fitting.market_weights(frame.limit(0), events, markets, calendar, years).count() == 0


def test_the_real_calendar_stands_out_among_shifts_and_noise_does_not(spark):
    rng, days_ = np.random.default_rng(12), []
    on = sorted(rng.choice(np.arange(9000, 10000), 80, replace=False).tolist())
    for e in (1, 2, 3, 4):
        days_ += [(e, k, float(np.clip(40 * np.exp((0.4 if e < 3 else 0.0) * (k in on) + rng.normal(0, 0.2)), 1, 100))) for k in range(9000, 10000)]
    frame = spark.createDataFrame(days_, "entity_id int, day int, label double").withColumn("date", F.date_from_unix_date("day"))
    markets = spark.createDataFrame([(e, "a", 1.0) for e in (1, 2, 3, 4)], "entity_id int, code string, prior double")
    calendar = spark.createDataFrame([("a", k, 1.0, 0.0) for k in on], "code string, day int, national double, school double")
    none = spark.createDataFrame([], "code string, year int")
    got = {r.entity_id: r for r in fitting.placebo_ranks(frame, spark.createDataFrame([], "entity_id int, day int, rn int"), markets, calendar, none, tuple(range(31, 31 * 20, 31))).collect()}
    assert all(got[e].p_value == 0.05 and got[e].r2 > 0.1 > got[e].median_shifted for e in (1, 2)) and all(got[e].shifts == 19 for e in got)
    assert all(got[e].p_value > 0.05 for e in (3, 4))


def test_entity_means_hold_no_label_of_their_own_fold(spark):
    """A changed label changes the inputs of other folds' rows of its entity, and never its own row's (or fold's)."""
    rows = [(e, d, float(10 * e + d % 7)) for e in range(4) for d in range(60)]
    schema = "entity_id int, day int, label double"
    frame = spark.createDataFrame(rows, schema)
    later = spark.createDataFrame([(e, d, 1000.0 if (e, d) == (2, 30) else y) for e, d, y in rows], schema)
    a, b = ({(r.entity_id, r.day): (r.entity_mean, r.fold) for r in models.EntityMeans(x, {"mean": F.col("label")}).learned.withColumn("fold", F.pmod(F.xxhash64("day"), F.lit(5))).collect()} for x in (frame, later))
    own = a[2, 30][1]
    assert all((a[k] == b[k]) == (a[k][1] == own) for k in a if k[0] == 2) and a[2, 30] == b[2, 30]
    assert all(a[k] == b[k] for k in a if a[k][1] == own)
    for (e, d), (mean, fold) in a.items():
        rest = [y for e2, d2, y in rows if e2 == e and a[e2, d2][1] != fold]
        around = [y for e2, d2, y in rows if a[e2, d2][1] != fold]
        assert mean == pytest.approx((sum(rest) + 20 * sum(around) / len(around)) / (len(rest) + 20))
    means = models.EntityMeans(frame, {"mean": F.col("label"), "high": F.col("label") > 20})
    met = {r.entity_id: (r.entity_mean, r.entity_high) for r in means.known(spark.createDataFrame([(3,), (99,)], "entity_id int")).collect()}
    every = sum(y for *_, y in rows) / len(rows)
    assert met[99][0] == pytest.approx(every) and met[3][0] == pytest.approx((sum(y for e, _, y in rows if e == 3) + 20 * every) / 80) and met[3][1] > 0.8


def test_fits_pass_over_as_many_partitions_as_their_bytes_fill(spark, monkeypatch):
    """Two entities' rows are not read in 64 tasks on every pass because the shuffle before had 64 partitions."""
    seen, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df, *a: (seen.append(df.rdd.getNumPartitions()), fit(self, df, *a))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        models.GatedModel.fit(labelled_frame(spark), COLUMNS, HISTORY, 9440, iterations=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 2 and max(seen) <= 8


def test_twenty_thousand_entities_fit(spark):
    """Entities are numbers to the trees: no category limits them, and the level of each is learned."""
    frame = spark.range(100_000).selectExpr("cast(id % 20000 as int) as entity_id", "cast(id div 20000 as int) as day", "cast((id % 20000) % 90 + (id div 20000) as double) as label", "cast(id % 7 as int) as dow", "date_add(date'1995-01-01', cast(id div 20000 as int)) as date")
    got = models.forest(frame.where("day < 4"), frame.where("day = 4"), ["dow"])
    r = got.agg(F.corr("label", "prediction").alias("r"), F.count(F.lit(1)).alias("n")).first()
    assert r.n == 20_000 and r.r > 0.6
