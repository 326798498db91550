"""Models on tables with MLlib: gated regression, status, closing category, back-tests and replays."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import drop_table, materialise, together
from .evaluation import error_by, global_mean, group_mean, history_gate
from .frames import SUM_ERROR
from .linear import EntityRidge

MISSING = -999.0


def training_blanks(df: DataFrame) -> DataFrame:
    """Adds lag (as if made 0, 1, 7 or 14 days ahead) and no_weather (a quarter of the rows) by arithmetic on the key."""
    h = (F.col("entity_id") * 7919 + F.col("day") * 104_729) % 1_000_003
    return df.withColumns({"lag": F.element_at(F.array(*map(F.lit, (0, 1, 7, 14))), (h % 4 + 1).cast("int")), "no_weather": h % 16 < 4})


def as_of(df: DataFrame, lag: Column | int | None, horizons: tuple[int, ...] = (1, 7, 14)) -> DataFrame:
    """Drift columns as they are known `lag` days before: drift<h> stays where h >= lag; without a lag none stays.

    A lag of 0 or null stands for no recent labels.
    """
    known = F.lit(0) if lag is None else lag if isinstance(lag, Column) else F.lit(lag)
    return df.withColumns({f"drift{h}": F.when((known > 0) & (known <= h), F.col(f"drift{h}")) for h in horizons if f"drift{h}" in df.columns})


def blanked(df: DataFrame, weather: list[str]) -> DataFrame:
    """Training rows as predictions will find them: labels known up to a drawn lag, weather missing in a quarter of the rows."""
    out = as_of(training_blanks(df), F.col("lag"))
    return out.withColumns({c: F.when(~F.col("no_weather"), F.col(c)) for c in weather}).drop("lag", "no_weather")


def backfill_schedule(labels: DataFrame, first: int, last: int, leads: tuple[int, ...] = (1, 7, 14, 30), refit: int = 90) -> DataFrame:
    """What each back-dated prediction may know: day made, label lag, archived weather lead, and the refit it uses."""
    out = labels.withColumn("lead", F.explode(F.array(*map(F.lit, leads)))).withColumn("made_day", F.col("day") - F.col("lead")).where(F.col("made_day").between(first, last))
    weather = F.when(F.col("lead") <= 3, F.col("lead") - 1).when(F.col("lead") <= 16, F.col("lead") - 7)
    return out.withColumns({"lag": F.col("lead") + 1, "weather_lead": weather, "refit_day": first + F.floor((F.col("made_day") - first) / refit).cast("int") * refit})


def prepared(df: DataFrame, columns: list[str], missing: float = MISSING) -> DataFrame:
    """Missing values as a constant, with a column that tells."""
    return df.withColumns({**{f"{c}_v": F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in columns}, **{f"{c}_gone": F.col(c).isNull().cast("double") for c in columns}})


class EntityMeans:
    """Entities as numbers: each target's mean over an entity's training rows, drawn to the mean of all by SHRINK rows.

    However many entities there are, a tree splits them like any other number. learned: the training rows with the means
    out of fold, so that no row's own label (nor those of its fold's days) is in its inputs. A new entity has the mean of
    all. table: one row an entity.
    """

    FOLDS, SHRINK = 5, 20.0

    def __init__(self, train: DataFrame, targets: dict[str, Column]):
        self.names = [f"entity_{name}" for name in targets]
        entity = Window.partitionBy("entity_id")
        rows = train.withColumns({"_fold": F.pmod(F.xxhash64("day"), F.lit(self.FOLDS)), **{f"_{c}": t.cast("double") for c, t in zip(self.names, targets.values())}})
        sums = [x for c in self.names for x in (F.sum(f"_{c}").alias(f"_s{c}"), F.count(f"_{c}").alias(f"_n{c}"))]
        found = {r["_fold"]: r for r in rows.groupBy("_fold").agg(*sums).collect()}  # FOLDS rows

        def mean(name: str, without: int | None = None) -> float:
            kept = [r for k, r in found.items() if k != without]
            return float(sum(r[f"_s{name}"] or 0 for r in kept) / max(1, sum(r[f"_n{name}"] for r in kept)))

        self.means = {c: mean(c) for c in self.names}
        learned, known = {}, {}
        for c in self.names:
            around = F.element_at(F.array(*[F.lit(mean(c, k)) for k in range(self.FOLDS)]), (F.col("_fold") + 1).cast("int"))
            rest = [f(f"_{c}").over(entity) - F.coalesce(f(f"_{c}").over(Window.partitionBy("entity_id", "_fold")), F.lit(0)) for f in (F.sum, F.count)]
            learned[c] = (F.coalesce(rest[0], F.lit(0.0)) + self.SHRINK * around) / (rest[1] + self.SHRINK)
            known[c] = (F.coalesce(F.sum(f"_{c}"), F.lit(0.0)) + self.SHRINK * self.means[c]) / (F.count(f"_{c}") + self.SHRINK)
        self.learned = rows.withColumns(learned).drop("_fold", *[f"_{c}" for c in self.names])
        self.table = rows.groupBy("entity_id").agg(*[v.alias(c) for c, v in known.items()])

    def known(self, rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """rows with their entities' means, by one join; more: another table by entity_id, joined beforehand."""
        table = self.table if more is None else self.table.join(more, "entity_id", "full_outer")
        return rows.join(table, "entity_id", "left").fillna(self.means)


def _inputs(columns: list[str], entity: tuple[str, ...] = ()) -> list[str]:
    return [x for c in columns for x in (f"{c}_v", f"{c}_gone")] + list(entity)


def tree_pipeline(estimator, columns: list[str], entity: tuple[str, ...] = ()) -> Pipeline:
    """entity: numbers that stand for the entity, without missing values."""
    return Pipeline(stages=[VectorAssembler(inputCols=_inputs(columns, entity), outputCol="inputs"), estimator])


def fit_on(rows: DataFrame, *pipelines: Pipeline) -> list[PipelineModel]:
    """Models of the same rows, which are written once: trees pass over them some 40 times a fit, and read back they lie in as
    many partitions as their bytes fill, not in one for each partition of the shuffle that made the entities' means. The
    models don't know of each other, and are fitted side by side."""
    held = materialise(rows)
    found = together(rows.sparkSession, [partial(p.fit, held) for p in pipelines])
    drop_table(held)
    return found


def _named(df: DataFrame, columns: list[str], blank: tuple[str, ...] = (), missing: float = MISSING) -> DataFrame:
    """Model inputs beside the row's own columns; columns in blank count as missing."""
    out = prepared(df, columns, missing)
    return out.withColumns({f"{c}_v": F.lit(MISSING) for c in blank} | {f"{c}_gone": F.lit(1.0) for c in blank})


def _score(model: PipelineModel, df: DataFrame, columns: list[str], out: str, blank: tuple[str, ...] = (), value: Column | None = None) -> DataFrame:
    """df with the model's prediction (or another expression on its output) as one more column; rows stay where they are."""
    found = model.transform(_named(df, columns, blank))
    return found.select(*df.columns, (F.col("prediction") if value is None else value).alias(out))


def learned_by(estimator, means: EntityMeans, columns: list[str], identity: bool = True) -> PipelineModel:
    """Trees fitted on the rows that means were made of, with these or without them."""
    entity = tuple(means.names) if identity else ()
    return fit_on(_named(means.learned, columns).select(estimator.getLabelCol(), *_inputs(columns, entity)), tree_pipeline(estimator, columns, entity))[0]


class GatedModel:
    """An entity's own model where it has enough history, else one without identity and history columns."""

    def __init__(self, full: PipelineModel, fallback: PipelineModel, gate: DataFrame, columns: list[str], means: EntityMeans):
        self.full, self.fallback, self.gate, self.columns, self.means = full, fallback, gate, columns, means
        self.drifts = tuple(c for c in columns if c.startswith("drift"))

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str], history: list[str], cutoff_day: int, weather: tuple[str, ...] = (), excluded: str | None = None, iterations: int = 8, least_years: float = 1.0) -> GatedModel:
        """Fitted on blanked() rows up to the cutoff, without those that the column `excluded` marks; these count as history."""
        upto = train.where(F.col("day") <= cutoff_day)
        learned = upto.where(~F.coalesce(F.col(excluded).cast("boolean"), F.lit(False))) if excluded else upto
        means = EntityMeans(learned, {"mean": F.col("label")})
        rows = _named(blanked(means.learned, [c for c in weather if c in columns]), columns)

        def trees() -> GBTRegressor:
            return GBTRegressor(featuresCol="inputs", labelCol="label", maxIter=iterations, maxDepth=5, stepSize=0.3, maxBins=64, seed=3)

        full, fallback = fit_on(rows.select("label", *_inputs(columns, tuple(means.names))), tree_pipeline(trees(), columns, tuple(means.names)), tree_pipeline(trees(), [c for c in columns if c not in history]))
        return cls(full, fallback, history_gate(train, cutoff_day, least_years), columns, means)

    def score(self, rows: DataFrame, lags: dict[str, Column | int | None]) -> DataFrame:
        """rows with the fallback's prediction, one of the full model for each named lag, and gated; no row moves but to meet its gate."""
        met = self.means.known(rows, self.gate.select("entity_id", "gated")).withColumn("gated", F.coalesce("gated", F.lit(False)))
        out = _score(self.fallback, met, self.columns, "fallback")
        for name, lag in lags.items():
            if lag is None:
                out = _score(self.full, out, self.columns, name, self.drifts)
            else:
                held = {d: F.col(d) for d in self.drifts}
                known = as_of(out.withColumns({f"_{d}": c for d, c in held.items()}), lag)
                scored = _score(self.full, known, self.columns, name)
                out = scored.withColumns({d: F.col(f"_{d}") for d in self.drifts}).drop(*[f"_{d}" for d in self.drifts])
        return out.drop(*self.means.names)

    def predict(self, rows: DataFrame, lag: Column | int | None = 1) -> DataFrame:
        """entity_id, day, label, prediction (0-100, one digit), low_confidence and drift_effect (with drift minus without).

        lag: labels are known so many days before a row (one number or a column), or None for no recent labels.
        """
        out = self.score(rows, {"main": lag, "long": None})
        value = clipped(F.when(F.col("gated"), F.col("main")).otherwise(F.col("fallback")))
        rest = [c for c in ("made_day", "lead") if c in rows.columns]
        return out.select("entity_id", "day", "label", *rest, (F.floor(value * 10 + 0.5) / 10).alias("prediction"), (~F.col("gated")).alias("low_confidence"), F.when(F.col("gated"), F.col("main") - F.col("long")).alias("drift_effect"))

    def raw(self, rows: DataFrame, which: str = "full", lag: Column | int | None = 1) -> DataFrame:
        """Predictions of one of the two models (full or fallback) for all rows, without gate or clip."""
        return self.score(rows, {"full": lag}).select("entity_id", "day", "label", F.col(which).alias("prediction"))

    def importance(self) -> list[tuple[str, float]]:
        """Share of each input of the full model, largest first."""
        weights = self.full.stages[-1].featureImportances.toArray()
        return sorted(zip(_inputs(self.columns, tuple(self.means.names)), map(float, weights)), key=lambda x: -x[1])


def clipped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def backtest(model: GatedModel, rows: DataFrame, lags: tuple[int, ...] = (1, 7, 14)) -> DataFrame:
    """Error by horizon (gated entities) and by group: section, name, n, mae, rmse and bias. One scoring pass, one aggregation.

    Horizons: no recent labels, and labels known up to each lag. Groups: the gated system, the full model for all, and
    for gated and for other entities what was used, what the other model gives, and for the others a constant 50.
    """
    scored = model.score(rows, {"long": None} | {f"lag{k}": k for k in lags})
    gated, full, rest = F.col("gated"), clipped(F.col("long")), clipped(F.col("fallback"))
    cases = [("horizon", "no recent labels", full, gated)] + [("horizon", f"labels up to {k} days before", clipped(F.col(f"lag{k}")), gated) for k in lags]
    cases += [("all entities", "gated system", F.when(gated, full).otherwise(rest), F.lit(True)), ("all entities", "full model", full, F.lit(True))]
    cases += [("gated", "full model (used)", full, gated), ("gated", "fallback", rest, gated)]
    cases += [("not gated", "fallback (used)", rest, ~gated), ("not gated", "full model", full, ~gated), ("not gated", "constant 50", F.lit(50.0), ~gated)]
    each = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), p.alias("prediction"), k.alias("counts")) for s, n, p, k in cases])
    return error_by(scored.select("label", F.explode(each).alias("c")).select("label", "c.*").where("counts"), ["section", "name"])


def weather_of_lead(rows: DataFrame, archived: DataFrame | None, weather: list[str], horizon: int = 16) -> DataFrame:
    """Rows (with lead) with the weather that was forecast so long before.

    archived: entity_id, day, weather_lead (0 for leads up to 3, else from 7 days before) and the weather columns; all of
    them replace a row's own where all are there. Beyond the horizon there is none.
    """
    if archived is not None:
        wanted = F.when(F.col("lead") <= 3, 1).otherwise(7)
        named = archived.select("entity_id", "day", F.col("weather_lead").alias("_lead"), *[F.col(c).alias(f"_{c}") for c in weather])
        rows = rows.withColumn("_lead", wanted).join(named, ["entity_id", "day", "_lead"], "left")
        there = reduce(lambda a, b: a & b, [F.col(f"_{c}").isNotNull() for c in weather])
        rows = rows.withColumns({c: F.when(there, F.col(f"_{c}")).otherwise(F.col(c)) for c in weather}).drop("_lead", *[f"_{c}" for c in weather])
    return rows.withColumns({c: F.when(F.col("lead") <= horizon, F.col(c)) for c in weather})


def replay(frame: DataFrame, first: int, last: int, columns: list[str], history: list[str], weather: list[str], archived: DataFrame | None = None, leads: tuple[int, ...] = (1, 7, 14, 30), refit: int = 90, **options) -> DataFrame:
    """Back-dated predictions made on days first to last, as log rows: made_day, entity_id, day, lead_days, prediction, source.

    A model is fitted every `refit` days on labels up to the day before; it predicts for all days made until the next fit,
    with labels known lead + 1 days before the day predicted. One fit and one plan a refit, whatever the rows; refits run
    side by side, a few at a time.
    """
    frame = frame.cache()  # every refit reads it
    made = frame.withColumn("lead", F.explode(F.array(*map(F.lit, leads)))).withColumn("made_day", F.col("day") - F.col("lead"))

    def predicted(start: int) -> DataFrame:
        model = GatedModel.fit(frame, columns, history, start - 1, tuple(weather), **options)
        rows = made.where(F.col("made_day").between(start, min(last, start + refit - 1)))
        found = model.predict(weather_of_lead(rows, archived, weather), F.col("lead") + 1)
        return found.select("made_day", "entity_id", "day", F.col("lead").alias("lead_days"), "prediction", "low_confidence", F.lit("backtest").alias("source"))

    return reduce(DataFrame.unionByName, together(frame.sparkSession, [partial(predicted, start) for start in range(first, last + 1, refit)]))


def forest(train: DataFrame, rows: DataFrame, columns: list[str], depth: int = 7) -> DataFrame:
    estimator = RandomForestRegressor(featuresCol="inputs", labelCol="label", numTrees=12, maxDepth=depth, maxBins=64, seed=3)
    means = EntityMeans(train, {"mean": F.col("label")})
    return learned_by(estimator, means, columns).transform(_named(means.known(rows), columns)).select("entity_id", "day", "label", "prediction")


def ablation(train: DataFrame, rows: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Error of the forest on the same rows by set of columns; one fit for each of the few sets."""
    found = [forest(train, rows, columns).withColumn("features", F.lit(name)) for name, columns in sets.items()]
    return error_by(reduce(DataFrame.unionByName, found), ["features"])


def yearly_backtest(rows: DataFrame, columns: list[str], years: list[int]) -> DataFrame:
    """Predictions of whole years, each by a model that was fitted on all days before it."""
    year = F.year("date")
    found = [forest(rows.where(year < y), rows.where(year == y), columns).withColumn("year", F.lit(y)) for y in years]
    return reduce(DataFrame.unionByName, found)


def ridge(train: DataFrame, rows: DataFrame, columns: list[str], penalty: float = 10.0, holiday: str | tuple[str, ...] | None = None, above: float = 0.2) -> DataFrame:
    """Ridge regression on numbers and on dummies of entity, weekday, month, entity x weekday, entity x month and, given score columns, entity x holiday of each.

    The penalty stands beside the sum of squared errors. Numbers are scaled, dummies are not.
    """
    shared = {"_dow": 7, "_month": 12}
    scores = [holiday] if isinstance(holiday, str) else list(holiday or ())
    flags = {f"_holiday{k}": (F.coalesce(c, F.lit(0.0)) > above + SUM_ERROR).cast("int") for k, c in enumerate(scores)}
    ready = lambda df: _named(df, columns, missing=0.0).withColumns({"_dow": F.weekday("date"), "_month": F.month("date") - 1, **flags})
    model = EntityRidge(ready(train), _inputs(columns), shared, shared | dict.fromkeys(flags, 2), penalty)
    return model.predict(ready(rows)).select("entity_id", "day", "label", "prediction")


def compare(rows: DataFrame, columns: list[str], depths: tuple[int, ...] = (5, 7), penalties: tuple[float, ...] = (1.0, 10.0, 100.0), holiday: str | tuple[str, ...] | None = None) -> DataFrame:
    """Test error of forest, ridge and their mean; rows: split (train, valid, test).

    Depth and penalty are those with the least error on the validation rows after fitting on the training rows; then both
    models are fitted on both. The grid is a handful of fits, each distributed.
    """
    rows = rows.cache()  # every fit and every error reads it
    train, valid, test = (rows.where(F.col("split") == x).drop("split") for x in ("train", "valid", "test"))

    def error(found: DataFrame) -> float:
        return found.agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]

    depth = min(depths, key=lambda k: error(forest(train, valid, columns, k)))
    penalty = min(penalties, key=lambda x: error(ridge(train, valid, columns, x, holiday)))
    known = train.unionByName(valid)
    pair = forest(known, test, columns, depth).join(ridge(known, test, columns, penalty, holiday).select("entity_id", "day", F.col("prediction").alias("ridge")), ["entity_id", "day"])
    cases = ((f"forest, depth {depth}", F.col("prediction")), (f"ridge, penalty {penalty:g}", F.col("ridge")), ("mean", (F.col("prediction") + F.col("ridge")) / 2))
    named = F.array(*[F.struct(F.lit(n).alias("model"), v.alias("prediction")) for n, v in cases])
    return error_by(pair.select("label", F.explode(named).alias("m")).select("label", "m.*"), ["model"])


def boosted(train: DataFrame, rows: DataFrame, columns: list[str], out: str, identity: bool = True, iterations: int = 8) -> DataFrame:
    """rows with one more column: boosted trees on these columns, with or without the entity's mean."""
    means = EntityMeans(train, {"mean": F.col("label")})
    entity = tuple(means.names) if identity else ()
    trees = GBTRegressor(featuresCol="inputs", labelCol="label", maxIter=iterations, maxDepth=5, stepSize=0.3, maxBins=64, seed=3)
    model = learned_by(trees, means, columns, identity)
    return _score(model, means.known(rows) if identity else rows, columns, out).drop(*entity)


def with_baselines(train: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (entity_id, dow, month, py364) with the means of all, of the entity, by weekday, by weekday and month, and last year's day."""
    out = global_mean(train, rows).withColumnRenamed("prediction", "global mean")
    for name, keys in (("entity mean", []), ("entity x weekday mean", ["dow"]), ("entity x weekday x month mean", ["dow", "month"])):
        out = group_mean(train, out, keys).withColumnRenamed("prediction", name)
    return out.withColumn("same weekday last year", F.coalesce("py364", "entity x weekday mean"))


def compare_all(rows: DataFrame, columns: list[str], history: list[str], holidays: list[str], holiday: str | tuple[str, ...], excluded: str | None = None, depth: int = 7, penalty: float = 10.0, iterations: int = 8) -> DataFrame:
    """Error of baselines, linear model, trees and their variants, on validation and on test rows: split, model, n, mae, rmse, bias, r2.

    rows: split (train, valid, test). For validation all are fitted on the training rows, for test on both. Models that
    learn leave out rows that the column `excluded` marks; baselines don't. Variants of the boosted trees: without last
    year, with it, without identity, without holidays. All predictions of a split stand on one row, so each has its rows.
    """
    rows, found = rows.cache(), []  # every fit and score reads it
    plain = [c for c in columns if c not in history]
    for name, known in (("valid", ["train"]), ("test", ["train", "valid"])):
        seen, asked = rows.where(F.col("split").isin(*known)).drop("split"), rows.where(F.col("split") == name).drop("split")
        learned = seen.where(~F.coalesce(F.col(excluded).cast("boolean"), F.lit(False))) if excluded else seen
        out = with_baselines(seen, asked)
        for label, used, identity in (("boosted, no last year", plain, True), ("boosted", columns, True), ("boosted, no identity", plain, False), ("boosted, no holidays", [c for c in columns if c not in holidays], True)):
            out = boosted(learned, out, used, label, identity, iterations)
        for label, table in (("forest", forest(learned, asked, columns, depth)), ("ridge", ridge(learned, asked, columns, penalty, holiday))):
            out = out.join(table.select("entity_id", "day", F.col("prediction").alias(label)), ["entity_id", "day"])
        models = [c for c in out.columns if c not in asked.columns]
        each = [(c, F.col(c)) for c in models] + [("mean of forest and boosted", (F.col("forest") + F.col("boosted")) / 2)]
        cases = F.array(*[F.struct(F.lit(c).alias("model"), clipped(v).alias("prediction")) for c, v in each])
        found.append(out.select("label", F.explode(cases).alias("m")).select(F.lit(name).alias("split"), "label", "m.*"))
    gap, label = F.col("prediction") - F.col("label"), F.col("label")
    r2 = 1 - F.sum(gap * gap) / (F.sum(label * label) - F.sum(label) * F.sum(label) / F.count(F.lit(1)))
    return found[0].unionByName(found[1]).groupBy("split", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("bias"), r2.alias("r2"))


def status_model(frame: DataFrame, rows: DataFrame, columns: list[str], iterations: int = 5) -> DataFrame:
    """Chance to be open, and opening and closing minutes on a half-hour grid, learned from open rows."""
    trees = {"maxIter": iterations, "maxBins": 64, "seed": 3, "featuresCol": "inputs"}
    def fitted(estimator, known: DataFrame, target: str) -> tuple[PipelineModel, EntityMeans]:
        means = EntityMeans(known, {"mean": F.col(target)})
        return learned_by(estimator, means, columns), means

    minutes = ("open_min", "close_min")
    fits = [partial(fitted, GBTClassifier(labelCol="is_open", **trees), frame.where("is_open is not null"), "is_open")]
    fits += [partial(fitted, GBTRegressor(labelCol=x, **trees), frame.where(f"is_open = 1 and {x} is not null"), x) for x in minutes]
    (model, means), *others = together(frame.sparkSession, fits)
    out = _score(model, means.known(rows.select("entity_id", "day", *columns)), columns, "open_chance", value=vector_to_array("probability")[1]).drop(*means.names)
    for target, (model, means) in zip(minutes, others):
        out = _score(model, means.known(out), columns, target, value=F.bround(F.col("prediction") / 30) * 30).drop(*means.names)
    return out.select("entity_id", "day", "open_chance", "open_min", "close_min")


def closing_category(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Most likely closing category of each row."""
    index = StringIndexer(inputCol="category", outputCol="target", handleInvalid="keep").fit(train)
    estimator = RandomForestClassifier(featuresCol="inputs", labelCol="target", numTrees=10, maxDepth=6, maxBins=64, seed=3)
    means = EntityMeans(index.transform(train), {f"share{k}": F.col("target") == k for k in range(len(index.labels))})
    model = learned_by(estimator, means, columns)
    names = F.array(*[F.lit(x) for x in index.labels])
    return model.transform(_named(means.known(rows), columns)).select("entity_id", "day", F.get(names, F.col("prediction").cast("int")).alias("category"))
