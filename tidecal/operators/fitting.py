"""Market weights from data: how much each region's holidays lift an entity, beside its controls.

Spark builds sparse entity-days (controls, targets, holiday features of the entity's regions) and gathers them by entity and
year, a bounded group, where they become one matrix; its products are summed by fold and month. Everything after that is
linear in these Gram matrices, so each entity is solved from its own: residuals after the controls, blocks of days left
out by subtraction, months drawn for intervals. Shifts of the holiday calendar are further features of the same days; they
share the products of controls and targets, and give the distribution of the gain under calendars that mean nothing.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import season_edges
from .scores import BLENDS, CAP_FLOOR, CAP_TIMES, GAIN_PART, LEAST_GAIN, LEAST_WEIGHT, MANY_ROWS, SOME_ROWS, YEAR_ROWS, coverage_mass

#: Days an entity needs; covered share of its school prior for a day to count, and such days for school
#: weights at all; folds of time; months drawn; the penalties' powers of ten around the features' mean square.
LEAST_ROWS, SCHOOL_MASS, SCHOOL_ROWS, FOLDS, DRAWS = 120, 0.6, 150, 6, 40
PENALTIES = tuple(10 ** (-3 + 0.5 * k) for k in range(10))
#: Most control events of an entity, and targets: logarithm of the label, label, and its rank as a normal score.
EVENTS, TARGETS = 12, 3
WEIGHTS = "entity_id int, code string, type string, weight double, ci_low double, ci_high double, stability double, n_obs long, prior_only boolean, rho double, r2 double, r2_prior double, penalty double, agree_raw double, agree_rank double, effect double, effect_low double, effect_high double, std_effect double, n_days long, reason string"
WEIGHTS_COLUMNS = [x.split()[0] for x in WEIGHTS.split(", ")]


def polynomial(x: Column, *factors: float) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + f
    return out


def normal_score(p: Column) -> Column:
    """Inverse of the normal distribution, by a rational approximation in three ranges (relative error about 1e-9)."""
    # Fixed: Acklam's published coefficients.
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
    q, low, high = p - 0.5, F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    tail = lambda x: polynomial(x, *c) / polynomial(x, *d)
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(q * polynomial(q * q, *a) / polynomial(q * q, *b))


def covered_days(days: DataFrame, markets: DataFrame, school_years: DataFrame) -> DataFrame:
    """days with use_school; where an entity has SCHOOL_ROWS days whose year's school calendars cover SCHOOL_MASS of its prior, only those.

    markets: entity_id, code, prior; school_years: code, year of the school calendars there are.
    """
    share = coverage_mass(markets, school_years.select("code", "year").distinct().withColumn("covered", F.lit(1.0)), "code").withColumnRenamed("mass", "_mass")
    marked = days.withColumn("year", F.year("date")).join(share, ["entity_id", "year"], "left").withColumn("_ok", F.coalesce(F.col("_mass"), F.lit(0.0)) >= SCHOOL_MASS)
    out = marked.withColumn("use_school", F.sum(F.col("_ok").cast("int")).over(Window.partitionBy("entity_id")) >= SCHOOL_ROWS)
    return out.where("_ok or not use_school").drop("year", "_mass", "_ok")


def sparse_days(days: DataFrame, events: DataFrame, years: tuple[int, int]) -> tuple[DataFrame, int]:
    """(entity_id, day, fold, month, use_school and the non-zero controls and targets: base_i, base_x), and the number of controls.

    Controls are a constant, weekdays, waves, season edges, years (first to last of all days) and up to 12 event flags
    (events: entity_id, day, rn); targets follow them.
    """
    entity = Window.partitionBy("entity_id")
    rank = F.rank().over(entity.orderBy("label")) + (F.count(F.lit(1)).over(Window.partitionBy("entity_id", "label")) - 1) / 2
    out = season_edges(days).withColumns({"n_rows": F.count(F.lit(1)).over(entity), "fold": F.ntile(FOLDS).over(entity.orderBy("day")), "rank": rank})
    waves = F.when(F.col("n_rows") >= MANY_ROWS, 8).when(F.col("n_rows") >= SOME_ROWS, 4).otherwise(2)
    angle = 2 * F.pi() * F.dayofyear("date") / 365.25
    flags = events.groupBy("entity_id", "day").agg(F.collect_set("rn").alias("events"))
    out = out.join(flags, ["entity_id", "day"], "left")
    columns = [F.lit(1.0)] + [(F.weekday("date") == k) for k in range(1, 7)] + [F.col("season_start"), F.col("season_end")]
    columns += [F.when(waves >= k, f(k * angle)).otherwise(0.0) for k in range(1, 9) for f in (F.sin, F.cos)]
    columns += [(F.year("date") == y) & (F.col("n_rows") >= YEAR_ROWS) for y in range(years[0] + 1, years[1] + 1)]
    columns += [F.coalesce(F.array_contains("events", F.lit(k)), F.lit(False)) for k in range(1, EVENTS + 1)]
    targets = [F.log(F.greatest("label", F.lit(1.0))), F.col("label") / 100, normal_score((F.col("rank") - 0.5) / F.col("n_rows"))]
    dense = F.array(*[c.cast("double") for c in columns + targets])
    base = F.filter(F.transform(dense, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda v: v["x"] != 0)
    return out.select("entity_id", "day", "fold", (F.year("date") * 100 + F.month("date")).alias("month"), "use_school", base["i"].alias("base_i"), base["x"].alias("base_x")), len(columns)


def feature_days(markets: DataFrame, calendar: DataFrame, shifts: tuple[int, ...]) -> DataFrame:
    """entity_id, day, and the non-zero features of the entity's regions on it: f_shift, f_school, f_idx, f_x.

    markets: entity_id, code, idx. A shift moves the calendar around its own span; f_shift counts them from 0.
    """
    span = calendar.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    low, length = span.a or 0, (span.b or 0) - (span.a or 0) + 1
    moved = calendar.select("code", "day", F.posexplode(F.array(*map(F.lit, shifts))).alias("k", "shift"), "national", "school")
    moved = moved.withColumn("day", (F.lit(low) + F.pmod(F.col("day") - low + F.col("shift"), F.lit(length))).cast(calendar.schema["day"].dataType))
    # Dealt by day before the join with markets multiplies the rows: few files hold a calendar, and its lists then stay where they are.
    moved = moved.repartition(int(calendar.sparkSession.conf.get("spark.sql.shuffle.partitions")), "day")
    kinds = F.array(*[F.struct(F.lit(k).alias("school"), F.col(c).cast("double").alias("x")) for k, c in enumerate(("national", "school"))])
    long = markets.select("entity_id", "code", "idx").join(moved, "code").select("entity_id", "day", "k", "idx", F.explode(kinds).alias("f")).where("f.x <> 0")
    lists = long.groupBy("entity_id", "day").agg(F.collect_list(F.struct("k", "f.school", "idx", "f.x")).alias("f"))
    return lists.select("entity_id", "day", *[F.col(f"f.{c}").alias(f"f_{n}") for c, n in (("k", "shift"), ("school", "school"), ("idx", "idx"), ("x", "x"))])


GRAMS = "entity_id int, shift int, fold int, month int, intense array<long>, sums array<double>"
#: The shift of sums that don't depend on the calendar.
ANY_SHIFT = -1


def gram_blocks(rows: DataFrame, features: DataFrame, sizes: DataFrame, n_controls: int, shifts: int = 1, by_month: bool = True) -> DataFrame:
    """GRAMS: by entity, fold and month (or fold and year), products of controls and targets (shift -1), and for each shift those
    of its features with controls, targets and features; intense counts the days on which a feature is over one half.

    sizes: entity_id and k, its regions. A group is an entity's year: 366 rows at most.
    """
    width = n_controls + TARGETS

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n, k = len(frame), int(frame["k"].iloc[0])

        def flat(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
            lists = [np.asarray(x if x is not None else (), dtype=kind) for x in frame[name]]
            return np.repeat(np.arange(n), [len(x) for x in lists]), np.concatenate(lists)

        base, held = np.zeros((n, width)), np.zeros((shifts, n, 2 * k))
        at, i = flat("base_i", np.int64)
        base[at, i] = flat("base_x", np.float64)[1]
        at, shift = flat("f_shift", np.int64)
        school, idx, x = flat("f_school", np.int64)[1], flat("f_idx", np.int64)[1], flat("f_x", np.float64)[1]
        used = (school == 0) | frame["use_school"].to_numpy()[at]
        held[shift[used], at[used], (school * k + idx)[used]] = x[used]
        entity, out = frame["entity_id"].iloc[0], []
        blocks = frame["fold"].to_numpy() * 1_000_000 + frame["month"].to_numpy() * by_month
        for block in np.unique(blocks):
            own = blocks == block
            fold, month = int(block // 1_000_000), int(block % 1_000_000) or int(frame["month"].iloc[0])
            out.append((entity, ANY_SHIFT, fold, month, None, (base[own].T @ base[own]).ravel()))
            out += [(entity, s, fold, month, (f[own] > 0.5).sum(0), (f[own].T @ np.hstack([base[own], f[own]])).ravel()) for s, f in enumerate(held)]
        return pd.DataFrame(out, columns=["entity_id", "shift", "fold", "month", "intense", "sums"])

    met = rows.join(features, ["entity_id", "day"], "left").join(sizes, "entity_id").withColumn("year", F.floor(F.col("month") / 100))
    return met.groupBy("entity_id", "year").applyInPandas(run, GRAMS)


def nonnegative(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 with the least x'ax - 2b'x, by coordinate descent; a is a Gram matrix."""
    x, slope, size = np.zeros(len(b)), -b.astype(float), np.maximum(np.diag(a), 1e-12)
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(b)):
            to = max(0.0, x[k] - slope[k] / size[k])
            if to != x[k]:
                slope = slope + a[:, k] * (to - x[k])
                moved, x[k] = max(moved, abs(to - x[k])), to
        if moved < 1e-9:
            break
    return x


def poured(mixed: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """min(cap, level * mixed) for the level at which the weights sum to 1: capping and rescaling until nothing changes.

    The least ratios of cap to weight are capped first; the level that the others then need is final once it keeps them
    below their caps. Caps that sum to less than 1 are taken as shares.
    """
    if caps.sum() <= 1:
        return caps / caps.sum()
    order = np.argsort(np.divide(caps, mixed, out=np.full(len(caps), np.inf), where=mixed > 0), kind="stable")
    w, c = mixed[order], caps[order]
    left, rest = 1 - np.concatenate([[0.0], np.cumsum(c)[:-1]]), np.cumsum(w[::-1])[::-1]
    levels = np.divide(left, rest, out=np.full(len(w), np.inf), where=rest > 0)
    fits = (w > 0) & (np.where(w > 0, levels, 0) * w <= c * (1 + 1e-12))
    level = levels[np.argmax(fits)] if fits.any() else 1 / mixed.sum()
    return np.minimum(caps, level * mixed)


def mixture(fitted: np.ndarray, prior: np.ndarray, rho: float) -> np.ndarray:
    """Weights with a part rho from the fit (scaled to 1) and the rest from the prior, none over its cap; the prior without a fit."""
    total = float(fitted.sum())
    return poured(prior + rho * (fitted / total - prior), CAP_TIMES * prior + CAP_FLOOR) if total > 1e-9 else prior


def first_keeping(gains: np.ndarray) -> int:
    """The first blend that keeps most of the best gain over the prior, which stands first; 0 where the best is small."""
    return int(np.argmax(gains >= GAIN_PART * gains.max())) if gains.max() > LEAST_GAIN / 2 else 0


def blends_by_gain(r2: np.ndarray) -> tuple[int, int]:
    """Which blends (row: national, column: school) a table of held-out R2 speaks for; the prior of both is at 0, 0."""
    if np.max(r2 - r2[0, 0]) <= LEAST_GAIN:
        return 0, 0
    row = r2[np.unravel_index(np.argmax(r2), r2.shape)[0]]
    school = first_keeping(row - row[0])
    return first_keeping(r2[:, school] - r2[0, school]), school


class EntityFit:
    """The sums of one entity: residual Gram matrices of features (national, then school) and targets by fold and by month."""

    def __init__(self, fixed: pd.DataFrame, moving: pd.DataFrame, n_controls: int, prior: np.ndarray, school: np.ndarray):
        k, nc = len(prior), n_controls
        self.k, self.y, base, width = k, 2 * k, nc + TARGETS, nc + 2 * k + TARGETS
        named, moving = (frame.sort_values(["fold", "month"], ignore_index=True) for frame in (fixed, moving))
        inner = np.stack(named["sums"].to_numpy()).reshape(-1, base, base)
        outer = np.stack(moving["sums"].to_numpy()).reshape(-1, 2 * k, base + 2 * k)
        controls, features, targets = np.arange(nc), nc + np.arange(2 * k), nc + 2 * k + np.arange(TARGETS)
        fixed_at, grams = np.concatenate([controls, targets]), np.zeros((len(inner), width, width))
        grams[:, fixed_at[:, None], fixed_at] = inner
        grams[:, features[:, None], np.concatenate([fixed_at, features])] = outer
        grams[:, fixed_at[:, None], features] = outer[:, :, :base].transpose(0, 2, 1)
        total = grams.sum(0)
        self.n, self.months = int(round(total[0, 0])), named["month"].to_numpy()
        c = total[:nc, :nc] + 1e-9 * max(1.0, np.trace(total[:nc, :nc]) / nc) * np.eye(nc)
        beta = np.linalg.solve(c, total[:nc, nc:])
        self.rest = grams[:, nc:, nc:] - grams[:, nc:, :nc] @ beta - beta.T @ grams[:, :nc, nc:] + beta.T @ grams[:, :nc, :nc] @ beta
        self.total = self.rest.sum(0)
        self.folds = [self.rest[named["fold"].to_numpy() == f].sum(0) for f in sorted(set(named["fold"]))]
        self.intense = np.stack(moving["intense"].to_numpy()).sum(0)
        self.priors = (prior / prior.sum(), school / school.sum() if school.sum() > 0 else school)
        spread = np.diag(total)[nc : nc + 2 * k] / self.n - (total[0, nc : nc + 2 * k] / self.n) ** 2
        self.live = (spread > 1e-12) & (np.concatenate([np.ones(k, dtype=bool), np.full(k, school.sum() > 0)]))
        self.scale = np.sqrt(np.concatenate([prior, prior]))

    def solve(self, gram: np.ndarray, penalty: float, target: int = 0) -> np.ndarray:
        """Weights of all features; those of larger prior are penalised less."""
        at = np.flatnonzero(self.live)
        s = self.scale[at]
        u = nonnegative(gram[np.ix_(at, at)] * np.outer(s, s) + penalty * np.eye(len(at)), gram[at, self.y + target] * s)
        out = np.zeros(2 * self.k)
        out[at] = u * s
        return out

    def loss(self, gram: np.ndarray, weights: np.ndarray, target: int = 0) -> float:
        y = self.y + target
        return float(gram[y, y] - 2 * weights @ gram[: self.y, y] + weights @ gram[: self.y, : self.y] @ weights)

    def penalty(self, target: int = 0, every: int = 1) -> float:
        """The ridge penalty with the least error over held-out blocks of time."""
        at = np.flatnonzero(self.live)
        base = float(np.mean(np.diag(self.total)[at] * self.scale[at] ** 2))
        return min((base * x for x in PENALTIES[::every]), key=lambda x: sum(self.loss(f, self.solve(self.total - f, x, target), target) for f in self.folds))

    def scores(self, gram: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gram matrix of the two weighted scores, and their products with the main target."""
        w = np.zeros((2 * self.k, 2))
        w[: self.k, 0], w[self.k :, 1] = weights
        return w.T @ gram[: self.y, : self.y] @ w, w.T @ gram[: self.y, self.y]

    def parts(self, both: np.ndarray) -> list[np.ndarray]:
        return [both[: self.k], both[self.k :]]

    def mixed(self, fitted: np.ndarray, rho: tuple[float, float]) -> list[np.ndarray]:
        return [mixture(x, p, r) for x, p, r in zip(self.parts(fitted), self.priors, rho)]

    def held_out(self, penalty: float) -> np.ndarray:
        """R2 on held-out blocks for each blend of national (rows) and school (columns) weights fitted without the block."""
        school = BLENDS if self.live[self.k :].any() else BLENDS[:1]
        lost = np.zeros((len(BLENDS), len(school)))
        for f in self.folds:
            fitted = self.solve(self.total - f, penalty)
            for a, b in np.ndindex(lost.shape):
                w = self.mixed(fitted, (BLENDS[a], school[b]))
                effect = nonnegative(*self.scores(self.total - f, w))
                g, t = self.scores(f, w)
                lost[a, b] += f[self.y, self.y] - 2 * effect @ t + effect @ g @ effect
        return 1 - lost / max(float(self.total[self.y, self.y]), 1e-12)


def _entity(frame: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    first = frame.iloc[0]
    return list(first["codes"]), np.asarray(first["prior"], dtype=float), np.asarray(first["school"], dtype=float)


def _too_little(fit: EntityFit, least_rows: int) -> str:
    return "too few days" if fit.n < least_rows else "" if fit.live.any() else "no holiday varies"


def solve_entity(frame: pd.DataFrame, n_controls: int, draws: int = DRAWS, least_rows: int = LEAST_ROWS) -> pd.DataFrame:
    """All weights of an entity; frame: its Gram matrices, with codes, prior and school (prior of regions with school data, if used)."""
    entity, (codes, prior, school) = int(frame["entity_id"].iloc[0]), _entity(frame)
    of_any = frame["shift"] == ANY_SHIFT
    fit = EntityFit(frame[of_any], frame[~of_any], n_controls, prior, school)
    reason = _too_little(fit, least_rows)

    def rows(kind: int, weight, values: dict) -> pd.DataFrame:
        none = dict.fromkeys(("ci_low", "ci_high", "stability", "r2", "r2_prior", "penalty", "agree_raw", "agree_rank", "effect", "effect_low", "effect_high", "std_effect"), np.nan)
        own = {"entity_id": entity, "code": codes, "type": ("national", "school")[kind], "weight": weight, "n_obs": fit.parts(fit.intense)[kind], "n_days": fit.n, "reason": reason, "rho": 0.0}
        return pd.DataFrame(none | own | values).assign(prior_only=lambda t: t["rho"] == 0)[WEIGHTS_COLUMNS]

    if reason:
        return pd.concat([rows(i, fit.priors[i], {}) for i in (0, 1)])
    penalty = fit.penalty()
    r2 = fit.held_out(penalty)
    at = blends_by_gain(r2)
    rho = tuple(BLENDS[k] for k in at)
    fitted = fit.solve(fit.total, penalty)
    weight, gain = fit.mixed(fitted, rho), float(r2[at])
    g, t = fit.scores(fit.total, weight)
    effect = nonnegative(g, t) if gain > 0 else np.zeros(2)
    reason = "" if gain > 0 else "no gain on held-out days"
    std = effect * np.sqrt(np.maximum(np.diag(g), 0) / max(float(fit.total[fit.y, fit.y]), 1e-12))

    def agree(target: int) -> float:
        other = fit.solve(fit.total, fit.penalty(target, 2), target)
        found = [np.corrcoef(a, b)[0, 1] for a, b in zip(fit.parts(fitted), fit.parts(other)) if a.std() > 0 and b.std() > 0]
        return float(np.mean(found)) if found else np.nan

    common = {"r2": gain, "r2_prior": float(r2[0, 0]), "penalty": penalty, "agree_raw": agree(1), "agree_rank": agree(2)}
    months, rng = np.unique(fit.months), np.random.default_rng(entity)
    by_month = np.stack([fit.rest[fit.months == m].sum(0) for m in months])
    drawn, effects = [], np.zeros((draws, 2))
    for d in range(draws):
        gram = by_month[rng.integers(0, len(months), len(months))].sum(0)
        drawn.append(fit.mixed(fit.solve(gram, penalty), rho))
        effects[d] = nonnegative(*fit.scores(gram, drawn[-1]))
    out = []
    for i in (0, 1):
        values = common | {"effect": float(effect[i]), "std_effect": float(std[i]), "rho": rho[i]}
        if draws:
            values |= dict(zip(("effect_low", "effect_high"), np.percentile(effects[:, i], [5, 95])))
        if rho[i] and draws:
            each = np.stack([w[i] for w in drawn])
            values |= {"ci_low": np.percentile(each, 5, axis=0), "ci_high": np.percentile(each, 95, axis=0), "stability": (each > LEAST_WEIGHT).mean(0)}
        out.append(rows(i, weight[i], values))
    return pd.concat(out)


SHIFTS = "entity_id int, k int, n_days long, r2 double, r2_prior double, reason string"


def solve_shifts(frame: pd.DataFrame, n_controls: int, least_rows: int = LEAST_ROWS) -> pd.DataFrame:
    """Held-out R2 of the chosen blends, and of the prior, for each shift of the calendar (k counts them, 0 the first)."""
    entity, (_, prior, school) = int(frame["entity_id"].iloc[0]), _entity(frame)
    of_any, out = frame["shift"] == ANY_SHIFT, []
    for shift in sorted(set(frame.loc[~of_any, "shift"])):
        fit = EntityFit(frame[of_any], frame[frame["shift"] == shift], n_controls, prior, school)
        reason = _too_little(fit, least_rows)
        r2 = np.array([[np.nan]]) if reason else fit.held_out(fit.penalty())
        out.append((entity, int(shift), fit.n, float(r2[(0, 0) if reason else blends_by_gain(r2)]), float(r2[0, 0]), reason))
    return pd.DataFrame(out, columns=[x.split()[0] for x in SHIFTS.split(", ")])


def grams_of(days: DataFrame, events: DataFrame, markets: DataFrame, calendar: DataFrame, school_years: DataFrame, shifts: tuple[int, ...] = (0,), by_month: bool = True) -> tuple[DataFrame, int] | None:
    """Gram matrices of all entities with codes, prior and school beside them, and the number of controls; None without days."""
    # Workers get this module's functions by value, whether or not they can import the package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    span = days.agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b")).first()
    if span.a is None:
        return None
    order = Window.partitionBy("entity_id").orderBy(F.desc("prior"), "code")
    has = school_years.select("code").distinct().withColumn("has", F.lit(1.0))
    known = markets.join(has, "code", "left").withColumn("idx", F.row_number().over(order) - 1)
    rows, n_controls = sparse_days(covered_days(days, markets, school_years), events, (span.a, span.b))
    lists = known.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("idx", "code", "prior", (F.col("prior") * F.coalesce("has", F.lit(0.0))).alias("school")))).alias("all"))
    # Without enough covered days there are no school features, and the school prior stands as it is.
    grams = gram_blocks(rows, feature_days(known, calendar, shifts), lists.select("entity_id", F.size("all").alias("k")), n_controls, len(shifts), by_month)
    return grams.join(lists.select("entity_id", F.col("all.code").alias("codes"), F.col("all.prior").alias("prior"), F.col("all.school").alias("school")), "entity_id"), n_controls


def market_weights(days: DataFrame, events: DataFrame, markets: DataFrame, calendar: DataFrame, school_years: DataFrame, draws: int = DRAWS) -> DataFrame:
    """Weights of every region and kind on every entity, with interval, stability, blend, effect and agreement of other targets.

    days: entity_id, day, date, label; events: entity_id, day, rn; markets: entity_id, code, prior; calendar: code, day,
    national, school; school_years: code, year of regions with school data. Deterministic: months are drawn by the
    entity's id. Entities with few days, or whose regions have no holidays, keep the prior.
    """
    found = grams_of(days, events, markets, calendar, school_years)
    if found is None:
        return days.sparkSession.createDataFrame([], WEIGHTS)
    grams, n_controls = found
    return grams.groupBy("entity_id").applyInPandas(lambda frame: solve_entity(frame, n_controls, draws), WEIGHTS)


def placebo_ranks(days: DataFrame, events: DataFrame, markets: DataFrame, calendar: DataFrame, school_years: DataFrame, shifts: tuple[int, ...]) -> DataFrame:
    """How the real calendar's held-out R2 stands among shifted ones: entity_id, n_days, r2, median_shifted, shifts, p_value.

    p_value: the part of all calendars (the real one too) that do as well at least; about uniform where holidays mean
    nothing. Shifts are circular, in days; all are one run of the whole fit.
    """
    found = grams_of(days, events, markets, calendar, school_years, (0, *[s for s in shifts if s]), by_month=False)
    empty = days.sparkSession.createDataFrame([], SHIFTS)
    n_controls = found[1] if found else 0
    each = empty if found is None else found[0].groupBy("entity_id").applyInPandas(lambda frame: solve_shifts(frame, n_controls), SHIFTS)
    real = F.max(F.when(F.col("k") == 0, F.col("r2"))).over(Window.partitionBy("entity_id"))
    others = F.col("k") != 0
    out = each.where("reason = ''").withColumn("real", real).groupBy("entity_id").agg(
        F.max("n_days").alias("n_days"), F.max("real").alias("r2"), F.median(F.when(others, F.col("r2"))).alias("median_shifted"), F.count(F.when(others, 1)).alias("shifts"), F.count(F.when(F.col("r2") >= F.col("real"), 1)).alias("_as_good")
    )
    return out.select("entity_id", "n_days", "r2", "median_shifted", "shifts", (F.col("_as_good") / (F.col("shifts") + 1)).alias("p_value"))


def strengths(weights: DataFrame) -> DataFrame:
    """One row an entity: standardised effect of each kind over the 95th percentile of the positive ones (0-1), and uplifts in percent with intervals."""
    one = weights.groupBy("entity_id", "type").agg(*[F.max(c).alias(c) for c in ("effect", "effect_low", "effect_high", "std_effect", "r2", "n_days")])
    top = one.where("std_effect > 0").groupBy("type").agg(F.percentile("std_effect", F.lit(0.95)).alias("_top"))
    uplift = {f"uplift{x}": F.floor(1000 * (F.exp(f"effect{x}") - 1) + 0.5) / 10 for x in ("", "_low", "_high")}
    out = one.join(top, "type", "left").withColumns({"strength": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("std_effect") / F.coalesce("_top", F.lit(1.0)))), **uplift})
    wide = [F.max(F.when(F.col("type") == t, F.col(c))).alias(f"{t}_{c}") for t in ("national", "school") for c in ("strength", *uplift)]
    return out.groupBy("entity_id").agg(F.max("n_days").alias("n_days"), F.max("r2").alias("r2"), *wide)
