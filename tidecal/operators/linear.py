"""Ridge regression with shared terms and terms of each entity, solved exactly however many entities there are.

The squared errors plus the penalty times the squared coefficients are least where linear equations hold, so a fit is sums of
products and their solution, without steps that could end early. An entity's own terms meet no other entity's: they are
eliminated entity by entity, the equations that are left hold shared terms only and are added up and solved once, and the own
terms follow from that solution.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise


def one_hot(codes: pd.Series, levels: int) -> np.ndarray:
    """A column for each level; a missing code is in none of them."""
    return (codes.to_numpy()[:, None] == np.arange(levels)).astype(float)


class EntityRidge:
    """Least squared errors of label plus penalty times squared coefficients (of numbers scaled to deviation 1, and of dummies).

    train: entity_id, label, the numbers without missing values, and codes from 0. shared, own: code columns with their
    number of levels; each level of a shared code has a dummy, and each level of an own code one for every entity, which has
    one for itself as well. The constant is not penalised. Levels and entities that train doesn't hold add nothing.
    """

    def __init__(self, train: DataFrame, numbers: list[str], shared: dict[str, int], own: dict[str, int], penalty: float):
        if not penalty > 0:
            raise ValueError("a ridge needs a penalty above 0")
        if train.isEmpty():
            raise ValueError("no rows to fit a ridge on")
        # Workers get this module's functions by value, whether or not they can import the package.
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        self.numbers, self.shared, self.own = numbers, shared, own
        spread = train.agg(Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.array(*numbers))).alias("s")).first().s
        means, variances = spread["mean"].toArray(), spread["variance"].toArray() * (1 - 1 / spread["count"])
        scales = np.where(variances > 0, np.sqrt(variances), 1.0)
        n, m = 1 + len(numbers) + sum(shared.values()), 1 + sum(own.values())

        def eliminated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """One entity's equations: rest, what its rows say on shared terms and the label; ties, its own terms by these."""
            products, entity = np.zeros((n + 1 + m, n + 1 + m)), None
            for frame in batches:
                constant = np.ones((len(frame), 1))
                x = np.hstack([
                    constant, (frame[numbers].to_numpy(dtype=float) - means) / scales, *[one_hot(frame[c], k) for c, k in shared.items()],
                    frame[["label"]].to_numpy(dtype=float), constant, *[one_hot(frame[c], k) for c, k in own.items()],
                ])
                products += x.T @ x
                entity = frame["entity_id"].iloc[0]
            if not np.isfinite(products).all():
                raise ValueError("labels and numbers of a ridge must be finite")
            across = products[n + 1 :, : n + 1]
            ties = np.linalg.solve(products[n + 1 :, n + 1 :] + penalty * np.eye(m), across)
            rest = products[:n, : n + 1] - across[:, :n].T @ ties
            yield pd.DataFrame({"entity_id": [entity], "rest": [rest.ravel()], "ties": [ties.ravel()]})

        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(n * (n + 1))
            for frame in batches:
                total += sum(frame["rest"], np.zeros(len(total)))
            yield pd.DataFrame({"rest": [total]})

        kind = train.schema["entity_id"].dataType.simpleString()
        codes = list(dict.fromkeys([*shared, *own]))
        each = materialise(train.select("entity_id", "label", *numbers, *codes).groupBy("entity_id").applyInPandas(eliminated, f"entity_id {kind}, rest array<double>, ties array<double>"))
        # One sum for each file that the entities' equations fill comes to the driver.
        sums = sum(np.array(r.rest) for r in each.select("rest").mapInPandas(added, "rest array<double>").collect()).reshape(n, n + 1)
        found = np.linalg.solve(sums[:, :n] + penalty * np.diag([0.0] + [1.0] * (n - 1)), sums[:, n])

        def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by = np.append(-found, 1.0)
            for frame in batches:
                yield pd.DataFrame({"entity_id": frame["entity_id"], "_own": [t.reshape(m, n + 1) @ by for t in frame["ties"]]})

        self.weights = found[1 : 1 + len(numbers)] / scales
        self.constant = float(found[0] - self.weights @ means)
        self.levels = found[1 + len(numbers) :]
        self.table = each.select("entity_id", "ties").mapInPandas(solved, f"entity_id {kind}, _own array<double>")

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with prediction, by one join with the entities' own terms."""
        out, none = F.lit(self.constant), F.lit(0.0)
        for c, w in zip(self.numbers, self.weights):
            out = out + F.col(c) * float(w)
        at = 0
        for c, k in self.shared.items():
            out = out + F.coalesce(F.get(F.array(*[F.lit(float(w)) for w in self.levels[at : at + k]]), F.col(c)), none)
            at += k
        out, at = out + F.coalesce(F.get("_own", F.lit(0)), none), 1
        for c, k in self.own.items():
            out = out + F.coalesce(F.get("_own", F.col(c) + at), none)
            at += k
        table = self.table.withColumnRenamed("entity_id", "_entity")
        return rows.join(table, F.col("entity_id").eqNullSafe(F.col("_entity")), "left").withColumn("prediction", out).drop("_entity", "_own")
