"""Table contracts, checked in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """All that is wrong with a table, in one message."""


@dataclass(frozen=True)
class Contract:
    required: tuple[str, ...]
    key: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)


def report(df: DataFrame, contract: Contract) -> DataFrame:
    """One row for each rule: rule, n (rows that break it) and found. One aggregation over the table, one over its key.

    found: the first five values that aren't allowed, in order; the least and the largest value out of range; the columns
    that are missing. Wrong values are made distinct by all tasks, and each sends on its first five of a rule.
    """
    missing = [c for c in contract.required if c not in df.columns]
    counts, found, listed = {}, {}, []
    for c, values in contract.allowed.items():
        if c in df.columns:
            wrong = F.col(c).isNotNull() & ~F.col(c).isin(*values)
            counts[f"allowed:{c}"] = F.sum(wrong.cast("long"))
            found[f"allowed:{c}"] = F.lit("")
            listed.append(F.struct(F.lit(f"allowed:{c}").alias("rule"), F.when(wrong, F.col(c).cast("string")).alias("value")))
    for c, (low, high) in contract.ranges.items():
        if c in df.columns:
            wrong = (F.col(c) < low) | (F.col(c) > high)
            counts[f"range:{c}"] = F.sum(wrong.cast("long"))
            found[f"range:{c}"] = F.concat_ws(" to ", F.min(F.when(wrong, F.col(c))).cast("string"), F.max(F.when(wrong, F.col(c))).cast("string"))
    one = df.agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in counts.items()], *[v.alias(f"found {k}") for k, v in found.items()], F.lit(len(missing)).cast("long").alias("missing_columns"), F.lit(", ".join(missing)).alias("found missing_columns"))
    rules = [*counts, "missing_columns"]
    out = one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("n"), F.col(f"`found {r}`").alias("found")) for r in rules])).alias("x")).select("x.*")
    if listed:
        values = df.select(F.explode(F.array(*listed)).alias("x")).select("x.*").where("value is not null").distinct()
        first = values.withColumn("_k", F.row_number().over(Window.partitionBy("rule").orderBy("value"))).where("_k <= 5")
        named = first.groupBy("rule").agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("_found"))
        out = out.join(named, "rule", "left").select("rule", "n", F.coalesce("_found", "found").alias("found"))
    if contract.key and not set(contract.key) - set(df.columns):
        twice = df.groupBy(*contract.key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.lit("duplicate_keys").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit("").alias("found"))
        out = out.unionByName(twice)
    return out


def check(df: DataFrame, contract: Contract) -> DataFrame:
    """The table itself, or ContractError with every broken rule."""
    broken = [f"{r.rule}: {r.n}" + (f" ({r.found})" if r.found else "") for r in report(df, contract).where("n > 0").collect()]
    if broken:
        raise ContractError("; ".join(broken))
    return df
