"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors of a label are ordered lexicographically by the concatenated signs of random projections, and each
is compared with its next WINDOW neighbours. Two vectors at the cosine threshold agree in a sign with a known chance, so the
number of passes that a label needs follows from its size and the recall wanted; a label that a window holds whole needs
one pass and loses nothing. Where more vectors than a window share the leading signs that the estimate counts on (dense
groups, hubs, labels off the centre), the whole run is compared block against block, so density costs work and no pairs;
a run whose members lie together in a longer run of an earlier pass isn't compared again.

A task sends edges to the roots of its trees and not its pairs; the edges of all passes are united into components. Then
all pairs of a component are compared once more to count links, so n_links is exact within what the passes united.

Defined cases: a vector that is null, zero, or holds a null or non-finite component, or whose label or vec_id is null,
links with nothing. Equal vectors are compared once and counted by their number. Vectors of unequal length never link. A
repeated vec_id takes the largest count and the least component of its rows. Empty tables give empty tables; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_table, materialise, ship_package, spread_join

#: WINDOW: neighbours each vector is compared with in a pass; BITS: signs in a pass's sort key.
COSINE, WINDOW, BITS = 0.93, 1024, 62
#: Chance that a pair just at the cosine meets in some pass; closer pairs have a better one.
RECALL = 0.99
#: Most members of a block; a group that is cut has FEW blocks at least, as far as these hold LEAST members each.
BLOCK, FEW, LEAST = 4096, 8, 512
#: Sorted rows a task, about.
ROWS = 20_000


def _unit(column: pd.Series) -> np.ndarray:
    rows = np.stack(column.to_numpy()).astype(np.float64)
    # Scaled first, so that very large or small components neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector (floats where the input has floats, else doubles) of rows that can link."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    known = vectors.select("vec_id", "label", F.col("embedding").cast(kind).alias("vector")).where("label is not null and vec_id is not null and vector is not null")
    return known.where(finite & F.exists("vector", lambda x: x != 0))


def leading_signs(rows: int, window: int = WINDOW) -> int:
    """Signs after which a run of a label of so many rows is expected to fill half a window."""
    return max(0, math.ceil(math.log2(2 * rows / window))) if rows > window else 0


def passes_for(rows: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL, lead: int | None = None) -> int:
    """Passes over a label of so many vectors in which a pair at the cosine agrees in all leading signs with chance `recall`.

    A sign agrees with chance 1 - angle / pi, so passes grow with a small power of the rows (0.18 at cosine 0.93).
    """
    meets = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** (leading_signs(rows, window) if lead is None else lead)
    return 1 if meets >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-meets)))


def keyed(vectors: DataFrame, seed: int = 11) -> DataFrame:
    """uid and, for each of its label's passes, step, key (BITS signs as a number) and run (the leading signs)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            widths = batch["vector"].map(len).to_numpy()
            for width in np.unique(widths):
                part = batch[widths == width]
                unit, passes, lead, uid = _unit(part["vector"]), part["passes"].to_numpy(), part["lead"].to_numpy(), part["uid"].to_numpy()
                for k in range(int(passes.max())):
                    at = np.flatnonzero(passes > k)
                    normals = np.random.default_rng([seed, k, int(width)]).normal(size=(width, BITS))
                    key = (unit[at] @ normals > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS, dtype=np.int64)[::-1])
                    yield pd.DataFrame({"uid": uid[at], "step": np.int32(k), "key": key, "run": key >> (BITS - lead[at])})

    return vectors.select("uid", "vector", "passes", "lead").mapInPandas(run, "uid long, step int, key long, run long")


def merge_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the trees of i and j in place; root holds every row's least known row."""
    while len(i):
        low = np.minimum(root[i], root[j])
        apart = (root[i] != low) | (root[j] != low)
        i, j, low = i[apart], j[apart], low[apart]
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root != root[root]).any():
            root[:] = root[root]


def window_edges(ordered: DataFrame, window: int, cosine: float) -> DataFrame:
    """Edges a, b among sorted rows: each with the next `window` of its pass, label and width, across partitions too.

    A partition streams its rows and keeps the last `window`. Its first and last rows are sent on with the partition's
    number, and the seams between neighbouring partitions are compared in a second step.
    """
    out = f"kind int, seam int, at int, step int, group string, a long, b long, vector {dict(ordered.dtypes)['vector']}"

    def compare(frame: pd.DataFrame, fresh_from: int) -> np.ndarray:
        """Edges among the rows, one of each pair being from fresh_from on."""
        nodes, root = frame["uid"].to_numpy(), np.arange(len(frame))
        step, group = frame["step"].to_numpy(), frame["group"].to_numpy()
        starts = np.flatnonzero(np.append(True, (step[1:] != step[:-1]) | (group[1:] != group[:-1])))
        for low, high in zip(starts, np.append(starts[1:], len(frame))):
            unit = _unit(frame["vector"].iloc[low:high])
            for k in range(0, high - low, 256):
                top = min(high - low, k + 256 + window)
                if low + top <= fresh_from:
                    continue
                i, j = np.nonzero(unit[k : k + 256] @ unit[k:top].T >= cosine)
                hit = (j > i) & (j - i <= window) & (low + k + j >= fresh_from)
                merge_roots(root, low + k + i[hit], low + k + j[hit])
        hit = np.flatnonzero(root != np.arange(len(root)))
        return np.stack([nodes[hit], nodes[root[hit]]], axis=1)

    def edges(found: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.int32(0), "seam": np.int32(0), "at": np.int32(0), "step": np.int32(0), "group": "", "a": found[:, 0], "b": found[:, 1], "vector": None})

    def sent_on(rows: pd.DataFrame, kind: int, seam: int) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.int32(kind), "seam": np.int32(seam), "at": np.arange(len(rows), dtype=np.int32), "step": rows["step"].to_numpy(), "group": rows["group"].to_numpy(), "a": rows["uid"].to_numpy(), "b": rows["uid"].to_numpy(), "vector": rows["vector"].to_numpy()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, head, pid = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            pid = int(batch["pid"].iloc[0])
            if head < window:
                yield sent_on(batch.iloc[: window - head], 1, pid - 1)
                head += len(batch)
            frame = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            yield edges(compare(frame, 0 if tail is None else len(tail)))
            tail = frame.iloc[-window:]
        if tail is not None:
            yield sent_on(tail, 2, pid)

    def seams(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["kind", "at"], ascending=[False, True], ignore_index=True).rename(columns={"a": "uid"})
        return pd.DataFrame(compare(frame, int((frame["kind"] == 2).sum())), columns=["a", "b"])

    both = materialise(ordered.withColumn("pid", F.spark_partition_id()).mapInPandas(run, out))
    across = both.where("kind > 0").groupBy("seam").applyInPandas(seams, "a long, b long")
    return both.where("kind = 0").select("a", "b").unionAll(across).distinct()


def block_links(members: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """uid, root, n of members (team, size, part, uid, copies, vector): all pairs of a part in a team of `size` members.

    n sums to a vector's links over its rows; the rows' edges (uid, root) connect what is linked. A team is cut into blocks
    by hash; a member goes to one cell for each block of its team, and a task compares two blocks at a time.
    """
    blocks = F.greatest(F.ceil(F.col("size") / block), F.least(F.lit(FEW), F.ceil(F.col("size") / LEAST))).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    # One column, else the rows of a team would stay together in the task that joined them.
    cells = cells.select(F.concat_ws(":", "team", x, y).alias("cell"), (x == y).alias("alone"), (F.col("own") == x).alias("left"), "part", "uid", "copies", "vector")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        alone, side = bool(frame["alone"].iloc[0]), frame["left"].to_numpy()
        widths, part = frame["vector"].map(len).to_numpy(), pd.factorize(frame["part"])[0]
        uid, copies = frame["uid"].to_numpy(), frame["copies"].to_numpy(dtype=np.float64)
        root, count = np.arange(len(frame)), np.zeros(len(frame))
        for width in np.unique(widths):
            left = np.flatnonzero((widths == width) & side)
            right = left if alone else np.flatnonzero((widths == width) & ~side)
            if not len(left) or not len(right):
                continue
            unit = _unit(frame["vector"].iloc[left])
            others = unit if alone else _unit(frame["vector"].iloc[right])
            for k in range(0, len(left), 256):
                near = (unit[k : k + 256] @ others.T >= cosine) & (part[left[k : k + 256], None] == part[None, right])
                if alone:
                    near[np.arange(len(near)), np.arange(k, k + len(near))] = False
                count[left[k : k + 256]] += near @ copies[right]
                if not alone:
                    count[right] += copies[left[k : k + 256]] @ near
                i, j = np.nonzero(near)
                merge_roots(root, left[k + i], right[j])
        hit = np.flatnonzero(count)
        return pd.DataFrame({"uid": uid[hit], "root": uid[root[hit]], "n": count[hit].astype(np.int64)})

    return cells.groupBy("cell").applyInPandas(run, "uid long, root long, n long")


def with_passes(distinct: DataFrame, rows: int, cosine: float, window: int, recall: float) -> DataFrame:
    """Adds lead (leading signs) and passes, by the size of the row's label."""
    few = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    lead = F.when(F.col("n") <= window, 0).otherwise(F.greatest(F.lit(0), F.ceil(F.log2(2 * F.col("n") / window)))).cast("int")
    by_lead = F.array(*[F.lit(passes_for(0, cosine, window, recall, lead=k)) for k in range(BITS)])
    few = few.withColumn("lead", F.least(lead, F.lit(BITS - 1))).withColumn("passes", F.get(by_lead, F.col("lead")))
    return spread_join(distinct, few, "label", rows)


def fresh_runs(members: DataFrame) -> DataFrame:
    """Of long runs (rows uid, step, team, n) those to compare: team and n.

    A run isn't compared if all its members lie together in one longer run of an earlier pass: their pairs met there, or
    in a run that held that one. So a narrow cone, which most passes leave in one run, is compared once and not in each.
    """
    before = Window.partitionBy("uid").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    held = members.withColumn("cover", F.max(F.struct("n", "team")).over(before)["team"])
    runs = held.groupBy("team").agg(F.first("n").alias("n"), F.count("cover").alias("held"), F.min("cover").alias("low"), F.max("cover").alias("high"))
    return runs.where("held < n or low <> high").select("team", "n")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    ship_package(vectors.sparkSession)
    mark = F.concat_ws(":", F.col("label").cast("string"), F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"))
    rows = materialise(usable(vectors).withColumn("mark", mark))
    distinct = rows.groupBy("mark").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = materialise(distinct.withColumn("uid", F.monotonically_increasing_id()))
    total = distinct.count()
    named = with_passes(distinct.select("uid", "label", "vector"), total, cosine, window, recall)
    keys = materialise(keyed(named))
    sorted_rows = keys.count()
    place = keys.join(distinct.select("uid", F.concat_ws("|", F.col("label").cast("string"), F.size("vector")).alias("group"), "copies", "vector"), "uid")
    partitions = max(1, -(-sorted_rows // ROWS))
    ordered = place.repartitionByRange(partitions, "step", "group", "key", "uid").sortWithinPartitions("step", "group", "key", "uid").select("step", "group", "uid", "vector")
    edges = window_edges(ordered, window, cosine)
    # Runs of the leading signs that no window holds.
    team = F.concat_ws("|", "step", "group", "run")
    runs = place.select(team.alias("team"), "uid", "copies", "vector")
    long_runs = materialise(runs.groupBy("team").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window))
    if long_runs.head(1):
        narrow = place.select(team.alias("team"), "uid", "step")
        again = long_runs
        long_runs = materialise(fresh_runs(spread_join(narrow, again.withColumn("size", F.col("n")), "team", sorted_rows).withColumnRenamed("size", "n")))
        drop_table(again)
        held = spread_join(runs, long_runs.select("team", "n", F.col("n").alias("size")), "team", sorted_rows)
        edges = edges.unionAll(block_links(held.withColumn("part", F.lit(0)), cosine).select("uid", "root"))
    found = materialise(components(edges).withColumnRenamed("node", "uid"))
    for table in (keys, long_runs):
        drop_table(table)
    counts, least = component_counts(distinct, found, cosine)
    linked = distinct.select("mark", "uid", "first", "copies").join(found, "uid", "left").join(counts, "uid", "left")
    linked = materialise(linked.select("mark", F.col("copies").alias("n"), "first", "component", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    grouped = spread_join(linked.where("component is not null").withColumnRenamed("n", "size"), least, "component", total).withColumnRenamed("size", "n")
    alone = linked.where("component is null").withColumn("component_id", F.col("first"))
    values = grouped.select("mark", "n", "n_links", "component_id").unionAll(alone.select("mark", "n", "n_links", "component_id"))
    per_id = spread_join(rows.select("vec_id", "mark"), values, "mark", rows.count()).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = vectors.select("vec_id")
    out = ids.where("vec_id is not null").join(per_id, "vec_id", "left").unionByName(ids.where("vec_id is null"), allowMissingColumns=True)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def component_counts(distinct: DataFrame, found: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(uid, n_links) over all pairs of each component, and (component, component_id, n) with the least vec_id of its members.

    Small components are compared together, many to a task; larger ones are teams of their own.
    """
    members = materialise(distinct.select("uid", "first", "copies", "vector").join(found, "uid"))
    least = materialise(members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("component_id")))
    rows = members.count()
    sized = spread_join(members, least.select("component", "n", F.col("n").alias("size")), "component", rows)
    small = F.col("size") <= LEAST
    bucket = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-rows // LEAST))))
    teams = sized.select(F.when(small, F.concat(F.lit("s"), bucket)).otherwise(F.concat(F.lit("c"), F.col("component"))).alias("team"), F.when(small, 1).otherwise(F.col("size")).alias("size"), F.col("component").alias("part"), "uid", "copies", "vector")
    return block_links(teams, cosine).groupBy("uid").agg(F.sum("n").alias("n_links")), least
