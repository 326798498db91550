"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints are cut into partitions of correlated bits with a threshold each. If the thresholds plus one sum to the
allowed distance plus one, two linked fingerprints are within the threshold in at least one partition. Number of
partitions and thresholds are chosen by dynamic programming on candidate counts, estimated from the exact counts of every
group's values over all fingerprints. Each distinct fingerprint goes to the cells of its own values and of all values
within the threshold. Fingerprints that share a cell are verified by their distance: in small cells pair by pair, in
larger ones block against block, where a task sends edges to the roots of its trees and not all its pairs.

Defined cases: a null or empty text has fingerprint 0 and is linked like any other. Rows with a null doc_id get a
fingerprint, and component_id of their fingerprint's group (null if no id is in it); links through them count. Rows that
share an id but not a fingerprint are not linked by that. Repeated rows stay. Empty tables give empty tables. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop_table, keyed_rows, materialise, ship_package, spread_join

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Most members of a cell whose pairs are joined; larger cells are compared block against block.
SMALL, BLOCK = 512, 4096
#: Comparisons of a task that compares large cells, about.
EACH = 50_000_000
#: A partition that would need more probes a fingerprint isn't chosen.
MOST_PROBES = 5000
_SPACE = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in bytes(range(256)).lower())


def fingerprint(text: str | None) -> int:
    """64 bits as a signed number; a bit is 1 if it is set in over half the shingle hashes."""
    import xxhash

    words = [w for w in (text or "").encode("utf-8", "replace").translate(_SPACE).split(b" ") if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    last = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    ones, done = np.zeros(64, dtype=np.int64), 0
    for block in range(0, last, 8192):
        size = min(8192, last - block)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[block : block + size], ends[min(SHINGLE, len(words)) - 1 + block :])), dtype=np.uint64, count=size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        done += size
    return int(np.packbits((2 * ones > done).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprint_of(spark: SparkSession, text: Column) -> Column:
    """The fingerprint (signed long) of a text column."""
    ship_package(spark)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t if isinstance(t, str) else None) for t in texts], dtype="int64")

    return run(text)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and for every pair of bits in how many rows both are set; over all rows, summed before they move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((64, 64), dtype=np.int64), 0
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy(dtype=np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total, rows = total + (bits.T @ bits).astype(np.int64), rows + len(bits)
        if rows:
            i, j = np.indices((64, 64)).reshape(2, -1)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(total.ravel(), rows)})

    out, rows = np.zeros((64, 64)), 0
    for r in fps.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r.i < 0:
            rows = r.n
        else:
            out[r.i, r.j] = r.n
    return rows, out


def correlated_groups(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size; each grows from a free bit by the strongest mean correlation."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs((both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = list(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (strength[b, [x for x in free if x != b]].max(initial=0), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (strength[b, group].mean(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def variants(bits: list[int], threshold: int) -> list[int]:
    """Masks (signed) that flip up to threshold of the bits."""
    return [signed(sum(1 << b for b in some)) for n in range(threshold + 1) for some in itertools.combinations(bits, n)]


def collisions(fps: DataFrame, groupings: list[list[list[int]]]) -> list[list[float]]:
    """For every group of bits of every grouping, the sum over its values of count squared; over all distinct fingerprints."""
    masks = sorted({signed(sum(1 << b for b in g)) for groups in groupings for g in groups})
    values = F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for m in masks])
    counted = fps.select(F.explode(values).alias("x")).select("x.*").groupBy("mask", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    found = {r["mask"]: r["met"] for r in counted.groupBy("mask").agg(F.sum(F.col("n") * F.col("n")).alias("met")).collect()}
    return [[found.get(signed(sum(1 << b for b in g)), 0.0) for g in groups] for groups in groupings]


def allocate(rows: int, met: list[float], groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """The least estimated cost and a threshold for each group (-1: not probed), summing to distance - groups + 1.

    Two values within a threshold meet at most as often, over all flips of so many bits, as values meet themselves (by
    Cauchy and Schwarz), so probes times the group's own collisions bounds the candidates from above.
    """
    probes = [[sum(math.comb(len(g), i) for i in range(n + 1)) for n in range(distance + 1)] for g in groups]

    def cost(k: int, threshold: int) -> float:
        return 0.0 if threshold < 0 else probes[k][threshold] * (rows + 0.05 * met[k]) if probes[k][threshold] <= MOST_PROBES else math.inf

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the sum of thresholds plus one
    for k in range(len(groups)):
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for threshold in range(-1, distance - used + 1):
                total, at = c + cost(k, threshold), used + threshold + 1
                if at not in following or total < following[at][0]:
                    following[at] = (total, [*chosen, threshold])
        best = following
    return best[distance + 1]


def plan(fps: DataFrame, rows: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every probed partition of distinct fingerprints fps."""
    groupings = [correlated_groups(rows, both, parts) for parts in range(2, distance + 2)]
    options = []
    for groups, met in zip(groupings, collisions(fps, groupings)):
        cost, thresholds = allocate(rows, met, groups, distance)
        options.append((cost, len(groups), [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(options, key=lambda x: x[:2])[2]


def cell_edges(fps: np.ndarray, others: np.ndarray | None, distance: int) -> np.ndarray:
    """Edges (fingerprint, root) that connect what is linked among fps, or between fps and others: one a fingerprint."""
    every = fps if others is None else np.concatenate([fps, others])
    first = np.arange(len(fps)) if others is None else np.arange(len(fps), len(every))
    root = np.arange(len(every))
    for k in range(0, len(fps), 256):
        apart = np.bitwise_count(fps[k : k + 256, None].view(np.uint64) ^ every[None, first].view(np.uint64))
        i, j = np.nonzero(apart <= distance)
        i, j = i + k, first[j]
        while True:
            low = np.minimum(root[i], root[j])
            if (root[i] == low).all() and (root[j] == low).all():
                break
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while (root != root[root]).any():
                root = root[root]
    hit = np.flatnonzero(root != np.arange(len(every)))
    return np.stack([every[hit], every[root[hit]]], axis=1)


def _cells(part: int, value: Column, flips: Column) -> Column:
    return F.transform(flips, lambda m: F.xxhash64(F.lit(part), value.bitwiseXOR(m)))


def links(nodes: DataFrame, partitions: list[tuple[list[int], int]], distance: int = DISTANCE, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Edges a, b among distinct fingerprints (fp) that connect exactly what lies within the distance of each other."""
    probed = []
    for k, (bits, threshold) in enumerate(partitions):
        value = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))
        # Cells of different partitions are told apart by hashing; a chance meeting costs a comparison and is verified.
        probed.append(_cells(k, value, F.array(*[F.lit(m) for m in variants(bits, threshold)])))
    cells = materialise(nodes.select("fp", F.explode(F.flatten(F.array(*probed))).alias("cell")))
    counts = materialise(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = materialise(spread_join(cells, counts.select("cell", "n", F.col("n").alias("size")), "cell", cells.count()))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    few = members.where(F.col("size") <= small).select("fp", "cell")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "cell").where(near).select("a", "b")
    # A large cell is cut into blocks by hash, and a task compares two of them; a cell of one block is one comparison.
    large = members.where(F.col("size") > small).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("fp", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "cell")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left = frame["own"] == frame["x"]
        fps, others = frame.loc[left, "fp"].to_numpy(), frame.loc[~left, "fp"].to_numpy()
        found = cell_edges(fps, others if frame["x"].iloc[0] != frame["y"].iloc[0] else None, distance)
        return pd.DataFrame(found, columns=["a", "b"])

    # The work goes with the square of the members, which the size of the shuffle doesn't show.
    work = counts.where(F.col("n") > small).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    tasks = int(min(10_000, 1 + work // EACH))
    trees = dealt.repartition(tasks, "cell", "x", "y").groupBy("cell", "x", "y").applyInPandas(run, "a long, b long")
    found = materialise(pairs.unionAll(trees).distinct())
    for table in (cells, counts, members):
        drop_table(table)
    return found


def near_groups(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, n (its rows) and component (the least fingerprint that it hangs together with) of rows with a fingerprint fp."""
    nodes = materialise(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    count, both = bit_statistics(nodes)
    if not count:
        return nodes.withColumn("component", F.col("fp"))
    found = components(links(nodes.select("fp"), plan(nodes, count, both, distance), distance))
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    rows = materialise(docs.select("doc_id", fingerprint_of(docs.sparkSession, F.col("text")).alias("fp")))
    named = materialise(near_groups(rows, distance))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(named, "fp").groupBy("component")
    least = least.agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    known = spread_join(named.select("fp", F.col("n").alias("size"), "component"), least, "component", named.count())
    found = spread_join(rows, known.select("fp", F.col("size").alias("n"), "component_id"), "fp", rows.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near-duplicate texts, with all columns: the row with the least doc_id (null last).

    Of rows that share that id too, one stays. Rows are found again by a hash of all their columns, so texts that share an
    id are only dropped for a near-duplicate text. Rows equal in all columns collapse before they move.
    """
    rows = keyed_rows(docs)
    narrow = materialise(rows.select("k1", "k2", F.col("row.doc_id").alias("doc_id"), fingerprint_of(docs.sparkSession, F.col("row.text")).alias("fp")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    best = narrow.groupBy("fp").agg(F.min(order).alias("best")).join(near_groups(narrow, distance), "fp")
    kept = materialise(best.groupBy("component").agg(F.min("best").alias("best")).select("best.k1", "best.k2"))
    return rows.dropDuplicates(["k1", "k2"]).join(kept, ["k1", "k2"], "left_semi").select("row.*")
