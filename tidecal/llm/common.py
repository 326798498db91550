"""Helpers shared by the training-data operators: shared scratch tables, gapless numbering, connected components."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import drop_table, materialise, run_dir, shared_dir  # noqa: F401

#: White space and words as the operators count them.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def keyed_rows(docs: DataFrame) -> DataFrame:
    """row (all columns) with k1 and k2, 128 bits by which a row is found again: rows equal in all columns share them."""
    names = [F.col(c) for c, kind in docs.dtypes if not kind.startswith("map")]
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.xxhash64(*names).alias("k1"), F.xxhash64(F.lit(1), *names).alias("k2"))


def word_count(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))).cast("long")


def bind(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def slices_for(rows: int, least: int = 256, each: int = 200_000) -> int:
    """Into how many slices a group is cut for numbering: from the row count alone, so that reruns agree."""
    return max(least, -(-rows // each))


def spread_key(doc_id: Column, text: Column) -> Column:
    """A whole number to scatter a row by: its id, or, for a null id, 32 bits of its text's MD5."""
    return F.coalesce(doc_id, F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"))


def scatter(key: Column, slices: int) -> Column:
    """A slice from 0 for a whole number, by arithmetic that SQL engines share; null goes where 0 goes.

    The high bits of a product decide, so evenly spaced keys are scattered too.
    """
    mixed = F.pmod(F.coalesce(key, F.lit(0)) % 2_147_483_648 * F.lit(1_640_531_527), F.lit(2_147_483_648))
    return F.shiftright(mixed * slices, 31)


def number_within(df: DataFrame, keys: list[str], cells: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in the order of cells, then of order.

    A key is cut into cells that are numbered apart; the running count of the cells before is added. So one key may hold
    most rows: no task gets more than one cell at a time. keys and cells hold no nulls. Rows equal in cells and order
    may swap numbers.
    """
    counts = df.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *cells, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, *cells).orderBy(*order)))
    return ranked.join(offsets, [*keys, *cells]).withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_before", "_rank")


#: A key with more than this share of all rows is dealt over several tasks; so there are at most that many such keys.
HOT = 4096


def spread_join(rows: DataFrame, few: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with few, which holds one row a key and in n how many of the `total` rows have it; n is dropped.

    Rows of a key with over total / HOT of them are dealt over several tasks, to each of which the key's row of few is
    copied. There are fewer than HOT such keys, so their list is broadcast.
    """
    most = max(1, total // HOT)
    hot = few.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_tasks"))
    salt = F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.coalesce("_tasks", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_tasks")
    tasks = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")
    copied = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("n")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph with columns a and b (long): node, component (its smallest node).

    Alternates large-star and small-star steps; each round is two aggregations and two joins on node ids, written to the
    shared folder. A node that many edges meet is dealt over several tasks. Nodes without edges don't appear. Empty edges
    give an empty table. Raises if most_rounds don't suffice, so that no unfinished result is taken for a whole one.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rows, total = now.count(), None
    for _ in range(most_rounds):
        if not rows:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = spread_join(both, low, "u", 2 * rows).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, least, "u", rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        following = materialise(small)
        drop_table(now)
        now = following
        # A star forest: every node has one smaller neighbour, which has none.
        state = now.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("nodes"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state.n == state.nodes and (state.n, state.h) == total:
            break
        rows, total = state.n, (state.n, state.h)
    else:
        raise RuntimeError(f"components are still changing after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tidecal-")) / "tidecal_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
