"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source_size copies. The expected copies are summed in the order of
(size bin, mixed id, id), one random offset of the source is added, and a document is emitted once for each integer
boundary that its step crosses. Sizes are stratified by that order, so the words taken come near the target. The offset
comes from the seed and the source's name: reruns agree, and another source doesn't change it.

Defined cases: a null text has size 0; a null source is a source of its own, the last; a source without words has
target 0 and takes nothing. A null id is placed by its text instead. Repeated rows count each. Empty tables give empty
tables. Columns other than doc_id, text and source are ignored by mix() and carried by emit(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_rows, materialise, number_within, slices_for, spread_key, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Another seed, another mix of the same shares.
SEED = 20
_MIX, _MOD = 1_640_531_527, 2_147_483_648


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source (no_source, source_name): source_size and target. One row for each source goes through one window.

    Raising one water level L until sum(least(most * size, L * weight)) is the total is the fixed point of sharing the
    excess of full sources by weight.
    """
    totals = sizes.groupBy("no_source", "source_name").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("k", F.row_number().over(Window.orderBy("no_source", "source_name")) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "cap": most * F.col("source_size")})
    up = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumns(
        {
            "total": share * F.sum("source_size").over(everything),
            "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "k", "level"))).over(everything)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return ranked.select("no_source", "source_name", "k", "source_size", target.alias("target"))


def size_bin(size: Column) -> Column:
    """Sizes to four leading bits after the first: bins grow with the size."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 5, F.lit(0))
    return (shift * 32 + F.expr("shiftright(size, greatest(length(bin(size)) - 5, 0))")).cast("long")


def offset(source: Column, no_source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1): 32 bits of the MD5 of seed and name, so that no other source changes it."""
    name = F.concat_ws(":", F.lit(str(seed)), F.when(no_source, "null").otherwise("source"), source)
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(4_294_967_296.0)


def copies_of(narrow: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """narrow (spread, source, size and any more columns) with source_size, target and copies.

    Rows are numbered by cells of a source, a size bin and a slice of the mixed ids; the slices grow with the rows.
    """
    narrow = materialise(
        narrow.withColumns(
            {
                "no_source": F.col("source").isNull(),
                "source_name": F.coalesce("source", F.lit("")),
                "bin": size_bin(F.col("size")),
                "mixed": F.pmod(F.coalesce("spread", F.lit(0)) % _MOD * F.lit(_MIX), F.lit(_MOD)),
            }
        )
    )
    per_source = targets(narrow, **options)
    sliced = narrow.withColumn("slice", F.floor(F.col("mixed") * slices_for(narrow.count(), least=32, each=1_000_000) / _MOD))
    placed = number_within(sliced, ["no_source", "source_name"], ["bin", "slice"], ["mixed", "spread", "size"], "place")
    placed = placed.join(F.broadcast(per_source) if per_source.count() <= 10_000 else per_source, ["no_source", "source_name"])
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = offset(F.col("source_name"), F.col("no_source"), seed)
    copies = F.floor(start + step * (F.col("place") + 1)) - F.floor(start + step * F.col("place"))
    return placed.withColumn("copies", copies.cast("long")).drop("no_source", "source_name", "bin", "mixed", "slice", "place", "k")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    narrow = docs.select("doc_id", "source", spread_key(F.col("doc_id"), F.col("text")).alias("spread"), word_count(F.col("text")).alias("size"))
    return copies_of(narrow, **options).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, most: int = 4096, **options) -> DataFrame:
    """Every row of docs as often as the mix takes it.

    Rows are found again by a hash of all their columns; rows equal in all of them collapse before they move, and come out
    as often as they are taken together. One that is taken over `most` times is dealt over several tasks.
    """
    rows = keyed_rows(docs)
    doc = lambda c: F.col(f"row.{c}")
    narrow = rows.select("k1", "k2", spread_key(doc("doc_id"), doc("text")).alias("spread"), doc("source").alias("source"), word_count(doc("text")).alias("size"))
    counts = materialise(copies_of(narrow, **options).where("copies > 0").groupBy("k1", "k2").agg(F.sum("copies").cast("int").alias("copies")))
    taken = rows.dropDuplicates(["k1", "k2"]).join(counts, ["k1", "k2"]).select("row", "copies")
    often = taken.where(F.col("copies") <= most)
    if counts.where(F.col("copies") > most).head(1):
        parts = F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(most)))
        dealt = taken.where(F.col("copies") > most).withColumn("part", parts).repartition("part")
        often = often.unionByName(dealt.select("row", F.least(F.lit(most), F.col("copies") - F.col("part")).alias("copies")))
    return often.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
