"""A bounded sample of labelled documents for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_hashed(ids: DataFrame, seed: str, wanted: int, known: int) -> list[int]:
    """The `wanted` doc_ids with the least hash, out of `known` rows.

    Only hashes below a bound are sorted. The bound lets through about twice the ids wanted, wherever they lie, so what
    the tasks send to the driver doesn't grow with their number.
    """
    spot, room = F.xxhash64("doc_id", F.lit(seed)), 2 * wanted + 100
    if known > room:
        ids = ids.where(spot < -(1 << 63) + (1 << 64) * room // known)
    return [r.doc_id for r in ids.orderBy(spot, "doc_id").limit(wanted).collect()]


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the id's text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: Stretches, evenly spaced from its first to its last character, that stand for a text over most_chars.
STRETCHES = 20


def bounded(text: Column, most_chars: int) -> Column:
    """The whole text, or STRETCHES evenly spaced parts of it on lines of their own, together most_chars code points at most."""
    size = max(1, most_chars // STRETCHES - 1)
    step = (F.char_length(text) - size) / F.lit(STRETCHES - 1)
    parts = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.substr(text, F.floor(k * step).cast("int") + 1, F.lit(size)))
    return F.when(F.char_length(text) <= most_chars, text).otherwise(F.array_join(parts, "\n"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_chars: int, modulus: int, remainder: int) -> list[tuple[str, int, float]]:
    """At most `rows` (text, label, weight), the same on every run: of each class, the half of `rows` with the least hash of the id.

    The weight is the number of labelled documents of the class for each one drawn. Ids are drawn from the narrow labels
    first; only their texts come to the driver. Of a text over most_chars code points, parts from all over it are learned
    from (it is scored whole like all others), so the sample holds rows * most_chars characters at most. An id with both
    labels is not learned from. Of several texts of one id the one with the least hash is taken; a null label or id counts as no label.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(modulus, remainder)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("high"))
    known = known.where("y = high").select("doc_id", "y")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn: dict[int, int] = {}
    for y, size in sizes.items():
        drawn |= dict.fromkeys(least_hashed(known.where(F.col("y") == y), "sample", rows // 2, size), y)
    if not drawn:
        return []
    theirs = docs.select("doc_id", "text").where(F.col("doc_id").isin(list(drawn)) & F.col("text").isNotNull())
    found = theirs.select("doc_id", bounded(F.col("text"), most_chars).alias("text")).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).collect()
    here = {y: sum(drawn[r.doc_id] == y for r in found) for y in sizes}
    return [(r.text, drawn[r.doc_id], sizes[drawn[r.doc_id]] / here[drawn[r.doc_id]]) for r in sorted(found, key=lambda r: r.doc_id)]
