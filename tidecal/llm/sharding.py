"""Weighted rendezvous hashing of record keys over shards.

Slots are numbered in slices of scattered ids, so a shard's rows are numbered in many tasks whatever the ids look like.

Defined cases: a null text has no bytes; a null key hashes like any other value, so all null keys meet in one shard, where
their texts scatter them over the slices. Repeated rows go to the same shard and get slots of their own. Empty tables give
empty tables. Extra columns are ignored by shard_documents() and kept by assign_shards(), which adds its two columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, number_within, scatter, slices_for, spread_key

#: A prime below 2 ** 31: products of two residues fit a long.
PRIME = 2_147_483_647


def key_residue(key: Column, kind: str) -> Column:
    """A key as a residue: integers by themselves, any other type by its hash; null as 0."""
    number = key.cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    return F.coalesce(F.pmod(number, F.lit(PRIME)), F.lit(0))


def draw(residue: Column, shard: int) -> Column:
    """A number in 0 .. PRIME - 1 decided by key and shard; two multiply-and-fold steps."""
    first = (residue + F.lit(1 + (shard + 1) * 40_503_001 % PRIME)) % PRIME * F.lit(48_271 + 2 * shard) % PRIME
    folded = first.bitwiseXOR(F.shiftright(first, 15)) * F.lit(1_812_433_253 % PRIME) % PRIME
    return folded.bitwiseXOR(F.shiftright(folded, 13)) * F.lit(69_621) % PRIME


def score(residue: Column, shard: int, weight: float) -> Column:
    """Highest wins; a shard of twice the weight wins twice as often."""
    return F.lit(float(weight)) / -F.log((draw(residue, shard) + 1) / float(PRIME + 1))


def winner(residue: Column, weights: Sequence[float]) -> Column:
    """The shard that wins a key; equal scores go to the larger number. With equal weights the draws are compared themselves."""
    even = len(set(weights)) == 1
    bids = [F.struct((draw(residue, k) if even else score(residue, k, w)).alias("s"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    return (F.greatest(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Adds shard and, where grown is given, grown_shard for those weights."""
    held = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), key_residue(F.col(key), dict(df.dtypes)[key]).alias("residue"))
    new = {"shard": winner(F.col("residue"), weights)} | ({"grown_shard": winner(F.col("residue"), grown)} if grown else {})
    return held.select(*[F.col(f"row.{c}").alias(c) for c in df.columns if c not in new], *[value.alias(name) for name, value in new.items()])


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard with one shard more, of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), spread_key(F.col("doc_id"), F.col("text")).alias("spread"))
    placed = assign_shards(rows, "doc_id", [1.0] * shards, [1.0] * (shards + 1))
    placed = materialise(placed.withColumn("slice", scatter(F.col("spread"), slices_for(docs.count(), least=64))))
    placed = number_within(placed, ["shard"], ["slice"], ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
