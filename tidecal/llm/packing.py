"""Packing by optimal length buckets: boundaries that minimise padding, then token-budget batches inside each bucket.

Rows of at most `budget` tokens fall into buckets. Dynamic programming on the driver over the exact histogram of their
lengths, which has budget + 1 steps at most for any corpus, finds the boundaries with the least padding of all choices; every
boundary is the length of a row. Batches hold as many rows as the budget has room for at the bucket's length. A row of more
tokens than the budget is a batch by itself and is not padded; these rows form one last bucket.

Defined cases: a null or empty text has 0 tokens and goes to the lowest bucket. Repeated rows are packed each. A null id is
scattered by its text instead. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, number_within, scatter, slices_for, spread_key, word_count

BUCKETS = 16
BUDGET = 65_536


def best_boundaries(steps: list[int], rows: list[int], tokens: list[int], buckets: int) -> list[int]:
    """At most `buckets` boundaries out of ascending steps, the last one included, with the least padding in all."""
    n = len(steps)
    if not n:
        return []
    top = np.array(steps, dtype=np.float64)
    c = np.concatenate([[0.0], np.cumsum(np.array(rows, dtype=np.float64))])
    t = np.concatenate([[0.0], np.cumsum(np.array(tokens, dtype=np.float64))])
    best = top * c[1:] - t[1:]  # one bucket up to each step
    back = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        following, came = best.copy(), np.full(n, -1, dtype=np.int64)
        # The best last boundary never moves back as j grows, so the middle j bounds the search on both its sides.
        todo = [(1, n - 1, 0, n - 2)]
        while todo:
            first, last, low, high = todo.pop()
            if first > last:
                continue
            j = (first + last) // 2
            end = min(high, j - 1)
            cost = best[low : end + 1] + top[j] * (c[j + 1] - c[low + 1 : end + 2]) - (t[j + 1] - t[low + 1 : end + 2])
            i = int(np.argmin(cost))
            if cost[i] < following[j]:
                following[j], came[j] = cost[i], low + i
            todo += [(first, j - 1, low, low + i), (j + 1, last, low + i, high)]
        back.append(came)
        best = following
    chosen, j, k = [], n - 1, len(back) - 1
    while True:
        while k > 0 and back[k][j] < 0:
            k -= 1
        chosen.append(steps[j])
        if k == 0:
            break
        j, k = int(back[k][j]), k - 1
    return chosen[::-1]


def length_buckets(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> list[int]:
    """Boundaries for a table with n_tokens."""
    table = lengths.where(F.col("n_tokens") <= budget).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).orderBy("n_tokens").collect()
    return best_boundaries([r.n_tokens for r in table], [r.rows for r in table], [r.rows * r.n_tokens for r in table], buckets)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch (from 0 in its bucket), batch_rows (room) and padding of every row."""
    lengths = docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"), spread_key(F.col("doc_id"), F.col("text")).alias("spread"))
    lengths = materialise(lengths)
    bounds = length_buckets(lengths, buckets, budget)
    bucket, top = F.lit(len(bounds)), F.col("n_tokens")
    for k in range(len(bounds) - 1, -1, -1):
        bucket, top = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(bucket), F.when(F.col("n_tokens") <= bounds[k], F.lit(bounds[k]).cast("long")).otherwise(top)
    slices = slices_for(lengths.count())
    rows = lengths.withColumns({"bucket": bucket, "bucket_len": top, "slice": scatter(F.col("spread"), slices)})
    rows = number_within(rows, ["bucket"], ["slice"], ["doc_id", "n_tokens"], "place")
    room = F.greatest(F.lit(1), F.floor(budget / F.greatest("bucket_len", F.lit(1)))).cast("long")
    rows = rows.withColumn("batch_rows", room)
    return rows.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("place") / F.col("batch_rows")).cast("long").alias("batch"), "batch_rows", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
