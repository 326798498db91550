"""Exact duplicates by an extendible-hash index whose pages and buckets are files of the shared folder.

Texts are equal when they are identical after lower-casing A-Z. One pass over the texts writes the index's pages: a narrow
row for each document, and each text once for each task that met it, with the number of its copies there. The directory
starts with one bucket and doubles while a bucket holds more bytes than it has room for, so that it ends as contiguous
ranges of 64-bit hashes. Each owner task gets a range of buckets, reads its texts in the order of their hashes, chains
texts of one hash and compares them byte by byte. Documents then take their group's result by the text's SHA-256; the
owners make sure that one SHA-256 means one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship_package, spread_join

#: Lower-cases A-Z in UTF-8; no byte of a longer character is touched.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The directory has at most 2 ** MOST_DEPTH slots; this many counts come to the driver.
MOST_DEPTH = 16
#: Bytes of text for which a bucket has room before it is split.
ROOM = 64 << 20
#: Bytes of text that a task holds to count its copies before it writes them.
HELD = 32 << 20
#: Bytes of text in one Arrow batch that a task hands on.
BATCH = 8 << 20

_PAGES = "doc_id long, pos long, h long, digest binary, norm binary, n long, keep_id long, keep_pos long"
_PAGES_ARROW = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("h", pa.int64()), ("digest", pa.binary()), ("norm", pa.binary()), ("n", pa.int64()), ("keep_id", pa.int64()), ("keep_pos", pa.int64())])
_GROUPS = "bucket int, h long, chain int, digest binary, n long, keep_id long, keep_pos long"
_GROUPS_ARROW = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("chain", pa.int32()), ("digest", pa.binary()), ("n", pa.int64()), ("keep_id", pa.int64()), ("keep_pos", pa.int64())])


def _stays(one: tuple, other: tuple) -> tuple:
    """Of two (id, position) the one that stays: the larger id, null last; among equal ids the earlier position."""
    return max(one, other, key=lambda x: (x[0] is not None, x[0] or 0, -x[1]))


def _write_pages(log: int, held: int, batch: int):
    """Task: a row without text for each document, and now and then the texts met so far, each once, with their copies."""

    def entries(met: dict) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for (h, norm), (digest, n, (keep_id, keep_pos)) in met.items():
            rows.append((None, None, h, digest, norm, n, keep_id, keep_pos))
            size += len(norm)
            if size >= batch:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGES_ARROW, strict=True)], schema=_PAGES_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGES_ARROW, strict=True)], schema=_PAGES_ARROW)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = log << 55 | TaskContext.get().partitionId() << 33
        met: dict = {}
        size = 0
        for got in batches:
            members = []
            for doc_id, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                norm = (text or b"").translate(LOWER)
                h = xxhash.xxh64_intdigest(norm) - (1 << 63)
                seen = met.get((h, norm))
                if seen is None:
                    digest = hashlib.sha256(norm).digest()
                    met[h, norm] = (digest, 1, (doc_id, pos))
                    size += len(norm) + 300
                else:
                    digest = seen[0]
                    met[h, norm] = (digest, seen[1] + 1, _stays(seen[2], (doc_id, pos)))
                members.append((doc_id, pos, h, digest))
                pos += 1
                if size >= held:
                    yield from entries(met)
                    met, size = {}, 0
            if members:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*members, strict=True), _PAGES_ARROW, strict=False)]
                yield pa.record_batch(columns + [pa.nulls(len(members), f.type) for f in list(_PAGES_ARROW)[4:]], schema=_PAGES_ARROW)
        yield from entries(met)

    return task


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: texts come in the order of their hashes; those of one hash are chained and compared byte by byte."""

    def groups(bucket: int, h: int, chain: list) -> Iterator[tuple]:
        if len({x[1] for x in chain}) < len(chain):
            raise RuntimeError("two different texts have one SHA-256")
        for k, (_, digest, n, (keep_id, keep_pos)) in enumerate(chain):
            yield bucket, h, k, digest, n, keep_id, keep_pos

    at, chain = (None, None), []
    for got in batches:
        out = []
        for bucket, h, digest, norm, n, keep_id, keep_pos in zip(*(c.to_pylist() for c in got.columns), strict=True):
            if (bucket, h) != at:
                out += groups(*at, chain)
                at, chain = (bucket, h), []
            for k, (text, own, m, stays) in enumerate(chain):
                if text == norm:
                    chain[k] = (text, own, m + n, _stays(stays, (keep_id, keep_pos)))
                    break
            else:
                chain.append((norm, digest, n, (keep_id, keep_pos)))
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _GROUPS_ARROW, strict=True)], schema=_GROUPS_ARROW)
    if chain:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*groups(*at, chain), strict=True), _GROUPS_ARROW, strict=True)], schema=_GROUPS_ARROW)


def split_directory(load: list[int], room: int) -> list[tuple[int, int, int]]:
    """Buckets (first slot, local depth, load) for the loads of all finest slots, of which there is a power of two.

    The directory doubles whenever a bucket that only one slot leads to is overfull; such a bucket is split by the next
    bit. A bucket of one finest slot isn't split further: it keeps what it has.
    """
    most = (len(load) - 1).bit_length()
    before = [0]
    for x in load:
        before.append(before[-1] + x)
    depth, slots = 0, [(0, 0)]  # of the directory; each slot's bucket as (first finest slot, local depth)
    while True:
        size = {b: before[b[0] + (1 << most - b[1])] - before[b[0]] for b in slots}
        over = {b for b, x in size.items() if x > room and b[1] < most}
        if not over:
            return [(*b, size[b]) for b in dict.fromkeys(slots)]
        if any(local == depth for _, local in over):
            slots, depth = [b for b in slots for _ in range(2)], depth + 1
        for s, (first, local) in enumerate(slots):
            if (first, local) in over:
                half = s >> depth - local - 1 & 1
                slots[s] = (first + half * (1 << most - local - 1), local + 1)


@dataclass
class ExactIndex:
    """pages: folders of rows and texts, one for each load; directory: slot, bucket, depth, owner; groups: one row a text."""

    spark: SparkSession
    pages: list[DataFrame] = field(default_factory=list)
    directory: DataFrame | None = None
    groups: DataFrame | None = None

    def all_pages(self) -> DataFrame:
        out = self.pages[0]
        for more in self.pages[1:]:
            out = out.unionAll(more)
        return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", onto: ExactIndex | None = None, room: int = ROOM, most_depth: int = MOST_DEPTH, held: int = HELD) -> ExactIndex:
    """Index of all rows of docs, which are added to the rows of `onto` if it is given.

    Copies within a task are counted there, so a text that a third of all rows share reaches its owner once a task. A
    null text counts as empty. `most_depth` bounds the directory and the counts that the driver sees (2 ** most_depth);
    buckets that are still overfull at that depth are read in order as they are. Tasks hold `held` bytes of text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    done = onto or ExactIndex(spark)
    log = len(done.pages)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    pages = materialise(rows.mapInArrow(_write_pages(log, held, BATCH), _PAGES), compression="zstd")
    index = ExactIndex(spark, [*done.pages, pages])
    slot = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - most_depth).cast("int")
    entries = index.all_pages().where("norm is not null").withColumn("slot", slot)
    load = [0] * (1 << most_depth)
    for r in entries.groupBy("slot").agg(F.sum(F.length("norm") + F.lit(100)).alias("load")).collect():
        load[r.slot] = r.load
    buckets = split_directory(load, room)
    table, owner, filled = [], 0, 0
    for k, (first, depth, size) in enumerate(buckets):
        if filled and filled + size > room:
            owner, filled = owner + 1, 0
        filled += size
        table += [(s, k, depth, owner) for s in range(first, first + (1 << most_depth - depth))]
    columns = dict(zip(("slot", "bucket", "depth", "owner"), map(list, zip(*table, strict=True)), strict=True))
    index.directory = materialise(spark.createDataFrame(pa.table(columns, schema=pa.schema([(c, pa.int32()) for c in columns]))))
    # The directory has at most 2 ** most_depth rows.
    owned = entries.join(F.broadcast(index.directory), "slot").repartitionById(owner + 1, "owner").sortWithinPartitions("bucket", "h")
    index.groups = materialise(owned.select("bucket", "h", "digest", "norm", "n", "keep_id", "keep_pos").mapInArrow(_own, _GROUPS))
    return index


def members(index: ExactIndex) -> DataFrame:
    """One row for each document: doc_id, keep_id (the largest id of its group), group_size, kept, text_sha256, bucket.

    Null ids are smaller than all others; of a group without ids keep_id is null. Of rows equal in text and id one has kept.
    """
    rows = index.all_pages().where("norm is null").select("doc_id", "pos", "digest")
    groups = index.groups.select("digest", "n", F.col("n").alias("group_size"), "keep_id", "keep_pos", "bucket")
    found = spread_join(rows, groups, "digest", rows.count())
    return found.select("doc_id", "keep_id", "group_size", (F.col("pos") == F.col("keep_pos")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "bucket")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """members() of an index of docs. Other columns are not read; an empty table gives an empty result."""
    return members(build_index(docs, id_col, text_col, **sizes))
