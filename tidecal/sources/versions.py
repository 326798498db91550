"""A log that is replaced atomically: versions as lists of folders, and a pointer file for each that is created last.

    data/load=<version>/<key>=<value>/...   rows of one batch, written once and never changed
    pointers/<version>.json                 folders that make up the version, and the last batch of each stream

A batch replaces the rows whose every key occurs in it, be it in different rows (evaluation.append_log()'s meaning). Rows
are kept in folders by key, so a batch writes its own rows alone: replaced folders are left out of the new pointer. The
version is there once its pointer is; a crash before that leaves the last one as it was, and two writers of one version
can't both create its pointer.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConflictError(RuntimeError):
    """Another writer created the version first."""


@dataclass
class Version:
    """number (0: nothing written yet), folders below data, by load, and for each stream its last batch."""

    number: int = 0
    folders: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)


class VersionedLog:
    """The log at a path, in any file system that Spark reads. keys: columns of the folders; defaults fill their nulls."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("made_on", "source"), defaults: dict[str, str] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.defaults = {"source": "live"} if defaults is None and "source" in keys else defaults or {}

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def version(self) -> Version:
        """The latest version that has a pointer."""
        found = [n for n in self._names(f"{self.path}/pointers") if n.endswith(".json") and n[:-5].isdigit()]
        if not found:
            return Version()
        fs, where = self._fs(f"{self.path}/pointers/{found[-1]}")
        stream = fs.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _point(self, new: Version) -> None:
        """Create the pointer, which makes the version; it is never overwritten."""
        fs, where = self._fs(f"{self.path}/pointers/{new.number:012d}.json")
        try:
            stream = fs.create(where, False)
        except Exception as e:
            if "exists" in str(e).lower():
                raise ConflictError(f"version {new.number} is there already") from e
            raise
        try:
            stream.write(json.dumps(vars(new)).encode())
        finally:
            stream.close()

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of the latest version (or of one that was seen before); None where nothing is written."""
        now = self.version() if number is None else self._version_of(number)
        if not now.folders:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", True).parquet(*[f"{self.path}/data/{f}" for f in now.folders])
        return rows.drop("load")

    def _version_of(self, number: int) -> Version:
        fs, where = self._fs(f"{self.path}/pointers/{number:012d}.json")
        stream = fs.open(where)
        try:
            return Version(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def replace(self, batch: DataFrame, stream: str | None = None, batch_id: int | None = None) -> bool:
        """Put a batch in: all folders whose every key value occurs in it go, its own are added. True if it was put in.

        With stream and batch_id a batch that was put in before changes nothing. An empty batch is noted in its stream.
        """
        now = self.version()
        if stream is not None and batch_id is not None and batch_id <= now.batches.get(stream, -1):
            return False
        new = Version(now.number + 1, list(now.folders), dict(now.batches))
        load = f"load={new.number}"
        rows = batch.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in self.defaults.items()})
        # A crash may have left this load's folder without a pointer: it is nobody's, and is overwritten.
        rows.write.mode("overwrite").partitionBy(*self.keys).parquet(f"{self.path}/data/{load}")
        own = self._leaves(f"{self.path}/data/{load}", load, len(self.keys))
        held = [{part for f in own if (part := f.split("/")[1 + k])} for k in range(len(self.keys))]
        new.folders = [f for f in now.folders if not all(part in seen for part, seen in zip(f.split("/")[1:], held))] + own
        if stream is not None and batch_id is not None:
            new.batches[stream] = batch_id
        self._point(new)
        return True

    def _leaves(self, path: str, name: str, depth: int) -> list[str]:
        if not depth:
            return [name]
        return [leaf for n in self._names(path) if "=" in n for leaf in self._leaves(f"{path}/{n}", f"{name}/{n}", depth - 1)]

    def writer(self, stream: str):
        """For DataStreamWriter.foreachBatch: each batch is put in once, however often it is delivered."""

        def put(batch: DataFrame, batch_id: int) -> None:
            self.replace(batch, stream, batch_id)

        return put
