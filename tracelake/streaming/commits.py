"""A table that several writers change at once: an optimistic commit log.

A commit is a Parquet folder of changed rows and one numbered file in the log, which names it. The number is taken
by creating that file, which only one writer can: the others read the new state and decide again. Readers take the rows of all
commits up to a version and keep the latest of each key, so a folder without a log file, as a failed or slower writer leaves it, is
never seen. Every ``COMPACT`` commits the state is written as a snapshot; rows that are done for good are apart in it and need not be
read any more.

On local folders a number is taken by a hard link, elsewhere by a rename that fails where the name exists, as on HDFS. Object
stores whose rename replaces files don't fit.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPACT, TRIES = 20, 100


class Conflict(RuntimeError):
    """Another writer was faster, again and again."""


class CommitLog:
    """Rows of ``schema`` with a key, under one folder."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, done: Column):
        """``done``: rows that no later commit changes."""
        self.spark, self.path, self.schema, self.key, self.done = spark, path.rstrip("/"), schema, key, done
        self.stored = T.StructType([*schema.fields, T.StructField("__version", T.LongType())])
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("log").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._at("log")):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(self._at("log")))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def entry(self, version: int) -> dict:
        stream = self._fs().open(self._at(f"log/{version:020}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def history(self) -> list[dict]:
        """What the commits say, oldest first."""
        return [self.entry(v) | {"version": v} for v in self.versions()]

    def _take(self, version: int, entry: dict) -> bool:
        """True if this writer gets the number."""
        final = self._at(f"log/{version:020}.json")
        fs = self._fs()
        fs.mkdirs(final.getParent())
        staged = self._at(f"log/.{uuid.uuid4().hex}")
        data = json.dumps(entry).encode()
        if fs.getUri().getScheme() == "file":
            here, there = (p.toUri().getPath() for p in (staged, final))
            with open(here, "xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(here, there)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(here)
        return self._take_by_rename(staged, final, data)

    def _take_by_rename(self, staged, final, data: bytes) -> bool:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        stream = self._fs().create(staged, False)
        stream.write(data)
        stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(staged, final, options)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            context.delete(staged, False)
            return False

    def read(self, version: int | None = None, open_only: bool = False) -> DataFrame:
        """The latest row of each key; ``open_only`` leaves out rows that were done at the last snapshot."""
        versions = [v for v in self.versions() if version is None or v <= version]
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        # Snapshots lie beside the log under their version; the last whole one and what came after it are read.
        snapshot = max((v for v in self.snapshots() if v <= versions[-1]), default=0)
        parts = [self.entry(v)["data"] for v in versions if v > snapshot]
        rows = self.spark.createDataFrame([], self.stored)
        if parts:
            rows = self.spark.read.schema(self.stored).parquet(*[f"{self.path}/{p}" for p in parts])
            rows = self._latest(rows)
        if snapshot:
            base = self.spark.read.schema(T.StructType([*self.stored.fields, T.StructField("__done", T.BooleanType())])).parquet(f"{self.path}/snapshots/{snapshot:020}")
            base = (base.filter("not __done") if open_only else base).drop("__done")
            rows = self._latest(base.unionByName(rows))
        return rows.drop("__version")

    def _latest(self, rows: DataFrame) -> DataFrame:
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.stored.names), "__version").alias("r"))
        return last.select("r.*")

    def snapshots(self) -> list[int]:
        fs, at = self._fs(), self._at("snapshots")
        if not fs.exists(at):
            return []
        whole = [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(self._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(n) for n in whole if n.isdigit())

    def compact(self, version: int) -> None:
        """Writes the state at a version as a snapshot. Of two writers that do so at once one is too late, with the same rows."""
        staged = f"{self.path}/snapshots/.{uuid.uuid4().hex}"
        rows = self.read(version).withColumn("__version", F.lit(version).cast("long"))
        rows.withColumn("__done", F.coalesce(self.done, F.lit(False))).write.partitionBy("__done").parquet(staged)
        fs, final = self._fs(), self._at(f"snapshots/{version:020}")
        path = self._jvm.org.apache.hadoop.fs.Path(staged)
        if fs.exists(final) or not fs.rename(path, final):
            fs.delete(path, True)

    def change(self, decide: Callable[[DataFrame], DataFrame], info: dict | None = None, open_only: bool = True, tell: Callable[[DataFrame], dict] | None = None) -> DataFrame | None:
        """Commits the rows that ``decide`` makes of the state; None if there are none. It is asked again when another writer was faster.

        ``tell`` adds to the entry what it says of these rows.
        """
        fs = self._fs()
        for _ in range(TRIES):
            version = max(self.versions(), default=0) + 1
            data = f"data/{uuid.uuid4().hex}"
            rows = decide(self.read(version - 1, open_only)).select(*self.schema.names).withColumn("__version", F.lit(version).cast("long"))
            rows.write.parquet(f"{self.path}/{data}")
            changed = self.spark.read.schema(self.stored).parquet(f"{self.path}/{data}").drop("__version")
            n = changed.count()
            if n and self._take(version, {"data": data, "rows": n, **(info or {}), **(tell(changed) if tell else {})}):
                if version % COMPACT == 0:
                    self.compact(version)
                return changed
            fs.delete(self._at(data), True)
            if not n:
                return None
        raise Conflict(f"{self.path}: {TRIES} commits of others came first")
