"""What the operators of this subpackage share: shared storage, salted ranks and packed columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: What written() and in_parts() have made, for release().
_made: dict[str, list[str]] = {"paths": [], "tables": []}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set on a single machine (tests), a temporary one.

    On a cluster an unset folder is an error: a machine's own folder would lose other executors' files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def made(path: str | None = None, table: str | None = None) -> None:
    """Notes an intermediate folder or table for release()."""
    _made["paths"] += [path] if path else []
    _made["tables"] += [table] if table else []


def written(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and read back from the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    made(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> tuple[int, int]:
    """The intermediates made so far, for release()."""
    return len(_made["paths"]), len(_made["tables"])


def release(spark: SparkSession, since: tuple[int, int] = (0, 0)) -> None:
    """Deletes the intermediate folders and tables made since a mark(). Call it when the results that use them are written."""
    paths, tables = _made["paths"][since[0] :], _made["tables"][since[1] :]
    del _made["paths"][since[0] :], _made["tables"][since[1] :]
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def column_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores before it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


#: Keys up to which a table of keys is broadcast whole, rows beyond which one is hot, and hot ones at most.
FEW_KEYS, HOT_ROWS, MOST_HOT = 150_000, 1 << 16, 100_000


def joined_by_key(rows: DataFrame, table: DataFrame, key: str | list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, which has one row for each key and in ``size`` how many rows have it.

    A table of at most FEW_KEYS keys is broadcast. Of a larger one the hot keys are, those of more than HOT_ROWS rows or
    of more than one row in MOST_HOT, so there are never more than MOST_HOT; their rows stay where they are, and only
    the others are shuffled.
    """
    key = [key] if isinstance(key, str) else key
    table = written(table, "keys")
    n, total = table.agg(F.count("*"), F.sum(size)).first()
    if n <= FEW_KEYS:
        return rows.join(F.broadcast(table), key, how)
    most = max(HOT_ROWS, total // MOST_HOT)
    hot = table.filter(F.col(size) > most)
    others = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(table.filter(F.col(size) <= most), key, how))


def gapless_rank(df: DataFrame, group: list[str], order: list[Column], rank: str, cells: int = 1024, spread: list[Column] | None = None) -> DataFrame:
    """Adds ``rank``: 0, 1, 2 .. within each group, though no task sees a whole group.

    The rows of a group are dealt into ``cells`` cells; the cells' counts (at most ``cells`` rows a
    group) give the number at which each begins, and only a cell is sorted. ``spread`` are the values
    by which rows are dealt. The numbers follow the cells, then ``order``.
    """
    spread = spread or [F.col(c) for c in df.columns]
    cell, count, base = column_name(df, "cell"), column_name(df, "cell_rows"), column_name(df, "cell_base")
    dealt = df.withColumn(cell, F.pmod(F.xxhash64(*spread), F.lit(cells)).cast("int"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*group, cell).agg(F.count("*").alias(count)).withColumn(base, F.coalesce(F.sum(count).over(before), F.lit(0)))
    bases = bases.select(*[F.col(c).alias(f"__{c}") for c in [*group, cell]], base)
    same = [dealt[c].eqNullSafe(bases[f"__{c}"]) for c in [*group, cell]]
    within = Window.partitionBy(*group, cell).orderBy(*order)
    out = dealt.join(bases, same).withColumn(rank, F.col(base) + F.row_number().over(within) - 1)
    return out.drop(cell, base, *[f"__{c}" for c in [*group, cell]])


def trimmed(f, *arguments):
    """f(*arguments); then memory that it has freed goes back to the system, as Python workers stay for later tasks."""
    out = f(*arguments)
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    return out


def planes(values: np.ndarray) -> bytes:
    """The bytes of a number column, first all low bytes, then all second ones: Spark's codec shrinks the high ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def sorted_planes(values: np.ndarray) -> bytes:
    """planes() of the steps between ascending values."""
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def unsorted_planes(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unplanes(data, dtype), dtype=dtype)
