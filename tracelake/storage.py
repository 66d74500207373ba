"""Intermediate tables in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir; on a single machine, below a temporary folder where none is set. release() deletes it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = at or "file://" + tempfile.mkdtemp(prefix="tracelake-")
    _made.append(f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and read back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def streamed(df: DataFrame, what: str) -> DataFrame:
    """All that a streaming DataFrame gives of what its source holds now, as a table."""
    spark = df.sparkSession
    path, checkpoint = new_path(spark, what), new_path(spark, f"{what}-state")
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes what was made since a mark(). Call it when the results that use it are written."""
    gone = _made[since:]
    del _made[since:]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
