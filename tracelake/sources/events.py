"""JSON-lines event files: split, hashed, numbered, validated and normalised.

A file is known by the SHA-256 of its bytes and a line by its number, so rereading a file gives the same event
ids. Lines are split at line feeds only. Files are read in byte ranges, by as many tasks as Spark makes of them: a line's
number is its place in its range and the number of lines in the ranges before, from one count for each range. A file's hash
can only be taken in order; it is computed by a task of its own that streams the lines and keeps none. A file with any invalid line is
left out as a whole and reported. Duplicate keys within a line and bytes that aren't UTF-8 count as invalid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import utc_text, utc_timestamp
from ..storage import new_path, written

TEXT_FIELDS = ("host", "channel", "provider")
NUMBER_FIELDS = ("event_id", "record_id")
#: Ranges or files up to which a table of them is broadcast.
FEW = 100_000
BOM = b"\xef\xbb\xbf"


@dataclass
class Ingested:
    events: DataFrame
    errors: DataFrame
    sources: DataFrame


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, source_sha256) of each file that has a line, as a written table: a task for each file, which reads it as a stream."""
    whole = spark.newSession()  # in which no file is split and no two are read by one task
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        whole.conf.set(key, str(1 << 60))
    rows = whole.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = size = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                file, size, done = batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), 0
                # The reader leaves out a byte order mark at the begin; whether there was one shows in the size.
                plain, marked = hashlib.sha256(), hashlib.sha256(BOM)
            else:
                plain.update(b"\n"), marked.update(b"\n")
                done += 1
            data = b"\n".join(batch.column(2).to_pylist())
            plain.update(data), marked.update(data)
            done += len(data)
        if file is not None:
            missing = size - done
            for sha in (plain, marked):
                sha.update(b"\n" * (missing % len(BOM)))
            yield pa.RecordBatch.from_pydict({"file": [file], "source_sha256": [(marked if missing >= len(BOM) else plain).hexdigest()]})

    at = new_path(spark, "digests")
    rows.mapInArrow(run, "file string, source_sha256 string").write.parquet(at)
    return spark.read.schema("file string, source_sha256 string").parquet(at)


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= FEW else table


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_sha256, source_line, raw) of all lines that aren't blank."""
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("place"))
    # The lines of a range follow each other in one task.
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("file", "range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ranges = written(ranges.select("file", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before")), "ranges")
    numbered = rows.join(_small(ranges), ["file", "range"]).join(_small(digests(spark, path)), "file")
    number = F.col("place") - F.col("first") + F.col("lines_before") + 1
    raw = F.regexp_replace(F.when(number == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")), "\r$", "")
    out = numbered.select(F.col("file").alias("path"), "source_sha256", number.cast("long").alias("source_line"), F.when(F.is_valid_utf8("value"), raw).otherwise(F.col("value")).alias("raw"))
    return out.filter(F.trim("raw") != "")


def parsed(rows: DataFrame) -> DataFrame:
    """rows with the event's columns and error (null for a valid line)."""
    v = F.try_parse_json(F.when(F.is_valid_utf8("raw"), F.col("raw")))
    get = lambda k, t: F.try_variant_get("v", f"$.{k}", t)
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")), F.lit("VOID"))
    out = rows.withColumn("v", v)
    for k in ("timestamp", *TEXT_FIELDS):
        out = out.withColumn(k, F.when(kind(k) == "STRING", get(k, "string")))
    for k in NUMBER_FIELDS:
        out = out.withColumn(k, F.when(kind(k) == "BIGINT", get(k, "long")))
    data = F.when(kind("event_data").startswith("OBJECT"), F.try_variant_get("v", "$.event_data", "map<string,variant>"))
    out = out.withColumn("__data", data).withColumn("timestamp", utc_timestamp(F.col("timestamp")))
    error = (
        F.when(~F.is_valid_utf8("raw"), F.lit("not UTF-8"))
        .when(F.col("v").isNull(), F.lit("not a JSON value"))
        .when(F.col("timestamp").isNull(), F.lit("timestamp needs ISO-8601 with a zone"))
        .when(F.coalesce(*[F.when(F.coalesce(F.trim(k), F.lit("")) == "", F.lit(True)) for k in TEXT_FIELDS], F.lit(False)), F.lit("host, channel and provider must be texts"))
        .when(F.coalesce(F.col("event_id"), F.lit(-1)) < 0, F.lit("event_id must be a whole number"))
        .when(F.coalesce(F.col("record_id"), F.lit(-1)) < 0, F.lit("record_id must be a whole number"))
        .when(F.col("__data").isNull() | F.exists(F.map_values("__data"), lambda x: x.isNull() | (F.coalesce(F.schema_of_variant(x), F.lit("VOID")) != "STRING")), F.lit("event_data must map names to texts"))
    )
    text = F.transform_values("__data", lambda k, x: F.try_variant_get(x, "$", "string"))
    out = out.withColumn("error", error).withColumn("event_data", F.when(F.col("error").isNull(), text))
    return out.withColumn("event_uid", F.sha2(F.concat_ws(":", "source_sha256", "source_line"), 256)).withColumnRenamed("raw", "original_json").drop("v", "__data")


COLUMNS = ("event_uid", "source_sha256", "source_line", "timestamp", "host", "channel", "provider", "event_id", "record_id", "event_data", "original_json")


def ingest(spark: SparkSession, path: str, known: DataFrame | None = None) -> Ingested:
    """The events of the files at path that aren't in ``known`` (source_sha256), with errors and sources."""
    rows = parsed(lines(spark, path))
    rows = rows if known is None else rows.join(known.select("source_sha256").distinct(), "source_sha256", "left_anti")
    errors = rows.filter("error is not null").select("path", "source_sha256", "source_line", "error")
    good = rows.join(errors.select("source_sha256").distinct(), "source_sha256", "left_anti")
    events = good.dropDuplicates(["source_sha256", "source_line"]).select(*COLUMNS)
    sources = good.groupBy("source_sha256").agg(F.min("path").alias("path"), F.count_distinct("source_line").alias("event_count"))
    return Ingested(events, errors, sources)


def search(events: DataFrame, host=None, user=None, start=None, end=None, event_id=None, term=None, limit: int | None = None) -> DataFrame:
    """Events by host, number and time, which reach the scan, and by user or text, in canonical order."""
    out = events
    if host is not None:
        out = out.filter(F.col("host") == host)
    if event_id is not None:
        out = out.filter(F.col("event_id") == event_id)
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if user is not None:
        names = F.array(*[F.lower(F.col("event_data")[k]) for k in ("User", "TargetUserName", "SubjectUserName")])
        out = out.filter(F.exists(names, lambda x: x == user.lower()))
    if term is not None:
        out = out.filter(F.lower("original_json").contains(term.lower()))
    out = out.orderBy("timestamp", "source_sha256", "source_line")
    return out if limit is None else out.limit(limit)


#: Fields that the flat log line carries on its top level.
FLAT_FIELDS = ("TargetUserName", "TargetDomainName", "IpAddress", "LogonType", "User", "Image", "CommandLine", "ParentImage", "DestinationIp", "ProcessGuid")


#: What stands for an event in evidence.
ANCHOR = ("event_uid", "source_sha256", "source_line", "timestamp", "host", "event_id", "record_id")


def reference() -> Column:
    """An event's anchor, as a struct."""
    return F.struct(*ANCHOR)


def flatten(events: DataFrame) -> DataFrame:
    """Events as flat log lines; missing fields are empty texts."""
    extra = [F.coalesce(F.col("event_data")[k], F.lit("")).alias(k) for k in FLAT_FIELDS]
    anchors = ["event_uid", "source_sha256", "source_line", "host", "channel", "provider", "event_id", "record_id"]
    return events.select(*anchors, utc_text(F.col("timestamp")).alias("original_timestamp"), *extra, "event_data")


def reread(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Events whose stored columns differ from those read again, or that only one side has."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*[F.col(c) if c != "event_data" else F.array_sort(F.map_entries("event_data")).alias("event_data") for c in df.columns if c != "event_uid"])), 256)
    a, b = stored.select("event_uid", digest(stored).alias("a")), again.select("event_uid", digest(again).alias("b"))
    return a.join(b, "event_uid", "full").filter("not (a <=> b)").select("event_uid", F.when(F.col("a").isNull(), "not stored").when(F.col("b").isNull(), "not in archive").otherwise("differs").alias("difference"))
