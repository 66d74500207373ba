"""Incremental detection: micro-batches of events through the batch operators.

A store is a folder of append-only Parquet logs. Each batch is deduplicated against everything stored, appended, and
the findings of the look-back window are computed again by the same operators as in a batch run; findings that are
already alerts are left out. All rows of a batch carry its id and go to a folder of that name, so a batch that is
repeated after a failure replaces what it wrote. Stored events are never dropped for being late; they are only outside
the window.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import due
from ..operators.rules import first_by_order
from .queue import QUEUED, Queue, stamps

#: Seconds that an event may lie in the future and still be evaluated.
FUTURE_SLACK = 120
FINGERPRINT = ("timestamp", "host", "channel", "provider", "event_id", "record_id")
#: Days of a batch up to which only they are looked up in the store.
MOST_DAYS = 1000


def fingerprint() -> Column:
    """SHA-256 of what an event says, wherever it came from."""
    return F.sha2(F.to_json(F.struct(*FINGERPRINT, F.array_sort(F.map_entries("event_data")).alias("event_data"))), 256)


@dataclass(frozen=True)
class Limits:
    """What a batch and a store may hold; None is no limit. A batch beyond them is refused whole and nothing is written."""

    batch_records: int | None = None
    batch_bytes: int | None = None
    stored_events: int | None = None
    waiting_rows: int | None = None


class NotAdmitted(ValueError):
    """A batch that the store doesn't take."""


class Store:
    """Logs of events and alerts and a delivery queue under one folder, which may be on any file system that Spark writes.

    Every log has a folder for each batch and in it one for each day of the event, so the days that a batch or a window
    touches are read alone.
    """

    def __init__(self, spark: SparkSession, path: str, event_schema: T.StructType, private_roots: tuple[str, ...] = ()):
        """``private_roots``: folders below which a store may take private events."""
        self.spark, self.path, self.private_roots = spark, path.rstrip("/"), private_roots
        self.schemas = {
            "events": T.StructType([*event_schema.fields, T.StructField("fingerprint", T.StringType())]),
        }
        self.queue = Queue(spark, f"{self.path}/outbox", QUEUED)

    def is_private(self) -> bool:
        """Whether the store lies below a private root, however its path is written."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()

        def whole(at: str) -> str:
            path = jvm.org.apache.hadoop.fs.Path(at)
            uri = path.getFileSystem(conf).makeQualified(path).toUri()
            there = uri.getPath()
            return f"{uri.getScheme()}:{os.path.realpath(there) if uri.getScheme() == 'file' else posixpath.normpath(there)}/"

        return any(whole(self.path).startswith(whole(root)) for root in self.private_roots)

    def read(self, log: str, schema: T.StructType | None = None, but: int | None = None) -> DataFrame:
        """A log, with batch and day; rows of batch ``but`` are left out."""
        schema = T.StructType([*(schema or self.schemas[log]).fields, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{log}")
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], schema)
        return rows if but is None else rows.filter(F.col("batch") != but)

    def write(self, log: str, rows: DataFrame, batch: int, day: Column) -> None:
        rows.withColumn("day", day.cast("date")).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/{log}/batch={batch}")


def admit(store: Store, batch: DataFrame, batch_id: int, limits: Limits, kind: str) -> None:
    """Raises NotAdmitted if the batch or, with it, the store is over a limit, or if the batch mixes kinds."""
    size = F.octet_length("original_json").cast("long") if "original_json" in batch.columns else F.lit(0).cast("long")
    mixed = F.count_if(~F.col("kind").eqNullSafe(F.lit(kind))) if "kind" in batch.columns else F.lit(0)
    n, n_bytes, others = batch.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), mixed).first()
    over = lambda have, most: most is not None and have > most
    if others:
        raise NotAdmitted(f"{others} events are not of kind {kind}")
    if over(n, limits.batch_records) or over(n_bytes, limits.batch_bytes):
        raise NotAdmitted(f"a batch of {n} events and {n_bytes} bytes is too large")
    if limits.stored_events is not None and over(store.read("events", but=batch_id).count() + n, limits.stored_events):
        raise NotAdmitted("the store is full")
    if limits.waiting_rows is not None and over(store.queue.log.read(open_only=True).filter(F.col("state") != "delivered").filter(~F.col("batch").eqNullSafe(batch_id)).count() + n, limits.waiting_rows):
        raise NotAdmitted("too many rows wait for delivery")


def alerts_of(findings: DataFrame, now: Column) -> DataFrame:
    return findings.withColumn("created", now).withColumn("due", due(now, F.col("severity"))).withColumn("state", F.lit("new")).withColumn("revision", F.lit(1).cast("long"))


def process(store: Store, batch: DataFrame, batch_id: int, detect: Callable[[DataFrame], DataFrame], now: Column, window: int, limits: Limits = Limits(), scope: str = "default", kind: str = "event", private: bool = False) -> None:
    """One micro-batch. detect maps events to findings with finding_id and severity; now is a timestamp.

    Equal events have equal timestamps, so only the stored events of the batch's own days can repeat them. What is new is
    put into the store's delivery queue; a repeated batch adds nothing to it.
    """
    if private and not store.is_private():
        raise NotAdmitted("private events are only taken by a store below one of its private roots")
    admit(store, batch, batch_id, limits, kind)
    days = [r[0] for r in batch.select(F.to_date("timestamp")).distinct().limit(MOST_DAYS + 1).collect()]
    known = store.read("events", but=batch_id)
    known = known.filter(F.col("day").isin(days)) if len(days) <= MOST_DAYS else known
    fresh = first_by_order(batch.withColumn("fingerprint", fingerprint()), ["fingerprint"], [F.col("source_sha256"), F.col("source_line")])
    fresh = fresh.join(known.select("fingerprint"), "fingerprint", "left_anti").select(*store.schemas["events"].names)
    store.write("events", fresh, batch_id, F.col("timestamp"))
    fresh = store.read("events").filter(F.col("batch") == batch_id)
    begin, end = now - F.make_dt_interval(secs=F.lit(window)), now + F.make_dt_interval(secs=F.lit(FUTURE_SLACK))
    recent = store.read("events").filter(F.col("day").between(F.to_date(begin), F.to_date(end)) & F.col("timestamp").between(begin, end))
    alerts = alerts_of(detect(recent.drop("fingerprint", "batch", "day")).dropDuplicates(["finding_id"]), now)
    store.schemas["alerts"] = alerts.schema
    # A finding of the window's events was first made no earlier than its last event came, which may be ahead of the clock a little.
    known = store.read("alerts", but=batch_id).filter(F.col("day") >= F.to_date(begin - F.make_dt_interval(secs=F.lit(FUTURE_SLACK))))
    alerts = alerts.join(known.select("finding_id"), "finding_id", "left_anti").select(*alerts.columns)
    store.write("alerts", alerts, batch_id, F.col("created"))
    state = F.lit("held_private" if private else "pending")
    store.queue.add(fresh.select("event_uid", F.lit(scope).alias("scope"), F.lit(kind).alias("kind"), stamps(now, ["source_sha256", "source_line"]).alias("stamp"), state.alias("state"), now.alias("next_at"), F.lit(batch_id).cast("long").alias("batch")))


def run(events: DataFrame, store: Store, checkpoint: str, detect: Callable[[DataFrame], DataFrame], now: Callable[[], Column], window: int, limits: Limits = Limits(), scope: str = "default", kind: str = "event", private: bool = False):
    """A streaming query over a stream of events; works off what there is and stops. A batch beyond the limits ends it, its offsets uncommitted."""
    each = lambda batch, batch_id: process(store, batch, batch_id, detect, now(), window, limits, scope, kind, private)
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def run_leads(leads: DataFrame, store: Store, checkpoint: str, now: Callable[[], Column]):
    """A streaming query that stores the findings of operators with state (``streaming.state``) as alerts; nothing stored is read again."""
    each = lambda batch, batch_id: store.write("leads", alerts_of(batch, now()), batch_id, F.col("created"))
    store.schemas["leads"] = alerts_of(leads, now()).schema
    return leads.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
