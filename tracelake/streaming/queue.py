"""A delivery queue over a commit log: claims are leases that are stored, so no row is ever held by two of them.

States: pending, sending (claimed, until lease_until), delivered, dead_letter (given up after MAX_ATTEMPTS) and held_private, which
no claim takes. A claim that isn't finished becomes claimable again when its lease is over; what it reports after another one has
taken the row changes nothing. So delivery is at least once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.documents import checked_text
from ..functions.times import micros, retry_delay
from .commits import CommitLog

MAX_ATTEMPTS, LEASE_SECONDS = 8, 180


#: What the queue of a live store has besides.
QUEUED = T.StructType([T.StructField("batch", T.LongType())])


@dataclass(frozen=True)
class Claim:
    """Rows that this claim alone may deliver until its lease is over."""

    token: str
    rows: DataFrame


class Queue:
    """Rows of event_uid, scope, kind, stamp (their order of arrival) and more columns, under one folder."""

    def __init__(self, spark: SparkSession, path: str, more: T.StructType = T.StructType([])):
        fields = "event_uid string, scope string, kind string, stamp long, state string, attempts int, next_at timestamp, lease_token string, lease_until timestamp, error string"
        schema = T.StructType([*T.StructType.fromDDL(fields).fields, *more.fields])
        self.log = CommitLog(spark, path, schema, "event_uid", F.col("state") == "delivered")

    def read(self) -> DataFrame:
        return self.log.read()

    def waiting(self) -> int:
        return self.log.read(open_only=True).filter("state <> 'delivered'").count()

    def add(self, rows: DataFrame, info: dict | None = None) -> DataFrame | None:
        """Adds the rows whose event_uid isn't there yet; what a row doesn't state is as of a new one."""
        new = {"state": F.lit("pending"), "attempts": F.lit(0), "lease_token": F.lit(None).cast("string"), "lease_until": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string")}
        rows = rows.withColumns({c: v for c, v in new.items() if c not in rows.columns})
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.log.schema.fields]).dropDuplicates(["event_uid"])
        return self.log.change(lambda had: rows.join(had.select("event_uid"), "event_uid", "left_anti"), {"op": "add", **(info or {})}, open_only=False)

    def claim(self, now: Column, most: int = 100, lease_seconds: int = LEASE_SECONDS) -> Claim | None:
        """The next rows to deliver: due ones of one scope and kind, those of the row that waits longest, in the order of their stamps."""
        if not 1 <= most <= 250:
            raise ValueError("a claim takes 1 to 250 rows")
        token = uuid.uuid4().hex

        def decide(box: DataFrame) -> DataFrame:
            free = (F.col("state") == "pending") & (F.col("next_at") <= now) | (F.col("state") == "sending") & (F.col("lease_until") <= now)
            ready = box.filter(free)
            first = ready.orderBy("next_at", "event_uid").limit(1).select("scope", "kind")
            mine = ready.join(F.broadcast(first), ["scope", "kind"], "left_semi").orderBy("stamp", "event_uid").limit(most)  # one row is broadcast
            return mine.withColumns({"state": F.lit("sending"), "lease_token": F.lit(token), "lease_until": now + F.make_dt_interval(secs=F.lit(lease_seconds))})

        rows = self.log.change(decide, {"op": "claim", "token": token})
        return Claim(token, rows.orderBy("stamp", "event_uid")) if rows is not None else None

    def delivered(self, token: str) -> int:
        """The claimed rows are done. How many still were this claim's."""
        done = {"state": F.lit("delivered"), "error": F.lit(None).cast("string")}
        return self._finish(token, done, "delivered")

    def failed(self, token: str, error: str, now: Column) -> int:
        """The claimed rows wait, longer each time, or are given up. ``error`` is a class of error; messages may repeat what was sent."""
        tries = F.col("attempts") + 1
        later = now + F.make_dt_interval(secs=retry_delay(F.col("attempts")).cast("decimal(18,6)"))
        state = F.when(tries >= MAX_ATTEMPTS, "dead_letter").otherwise("pending")
        return self._finish(token, {"state": state, "next_at": later, "attempts": tries, "error": F.lit(error)}, "failed")

    def _finish(self, token: str, values: dict[str, Column], op: str) -> int:
        values = values | {"lease_token": F.lit(None).cast("string"), "lease_until": F.lit(None).cast("timestamp")}
        rows = self.log.change(lambda box: box.filter((F.col("state") == "sending") & (F.col("lease_token") == token)).withColumns(values), {"op": op, "token": token})
        return rows.count() if rows is not None else 0

    def redrive(self, actor: str, reason: str, now: Column) -> int:
        """Waiting and given-up rows become as new; the log says who did so and why."""
        info = {"op": "redrive", "actor": checked_text(actor), "reason": checked_text(reason)}
        new = {"state": F.lit("pending"), "attempts": F.lit(0), "next_at": now}
        rows = self.log.change(lambda box: box.filter(F.col("state").isin("pending", "dead_letter")).withColumns(new), info)
        return rows.count() if rows is not None else 0

    def maintenance(self) -> list[dict]:
        return [e for e in self.log.history() if e.get("op") == "redrive"]


def stamps(now: Column, order: list[str]) -> Column:
    """Arrival numbers in nanoseconds: those of one batch are a microsecond apart, in order within each source."""
    return micros(now) * 1000 + F.row_number().over(Window.partitionBy(order[0]).orderBy(*order)) * 1000
