"""Sequence operators over keyed, ordered events.

Each replaces a fold over a stream by windows partitioned by the key, so keys are independent and nothing but
one key's ordered rows passes through a task at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros

SECOND = 1_000_000


def followed_by(df: DataFrame, keys: list[str], ts: str, order: list[str], failure: Column, success: Column, n: int, within: int, uid: str) -> DataFrame:
    """Successes that come after at least n failures of their key within ``within`` seconds (inclusive).

    A success ends the key's sequence whether it fires or not. Adds evidence: the uids of the last n
    failures, then of the success.
    """
    rows = df.withColumn("__s", success).filter(failure | F.col("__s")).withColumn("__t", micros(F.col(ts)))
    by = [F.col("__t"), *[F.col(c) for c in order]]
    before = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__seg", F.coalesce(F.sum(F.col("__s").cast("int")).over(before), F.lit(0)))
    own = Window.partitionBy(*keys, "__seg").orderBy(*by)
    rows = rows.withColumn("__nth", F.lag("__t", n).over(own)).withColumn("evidence", F.collect_list(uid).over(own.rowsBetween(-n, 0)))
    fires = F.col("__s") & (F.col("__t") - F.col("__nth") <= within * SECOND)
    return rows.filter(fires).drop("__s", "__t", "__seg", "__nth")


def burst(df: DataFrame, keys: list[str], ts: str, order: list[str], n: int, within: int, uid: str) -> DataFrame:
    """Events that are at least the nth of their key within ``within`` seconds; evidence: the last n uids."""
    rows = df.withColumn("__t", micros(F.col(ts)))
    own = Window.partitionBy(*keys).orderBy(F.col("__t"), *[F.col(c) for c in order])
    rows = rows.withColumn("__nth", F.lag("__t", n - 1).over(own)).withColumn("evidence", F.collect_list(uid).over(own.rowsBetween(1 - n, 0)))
    return rows.filter(F.col("__t") - F.col("__nth") <= within * SECOND).drop("__t", "__nth")


def distinct_in_window(df: DataFrame, keys: list[str], ts: str, order: list[str], value: str, within: int) -> DataFrame:
    """Adds distinct_values: the different values of the key up to this event, within ``within`` seconds.

    Later events with the same timestamp don't count. An event adds a value if the value's last event is out of its
    window, and one takes it away again, after the window, if the value has no further event by then; the count is the
    running sum of both. So no window is ever collected, and a busy key costs a sort.
    """
    rows = df.withColumn("__t", micros(F.col(ts)))
    by = [F.col(c) for c in order]
    same = Window.partitionBy(*keys, value).orderBy("__t", *by)
    width, some = within * SECOND, F.col(value).isNotNull()
    begins = some & F.coalesce(F.col("__t") - F.lag("__t").over(same) > width, F.lit(True))
    ends = some & F.coalesce(F.lead("__t").over(same) - F.col("__t") > width, F.lit(True))
    step = lambda t, real, n: F.struct(t.alias("t"), F.lit(real).alias("real"), n.alias("n"))
    steps = F.array_compact(F.array(step(F.col("__t"), True, begins.cast("int")), F.when(ends, step(F.col("__t") + width + 1, False, F.lit(-1)))))
    told = rows.withColumn("__steps", steps).withColumn("__s", F.explode("__steps"))
    run = Window.partitionBy(*keys).orderBy("__s.t", "__s.real", *by).rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn("distinct_values", F.sum("__s.n").over(run)).filter("__s.real").drop("__t", "__steps", "__s")


def cooldown(df: DataFrame, keys: list[str], ts: str, order: list[str], within: int) -> DataFrame:
    """The candidates that fire if a key stays silent for ``within`` seconds after each alert; without a timestamp none does.

    The choice is greedy, so a key's rows stream through one task in order; all that is kept of them is the time of
    the key's last alert.
    """
    own = Window.partitionBy(*keys).orderBy("__t", *[F.col(c) for c in order])
    rows = df.withColumn("__t", micros(F.col(ts))).filter("__t is not null").withColumn("__first", F.row_number().over(own) == 1)
    rows = rows.sortWithinPartitions(*keys, "__t", *order)

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        silent_to = None
        for batch in batches:
            t, first = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("__t", "__first"))
            begins = np.flatnonzero(first).tolist()
            fired: list[int] = []
            for a, b in zip([0, *begins], [*begins, len(t)]):
                if a < b and first[a]:
                    silent_to = None
                at = a if silent_to is None else a + int(np.searchsorted(t[a:b], silent_to, "right"))
                while at < b:
                    fired.append(at)
                    silent_to = int(t[at]) + within * SECOND
                    at += int(np.searchsorted(t[at:b], silent_to, "right"))
            yield batch.take(pa.array(fired, pa.int64()))

    return rows.mapInArrow(fire, rows.schema).drop("__t", "__first")


def lookback(df: DataFrame, keys: list[str], ts: str, counted: Column, at: Column, within: int, name: str = "n_before") -> DataFrame:
    """Rows that meet ``at`` with the number of ``counted`` rows of their key in the closed interval of ``within`` seconds before."""
    rows = df.filter(counted | at).withColumn("__t", micros(F.col(ts)))
    recent = Window.partitionBy(*keys).orderBy("__t").rangeBetween(-within * SECOND, 0)
    return rows.withColumn(name, F.sum(F.when(counted, 1).otherwise(0)).over(recent).cast("long")).filter(at).drop("__t")


def sessions(df: DataFrame, keys: list[str], ts: str, order: list[str], starts: Column) -> DataFrame:
    """Adds session (0 before the first start): each row that meets ``starts`` begins a new one."""
    own = Window.partitionBy(*keys).orderBy(micros(F.col(ts)), *[F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("session", F.sum(starts.cast("int")).over(own).cast("long"))


def gap_statistics(df: DataFrame, keys: list[str], ts: str, order: list[str], least: int) -> DataFrame:
    """Per key with at least ``least`` events: count, span, mean, population deviation and variation of the gaps in seconds."""
    own = Window.partitionBy(*keys).orderBy(micros(F.col(ts)), *[F.col(c) for c in order])
    rows = df.withColumn("__t", micros(F.col(ts))).withColumn("__g", (F.col("__t") - F.lag("__t").over(own)) / SECOND)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_events"), ((F.max("__t") - F.min("__t")) / SECOND).alias("span_s"), F.avg("__g").alias("mean_gap_s"), F.stddev_pop("__g").alias("dev_gap_s"))
    return out.filter(F.col("n_events") >= least).withColumn("variation", F.try_divide("dev_gap_s", "mean_gap_s"))


def count_over_time(df: DataFrame, ts: str, at: Column, seconds: int, *by: str) -> DataFrame:
    """How many rows lie in the last ``seconds`` before ``at`` (later than their begin, up to their end), by label."""
    t = micros(F.col(ts))
    return df.filter((t > micros(at) - seconds * SECOND) & (t <= micros(at))).groupBy(*by).agg(F.count("*").alias("n"))


def count_over_range(df: DataFrame, ts: str, start: Column, end: Column, step: int, seconds: int, *by: str, most_steps: int = 11_000) -> DataFrame:
    """count_over_time at every ``step`` seconds from start to end (inclusive), by label: (labels, at, n), steps without a row too.

    A sweep: a row counts from the first step at or after it to the last one before its window is over, so it adds one where that
    begins and takes it away behind the end; the running sum of a label's steps are its counts. No row is repeated for each
    step. Labels are those with a row in any window.
    """
    first, last = df.sparkSession.range(1).select(micros(start), micros(end)).first()
    steps = (last - first) // (step * SECOND) + 1
    if not 0 < steps <= most_steps:
        raise ValueError(f"{steps} steps; at least one and at most {most_steps} are told")
    since = micros(F.col(ts)) - first
    wide = F.lit(step * SECOND)
    at_or_after = lambda t: ((t + F.pmod(-t, wide)) / wide).cast("long")
    rows = df.select(*by, F.greatest(at_or_after(since), F.lit(0)).alias("i"), F.least(at_or_after(since + seconds * SECOND), F.lit(steps)).alias("j")).filter("i < j")
    turns = rows.select(*by, F.explode(F.array(F.struct(F.col("i"), F.lit(1).alias("d")), F.struct(F.col("j").alias("i"), F.lit(-1).alias("d")))).alias("t")).select(*by, "t.*")
    turns = turns.groupBy(*by, "i").agg(F.sum("d").alias("d"))
    grid = rows.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("i"), F.lit(0).cast("long").alias("d"))
    told = turns.unionByName(grid).groupBy(*by, "i").agg(F.sum("d").alias("d"))
    run = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = F.timestamp_micros(F.lit(first) + F.col("i") * step * SECOND).cast("timestamp_ntz")
    return told.withColumn("n", F.sum("d").over(run)).filter(F.col("i") < steps).select(*by, at.alias("at"), "n")
