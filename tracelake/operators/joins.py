"""Joins of events: intervals, lookups, deduplication, set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros
from .rules import first_by_order
from .sequence import SECOND


def interval_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_ts: str, right_ts: str, before: int, after: int, condition: Column | None = None) -> DataFrame:
    """Pairs with equal keys and right_ts in [left_ts - before, left_ts + after] seconds, both ends included.

    Time is cut into cells as wide as the interval, and the cell is a join key: a right row lies in one cell, a
    left row looks into the two or three that its interval touches. So a busy key is spread over its cells, and no
    pair outside them is ever made. Columns of the two sides must have different names.
    """
    width = max(1, (before + after)) * SECOND
    lt, rt = micros(F.col(left_ts)), micros(F.col(right_ts))
    cell = lambda t: F.floor(t / F.lit(width)).cast("long")
    seen = left.withColumn("__lt", lt).withColumn("__cell", F.explode(F.sequence(cell(lt - before * SECOND), cell(lt + after * SECOND))))
    there = right.withColumn("__rt", rt).withColumn("__rcell", cell(rt))
    same = (F.col("__cell") == F.col("__rcell")) & F.col("__rt").between(F.col("__lt") - before * SECOND, F.col("__lt") + after * SECOND)
    for a, b in on:
        same = same & (F.col(a) == F.col(b))
    out = seen.join(there, same if condition is None else same & condition)
    return out.drop("__lt", "__rt", "__cell", "__rcell")


def matches_within(left: DataFrame, right: DataFrame, uid: str, on: list[tuple[str, str]], left_ts: str, right_ts: str, before: int, after: int, condition: Column | None = None) -> DataFrame:
    """left with n_matches (long) and match_state: not observed, unique or ambiguous."""
    pairs = interval_join(left, right, on, left_ts, right_ts, before, after, condition)
    n = pairs.groupBy(F.col(uid).alias("__uid")).agg(F.count("*").alias("n_matches"))
    out = left.join(n, F.col(uid) == F.col("__uid"), "left").drop("__uid").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    state = F.when(F.col("n_matches") == 0, F.lit("not observed")).when(F.col("n_matches") == 1, F.lit("unique")).otherwise(F.lit("ambiguous"))
    return out.withColumn("match_state", state)


def lookup(df: DataFrame, key: str, wanted: list, out: str = "found") -> DataFrame:
    """A row for each wanted value, with the columns of df and whether it was found. ``wanted`` has at most 1000 values."""
    if len(wanted) > 1000:
        raise ValueError("a lookup takes at most 1000 values")
    asked = df.sparkSession.createDataFrame([(w,) for w in wanted], f"wanted {df.schema[key].dataType.simpleString()}")
    hits = df.filter(F.col(key).isin(wanted)).withColumn("__hit", F.lit(True))
    return asked.join(hits, F.col("wanted") == F.col(key), "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit")


def new_rows(batch: DataFrame, known: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of batch whose keys are not in known, the first of each key."""
    return first_by_order(batch, keys, order).join(known.select(*keys).distinct(), keys, "left_anti")


def compare_sets(observed: DataFrame, approved: DataFrame, key: str) -> DataFrame:
    """(key, state) of both: present, missing (approved only) or unexpected (observed only)."""
    a = observed.select(key).distinct().withColumn("__o", F.lit(1))
    b = approved.select(key).distinct().withColumn("__a", F.lit(1))
    both = a.join(b, key, "full")
    return both.select(key, F.when(F.col("__o").isNull(), F.lit("missing")).when(F.col("__a").isNull(), F.lit("unexpected")).otherwise(F.lit("present")).alias("state"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with repeats, that only one side has, and the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df, or an error if it has more than ``most`` rows; reads no more than one row beyond."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df
