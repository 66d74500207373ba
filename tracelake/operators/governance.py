"""Append-only state: revisions, transitions, hash chains."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import compare_sets

#: Allowed next states of an alert.
TRANSITIONS = {"new": ("triaged",), "triaged": ("investigating",), "investigating": ("escalated", "closed"), "escalated": ("investigating", "closed"), "closed": ()}
GENESIS = "0" * 64


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. One partial aggregate a task, so a busy key costs no more than others."""
    rows = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__r"))
    return rows.select("__r.*")


def transition_errors(log: DataFrame, key: str, revision: str, state: str, verdict: str) -> DataFrame:
    """Log rows with an error: wrong first state, forbidden transition, gap in revisions, closed without verdict."""
    own = Window.partitionBy(key).orderBy(revision)
    before = F.lag(state).over(own)
    allowed = F.lit(False)
    for a, nexts in TRANSITIONS.items():
        if nexts:
            allowed = allowed | ((F.col("__before") == a) & F.col(state).isin(*nexts))
    error = (
        F.when(F.col(revision) != F.col("__n"), F.lit("revision out of sequence"))
        .when(F.col("__before").isNull() & (F.col(state) != "new"), F.lit("does not begin as new"))
        .when(F.col("__before").isNotNull() & ~allowed, F.lit("transition not allowed"))
        .when((F.col(state) == "closed") & (F.coalesce(F.trim(verdict), F.lit("")) == ""), F.lit("closed without verdict"))
    )
    rows = log.withColumn("__before", before).withColumn("__n", F.row_number().over(own)).withColumn("error", error)
    return rows.filter("error is not null").drop("__before", "__n")


def chain(df: DataFrame, keys: list[str], order: list[str], payload: Column) -> DataFrame:
    """Adds sequence (from 1), previous and sha256: each link hashes the one before it and its own payload, null as empty.

    A key's rows stream through one task in order; all that is kept of them is the last hash.
    """
    out = T.StructType([*df.schema.fields, T.StructField("sequence", T.LongType()), T.StructField("previous", T.StringType()), T.StructField("sha256", T.StringType())])
    own = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("sequence", F.row_number().over(own).cast("long")).withColumn("__p", F.coalesce(payload.cast("string"), F.lit("")))
    rows = rows.sortWithinPartitions(*keys, "sequence")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = GENESIS
        for batch in batches:
            before, after = [], []
            for n, p in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                last = GENESIS if n == 1 else last
                before.append(last)
                last = hashlib.sha256((last + p).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(before, pa.string()), pa.array(after, pa.string())], out.names)

    return rows.mapInArrow(link, out)


def chain_errors(df: DataFrame, keys: list[str], payload: Column) -> DataFrame:
    """Links with an error: a gap in the sequence, a previous hash that isn't the one before, or a hash that doesn't fit.

    Every link is checked against its neighbour alone, so chains of any length verify in parallel.
    """
    own = Window.partitionBy(*keys).orderBy("sequence")
    rows = df.withColumn("__n", F.row_number().over(own)).withColumn("__p", F.coalesce(F.lag("sha256").over(own), F.lit(GENESIS)))
    error = (
        F.when(F.col("sequence") != F.col("__n"), F.lit("sequence"))
        .when(F.col("previous") != F.col("__p"), F.lit("previous"))
        .when(F.col("sha256") != F.sha2(F.concat("previous", F.coalesce(payload.cast("string"), F.lit(""))), 256), F.lit("sha256"))
    )
    return rows.withColumn("error", error).filter("error is not null").drop("__n", "__p")


def next_revision(current: DataFrame, changes: DataFrame, key: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) changes: a change names the revision that it was made on, which must be the latest."""
    now = current.groupBy(key).agg(F.max(revision).alias("__now"))
    seen = changes.join(now, key, "left")
    first = F.row_number().over(Window.partitionBy(key, revision).orderBy(*[F.col(c) for c in changes.columns if c not in (key, revision)]))
    seen = seen.withColumn("__ok", (F.coalesce("__now", F.lit(0)) == F.col(revision)) & (first == 1))
    return seen.filter("__ok").withColumn(revision, F.col(revision) + 1).drop("__now", "__ok"), seen.filter("not __ok").drop("__now", "__ok")


def attach_evidence(cases: DataFrame, added: DataFrame, key: str, evidence: str = "evidence", most: int = 30) -> tuple[DataFrame, DataFrame]:
    """(cases with the uids of added (key, uid) after their own, each once; keys refused as they would have more than ``most`` or no case)."""
    new = added.groupBy(key).agg(F.array_sort(F.collect_set("uid")).alias("__new"))
    told = cases.join(new, key, "left").withColumn("__all", F.array_union(evidence, F.coalesce("__new", F.array().cast("array<string>"))))
    fits = F.size("__all") <= most
    out = told.withColumn(evidence, F.when(fits, F.col("__all")).otherwise(F.col(evidence))).drop("__new", "__all")
    refused = told.filter(~fits).select(key).unionByName(new.join(cases.select(key), key, "left_anti").select(key))
    return out, refused


def approved_scope(events: DataFrame, scope: dict, source: str = "source_sha256") -> DataFrame:
    """events, if their sources are exactly those that the scope approves, with an id and a reason of collection; else an error.

    Every approved source must be observed and no other; the hashes are stated once each, in full and in lower case.
    """
    hashes = scope.get("source_sha256") if isinstance(scope, dict) else None
    for k in ("id", "collection_reason"):
        if not isinstance(scope, dict) or not isinstance(scope.get(k), str) or not scope[k].strip():
            raise ValueError(f"a scope states its {k}")
    if not isinstance(hashes, list) or not hashes or not all(isinstance(h, str) and re.fullmatch("[0-9a-f]{64}", h) for h in hashes) or len(set(hashes)) != len(hashes):
        raise ValueError("a scope states the SHA-256 of each source once")
    approved = events.sparkSession.createDataFrame([(h,) for h in hashes], f"`{source}` string")
    odd = compare_sets(events, approved, source).filter("state <> 'present'").orderBy(source).limit(1).collect()
    if odd:
        raise ValueError(f"source {odd[0][source]} is {odd[0].state}")
    return events
