"""Telemetry quality: requirements against observations, inventory gaps, priorities, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros
from .sequence import SECOND

#: Order of criticality.
CRITICALITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def requirement_matrix(observed: DataFrame, requirements: DataFrame, as_of: str, window: int, future_slack: int = 120) -> DataFrame:
    """A row for each requirement, also where nothing was observed.

    observed: asset_id, scope, provider, channel, event_id, ts, received and fields (map of texts).
    requirements: id, asset_id, scopes, provider, channel, event_ids, required_fields, expected_activity_seconds,
    max_ingest_lag_seconds. Missing fields, late, future and negative-lag counts are over all observations;
    absent ids and in_window are over the window that ends at as_of.
    """
    now = micros(F.lit(as_of).cast("timestamp_ntz"))
    keyed = requirements.withColumn("scope", F.explode("scopes")).withColumn("event_id", F.explode("event_ids"))
    keyed = keyed.withColumn("__p", F.lower("provider")).withColumn("__c", F.lower("channel")).drop("provider", "channel", "scopes")
    seen = observed.withColumn("__p", F.lower("provider")).withColumn("__c", F.lower("channel")).drop("provider", "channel")
    # The small dimension goes to the events; requirements without any event come back by the last join.
    rows = seen.join(keyed.select("id", "asset_id", "scope", "__p", "__c", "event_id", "required_fields", "max_ingest_lag_seconds"), ["asset_id", "scope", "__p", "__c", "event_id"])
    t, r = micros(F.col("ts")), micros(F.col("received"))
    within = t.between(now - window * SECOND, now)
    empty = F.size(F.filter("required_fields", lambda f: F.coalesce(F.trim(F.col("fields")[f]), F.lit("")) == ""))
    per = rows.groupBy("id").agg(
        F.count("*").alias("observed_total"),
        F.count_if(within).alias("in_window"),
        F.max(F.when(t <= now, t)).alias("__latest"),
        F.sum(empty).cast("long").alias("missing_fields"),
        F.count_if(r - t > F.col("max_ingest_lag_seconds") * SECOND).alias("late_records"),
        F.count_if(t > now + future_slack * SECOND).alias("future_records"),
        F.count_if(r < t).alias("negative_lag"),
        F.collect_set(F.when(within, F.col("event_id"))).alias("__ids"),
    )
    out = requirements.join(per, "id", "left").na.fill(0, ["observed_total", "in_window", "missing_fields", "late_records", "future_records", "negative_lag"])
    absent = F.array_sort(F.array_except("event_ids", F.coalesce("__ids", F.expr("cast(array() as array<bigint>)"))))
    age = (now - F.col("__latest")) / SECOND
    quiet = (F.col("observed_total") == 0) | F.coalesce(age > F.col("expected_activity_seconds"), F.lit(True))
    out = out.withColumn("latest_age_seconds", age).withColumn("absent_ids", absent)
    issues = quiet.cast("int") + (F.size("absent_ids") > 0).cast("int") + (F.col("missing_fields") > 0).cast("int") + (F.col("late_records") > 0).cast("int") + ((F.col("future_records") > 0) | (F.col("negative_lag") > 0)).cast("int")
    return out.withColumn("n_issues", issues.cast("long")).drop("__latest", "__ids")


def heartbeat_state(error: Column, gaps: Column, updated: Column, as_of: Column, max_age: Column) -> Column:
    """State of a collector: not required, missing, needs review or healthy."""
    age = (micros(as_of) - micros(updated)) / SECOND
    bad = (F.coalesce(error, F.lit("")) != "") | (F.coalesce(gaps, F.lit(0)) > 0) | (age < 0) | (age > max_age)
    return F.when(max_age.isNull(), F.lit("not required")).when(updated.isNull(), F.lit("missing")).when(bad, F.lit("needs review")).otherwise(F.lit("healthy"))


def collector_states(heartbeats: DataFrame, key: str, at: str, gaps: str, error: str, cursor: str) -> DataFrame:
    """A row for each collector of an append-only log of heartbeats: when it was last heard of, all gaps so far, its last error and cursor."""
    last = lambda c: F.max_by(c, at).alias(c)
    return heartbeats.groupBy(key).agg(F.max(at).alias("updated"), F.sum(F.coalesce(gaps, F.lit(0))).alias(gaps), last(error), last(cursor))


def unmapped(df: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """(key, observations) that the inventory doesn't have; the row counts come first, so the join sees one row a key."""
    return df.groupBy(key).agg(F.count("*").alias("observations")).join(inventory.select(key).distinct(), key, "left_anti")


def priority(criticality_rank: Column, active: Column, gaps: Column) -> Column:
    """What an asset needs first, from its rank (1 to 4), open leads and telemetry gaps."""
    return F.when((criticality_rank >= 3) & ((active > 0) | (gaps > 0)), F.lit("review_first")).when(gaps > 0, F.lit("add_telemetry")).when(active > 0, F.lit("queue")).otherwise(F.lit("none"))


def presence(df: DataFrame, requirements: DataFrame, keys: list[str]) -> DataFrame:
    """requirements with n_observed, zeros kept."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n_observed"))
    return requirements.join(n, keys, "left").na.fill(0, ["n_observed"])


def confusion(df: DataFrame, label: Column, predicted: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1, null where a denominator is zero."""
    label, predicted = F.coalesce(label, F.lit(False)), F.coalesce(predicted, F.lit(False))
    n = {"tp": label & predicted, "fp": ~label & predicted, "fn": label & ~predicted, "tn": ~label & ~predicted}
    out = df.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    tp, fp, fn = (F.col(k) for k in ("tp", "fp", "fn"))
    return out.withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn)).withColumn("f1", F.try_divide(2 * tp, 2 * tp + fp + fn))


def queue_health(df: DataFrame, state: str, created: str, due: str, as_of: Column, *by: str) -> DataFrame:
    """Per state, within the columns ``by`` (such as a scope): n_rows, oldest_age_s and n_overdue (rows that aren't closed and past due)."""
    age = (micros(as_of) - micros(F.col(created))) / SECOND
    late = (F.col(state) != "closed") & (F.col(due) < as_of)
    return df.groupBy(*by, state).agg(F.count("*").alias("n_rows"), F.max(age).alias("oldest_age_s"), F.count_if(late).alias("n_overdue"))


def validity_errors(profiles: DataFrame, id_: str, begin: str, end: str, as_of: Column, most_days: int = 366) -> DataFrame:
    """(id, error) of profiles whose time is missing, ends before it begins, is longer than so many days or isn't now."""
    width = (micros(F.col(end)) - micros(F.col(begin))) / (86400 * SECOND)
    error = (
        F.when(width.isNull(), F.lit("no validity"))
        .when(width <= 0, F.lit("ends before it begins"))
        .when(width > most_days, F.lit("valid for too long"))
        .when(~as_of.between(F.col(begin), F.col(end)), F.lit("not valid now"))
    )
    return profiles.select(id_, error.alias("error")).filter("error is not null")


def totals(df: DataFrame, issues: str, *flags: str) -> DataFrame:
    """One row: all rows, those with issues, and those for which each flag holds."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(issues) > 0).alias("n_with_issues"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])
