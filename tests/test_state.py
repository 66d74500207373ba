"""Streams with state against the batch operators, over random splits into batches and with a restart."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import sequence
from tracelake.streaming import state

SCHEMA = "id long, user string, kind string, value string, t long, tags map<string,string>"


def events(seed, n=240):
    rng, t, rows = random.Random(seed), 1_000_000_000, []
    for i in range(n):
        t += rng.choice([0, 1, 7, 60, 400]) * 1_000_000 + rng.randrange(3)
        rows.append((i, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice(["fail", "fail", "fail", "ok"]), rng.choice(["x", "y", "z", None]), t, {"k": str(i)}))
    return rows


def split(rows, rng, jitter):
    """Batches of the rows; with jitter, rows move by up to that many places."""
    rows = [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rng.uniform(0, jitter))]
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("t"))


def streamed(spark, tmp, batches, operator, restart):
    """Runs the operator over the batches, one file each; with restart, as a query of its own from the same checkpoint."""
    out = None
    for i, batch in enumerate(batches):
        frame(spark, batch).drop("ts").coalesce(1).write.parquet(f"{tmp}/raw{i}")
        os.makedirs(f"{tmp}/in", exist_ok=True)
        part = next(x for x in os.listdir(f"{tmp}/raw{i}") if x.endswith(".parquet"))
        os.rename(f"{tmp}/raw{i}/{part}", f"{tmp}/in/{i:03}.parquet")
        os.utime(f"{tmp}/in/{i:03}.parquet", (1000 + i, 1000 + i))
        if i in (restart, len(batches) - 1):
            df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in").withColumn("ts", F.timestamp_micros("t"))
            query = operator(df).writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/check").trigger(availableNow=True).start()
            assert query.awaitTermination(120)
    return spark.read.parquet(f"{tmp}/out")


def plain(df):
    return sorted((str(r.asDict(recursive=True)) for r in df.drop("ts").collect()))


OPERATORS = {
    "followed_by": lambda m, df, **k: m.followed_by(df, ["user"], "ts", ["id"], F.col("kind") == "fail", F.col("kind") == "ok", 3, 600, "id", **k),
    "burst": lambda m, df, **k: m.burst(df, ["user"], "ts", ["id"], 4, 120, "id", **k),
    "burst_once": lambda m, df, **k: m.burst_once(df, ["user"], "ts", ["id"], 4, 120, 90, "id", **k) if m is state else m.cooldown(m.burst(df, ["user"], "ts", ["id"], 4, 120, "id"), ["user"], "ts", ["id"], 90),
    "distinct": lambda m, df, **k: m.distinct_in_window(df, ["user"], "ts", ["id"], "value", 300, **k),
    "cooldown": lambda m, df, **k: m.cooldown(df, ["user"], "ts", ["id"], 500, **k),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_stream_in_order_equals_the_batch(spark, tmp_path, name):
    rows = events(1)
    got = streamed(spark, tmp_path, split(rows, random.Random(2), 0), lambda df: OPERATORS[name](state, df), 2)
    wanted = OPERATORS[name](sequence, frame(spark, rows)).select(*got.columns)
    assert plain(got) == plain(wanted) and got.count() > 2


@pytest.mark.parametrize("name, seed", [(n, s) for s, n in enumerate(sorted(OPERATORS))])
def test_a_stream_out_of_order_equals_the_batch(spark, tmp_path, name, seed):
    rows = events(seed + 5)
    late = (9999, "flush", "other", "x", rows[-1][4] + 10**12, {})
    batches = split(rows, random.Random(seed), 6) + [[late]]
    got = streamed(spark, tmp_path, batches, lambda df: OPERATORS[name](state, df, delay="2 hours"), seed + 1)
    wanted = OPERATORS[name](sequence, frame(spark, rows)).select(*got.columns)
    assert plain(got.filter("user <=> null or user <> 'flush'")) == plain(wanted) and wanted.count() > 2


def both(m, df, **k):
    """Sequences, and bursts of the failures with a value."""
    failed, passed, counted = F.col("kind") == "fail", F.col("kind") == "ok", F.col("value").isNotNull()
    if m is state:
        return state.followed_by_and_burst_once(df, ["user"], "ts", ["id"], failed, passed, 3, 600, counted, 4, 120, 90, "id", ["ts"], **k)
    first = sequence.followed_by(df, ["user"], "ts", ["id"], failed, passed, 3, 600, "id")
    second = sequence.cooldown(sequence.burst(df.filter(failed & counted), ["user"], "ts", ["id"], 4, 120, "id"), ["user"], "ts", ["id"], 90)
    return first.withColumn("which", F.lit(0)).unionByName(second.withColumn("which", F.lit(1)), allowMissingColumns=True)


@pytest.mark.parametrize("jitter, delay, seed", [(0, None, 31), (6, "2 hours", 32)])
def test_two_folds_with_one_state_equal_the_batch(spark, tmp_path, jitter, delay, seed):
    rows = events(seed, 400)
    batches = split(rows, random.Random(seed), jitter) + ([[(9999, "flush", "fail", "x", rows[-1][4] + 10**12, {})]] if delay else [])
    got = streamed(spark, tmp_path, batches, lambda df: both(state, df, delay=delay), 2).filter("user <=> null or user <> 'flush'")
    assert set(got.columns) == {"user", "id", "ts", "which", "evidence"}
    wanted = both(sequence, frame(spark, rows)).select(*got.columns)
    assert plain(got) == plain(wanted) and got.groupBy("which").count().count() == 2


def test_leads_on_a_stream_keep_one_state_for_both_rules(spark, tmp_path):
    from tracelake.plans import testwindows, windows

    rows = [(i, i // 3, "error" if i % 6 else "purchase", '{"k": 1}') for i in range(60)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").withColumn("ts", F.timestamp_seconds("event_id"))
    e.write.parquet(f"{tmp_path}/in")
    stream = testwindows.windows_events(spark, None, spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"))
    query = windows.streamed_leads(stream).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [len(p["stateOperators"]) for p in progress] == [1] and progress[0]["numInputRows"] == 60  # one state, and the rows are read once
    assert progress[0]["stateOperators"][0]["numRowsTotal"] == 20  # one value for each key
