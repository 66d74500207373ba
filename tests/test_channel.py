import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tracelake.operators import readiness
from tracelake.sources import channel, events
from tracelake.streaming import live


def record(n, text="x"):
    return json.dumps({"timestamp": f"2024-01-01T00:00:{n % 60:02d}Z", "host": "WS1", "channel": "Security", "provider": "p", "event_id": 1, "record_id": n, "event_data": {"t": text}})


def append(folder, first, numbers, text="x", end="\n"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{first:020}.jsonl", "a") as f:
        f.write("\n".join(record(n, text) for n in numbers) + end)


def poll(spark, folder, checkpoint, got, refuse=False):
    def each(batch, batch_id):
        if refuse:
            raise live.NotAdmitted("capacity")
        got.extend((r.source_line, r.gap) for r in batch.orderBy("source_line").collect())

    query = channel.read_channel(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination(60)
    return query


def test_a_cursor_resumes_and_tells_resets_and_gaps(spark, tmp_path):
    folder, check, got = f"{tmp_path}/channel", f"{tmp_path}/check", []
    append(folder, 1, range(1, 6))
    append(folder, 6, range(6, 9))
    poll(spark, folder, check, got)
    assert got == [(n, False) for n in range(1, 9)]
    got.clear()
    append(folder, 6, [9])
    append(folder, 6, [10], end="")  # no line feed yet
    poll(spark, folder, check, got)
    assert got == [(9, False)]
    got.clear()
    with open(f"{folder}/{6:020}.jsonl", "a") as f:
        f.write("\n")
    with pytest.raises(Exception, match="capacity"):
        poll(spark, folder, check, got, refuse=True)
    poll(spark, folder, check, got)  # the refused batch again, cursor unchanged
    assert got == [(10, False)]
    got.clear()
    append(folder, 14, range(14, 17))  # 11 to 13 are lost
    append(folder, 20, [20, 21, 23])  # and 17 to 19, and 22
    poll(spark, folder, check, got)
    assert got == [(14, True), (15, False), (16, False), (20, True), (21, False), (23, True)]
    got.clear()
    for name in os.listdir(folder):
        os.unlink(f"{folder}/{name}")
    append(folder, 1, range(1, 4), text="anew")  # cleared, smaller numbers
    poll(spark, folder, check, got)
    assert got == [(1, True), (2, False), (3, False)]
    got.clear()
    os.unlink(f"{folder}/{1:020}.jsonl")
    append(folder, 1, range(1, 6), text="once more")  # cleared and already past the cursor: its hash differs
    poll(spark, folder, check, got)
    assert got == [(1, True), (2, False), (3, False), (4, False), (5, False)]


def test_a_channel_feeds_events_and_collector_states(spark, tmp_path):
    folder = f"{tmp_path}/channel"
    append(folder, 1, [1, 2, 5])
    stream = events.parsed(channel.read_channel(spark, folder))
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    rows = spark.read.parquet(f"{tmp_path}/out")
    source = hashlib.sha256(folder.encode()).hexdigest()
    assert sorted((r.source_line, r.event_uid, r.error) for r in rows.collect()) == [(n, hashlib.sha256(f"{source}:{n}".encode()).hexdigest(), None) for n in (1, 2, 5)]
    states = readiness.collector_states(rows.withColumn("gaps", F.col("gap").cast("long")).withColumn("error", F.lit("")), "channel", "timestamp", "gaps", "error", "record_id").collect()
    assert [(r.channel, r.gaps, r.record_id) for r in states] == [("Security", 1, 5)]
