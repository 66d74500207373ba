from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tracelake.streaming import commits
from tracelake.streaming.queue import Queue


def at(seconds):
    return F.timestamp_seconds(F.lit(1_700_000_000 + seconds))


def filled(spark, path, n=12, state="pending", scopes=("lab",)):
    queue = Queue(spark, str(path))
    rows = spark.createDataFrame([(f"u{i:02}", scopes[i % len(scopes)], "event", n - i) for i in range(n)], "event_uid string, scope string, kind string, stamp long")
    queue.add(rows.withColumn("next_at", at(0)).withColumn("state", F.lit(state)))
    return queue


def states(queue):
    return {r.state: r["count"] for r in queue.read().groupBy("state").count().collect()}


def test_failed_delivery_and_a_new_process_keep_rows(spark, tmp_path):
    filled(spark, tmp_path, 2)
    queue = Queue(spark, str(tmp_path))  # as after a restart
    claim = queue.claim(at(0))
    assert [r.event_uid for r in claim.rows.collect()] == ["u01", "u00"]  # by stamp
    assert queue.claim(at(0)) is None
    assert queue.failed(claim.token, "ConnectionError", at(0)) == 2
    assert queue.claim(at(1)) is None  # two seconds to wait
    claim = Queue(spark, str(tmp_path)).claim(at(3))
    assert [(r.event_uid, r.attempts) for r in claim.rows.collect()] == [("u01", 1), ("u00", 1)]
    assert queue.delivered(claim.token) == 2 and states(queue) == {"delivered": 2}
    assert queue.delivered(claim.token) == 0


def test_an_abandoned_lease_is_free_when_it_is_over(spark, tmp_path):
    queue = filled(spark, tmp_path, 1)
    lost = queue.claim(at(0), lease_seconds=10)
    assert queue.claim(at(9)) is None
    again = queue.claim(at(11))
    assert again.rows.count() == 1
    assert queue.delivered(lost.token) == 0 and queue.failed(lost.token, "x", at(12)) == 0  # too late
    assert states(queue) == {"sending": 1} and queue.delivered(again.token) == 1


def test_rows_are_given_up_and_driven_again(spark, tmp_path):
    queue = filled(spark, tmp_path, 3, scopes=("lab", "site", "lab"))
    for attempt in range(4):
        claim = queue.claim(at(attempt * 301), most=1)
        first = claim.rows.first().event_uid
        queue.failed(claim.token, "HTTP_400", at(attempt * 301))
    # The claim of one row counts for that row alone.
    assert sum(r.attempts for r in queue.read().collect()) == 4 and first is not None
    while (claim := queue.claim(at(10**6), most=250)) is not None:
        queue.failed(claim.token, "HTTP_400", at(0))
    assert states(queue) == {"dead_letter": 3}
    assert {r.error for r in queue.read().collect()} == {"HTTP_400"}
    assert queue.redrive("operator", "destination repaired", at(0)) == 3
    assert [(e["actor"], e["reason"], e["rows"]) for e in queue.maintenance()] == [("operator", "destination repaired", 3)]
    assert {(r.state, r.attempts) for r in queue.read().collect()} == {("pending", 0)}
    for bad in ("", None):
        with pytest.raises(ValueError):
            queue.redrive(bad, "reason", at(0))


def test_private_rows_are_held_and_sizes_checked(spark, tmp_path):
    queue = filled(spark, tmp_path, 2, state="held_private")
    assert queue.claim(at(100)) is None and queue.waiting() == 2
    for most in (0, 251):
        with pytest.raises(ValueError):
            queue.claim(at(0), most)


def test_claims_at_once_share_no_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "COMPACT", 3)
    filled(spark, tmp_path, 12)
    with ThreadPoolExecutor(4) as pool:
        claims = list(pool.map(lambda _: Queue(spark, str(tmp_path)).claim(at(0), most=3), range(5)))
    got = [r.event_uid for c in claims if c for r in c.rows.collect()]
    assert sorted(got) == [f"u{i:02}" for i in range(12)] and sum(c is None for c in claims) == 1
    queue = Queue(spark, str(tmp_path))
    assert queue.log.versions() == [1, 2, 3, 4, 5] and queue.log.snapshots() == [3]
    for c in filter(None, claims):
        assert queue.delivered(c.token) == 3
    assert states(queue) == {"delivered": 12} and queue.waiting() == 0
    assert queue.log.read(open_only=True).count() < 12  # those that were done at the last snapshot are not read


def test_a_number_is_taken_once_and_unfinished_commits_are_not_seen(spark, tmp_path):
    queue = filled(spark, tmp_path, 2)
    log = queue.log
    assert not log._take(1, {"data": "other", "rows": 1}) and log.entry(1)["op"] == "add"
    staged, final = log._at("log/.renamed"), log._at(f"log/{2:020}.json")
    assert log._take_by_rename(staged, final, b'{"data": "data/x", "rows": 0, "op": "none"}')
    assert not log._take_by_rename(log._at("log/.late"), final, b"{}") and log.entry(2)["op"] == "none"
    read = log.read(1)
    spark.range(1).write.parquet(f"{tmp_path}/data/abandoned")
    assert read.count() == 2
