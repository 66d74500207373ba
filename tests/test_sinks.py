import glob
import json
import os

from test_events import scenario, write

from tracelake import __main__ as cli
from tracelake.operators import review
from tracelake.sources import sinks


def test_bundle_from_the_command_line(spark, tmp_path, capsys):
    source = write(tmp_path / "s.jsonl", scenario())
    table, out = f"{tmp_path}/table", f"{tmp_path}/bundle"
    assert cli.main(["ingest", source, table]) == 0
    assert cli.main(["ingest", source, table]) == 0  # known bytes are no second source
    assert cli.main(["analyze", table, out]) == 0
    manifest = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert (manifest["events"], manifest["findings_by_rule"]) == (11, {"AUTH-001": 1, "WIN-004": 1, "WIN-008": 1})
    assert cli.main(["verify", out]) == 0
    path = glob.glob(f"{out}/timeline/part-*")[0]
    with open(path, "a") as f:
        f.write("x")
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))  # the local file system's own check
    assert sinks.verify_bundle(spark, out, anchored=sinks.anchor(spark, out)) == sinks.verify_bundle(spark, out)
    assert sinks.verify_bundle(spark, out, anchored="0" * 64) == ["other manifest than anchored"]
    assert sinks.verify_bundle(spark, out) == [f"changed {path.removeprefix(out + '/')}"] and cli.main(["verify", out]) == 2
    bad = write(tmp_path / "bad.jsonl", ["{"])
    assert cli.main(["ingest", bad, table]) == 2


def test_archives_are_reproducible_and_metrics_are_lines(spark, tmp_path):
    a, b = (sinks.case_archive(f"{tmp_path}/{n}.zip", {"case.json": {"id": 1, "n": "é"}, "audit.json": []}) for n in "ab")
    assert a == b
    text = sinks.metrics(spark.createDataFrame([("new", 3, 5.0, 1)], "state string, n_rows long, oldest_age_s double, n_overdue long"))
    assert 'tracelake_n_rows{state="new"} 3' in text


def test_delivery_retries_and_reports(spark):
    lines = spark.createDataFrame([(f"u{i}", "bad" if i == 7 else f"line {i}") for i in range(20)], "event_uid string, line string").coalesce(1)
    got = sinks.deliver(lines, lambda texts: 503 if "bad" in texts else 204, batch=5, wait=lambda s: None).collect()
    assert {r.event_uid for r in got if not r.delivered} == {f"u{i}" for i in range(5, 10)} and len(got) == 20


def test_live_store_snapshot_and_restore_from_the_command_line(spark, tmp_path, capsys):
    import pytest

    source, store = write(tmp_path / "s.jsonl", scenario()), f"{tmp_path}/store"
    assert cli.main(["live", source, store, "2024-01-01T00:05:00Z"]) == 0
    assert cli.main(["snapshot", store, f"{tmp_path}/copy"]) == 0
    assert cli.main(["restore", f"{tmp_path}/copy", f"{tmp_path}/again"]) == 0
    held = lambda at: sorted(map(str, sinks.live_queue(spark, at).read().collect()))
    assert held(store) == held(f"{tmp_path}/again") != []
    for log in ("events", "alerts"):
        assert review.fingerprint(spark.read.parquet(f"{store}/{log}")).first() == review.fingerprint(spark.read.parquet(f"{tmp_path}/again/{log}")).first()
    capsys.readouterr()
    assert cli.main(["alerts", store, "--state", "new"]) == 0
    assert sorted(json.loads(x)["evidence_count"] for x in capsys.readouterr().out.strip().split("\n")) == [1, 1, 6]
    assert cli.main(["claim", store, "2024-01-01T00:05:00Z", "--most", "2"]) == 0
    taken = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert len(taken) == 2 and all(r["state"] == "sending" and r["original_json"] for r in taken)
    assert cli.main(["failed", store, taken[0]["lease_token"], "HTTP_503", "2024-01-01T00:05:00Z"]) == 0
    assert cli.main(["redrive", store, "operator", "repaired", "2024-01-01T00:06:00Z"]) == 0
    assert [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")] == [{"failed": 2}, {"redrive": len(held(store))}]
    spark.read.parquet(f"{tmp_path}/copy/outbox").limit(3).write.mode("append").parquet(f"{tmp_path}/copy/outbox")
    with pytest.raises(ValueError, match="not as it was"):
        sinks.restore(spark, f"{tmp_path}/copy", f"{tmp_path}/third")
    alerts = spark.read.parquet(f"{store}/alerts")
    one = alerts.filter("rule_id = 'AUTH-001'").first().finding_id
    path = f"{tmp_path}/review.zip"
    sinks.review_archive(path, one, alerts, alerts, spark.read.parquet(f"{store}/events"))
    import zipfile

    with zipfile.ZipFile(path) as z:
        assert len(json.loads(z.read("anchors.json"))) == 6 and json.loads(z.read("alert.json"))["finding_id"] == one


def test_labelled_corpus(spark, tmp_path, capsys):
    import hashlib

    from tracelake.sources import corpus

    lines = [json.loads(x) for x in scenario()]
    names = {"a": ("development", True, lines), "b": ("development", False, lines[:3]), "c": ("holdout", True, lines[:1])}
    with open(tmp_path / "manifest.jsonl", "w") as m:
        for n, (split, expected, events) in names.items():
            text = json.dumps({"id": n, "split": split, "expected_review": expected, "variant": "v", "rationale": "r", "events": events})
            (tmp_path / f"{n}.json").write_text(text)
            m.write(json.dumps({"file": f"{n}.json", "sha256": hashlib.sha256(text.encode()).hexdigest()}) + "\n")
    assert cli.main(["evaluate", str(tmp_path)]) == 0
    got = {(r["split"], r["method"]): (r["tp"], r["fp"], r["fn"], r["tn"], r["recall"]) for r in map(json.loads, capsys.readouterr().out.strip().split("\n"))}
    assert got == {("development", m): (1, 0, 0, 1, 1.0) for m in ("rules", "sequences")} | {("holdout", m): (0, 0, 1, 0, 0.0) for m in ("rules", "sequences")}
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "d.json").write_text("{}")
    assert sorted(map(tuple, corpus.load_scenarios(spark, str(tmp_path))[1].collect())) == [("b.json", "other bytes"), ("d.json", "not in the manifest")]
    assert cli.main(["evaluate", str(tmp_path)]) == 2
