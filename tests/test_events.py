import hashlib
import json

from pyspark.sql import functions as F

from tracelake.plans import windows
from tracelake.sources import events
from tracelake.streaming import live

SECURITY = {"channel": "Security", "provider": "Microsoft-Windows-Security-Auditing"}
SYSMON = {"channel": "Microsoft-Windows-Sysmon/Operational", "provider": "microsoft-windows-sysmon"}
LOGON = {"TargetUserName": "Ann", "TargetDomainName": "LAB", "IpAddress": "10.1.1.1", "LogonType": "3", "LogonGuid": "{00000000-0000-0000-0000-00000000000a}", "TargetLogonId": "0x1"}
G = "{{00000000-0000-0000-0000-0000000000{:02d}}}".format


def line(second, event_id, source, data, host="WS1", record=None):
    return json.dumps({"timestamp": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z", "host": host, "event_id": event_id, "record_id": record or second, "event_data": data} | source)


def process(second, guid, parent, image, command):
    return line(second, 1, SYSMON, {"ProcessGuid": guid, "ParentProcessGuid": parent, "Image": image, "CommandLine": command, "User": "lab\\ann", "LogonGuid": LOGON["LogonGuid"], "LogonId": "0X1"}, host="ws1")


def scenario():
    rows = [line(i, 4625, SECURITY, LOGON) for i in range(5)] + [line(10, 4624, SECURITY, LOGON)]
    rows += [process(20, G(1), G(99), "C:\\x\\mshta.exe", "mshta.exe https://a.test/x"), process(30, G(2), G(1), "C:\\x\\schtasks.exe", "schtasks.exe /create /tr powershell /tn x")]
    rows += [line(25, 3, SYSMON, {"ProcessGuid": G(1), "Initiated": "true", "DestinationIp": "1.2.3.4"})]
    rows += [line(40 + i, 4104, {"channel": "Microsoft-Windows-PowerShell/Operational", "provider": "Microsoft-Windows-PowerShell"}, {"ScriptBlockId": "B", "MessageNumber": str(i), "MessageTotal": "2", "ScriptBlockText": f"part{i};"}) for i in (1, 2)]
    return rows


def write(path, lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_ingest_is_strict_and_whole(spark, tmp_path):
    good = write(tmp_path / "good.jsonl", ["﻿" + scenario()[0], "", scenario()[1] + "\r"])
    base = json.loads(scenario()[0])
    wrong = [base | {"timestamp": "2024-01-01T00:00:00"}, base | {"event_id": True}, base | {"event_id": 1.0}, base | {"event_data": {"a": 1}}, base | {"host": " "}, base | {"record_id": -1}]
    for i, bad in enumerate(wrong):
        write(tmp_path / f"bad{i}.jsonl", [scenario()[2], json.dumps(bad)])
    write(tmp_path / "bad9.jsonl", ["{not json"])
    got = events.ingest(spark, f"{tmp_path}/*.jsonl")
    sha = hashlib.sha256(open(good, "rb").read()).hexdigest()
    rows = got.events.orderBy("source_line").collect()
    assert [(r.source_sha256, r.source_line, r.event_uid) for r in rows] == [(sha, n, hashlib.sha256(f"{sha}:{n}".encode()).hexdigest()) for n in (1, 3)]
    assert got.errors.select("source_sha256").distinct().count() == len(wrong) + 1
    assert events.ingest(spark, good, known=got.sources).events.count() == 0
    assert events.reread(got.events, events.ingest(spark, good).events).count() == 0
    assert events.search(got.events, user="ANN", term='"4"', event_id=4625, start="2024-01-01T00:00:01Z").count() == 0
    assert events.search(got.events, user="ANN", host="WS1").count() == 2
    assert events.flatten(got.events).first().CommandLine == ""


def test_files_are_read_in_ranges(spark, tmp_path):
    """Physical line numbers and event ids are those of the whole file, wherever Spark cuts it."""
    plain = scenario()
    texts = {
        "mark.jsonl": "\ufeff" + "\n".join(plain[:3]),
        "crlf.jsonl": "\r\n".join(plain) + "\r\n",
        "blank.jsonl": "\n\n" + "\n\n \n".join(plain * 30) + "\n\n",
        "umlaut.jsonl": "\n".join(x.replace("WS1", "Wörk😀") for x in plain * 40) + "\n",
        "none.jsonl": "",
        "lf.jsonl": "\n\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "odd.jsonl").write_bytes(plain[0].encode().replace(b"WS1", b"W\xff1") + b"\n" + plain[1].encode())
    wanted = set()
    for text in texts.values():
        sha = hashlib.sha256(text.encode()).hexdigest()
        wanted |= {(sha, n, x.rstrip("\r").lstrip("\ufeff")) for n, x in enumerate(text.split("\n"), 1) if x.strip()}
    for most in ("700", "4097", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        try:
            got = events.ingest(spark, f"{tmp_path}/*.jsonl")
            rows = got.events.collect()
            assert {(r.source_sha256, r.source_line, r.original_json) for r in rows} == wanted and len(rows) == len(wanted)
            assert all(r.event_uid == hashlib.sha256(f"{r.source_sha256}:{r.source_line}".encode()).hexdigest() for r in rows)
            assert [(r.source_line, r.error) for r in got.errors.collect()] == [(1, "not UTF-8")]
            assert {(r.source_sha256, r.event_count) for r in got.sources.collect()} == {(s, sum(w[0] == s for w in wanted)) for s in {w[0] for w in wanted}}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_findings_hunts_chain_and_scripts(spark, tmp_path):
    e = events.ingest(spark, write(tmp_path / "s.jsonl", scenario() + [scenario()[0]])).events.cache()
    assert sorted((r.rule_id, len(r.evidence)) for r in windows.findings(e).collect()) == [("AUTH-001", 6), ("WIN-004", 1), ("WIN-008", 1)]
    told = windows.run_hunts(spark, e)
    assert [len(h["rows"]) for h in told["hunts"]] == [2, 1, 1, 0, 2, 0, 0, 0]
    assert (told["total_events"], [x["events"] for x in told["sources"]]) == (12, [12])
    assert windows.run_query(spark, e, "mshta_remote").count() == 1
    unique, aliases = windows.unique_events(e)
    assert (unique.count(), aliases.count()) == (11, 1)
    unique = spark.createDataFrame(unique.collect(), unique.schema)
    chains, candidates = windows.investigate(unique, "scope")
    assert chains.count() == 1 and [(r.complete, r.missing) for r in candidates.collect()] == [(True, [])]
    assert [(r.complete, r.script) for r in windows.script_blocks(e).collect()] == [(True, "part1;part2;")]


def test_micro_batches_equal_one_batch(spark, tmp_path):
    e = events.ingest(spark, write(tmp_path / "s.jsonl", scenario())).events
    e = spark.createDataFrame(e.collect(), e.schema)
    store = live.Store(spark, f"{tmp_path}/store", e.schema)
    now = F.lit("2024-01-01T00:05:00Z").cast("timestamp")
    halves = [e.filter("event_id = 4625"), e.filter("event_id != 4625").union(e.limit(3)), e.filter("event_id != 4625")]
    for i, half in enumerate([halves[0], halves[1], halves[1], halves[2]]):
        live.process(store, half, min(i, 2) if i < 3 else 3, windows.findings, now, 600)
    live.process(store, halves[1], 1, windows.findings, now, 600)  # a repeated batch changes nothing
    assert store.read("events").count() == e.count()
    assert sorted(r.finding_id for r in store.read("alerts").collect()) == sorted(r.finding_id for r in windows.findings(e).collect())
    import pytest

    for limits in (live.Limits(batch_records=3), live.Limits(batch_bytes=100), live.Limits(stored_events=12), live.Limits(waiting_rows=5)):
        with pytest.raises(live.NotAdmitted):
            live.process(store, halves[1], 9, windows.findings, now, 600, limits)
    assert {r.state: r["count"] for r in store.queue.read().groupBy("state").count().collect()} == {"pending": e.count()}
    assert store.queue.claim(now, 100).rows.count() == e.count()


def test_streamed_leads_equal_those_of_the_batch(spark, tmp_path):
    e = events.ingest(spark, write(tmp_path / "s.jsonl", scenario())).events
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    query = windows.streamed_leads(stream, auth=(5, 600), credential=(3, 300)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r.rule_id, r.finding_id, tuple(r.evidence)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    wanted = windows.success_after_failures(e).unionByName(windows.failure_bursts(e, 3, 300))
    store = live.Store(spark, f"{tmp_path}/store", e.schema)
    assert live.run_leads(windows.streamed_leads(stream, auth=(5, 600), credential=(3, 300)), store, f"{tmp_path}/again", lambda: F.lit("2024-01-01T00:05:00Z").cast("timestamp")).awaitTermination(120)
    assert {(r.rule_id, r.finding_id, tuple(r.evidence)) for r in store.read("leads").collect()} == got
    assert got == {(r.rule_id, r.finding_id, tuple(r.evidence)) for r in wanted.collect()} and any(r[0] == "AUTH-001" for r in got)


def test_private_events_need_a_private_store(spark, tmp_path):
    import pytest

    e = events.ingest(spark, write(tmp_path / "s.jsonl", scenario())).events
    now = F.lit("2024-01-01T00:05:00Z").cast("timestamp")
    (tmp_path / "private").mkdir()
    for at, roots in ((f"{tmp_path}/store", ()), (f"{tmp_path}/private/../store", (f"{tmp_path}/private",)), (f"{tmp_path}/private-not", (f"{tmp_path}/private",))):
        with pytest.raises(live.NotAdmitted, match="private"):
            live.process(live.Store(spark, at, e.schema, roots), e, 0, windows.findings, now, 600, private=True)
    store = live.Store(spark, f"{tmp_path}/private/store", e.schema, (f"file://{tmp_path}/private",))
    live.process(store, e, 0, windows.findings, now, 600, private=True)
    assert {r.state for r in store.queue.read().collect()} == {"held_private"} and store.queue.claim(now) is None
