"""python -m tracelake COMMAND: ingest, analyze, hunt, query, investigate, search, scripts, decode, network, verify, evaluate, live, claim, delivered, failed, redrive, snapshot, restore, alerts."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelake")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        return c

    command("ingest", "source", "table")
    command("analyze", "table", "output").add_argument("--allowlist")
    command("hunt", "table")
    command("query", "table", "name")
    command("investigate", "table", "scope")
    s = command("search", "table")
    for o in ("--host", "--user", "--start", "--end", "--term"):
        s.add_argument(o)
    s.add_argument("--event-id", type=int)
    s.add_argument("--limit", type=int, default=100)
    command("scripts", "table")
    command("decode", "text")
    command("network", "capture")
    command("verify", "bundle")
    command("evaluate", "folder")
    live = command("live", "source", "store", "now")
    command("claim", "store", "now").add_argument("--most", type=int, default=100)
    command("delivered", "store", "token")
    command("failed", "store", "token", "error", "now")
    command("redrive", "store", "actor", "reason", "now")
    live.add_argument("--batch", type=int, default=0)
    live.add_argument("--window", type=int, default=600)
    live.add_argument("--most", type=int)
    command("snapshot", "store", "folder")
    command("restore", "folder", "store")
    listed = command("alerts", "store")
    listed.add_argument("--state")
    listed.add_argument("--limit", type=int, default=50)
    return p


def show(df, most: int = 1000) -> None:
    rows = df.limit(most + 1).collect()
    for r in rows[:most]:
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))
    if len(rows) > most:
        print(f"only the first {most} rows are shown", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions.text import encoded_command
    from .operators import network, review
    from .plans import windows
    from .sources import captures, corpus, events, sinks
    from .streaming import live

    a = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    if a.command == "verify":
        problems = sinks.verify_bundle(spark, a.bundle)
        print("\n".join(problems) or "unchanged")
        return 2 if problems else 0
    if a.command == "evaluate":
        scenarios, problems = corpus.load_scenarios(spark, a.folder)
        if not problems.isEmpty():
            show(problems)
            return 2
        found = windows.findings(corpus.scenario_events(scenarios)).join(corpus.scenario_events(scenarios).select("event_uid", "scenario"), "event_uid")
        rules_, sequences = (found.filter(F.col("rule_id").startswith(x)).select("scenario", F.lit(m).alias("method")) for x, m in (("WIN-", "rules"), ("AUTH-", "sequences")))
        show(corpus.evaluate(scenarios, rules_.unionByName(sequences), ["rules", "sequences"]).orderBy("split", "method"))
        return 0
    if a.command == "live":
        got = events.ingest(spark, a.source)
        if not got.errors.isEmpty():
            show(got.errors)
            return 2
        store = live.Store(spark, a.store, got.events.schema)
        live.process(store, got.events, a.batch, windows.findings, F.lit(a.now).cast("timestamp"), a.window, live.Limits(batch_records=a.most))
        return 0
    if a.command in ("claim", "delivered", "failed", "redrive"):
        queue = sinks.live_queue(spark, a.store)
        now = F.lit(a.now).cast("timestamp") if a.command != "delivered" else None
        if a.command == "claim":
            taken = queue.claim(now, a.most)
            if taken is not None:
                show(taken.rows.join(spark.read.parquet(f"{a.store}/events").select("event_uid", "original_json"), "event_uid").orderBy("stamp", "event_uid"))
            return 0
        n = queue.delivered(a.token) if a.command == "delivered" else queue.failed(a.token, a.error, now) if a.command == "failed" else queue.redrive(a.actor, a.reason, now)
        print(json.dumps({a.command: n}))
        return 0
    if a.command == "snapshot":
        print(json.dumps(sinks.snapshot(spark, a.store, a.folder)))
        return 0
    if a.command == "restore":
        sinks.restore(spark, a.folder, a.store)
        return 0
    if a.command == "alerts":
        show(review.alert_list(spark.read.parquet(f"{a.store}/alerts"), "finding_id", a.state, a.limit))
        return 0
    if a.command == "ingest":
        known = spark.read.parquet(f"{a.table}/sources") if _there(spark, f"{a.table}/sources") else None
        got = events.ingest(spark, a.source, known)
        if not got.errors.isEmpty():
            show(got.errors)
            return 2
        got.events.write.mode("append").parquet(f"{a.table}/events")
        got.sources.write.mode("append").parquet(f"{a.table}/sources")
        return 0
    if a.command == "decode":
        show(spark.range(1).select(encoded_command(F.lit(a.text)).alias("r")).select("r.*"))
        return 0
    if a.command == "network":
        p = network.with_flows(captures.read_packets(spark, a.capture))
        show(network.flows(p))
        return 0
    table = spark.read.parquet(f"{a.table}/events")
    if a.command == "analyze":
        allowed = None
        if a.allowlist:
            with open(a.allowlist, encoding="utf-8") as f:
                allowed = json.load(f)
        print(json.dumps(sinks.write_bundle(a.output, table, windows.findings(table, allowed), spark.read.parquet(f"{a.table}/sources"), {"allowlist": a.allowlist})))
    elif a.command == "hunt":
        print(json.dumps(windows.run_hunts(spark, table), default=str))
    elif a.command == "query":
        show(windows.run_query(spark, table, a.name))
    elif a.command == "investigate":
        for df in windows.investigate(windows.unique_events(table)[0], a.scope):
            show(df)
    elif a.command == "search":
        show(events.search(table, a.host, a.user, a.start, a.end, a.event_id, a.term, a.limit))
    elif a.command == "scripts":
        show(windows.script_blocks(table))
    return 0


def _there(spark, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


if __name__ == "__main__":
    sys.exit(main())
