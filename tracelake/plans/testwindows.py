"""The Windows plans as queries: the test table ``events`` dressed as Windows events, each query with its SQL.

Errors are failed logons and purchases successful ones, of an account for each user; signups are uses of another
account's credentials; views start a process and clicks open its connections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import streamed
from . import windows
from .testdata import DAY, EVENTS, ORACLE, QUERIES, events_stream, query

__all__ = ["ORACLE", "QUERIES"]  # those of the test tables and these



def windows_events(spark: SparkSession, d: str, stream: DataFrame | None = None) -> DataFrame:
    e = (spark.read.parquet(f"{d}/events.parquet") if stream is None else stream).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    of = lambda **fields: F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    user, text = F.col("user_id").cast("string"), F.lit
    guid = F.concat(text("{00000000-0000-0000-0000-"), F.lpad(user, 12, "0"), text("}"))
    logon = of(TargetUserName=F.concat(text("user"), user), TargetDomainName=text("LAB"), IpAddress=F.concat(text("10.0.0."), (F.col("user_id") % 250 + 1).cast("string")), LogonType=text("3"))
    other = of(SubjectUserSid=F.concat(text("S-1-"), user), SubjectUserName=F.concat(text("user"), user), SubjectDomainName=text("LAB"), TargetDomainName=text("LAB"), TargetServerName=text("SRV"), TargetUserName=F.concat(text("acct"), F.col("k").cast("string")), IpAddress=text("10.0.0.1"))
    started = of(Image=F.when(F.col("k") % 2 == 0, text("C:\\w\\MSHTA.exe")).otherwise(text("C:\\w\\calc.exe")), CommandLine=F.concat(text("mshta "), F.when(F.col("k") % 3 == 0, text("https://a.test/")).otherwise(text("local.hta"))), ProcessGuid=guid)
    opened = of(ProcessGuid=guid, Initiated=text("true"), DestinationIp=F.concat(text("10.9.0."), F.col("k").cast("string")))
    kinds = {"error": (4625, windows.SECURITY, logon), "purchase": (4624, windows.SECURITY, logon), "signup": (4648, windows.SECURITY, other), "view": (1, windows.SYSMON, started), "click": (3, windows.SYSMON, opened)}
    pick = lambda i: F.coalesce(*[F.when(F.col("event_type") == k, i(v)) for k, v in kinds.items()])
    return e.select(
        F.col("event_id").cast("string").alias("event_uid"), F.lit("s").alias("source_sha256"), F.col("event_id").alias("source_line"), F.col("ts").alias("timestamp"), F.concat(F.lit("WS"), user).alias("host"),
        pick(lambda v: F.lit(v[1][1])).alias("channel"), pick(lambda v: F.lit(v[1][0])).alias("provider"), pick(lambda v: F.lit(v[0]).cast("long")).alias("event_id"), F.col("event_id").alias("record_id"), pick(lambda v: v[2]).alias("event_data"),
    )


_SEQUENCE = """x AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM events WHERE event_type IN ('error', 'purchase')),
y AS (SELECT *, lag(ts, 3) OVER w AS nth, string_agg(event_id::VARCHAR, ':') OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS evidence FROM x WINDOW w AS (PARTITION BY user_id, seg ORDER BY ts, event_id))"""


@query(f"WITH {_SEQUENCE} SELECT event_id::VARCHAR AS event_uid, 'WS' || user_id AS host, sha256('AUTH-001:' || evidence) AS finding_id FROM y WHERE event_type = 'purchase' AND ts - nth <= INTERVAL 7 DAY")
def w01_success_after_failures(spark, d):
    return windows.success_after_failures(windows_events(spark, d), 3, 7 * DAY).select("event_uid", "host", "finding_id")


_GREEDY = """c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM b),
g AS (SELECT event_id, user_id, ts, n, ts AS last, true AS fires FROM c WHERE n = 1
  UNION ALL SELECT c.event_id, c.user_id, c.ts, c.n, CASE WHEN c.ts - g.last > INTERVAL 4 DAY THEN c.ts ELSE g.last END, c.ts - g.last > INTERVAL 4 DAY FROM g JOIN c ON c.user_id = g.user_id AND c.n = g.n + 1)"""


@query(f"""WITH RECURSIVE b AS (SELECT * FROM (SELECT *, lag(ts, 2) OVER w AS nth, string_agg(event_id::VARCHAR, ':') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS evidence
  FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE ts - nth <= INTERVAL 4 DAY), {_GREEDY}
SELECT event_id::VARCHAR AS event_uid, 'WS' || g.user_id AS host, sha256('AUTH-002:' || evidence) AS finding_id FROM g JOIN b USING (event_id) WHERE fires""")
def w02_failure_bursts(spark, d):
    return windows.failure_bursts(windows_events(spark, d), 3, 4 * DAY).select("event_uid", "host", "finding_id")


@query(f"""WITH RECURSIVE {EVENTS}, s AS (SELECT * FROM e WHERE event_type = 'signup'),
b AS (SELECT a.event_id, a.user_id, a.ts FROM s a JOIN s z ON z.user_id = a.user_id AND z.ts BETWEEN a.ts - INTERVAL 4 DAY AND a.ts AND (z.ts, z.event_id) <= (a.ts, a.event_id) GROUP BY ALL HAVING count(DISTINCT z.k) >= 3), {_GREEDY},
l AS (SELECT g.event_id, z.k, max((z.ts, z.event_id)) AS o FROM g JOIN s z ON fires AND z.user_id = g.user_id AND z.ts BETWEEN g.ts - INTERVAL 4 DAY AND g.ts AND (z.ts, z.event_id) <= (g.ts, g.event_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY o DESC) AS n FROM l)
SELECT event_id::VARCHAR AS event_uid, sha256('AUTH-003:' || string_agg(o[2]::VARCHAR, ':' ORDER BY o)) AS finding_id FROM r WHERE n <= 3 GROUP BY event_id""")
def w03_explicit_credentials(spark, d):
    return windows.explicit_credentials(windows_events(spark, d), 3, 4 * DAY).select("event_uid", "finding_id")


@query(f"""WITH RECURSIVE {EVENTS}, {_SEQUENCE} SELECT 'WIN-004' AS rule_id, 'high' AS severity, count(*) AS n FROM e WHERE event_type = 'view' AND k % 6 = 0
UNION ALL SELECT 'AUTH-001', 'high', count(*) FROM y WHERE event_type = 'purchase' AND ts - nth <= INTERVAL 7 DAY""")
def w04_findings(spark, d):
    found = windows.findings(windows_events(spark, d), auth=(3, 7 * DAY), credential=(1000, 300))
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS} SELECT 'WS' || user_id AS host, 'LAB' AS subject_domain, 'user' || user_id AS subject, 'SRV' AS target_server, count(DISTINCT k) AS distinct_target_users, count(*) AS observations
FROM e WHERE event_type = 'signup' GROUP BY ALL ORDER BY distinct_target_users DESC, host, subject_domain, subject, target_server LIMIT 100""")
def w05_credential_hunt(spark, d):
    return windows.run_query(spark, windows_events(spark, d), "HUNT-06")


@query(f"""WITH {EVENTS} SELECT c.event_id::VARCHAR AS creation_uid, n.event_id::VARCHAR AS network_uid, 'WS' || c.user_id AS host, CASE WHEN c.k % 2 = 0 THEN 'C:\\w\\MSHTA.exe' ELSE 'C:\\w\\calc.exe' END AS image, '10.9.0.' || n.k AS destination, 'true' AS initiated
FROM e c JOIN e n ON c.user_id = n.user_id AND n.ts >= c.ts WHERE c.event_type = 'view' AND n.event_type = 'click' AND c.user_id <> 0 ORDER BY c.ts, n.ts, creation_uid, network_uid LIMIT 100""")
def w06_process_connections(spark, d):
    return windows.run_query(spark, windows_events(spark, d), "HUNT-02")


@query("""SELECT 'WS' || user_id AS host, event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY ALL""")
def w07_logon_summary(spark, d):
    s = windows.run_query(spark, windows_events(spark, d), "auth_summary")
    kind = F.when(F.col("event_id") == 4625, "error").when(F.col("event_id") == 4624, "purchase").otherwise("signup")
    return s.groupBy("host", kind.alias("kind")).agg(F.sum("event_count").alias("n"))


@query("""SELECT CASE WHEN event_type IN ('view', 'click') THEN 'Microsoft-Windows-Sysmon' ELSE 'Microsoft-Windows-Security-Auditing' END AS provider,
CASE event_type WHEN 'error' THEN 4625 WHEN 'purchase' THEN 4624 WHEN 'signup' THEN 4648 WHEN 'view' THEN 1 ELSE 3 END::BIGINT AS event_id, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase', 'signup', 'view', 'click') GROUP BY ALL""")
def w08_event_counts(spark, d):
    found = windows.event_counts(windows_events(spark, d).filter("provider is not null"))
    return found.select("provider", "event_id", F.col(found.columns[-1]).alias("n"))


@query(f"SELECT 'AUTH-001' AS rule_id, * FROM ({ORACLE['w01_success_after_failures']}) UNION ALL SELECT 'AUTH-002', * FROM ({ORACLE['w02_failure_bursts']})")
def w09_streamed_leads(spark, d):
    """The leads of w01 and w02 from a stream, with state for each key."""
    e = windows_events(spark, d, events_stream(spark, d))
    return streamed(windows.streamed_leads(e, auth=(3, 7 * DAY), credential=(3, 4 * DAY)), "leads").select("rule_id", "event_uid", "host", "finding_id")
