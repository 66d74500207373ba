"""Windows security analysis: rules, authentication sequences, hunts, sessions and chains over event tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import micros
from ..operators import fragments, graph, joins, rules, sequence
from ..operators.review import fingerprint
from ..storage import written
from ..streaming import state
from ..operators.rules import Condition, Rule

SECURITY = ("Microsoft-Windows-Security-Auditing", "Security")
SYSMON = ("Microsoft-Windows-Sysmon", "Microsoft-Windows-Sysmon/Operational")
POWERSHELL = ("Microsoft-Windows-PowerShell", "Microsoft-Windows-PowerShell/Operational")
EVENTLOG = ("Microsoft-Windows-Eventlog", "Security")

#: Programs that interpret scripts.
INTERPRETERS = ("powershell", "pwsh", "wscript", "cscript", "mshta")
SHELLS = ("\\powershell.exe", "\\pwsh.exe")


def _from(source: tuple[str, str], event_id: int, *conditions: Condition) -> tuple[Condition, ...]:
    return (Condition("provider", "equals", source[0]), Condition("channel", "equals", source[1]), Condition("event_id", "equals", event_id), *conditions)


def _any(field: str, *values: str) -> Condition:
    return Condition(f"event_data.{field}", "contains_any", values)


def _ends(field: str, *values: str) -> Condition:
    return Condition(f"event_data.{field}", "endswith_any", values)


#: The declarative rules.
RULES = (
    Rule("WIN-001", "PowerShell encoded-command switch", "medium", _from(SYSMON, 1, _ends("Image", *SHELLS), _any("CommandLine", " -enc ", " -encodedcommand ", " -e ")), ("T1059.001", "T1027")),
    Rule("WIN-002", "PowerShell execution-policy bypass switch", "low", _from(SYSMON, 1, _ends("Image", *SHELLS), _any("CommandLine", "-executionpolicy bypass", "-ep bypass")), ("T1059.001",)),
    Rule("WIN-003", "Certutil file decoding", "medium", _from(SYSMON, 1, _ends("Image", "\\certutil.exe"), _any("CommandLine", " -decode ", " -decodehex ")), ("T1140",)),
    Rule("WIN-004", "Mshta with a remote URL or inline script", "high", _from(SYSMON, 1, _ends("Image", "\\mshta.exe"), _any("CommandLine", *tx.SCRIPT_SCHEMES)), ("T1218.005",)),
    Rule("WIN-005", "New scheduled task containing a script interpreter", "medium", _from(SECURITY, 4698, _any("TaskContent", *INTERPRETERS)), ("T1053.005",)),
    Rule(
        "WIN-006",
        "Run-key value set to a script interpreter",
        "medium",
        _from(SYSMON, 13, _any("TargetObject", "\\software\\microsoft\\windows\\currentversion\\run\\", "\\software\\microsoft\\windows\\currentversion\\runonce\\"), _any("Details", *INTERPRETERS)),
        ("T1547.001",),
    ),
    Rule("WIN-007", "Windows Security audit log cleared", "high", _from(EVENTLOG, 1102), ("T1070.001",)),
    Rule("WIN-008", "Schtasks creation targeting a script interpreter", "medium", _from(SYSMON, 1, _ends("Image", "\\schtasks.exe"), _any("CommandLine", " /create "), _any("CommandLine", *INTERPRETERS)), ("T1053.005",)),
    Rule(
        "WIN-009",
        "PowerShell script block with download-and-evaluate text",
        "medium",
        _from(POWERSHELL, 4104, _any("ScriptBlockText", "downloadstring", "downloadfile", "invoke-webrequest"), _any("ScriptBlockText", "iex", "invoke-expression")),
        ("T1059.001", "T1105"),
    ),
)
#: Fields that an allowlist entry states in full.
CONTEXT_FIELDS = ["host", "event_data.User", "event_data.Image", "event_data.CommandLine", "event_data.ParentImage"]
ORDER = ["source_sha256", "source_line"]


def data(name: str) -> Column:
    return F.col("event_data")[name]


def is_from(source: tuple[str, str], *ids: int) -> Column:
    return (F.lower("provider") == source[0].lower()) & (F.lower("channel") == source[1].lower()) & F.col("event_id").isin(*ids)


def with_auth_key(events: DataFrame, cross_source: bool) -> DataFrame:
    """Events whose identity is complete and remote, with auth_key."""
    parts = [F.col("host"), *[data(k) for k in ("TargetUserName", "TargetDomainName", "IpAddress", "LogonType")]]
    whole = F.lit(True)
    for p in parts:
        whole = whole & F.coalesce(~F.lower(F.trim(p)).isin(*tx.MISSING_IDENTITY), F.lit(False))
    scope = F.lit("combined") if cross_source else F.col("source_sha256")
    remote = ~data("IpAddress").isin(*tx.LOCAL_ADDRESSES)
    return events.filter(whole & remote).withColumn("auth_key", F.array(scope, *[tx.casefold(p) for p in parts]))


def _leads(rows: DataFrame, rule_id: str | Column, severity: str | Column) -> DataFrame:
    out = rows.select("event_uid", "timestamp", "host", F.col("evidence").alias("evidence"), F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"))
    return out.withColumn("finding_id", rules.finding_id(F.col("rule_id"), F.col("evidence")))


def success_after_failures(events: DataFrame, threshold: int = 5, window: int = 600, cross_source: bool = False) -> DataFrame:
    """AUTH-001."""
    rows = with_auth_key(events.filter(is_from(SECURITY, 4624, 4625)), cross_source)
    failed, passed = F.col("event_id") == 4625, F.col("event_id") == 4624
    return _leads(sequence.followed_by(rows, ["auth_key"], "timestamp", ORDER, failed, passed, threshold, window, "event_uid"), "AUTH-001", "high")


def failure_bursts(events: DataFrame, threshold: int = 10, window: int = 300, cross_source: bool = False) -> DataFrame:
    """AUTH-002: network logons only, one finding a key and window."""
    rows = with_auth_key(events.filter(is_from(SECURITY, 4625) & data("LogonType").isin("3", "10")), cross_source)
    hits = sequence.burst(rows, ["auth_key"], "timestamp", ORDER, threshold, window, "event_uid")
    hits = hits.select("auth_key", "timestamp", *ORDER, "event_uid", "host", "evidence")
    return _leads(sequence.cooldown(hits, ["auth_key"], "timestamp", ORDER, window), "AUTH-002", "medium")


def streamed_leads(events: DataFrame, delay: str | None = None, auth: tuple[int, int] = (5, 600), credential: tuple[int, int] = (10, 300), cross_source: bool = False) -> DataFrame:
    """AUTH-001 and AUTH-002 on a stream of events, by one pass with one state for every key: nothing that is stored is read again."""
    failed, passed = F.col("event_id") == 4625, F.col("event_id") == 4624
    # The key is one text, and only what the leads need goes through the state.
    rows = with_auth_key(events.filter(is_from(SECURITY, 4624, 4625)), cross_source).withColumn("auth_key", F.to_json("auth_key"))
    network = data("LogonType").isin("3", "10")
    found = state.followed_by_and_burst_once(rows, ["auth_key"], "timestamp", ORDER, failed, passed, *auth, network, *credential, credential[1], "event_uid", ["timestamp", "host"], delay)
    first = F.col("which") == 0
    return _leads(found, F.when(first, "AUTH-001").otherwise("AUTH-002"), F.when(first, "high").otherwise("medium"))


def explicit_credentials(events: DataFrame, threshold: int = 10, window: int = 300, cross_source: bool = False) -> DataFrame:
    """AUTH-003: one origin, many target accounts; evidence is the latest event of each of the last accounts."""
    fields = ("SubjectUserSid", "SubjectUserName", "TargetDomainName", "TargetServerName", "IpAddress")
    whole = ~F.coalesce(F.trim(data("TargetUserName")), F.lit("")).isin("", "-")
    for k in fields:
        whole = whole & ~F.coalesce(F.trim(data(k)), F.lit("")).isin("", "-")
    scope = F.lit("combined") if cross_source else F.col("source_sha256")
    rows = events.filter(is_from(SECURITY, 4648) & whole)
    rows = rows.withColumn("auth_key", F.array(scope, tx.casefold(F.col("host")), *[tx.casefold(F.trim(data(k))) for k in fields])).withColumn("account", tx.casefold(data("TargetUserName")))
    hits = sequence.distinct_in_window(rows, ["auth_key"], "timestamp", ORDER, "account", window).filter(F.col("distinct_values") >= threshold)
    fired = sequence.cooldown(hits.select("auth_key", "timestamp", *ORDER, "event_uid", "host"), ["auth_key"], "timestamp", ORDER, window)
    # The evidence is looked up for what fires alone: the last accounts, each with its latest event.
    at = F.struct("timestamp", *ORDER).alias("__o")
    seen = rows.select(F.col("auth_key").alias("__key"), F.col("timestamp").alias("__ts"), at, "account", F.col("event_uid").alias("__u"))
    asked = fired.select(F.col("event_uid").alias("__lead"), "auth_key", "timestamp", at.alias("__at"))
    pairs = joins.interval_join(asked, seen, [("auth_key", "__key")], "timestamp", "__ts", window, 0, F.col("__o") <= F.col("__at"))
    latest = pairs.groupBy("__lead", "account").agg(F.max(F.struct("__o", "__u")).alias("__last"))
    latest = latest.withColumn("__n", F.row_number().over(Window.partitionBy("__lead").orderBy(F.desc("__last")))).filter(F.col("__n") <= threshold)
    evidence = latest.groupBy("__lead").agg(F.transform(F.array_sort(F.collect_list("__last")), lambda x: x["__u"]).alias("evidence"))
    return _leads(fired.join(evidence, F.col("event_uid") == F.col("__lead")), "AUTH-003", "medium")


def findings(events: DataFrame, allowlist: list[dict] | None = None, auth: tuple[int, int] = (5, 600), credential: tuple[int, int] = (10, 300), cross_source: bool = False) -> DataFrame:
    """All findings: rule_id, severity, finding_id, event_uid, timestamp, host, evidence, context_id, status."""
    found = rules.match(events, list(RULES), "event_uid").withColumn("evidence", F.array("event_uid"))
    found = rules.annotate(found, allowlist or [], CONTEXT_FIELDS)
    columns = ["rule_id", "severity", "finding_id", "event_uid", "timestamp", "host", "evidence", "context_id", "status"]
    leads = success_after_failures(events, *auth, cross_source).unionByName(failure_bursts(events, *credential, cross_source)).unionByName(explicit_credentials(events, *credential, cross_source))
    leads = leads.withColumn("context_id", F.lit(None).cast("string")).withColumn("status", F.lit("needs_review"))
    return found.select(*columns).unionByName(leads.select(*columns))


_SYSMON_SQL = "lower(provider) = 'microsoft-windows-sysmon' AND lower(channel) = 'microsoft-windows-sysmon/operational'"
_SECURITY_SQL = "lower(provider) = 'microsoft-windows-security-auditing' AND lower(channel) = 'security'"
_POWERSHELL_SQL = "lower(provider) = 'microsoft-windows-powershell' AND lower(channel) = 'microsoft-windows-powershell/operational'"

#: Named queries over a view ``events``; every limit comes with a total order. Names, event numbers and fields.
QUERIES = {
    "mshta_remote": f"""SELECT timestamp, host, record_id, event_uid, event_data['Image'] AS image, event_data['CommandLine'] AS command_line FROM events
        WHERE {_SYSMON_SQL} AND event_id = 1 AND endswith(lower(event_data['Image']), chr(92) || 'mshta.exe')
        AND (contains(lower(event_data['CommandLine']), 'http://') OR contains(lower(event_data['CommandLine']), 'https://')) ORDER BY timestamp, source_line, event_uid""",
    "auth_summary": f"""SELECT host, event_id, event_data['TargetUserName'] AS target_user, event_data['TargetDomainName'] AS target_domain, event_data['IpAddress'] AS source_ip,
        event_data['LogonType'] AS logon_type, event_data['SubStatus'] AS substatus, count(*) AS event_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen
        FROM events WHERE {_SECURITY_SQL} AND event_id IN (4624, 4625, 4648) GROUP BY ALL ORDER BY event_count DESC, host, event_id, target_user, target_domain, source_ip, logon_type, substatus""",
    "powershell_content": f"""SELECT timestamp, host, event_id, record_id, event_uid, event_data['ScriptBlockText'] AS script_block, event_data['ContextInfo'] AS context, event_data['Payload'] AS payload
        FROM events WHERE {_POWERSHELL_SQL} AND event_id IN (4103, 4104) ORDER BY timestamp, source_line, event_uid""",
}
HUNTS = {
    "HUNT-01": f"SELECT event_data['ParentImage'] AS parent, event_data['Image'] AS child, count(*) AS observations FROM events WHERE event_id = 1 AND {_SYSMON_SQL} GROUP BY ALL ORDER BY observations, parent, child LIMIT 100",
    "HUNT-02": f"""WITH s AS (SELECT *, lower(host) AS h, lower(event_data['ProcessGuid']) AS g FROM events WHERE event_id IN (1, 3) AND {_SYSMON_SQL})
        SELECT c.event_uid AS creation_uid, n.event_uid AS network_uid, c.host, c.event_data['Image'] AS image, n.event_data['DestinationIp'] AS destination, n.event_data['Initiated'] AS initiated
        FROM s c JOIN s n ON c.h = n.h AND c.g = n.g AND n.timestamp >= c.timestamp
        WHERE c.event_id = 1 AND n.event_id = 3 AND length(c.g) = 38 AND c.g <> '{{00000000-0000-0000-0000-000000000000}}' ORDER BY c.timestamp, n.timestamp, creation_uid, network_uid LIMIT 100""",
    "HUNT-03": f"""SELECT host, event_data['TargetDomainName'] AS domain, event_data['TargetUserName'] AS account, event_data['IpAddress'] AS ip, event_data['SubStatus'] AS sub_status, count(*) AS failures
        FROM events WHERE event_id = 4625 AND {_SECURITY_SQL} GROUP BY ALL ORDER BY failures DESC, host, domain, account, ip, sub_status LIMIT 100""",
    "HUNT-04": f"SELECT event_uid, timestamp, host, event_data['TaskName'] AS task_name, event_data['TaskContent'] AS task_xml FROM events WHERE event_id = 4698 AND {_SECURITY_SQL} ORDER BY timestamp, event_uid LIMIT 100",
    "HUNT-05": f"""SELECT event_uid, host, event_data['ScriptBlockId'] AS block_id, event_data['MessageNumber'] AS part, event_data['MessageTotal'] AS total, event_data['ScriptBlockText'] AS text
        FROM events WHERE event_id = 4104 AND {_POWERSHELL_SQL} ORDER BY timestamp, event_uid LIMIT 100""",
    "HUNT-06": f"""SELECT host, event_data['SubjectDomainName'] AS subject_domain, event_data['SubjectUserName'] AS subject, event_data['TargetServerName'] AS target_server,
        count(DISTINCT lower(coalesce(event_data['TargetDomainName'], '') || chr(92) || coalesce(event_data['TargetUserName'], ''))) AS distinct_target_users, count(*) AS observations
        FROM events WHERE event_id = 4648 AND {_SECURITY_SQL} GROUP BY ALL ORDER BY distinct_target_users DESC, host, subject_domain, subject, target_server LIMIT 100""",
    "HUNT-07": "SELECT event_uid, timestamp, host, event_data FROM events WHERE event_id = 1102 AND lower(channel) = 'security' AND lower(provider) = 'microsoft-windows-eventlog' ORDER BY timestamp, event_uid LIMIT 100",
    "HUNT-08": f"SELECT event_uid, timestamp, host, event_data['Image'] AS image, event_data['TargetObject'] AS target, event_data['Details'] AS details FROM events WHERE event_id = 13 AND {_SYSMON_SQL} ORDER BY timestamp, event_uid LIMIT 100",
}


def run_query(spark: SparkSession, events: DataFrame, name: str) -> DataFrame:
    """One of the named queries or hunts; any other name is an error."""
    sql = (QUERIES | HUNTS)[name]
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=events)


#: What each hunt looks for, and what its rows do not say.
HYPOTHESES = {
    "HUNT-01": ("a parent starts a child that it rarely or never starts otherwise", "what is rare among these events may be usual elsewhere"),
    "HUNT-02": ("a process opens connections after it was created", "ids are only compared as texts; the process graph also checks their form and conflicting creations"),
    "HUNT-03": ("failed logons gather on an account, an address or a status", "a failure alone says nothing of a later success; look at its status and at the sources that were read"),
    "HUNT-04": ("a scheduled task was registered", "a registered task need not have run"),
    "HUNT-05": ("script text was recorded in fragments", "put the fragments together before words in them are judged"),
    "HUNT-06": ("one subject uses the credentials of many accounts", "administrators do so with permission; guessing of passwords is not shown"),
    "HUNT-07": ("an audit log was cleared", "maintenance clears logs, too, and no such event in a small sample doesn't prove that logs are whole"),
    "HUNT-08": ("a value was written to the registry", "key, value and permission must be looked at; no rows may mean that nothing was recorded"),
}
ROW_LIMIT, MOST_SOURCES = 100, 1000


def run_hunts(spark: SparkSession, events: DataFrame) -> dict:
    """All hunts over one table: what was searched, and each hunt with its hypothesis, caution, text hash and rows (at most ROW_LIMIT).

    Sources are listed up to MOST_SOURCES; n_sources and the fingerprint are of all of them.
    """
    out = []
    for name, sql in HUNTS.items():
        rows = [r.asDict(recursive=True) for r in run_query(spark, events, name).collect()]
        found = "rows to be reviewed" if rows else "nothing found, which may mean that nothing was collected"
        hypothesis, caution = HYPOTHESES[name]
        out.append({"id": name, "hypothesis": hypothesis, "query_sha256": hashlib.sha256(sql.encode()).hexdigest(), "rows": rows, "returned_rows": len(rows), "row_limit": ROW_LIMIT, "assessment": found, "caution": caution})
    counts = events.groupBy("source_sha256").agg(F.count("*").alias("events"))
    all_ = fingerprint(counts).first().asDict()
    listed = [r.asDict() for r in counts.orderBy("source_sha256").limit(MOST_SOURCES).collect()]
    return {"total_events": events.count(), "n_sources": counts.count(), "sources_fingerprint": all_, "sources": listed, "hunts": out, "caution": "hunts show what was recorded; they neither prove nor exclude an intrusion"}


def event_counts(events: DataFrame) -> DataFrame:
    """How many events each provider gave of each number."""
    return rules.counts(events, "provider", "event_id")


def unique_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events without exact repeats, aliases): repeats agree in all but their place; the first in canonical order stays."""
    meaning = [c for c in ("timestamp", "host", "channel", "provider", "event_id", "record_id") if c in events.columns]
    content = F.sha2(F.to_json(F.struct(*meaning, F.array_sort(F.map_entries("event_data")).alias("d"))), 256)
    rows = events.withColumn("__c", content)
    first = rows.groupBy("__c").agg(F.min_by("event_uid", F.struct("timestamp", *ORDER)).alias("__first"))
    told = rows.join(first, "__c")
    return told.filter("event_uid = __first").drop("__c", "__first"), told.filter("event_uid != __first").select("event_uid", F.col("__first").alias("kept_uid"))


def process_graph(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, activity with its node, diagnostics) of process events."""
    keyed = events.filter(is_from(SYSMON, 1, 3, 11, 13)).withColumn("h", F.lower("host")).withColumn("g", tx.guid(data("ProcessGuid")))
    creates = keyed.filter("event_id = 1").withColumn("risk", tx.risk_marker(data("Image"), data("CommandLine"))).withColumn("task", tx.creates_task(data("Image"), data("CommandLine")))
    nodes, odd = graph.nodes(creates, ["h", "g"])
    nodes = nodes.withColumn("id", F.concat_ws("|", "h", "g")).withColumn("parent", F.concat(F.col("h"), F.lit("|"), tx.guid(data("ParentProcessGuid"))))
    edges, wrong = graph.parent_edges(nodes, "id", "parent", "timestamp", ORDER)
    activity, loose = graph.attach(nodes.select("h", "g", "id", F.col("timestamp").alias("created")), keyed.filter("event_id != 1"), ["h", "g"], "created", "timestamp")
    diagnostics = odd.select(F.col("code"), F.concat_ws("|", "h", "g").alias("subject")).unionByName(wrong.select("code", F.col("child").alias("subject"))).unionByName(loose.select("code", F.col("event_uid").alias("subject")))
    return nodes, edges, activity, diagnostics


def investigate(events: DataFrame, scope_id: str, threshold: int = 5, auth_window: int = 600, chain_window: int = 900) -> tuple[DataFrame, DataFrame]:
    """(chains, candidates): failures, success, session-linked risky process, its connection, a descendant's task."""
    nodes, edges, activity, _ = process_graph(events)
    auth = with_auth_key(events.filter(is_from(SECURITY, 4624, 4625)), True)
    wins = F.col("event_id") == 4624
    starts = sequence.lookback(auth, ["auth_key"], "timestamp", F.col("event_id") == 4625, wins & data("LogonType").isin("3", "10"), auth_window, "failure_count").filter(F.col("failure_count") >= threshold)
    starts = starts.select(F.col("event_uid").alias("success_uid"), F.lower("host").alias("s_host"), F.col("timestamp").alias("s_ts"), "failure_count", tx.guid(data("LogonGuid")).alias("s_logon"), F.lower(tx.qualified_user(data("TargetDomainName"), data("TargetUserName"))).alias("s_user"), F.nullif(F.lower(data("TargetLogonId")), F.lit("")).alias("s_logon_id"))
    risky = nodes.filter("risk is not null").select(F.col("id").alias("node"), F.col("event_uid").alias("process_uid"), F.col("h").alias("n_host"), F.col("timestamp").alias("n_ts"), tx.guid(data("LogonGuid")).alias("n_logon"), F.lower(data("User")).alias("n_user"), F.nullif(F.lower(data("LogonId")), F.lit("")).alias("n_logon_id"))
    agree = F.coalesce(F.col("s_logon_id") == F.col("n_logon_id"), F.lit(True))
    linked = joins.interval_join(starts.filter("s_logon is not null"), risky, [("s_host", "n_host"), ("s_logon", "n_logon"), ("s_user", "n_user")], "s_ts", "n_ts", 0, chain_window, agree)
    within = lambda ts: micros(F.col(ts)).between(micros(F.col("s_ts")), micros(F.col("s_ts")) + chain_window * sequence.SECOND)
    first = lambda ts, uid: F.min(F.struct(ts, uid))[uid]
    network = activity.filter((F.col("event_id") == 3) & (F.lower(data("Initiated")) == "true")).select(F.col("node.id").alias("node"), F.col("timestamp").alias("c_ts"), F.col("event_uid").alias("network_uid"))
    tasks = nodes.filter("task").select(F.col("id").alias("task_node"), F.col("timestamp").alias("t_ts"), F.col("event_uid").alias("task_uid"))
    place = written(graph.positions(edges, "child", "parent"), "positions")
    own = lambda prefix, node: place.select(*[F.col(c).alias(node if c == "node" else f"{prefix}{c}") for c in place.columns])
    keys = ["success_uid", "node"]
    n = linked.join(network, "node").filter(within("c_ts")).groupBy(*keys).agg(first("c_ts", "network_uid").alias("network_uid"))
    placed = linked.select(*keys, "s_ts").join(own("n_", "node"), "node")
    beneath = joins.interval_join(placed, tasks.join(own("t_", "task_node"), "task_node"), [("n_root", "t_root")], "s_ts", "t_ts", 0, chain_window, graph.below("t_", "n_"))
    t = beneath.groupBy(*keys).agg(first("t_ts", "task_uid").alias("task_uid"))
    staged = linked.join(n, keys, "left").join(t, keys, "left")
    chains = staged.filter("network_uid is not null and task_uid is not null").select(F.sha2(F.concat(F.lit(scope_id), "success_uid", "node"), 256).alias("chain_id"), "success_uid", "process_uid", "network_uid", "task_uid", F.lit("needs_review").alias("status"))
    per = staged.groupBy("success_uid").agg(F.bool_or(F.col("network_uid").isNotNull() & F.col("task_uid").isNotNull()).alias("complete"), F.bool_or(F.col("network_uid").isNull()).alias("no_network"), F.bool_or(F.col("task_uid").isNull()).alias("no_task"), F.lit(True).alias("linked"))
    told = starts.join(per, "success_uid", "left")
    missing = F.array_compact(
        F.array(
            F.when(F.col("no_network"), F.lit("initiated network activity for the risky process")),
            F.when(F.col("s_logon").isNull(), F.lit("nonzero logon GUID")),
            F.when(F.col("no_task"), F.lit("observed descendant task-creation process")),
            F.when(F.col("linked").isNull(), F.lit("risky process with matching host, logon GUID and domain-qualified user")),
        )
    )
    complete = F.coalesce("complete", F.lit(False))
    return chains, told.select("success_uid", "failure_count", complete.alias("complete"), F.when(complete, F.array().cast("array<string>")).otherwise(F.array_sort(missing)).alias("missing"))


def script_blocks(events: DataFrame) -> DataFrame:
    """Script blocks put together from their fragments, per source, host and block."""
    rows = events.filter(is_from(POWERSHELL, 4104)).filter(F.coalesce(data("ScriptBlockId"), F.lit("")) != "")
    rows = rows.select("source_sha256", F.lower("host").alias("host"), F.lower(data("ScriptBlockId")).alias("block_id"), data("MessageNumber").alias("n"), data("MessageTotal").alias("m"), data("ScriptBlockText").alias("t"))
    return fragments.reassemble(rows, ["source_sha256", "host", "block_id"], "n", "m", "t")
