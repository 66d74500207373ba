"""The library's operators as queries over the test tables, each with the SQL it is compared with.

``events`` stand for security events: an error for a failed logon, a purchase for a successful one, a signup for
a process start, views and clicks for its activity, the user for the identity, ``k`` for the object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times as tm
from ..operators import fragments, governance, graph, joins, merkle, network, readiness, review, rules, sequence
from ..operators.rules import Condition, Rule
from ..sources import textindex
from ..storage import new_path, streamed, written
from ..streaming import live, state
from ..streaming.queue import Queue

DAY, HOUR = 86400, 3600
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def kind(name: str):
    return F.col("event_type") == name


EVENTS = "e AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"


@query("""SELECT event_id, ts, user_id, value, props FROM events WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
  AND contains(lower(props), '"k": 8') ORDER BY ts, event_id LIMIT 50""")
def q01_search(spark, d):
    e = table(spark, d, "events").filter(kind("error") & F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")))
    return e.filter(tx.fold(F.col("props")).contains('"k": 8')).orderBy("ts", "event_id").limit(50).select("event_id", "ts", "user_id", "value", "props")


@query("""SELECT w AS wanted, event_id IS NOT NULL AS found, user_id, event_type FROM (VALUES (5::BIGINT), (17), (250), (999), (123456789)) v(w) LEFT JOIN events ON event_id = w""")
def q02_lookup(spark, d):
    return joins.lookup(table(spark, d, "events"), "event_id", [5, 17, 250, 999, 123456789]).select("wanted", "found", "user_id", "event_type")


@query("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL")
def q03_summary(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query(f"WITH {EVENTS} SELECT event_type, k, count(*) AS n FROM e GROUP BY ALL ORDER BY n, event_type, k LIMIT 100")
def q04_rarity(spark, d):
    return events(spark, d).groupBy("event_type", "k").agg(F.count("*").alias("n")).orderBy("n", "event_type", "k").limit(100)


@query("""SELECT s.event_id AS start_id, c.event_id AS activity_id, s.user_id FROM events s JOIN events c ON s.user_id = c.user_id AND c.ts >= s.ts
  WHERE s.event_type = 'signup' AND c.event_type = 'click' ORDER BY s.ts, s.event_id, c.ts, c.event_id LIMIT 100""")
def q05_start_activity(spark, d):
    e = table(spark, d, "events")
    s = e.filter(kind("signup")).select(F.col("event_id").alias("start_id"), "user_id", F.col("ts").alias("s_ts"))
    c = e.filter(kind("click")).select(F.col("event_id").alias("activity_id"), "user_id", F.col("ts").alias("c_ts"))
    return s.join(c, "user_id").filter("c_ts >= s_ts").orderBy("s_ts", "start_id", "c_ts", "activity_id").limit(100).select("start_id", "activity_id", "user_id")


@query(f"WITH {EVENTS} SELECT user_id, k, count(*) AS failures FROM e WHERE event_type = 'error' GROUP BY ALL ORDER BY failures DESC, user_id, k LIMIT 100")
def q06_failures(spark, d):
    return events(spark, d).filter(kind("error")).groupBy("user_id", "k").agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "user_id", "k").limit(100)


@query(rf"""WITH {EVENTS} SELECT event_type, count(DISTINCT lower(coalesce(event_type, '') || '\' || k::VARCHAR)) AS distinct_targets, count(*) AS observations FROM e GROUP BY ALL""")
def q07_distinct_targets(spark, d):
    target = F.lower(tx.qualified_user(F.coalesce("event_type", F.lit("")), F.col("k").cast("string")))
    return events(spark, d).groupBy("event_type").agg(F.count_distinct(target).alias("distinct_targets"), F.count("*").alias("observations"))


DOC_RULES = [
    Rule("DOC-001", "English text with a license or an address", "medium", (Condition("lang", "equals", "EN"), Condition("text", "contains_any", ("License", "@")), Condition("source", "endswith_any", ("1", "5")))),
    Rule("DOC-002", "Text with a license", "low", (Condition("text", "contains_any", ("license",)),)),
    Rule("DOC-003", "French source", "high", (Condition("lang", "equals", "fr"), Condition("source", "endswith_any", ("3", "7", "9")))),
]
_FOUND = """f AS (
  SELECT 'DOC-001' AS rule_id, 'medium' AS severity, doc_id, lang, source FROM documents WHERE lower(lang) = 'en' AND (contains(lower(text), 'license') OR contains(lower(text), '@')) AND (ends_with(source, '1') OR ends_with(source, '5'))
  UNION ALL SELECT 'DOC-002', 'low', doc_id, lang, source FROM documents WHERE contains(lower(text), 'license')
  UNION ALL SELECT 'DOC-003', 'high', doc_id, lang, source FROM documents WHERE lower(lang) = 'fr' AND (ends_with(source, '3') OR ends_with(source, '7') OR ends_with(source, '9')))"""


def doc_findings(spark, d):
    return rules.match(table(spark, d, "documents"), DOC_RULES, "doc_id").select("rule_id", "severity", "doc_id", "lang", "source", "finding_id")


@query(f"WITH {_FOUND} SELECT doc_id, severity FROM f WHERE rule_id = 'DOC-001'")
def q08_rule(spark, d):
    return table(spark, d, "documents").filter(DOC_RULES[0].predicate()).select("doc_id", F.lit("medium").alias("severity"))


@query(f"WITH {_FOUND} SELECT rule_id, severity, doc_id, sha256(rule_id || ':' || doc_id::VARCHAR) AS finding_id FROM f")
def q09_findings(spark, d):
    return doc_findings(spark, d).select("rule_id", "severity", "doc_id", "finding_id")


@query("""WITH x AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM events WHERE event_type IN ('error', 'purchase')),
y AS (SELECT *, lag(ts, 3) OVER w AS nth, string_agg(event_id::VARCHAR, ',') OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS evidence
  FROM x WINDOW w AS (PARTITION BY user_id, seg ORDER BY ts, event_id))
SELECT event_id, user_id, ts, evidence FROM y WHERE event_type = 'purchase' AND ts - nth <= INTERVAL 7 DAY""")
def q10_sequence_rule(spark, d):
    found = sequence.followed_by(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], kind("error"), kind("purchase"), 3, 7 * DAY, "event_id")
    return found.select("event_id", "user_id", "ts", F.array_join("evidence", ",").alias("evidence"))


_BURST = """b AS (SELECT * FROM (SELECT *, lag(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type = 'error') WHERE ts - nth <= INTERVAL 4 DAY)"""


def bursts(spark, d):
    return sequence.burst(table(spark, d, "events").filter(kind("error")), ["user_id"], "ts", ["event_id"], 3, 4 * DAY, "event_id")


@query(f"WITH {_BURST} SELECT event_id, user_id, ts FROM b")
def q11_burst(spark, d):
    return bursts(spark, d).select("event_id", "user_id", "ts")


@query(f"""WITH RECURSIVE {_BURST}, c AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM b),
g AS (SELECT event_id, user_id, ts, n, ts AS last, true AS fires FROM c WHERE n = 1
  UNION ALL SELECT c.event_id, c.user_id, c.ts, c.n, CASE WHEN c.ts - g.last > INTERVAL 4 DAY THEN c.ts ELSE g.last END, c.ts - g.last > INTERVAL 4 DAY FROM g JOIN c ON c.user_id = g.user_id AND c.n = g.n + 1)
SELECT event_id, user_id, ts FROM g WHERE fires""")
def q12_cooldown(spark, d):
    return sequence.cooldown(bursts(spark, d).select("event_id", "user_id", "ts"), ["user_id"], "ts", ["event_id"], 4 * DAY)


@query(f"""WITH {EVENTS} SELECT a.event_id, count(DISTINCT b.k) AS distinct_values FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'error' AND b.ts BETWEEN a.ts - INTERVAL 3 DAY AND a.ts
WHERE a.event_type = 'error' GROUP BY a.event_id HAVING count(DISTINCT b.k) >= 2""")
def q13_distinct_burst(spark, d):
    found = sequence.distinct_in_window(events(spark, d).filter(kind("error")), ["user_id"], "ts", ["event_id"], "k", 3 * DAY)
    return found.filter("distinct_values >= 2").select("event_id", "distinct_values")


def events_stream(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")  # a pattern, as a stream takes no single file


@query(ORACLE["q10_sequence_rule"])
def q66_sequence_stream(spark, d):
    rows = events_stream(spark, d).select("event_id", "user_id", "ts", "event_type")  # no more than it needs goes through the state
    found = state.followed_by(rows, ["user_id"], "ts", ["event_id"], kind("error"), kind("purchase"), 3, 7 * DAY, "event_id")
    return streamed(found, "sequences").select("event_id", "user_id", "ts", F.array_join("evidence", ",").alias("evidence"))


@query(ORACLE["q12_cooldown"])
def q67_burst_stream(spark, d):
    rows = events_stream(spark, d).filter(kind("error")).select("event_id", "user_id", "ts")
    found = state.burst_once(rows, ["user_id"], "ts", ["event_id"], 3, 4 * DAY, 4 * DAY, "event_id")
    return streamed(found, "bursts").select("event_id", "user_id", "ts")


@query(ORACLE["q13_distinct_burst"])
def q68_distinct_stream(spark, d):
    rows = events_stream(spark, d).filter(kind("error")).select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    found = state.distinct_in_window(rows, ["user_id"], "ts", ["event_id"], "k", 3 * DAY)
    return streamed(found, "distinct").filter("distinct_values >= 2").select("event_id", "distinct_values")


ALLOWED = [
    {"id": "CTX-1", "rule_id": "DOC-001", "equals": {"lang": "en", "source": "src1"}},
    {"id": "CTX-2", "rule_id": "DOC-002", "equals": {"lang": "en", "source": "SRC5"}},
    {"id": "CTX-3", "rule_id": "DOC-002", "equals": {"lang": "en", "source": "src5"}},
]
_ANNOTATED = f"""{_FOUND}, a AS (SELECT *, CASE WHEN rule_id = 'DOC-001' AND lang = 'en' AND source = 'src1' THEN 'CTX-1' WHEN rule_id = 'DOC-002' AND lang = 'en' AND source = 'src5' THEN 'CTX-2' END AS context_id FROM f)"""


def annotated(spark, d):
    return rules.annotate(doc_findings(spark, d), ALLOWED, ["lang", "source"])


@query(f"WITH {_ANNOTATED} SELECT rule_id, doc_id, context_id, CASE WHEN context_id IS NULL THEN 'needs_review' ELSE 'context_matched' END AS status FROM a")
def q14_context(spark, d):
    return annotated(spark, d).select("rule_id", "doc_id", "context_id", "status")


@query(f"WITH {_ANNOTATED} SELECT rule_id, CASE WHEN context_id IS NULL THEN 'needs_review' ELSE 'context_matched' END AS status, count(*) AS findings FROM a GROUP BY ALL")
def q15_finding_counts(spark, d):
    return rules.counts(annotated(spark, d), "rule_id", "status")


@query("SELECT event_id, sha256(event_type || ':' || event_id::VARCHAR) AS event_uid, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_text FROM events")
def q16_event_uid(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2(F.concat_ws(":", "event_type", "event_id"), 256).alias("event_uid"), tm.utc_text(F.col("ts")).alias("ts_text"))


@query("""WITH g AS (SELECT sha256(text) AS h, min(doc_id) AS canonical_id, count(*) AS n_copies FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, canonical_id, n_copies FROM documents JOIN g ON sha256(text) = h""")
def q17_exact_copies(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    g = t.groupBy("h").agg(F.min("doc_id").alias("canonical_id"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    return t.join(g, "h").select("doc_id", "canonical_id", "n_copies")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def q18_new_rows(spark, d):
    e = table(spark, d, "events")
    known = e.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    batch = e.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return joins.new_rows(batch.union(batch), known, ["event_id"], [F.col("ts")]).select("event_id", "user_id", "event_type")


@query("""WITH a AS (SELECT 'src' || i AS source FROM range(18) t(i) UNION SELECT 'src90' UNION SELECT 'src91'), o AS (SELECT DISTINCT source FROM documents)
SELECT coalesce(o.source, a.source) AS source, CASE WHEN o.source IS NULL THEN 'missing' WHEN a.source IS NULL THEN 'unexpected' ELSE 'present' END AS state FROM o FULL JOIN a ON o.source = a.source""")
def q19_compare_sets(spark, d):
    approved = spark.createDataFrame([(f"src{i}",) for i in [*range(18), 90, 91]], "source string")
    return joins.compare_sets(table(spark, d, "documents"), approved, "source")


@query("""WITH RECURSIVE u(node, ancestor, depth) AS (SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_partkey > 1
  UNION ALL SELECT node, ancestor // 2, depth + 1 FROM u WHERE ancestor > 1) SELECT node, ancestor, depth FROM u""")
def q20_ancestors(spark, d):
    edges = table(spark, d, "part").filter("p_partkey > 1").select("p_partkey", F.expr("p_partkey div 2").alias("parent"))
    return graph.ancestors(edges, "p_partkey", "parent")


@query("""WITH RECURSIVE u(node, ancestor) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 1 UNION ALL SELECT node, ancestor // 2 FROM u WHERE ancestor > 1)
SELECT ancestor AS node, 1::BIGINT AS root, count(*) AS n_below FROM u GROUP BY ancestor""")
def q70_descendants(spark, d):
    edges = table(spark, d, "part").filter("p_partkey > 1").select("p_partkey", F.expr("p_partkey div 2").alias("parent"))
    place = graph.positions(edges, "p_partkey", "parent")
    return place.select("node", "root", F.expr("(leave - enter - 1) div 2").alias("n_below")).filter("n_below > 0")


@query(f"WITH {EVENTS} SELECT user_id, k, count(*) AS n_creations, 'conflicting_process_creation' AS code FROM e WHERE event_type = 'signup' GROUP BY user_id, k HAVING count(*) > 1")
def q21_conflicts(spark, d):
    return graph.nodes(events(spark, d).filter(kind("signup")), ["user_id", "k"])[1]


@query("""WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 ELSE -1 END AS parent, p_size FROM part)
SELECT c.id AS child, c.parent, CASE WHEN p.id IS NULL THEN 'parent_not_observed' WHEN p.p_size > c.p_size THEN 'invalid_parent_order_or_cycle' ELSE 'edge' END AS code FROM n c LEFT JOIN n p ON c.parent = p.id""")
def q21_parent_edges(spark, d):
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("p_size").cast("int"))
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey > 1 THEN p_partkey div 2 ELSE -1 END").alias("parent"), start.alias("ts"))
    edges, wrong = graph.parent_edges(n, "id", "parent", "ts", ["id"])
    return edges.withColumn("code", F.lit("edge")).unionByName(wrong)


def _side(df: DataFrame, p: str) -> DataFrame:
    return df.select(F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("ts").alias(f"{p}_ts"), F.col("k").alias(f"{p}_k"))


@query(f"""WITH {EVENTS} SELECT p.event_id AS p_id, s.event_id AS s_id FROM e p JOIN e s ON p.user_id = s.user_id AND s.ts BETWEEN p.ts AND p.ts + INTERVAL 12 HOUR
WHERE p.event_type = 'purchase' AND s.event_type = 'signup' AND coalesce(abs(p.k - s.k) <= 30, true)""")
def q22_session_link(spark, d):
    e = events(spark, d)
    near = F.coalesce(F.abs(F.col("p_k") - F.col("s_k")) <= 30, F.lit(True))
    return joins.interval_join(_side(e.filter(kind("purchase")), "p"), _side(e.filter(kind("signup")), "s"), [("p_user", "s_user")], "p_ts", "s_ts", 0, 12 * HOUR, near).select("p_id", "s_id")


@query("""SELECT p.event_id, count(f.event_id) AS n_before FROM events p LEFT JOIN events f ON f.user_id = p.user_id AND f.event_type = 'error' AND f.ts BETWEEN p.ts - INTERVAL 5 DAY AND p.ts
WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def q23_lookback(spark, d):
    return sequence.lookback(table(spark, d, "events"), ["user_id"], "ts", kind("error"), kind("purchase"), 5 * DAY).select("event_id", "n_before")


def _stage_sql(name: str, before: str, type_: str) -> str:
    return f"""{name} AS (SELECT b.*, (SELECT min((x.ts, x.event_id)) FROM events x WHERE x.event_type = '{type_}' AND x.user_id = b.user_id AND x.event_id <> b.last_id AND x.ts BETWEEN b.at AND b.at + INTERVAL 2 DAY) AS f FROM {before} b)"""


_CHAIN = f"""s0 AS (SELECT p.event_id, p.user_id, p.ts AS at, p.event_id AS last_id, (SELECT count(*) FROM events f WHERE f.user_id = p.user_id AND f.event_type = 'error' AND f.ts BETWEEN p.ts - INTERVAL 5 DAY AND p.ts) AS n FROM events p WHERE p.event_type = 'purchase'),
{_stage_sql("t1", "(SELECT * FROM s0 WHERE n >= 2)", "signup")}, s1 AS (SELECT event_id, user_id, f[1] AS at, f[2] AS last_id, f[2] AS signup_uid FROM t1),
{_stage_sql("t2", "s1", "view")}, s2 AS (SELECT event_id, user_id, f[1] AS at, f[2] AS last_id, signup_uid, f[2] AS view_uid FROM t2),
{_stage_sql("t3", "s2", "click")}, s3 AS (SELECT event_id, user_id, signup_uid, view_uid, f[2] AS click_uid FROM t3)"""


def chains(spark, d):
    e = table(spark, d, "events")
    starts = sequence.lookback(e, ["user_id"], "ts", kind("error"), kind("purchase"), 5 * DAY).filter("n_before >= 2")
    stages = [(n, e.filter(kind(n)).select("event_id", "user_id", "ts")) for n in ("signup", "view", "click")]
    return graph.staged_chain(starts.select("event_id", "user_id", "ts"), stages, "user_id", "event_id", "ts", 2 * DAY)


@query(f"WITH {_CHAIN} SELECT event_id, user_id, signup_uid, view_uid, click_uid FROM s3 WHERE click_uid IS NOT NULL")
def q24_chain(spark, d):
    return chains(spark, d).filter("click_uid is not null").select("event_id", "user_id", "signup_uid", "view_uid", "click_uid")


@query(f"""WITH {_CHAIN} SELECT event_id, click_uid IS NOT NULL AS complete, concat_ws(',', CASE WHEN click_uid IS NULL THEN 'click' END, CASE WHEN signup_uid IS NULL THEN 'signup' END, CASE WHEN view_uid IS NULL THEN 'view' END) AS missing FROM s3""")
def q25_candidates(spark, d):
    return chains(spark, d).select("event_id", F.col("click_uid").isNotNull().alias("complete"), F.array_join(graph.missing_stages(["signup", "view", "click"]), ",").alias("missing"))


@query("""SELECT t AS event_type, count(event_id) AS n_observed FROM (VALUES ('click'), ('purchase'), ('logout'), ('refund')) v(t) LEFT JOIN events ON event_type = t GROUP BY t""")
def q26_presence(spark, d):
    wanted = spark.createDataFrame([("click",), ("purchase",), ("logout",), ("refund",)], "event_type string")
    return readiness.presence(table(spark, d, "events"), wanted, ["event_type"])


@query("""SELECT event_id FROM events p WHERE event_type = 'purchase'
  AND (SELECT count(*) FROM events f WHERE f.user_id = p.user_id AND f.event_type = 'error' AND f.ts BETWEEN p.ts - INTERVAL 5 DAY AND p.ts) >= 2
  AND EXISTS (SELECT 1 FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND s.ts BETWEEN p.ts AND p.ts + INTERVAL 2 DAY)""")
def q27_exists(spark, d):
    e = events(spark, d)
    starts = sequence.lookback(e, ["user_id"], "ts", kind("error"), kind("purchase"), 5 * DAY).filter("n_before >= 2")
    after = joins.interval_join(_side(starts, "p"), _side(e.filter(kind("signup")), "s"), [("p_user", "s_user")], "p_ts", "s_ts", 0, 2 * DAY)
    return after.select(F.col("p_id").alias("event_id")).distinct()


@query("""WITH x AS (SELECT toxic = 1 AS label, regexp_matches(lower(text), 'stupid|idiot|trash|hate') AS hit FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE label AND hit) AS tp, count(*) FILTER (WHERE NOT label AND hit) AS fp, count(*) FILTER (WHERE label AND NOT hit) AS fn, count(*) FILTER (WHERE NOT label AND NOT hit) AS tn FROM x)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def q28_confusion(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", Condition("text", "contains_any", ("stupid", "idiot", "trash", "hate")).compile(F.col).alias("hit")), "doc_id")
    m = readiness.confusion(both, F.col("toxic") == 1, F.col("hit"))
    return m.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("""WITH c AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) + 1 AS total FROM conversations), k AS (SELECT * FROM c WHERE turn <> 3),
g AS (SELECT conv_id, max(total)::INT AS expected_parts, count(*) AS n_observed, string_agg(text, '' ORDER BY turn) AS script FROM k GROUP BY conv_id)
SELECT conv_id, expected_parts, n_observed, expected_parts = n_observed AS complete, CASE WHEN expected_parts > 3 THEN '4' ELSE '' END AS missing, CASE WHEN expected_parts = n_observed THEN sha256(script) END AS script_sha256 FROM g""")
def q29_fragments(spark, d):
    c = table(spark, d, "conversations")
    totals = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("total"))
    parts = c.filter("turn <> 3").join(totals, "conv_id").withColumn("number", F.col("turn") + 1)
    r = fragments.reassemble(parts, ["conv_id"], "number", "total", "text")
    return r.select("conv_id", "expected_parts", F.size("observed_parts").cast("long").alias("n_observed"), "complete", F.array_join("missing_parts", ",").alias("missing"), "script_sha256")


@query("""SELECT doc_id, from_base64(to_base64(encode(text)))::BLOB = encode(text) AS same, octet_length(encode(text)) AS n_bytes, true AS refused FROM documents""")
def q30_base64(spark, d):
    coded = F.base64(F.col("text").cast("binary"))
    back = tx.strict_base64(coded)
    return table(spark, d, "documents").select("doc_id", (back == F.col("text").cast("binary")).alias("same"), F.octet_length(back).cast("long").alias("n_bytes"), tx.strict_base64(F.concat(coded, F.lit("!"))).isNull().alias("refused"))


_TOKEN = r"""("[^"]*"|''[^'']*''|[^ \t\r\n"''][^ \t\r\n]*)"""


@query(rf"""WITH t AS (SELECT doc_id, CASE WHEN NOT regexp_matches(regexp_replace(text, '{_TOKEN}', '', 'g'), '["'']') THEN regexp_extract_all(text, '{_TOKEN}') END AS p FROM documents)
SELECT doc_id, len(p)::BIGINT AS n_tokens, p[1] AS first_token FROM t""")
def q31_tokens(spark, d):
    t = tx.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.when(t.isNotNull(), F.size(t)).cast("long").alias("n_tokens"), F.get(t, F.lit(0)).alias("first_token"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages),
l AS (SELECT page_id, i, x FROM (SELECT page_id, unnest(string_split(host, '.')) AS x, generate_subscripts(string_split(host, '.'), 1) AS i FROM h)),
b AS (SELECT page_id, arg_min(x, (-length(x), i)) AS label FROM l GROUP BY page_id),
c AS (SELECT page_id, label, ch, count(*) AS n FROM (SELECT page_id, label, unnest(string_split(label, '')) AS ch FROM b) GROUP BY ALL)
SELECT page_id, label, length(label) AS n_chars, round(-sum(n / length(label) * log2(n / length(label))), 3) AS entropy FROM c GROUP BY page_id, label""")
def q32_label_entropy(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    label = table(spark, d, "pages").select("page_id", tx.longest_label(host).alias("label"))
    return label.select("page_id", "label", F.length("label").cast("long").alias("n_chars"), F.round(tx.entropy(F.col("label")), 3).alias("entropy"))


@query("""WITH g AS (SELECT user_id, ts, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6 AS g FROM events WHERE event_type = 'error')
SELECT user_id, count(*) AS n_events, round(avg(g), 6) AS mean_gap_s, round(stddev_pop(g), 6) AS dev_gap_s, round(stddev_pop(g) / nullif(avg(g), 0), 6) AS variation FROM g GROUP BY user_id HAVING count(*) >= 6""")
def q33_regularity(spark, d):
    g = sequence.gap_statistics(table(spark, d, "events").filter(kind("error")), ["user_id"], "ts", ["event_id"], 6)
    return g.select("user_id", "n_events", *[F.round(c, 6).alias(c) for c in ("mean_gap_s", "dev_gap_s", "variation")])


@query("""WITH s AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM events)
SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def q34_sessions(spark, d):
    s = sequence.sessions(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], kind("signup"))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH m AS (SELECT p.event_id, count(f.event_id) AS n_matches FROM events p LEFT JOIN events f ON f.user_id = p.user_id AND f.event_type = 'error' AND f.ts BETWEEN p.ts - INTERVAL 10 HOUR AND p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id)
SELECT event_id, n_matches, CASE n_matches WHEN 0 THEN 'not observed' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS match_state FROM m""")
def q35_match_state(spark, d):
    e = events(spark, d)
    m = joins.matches_within(_side(e.filter(kind("purchase")), "p"), _side(e.filter(kind("error")), "f"), "p_id", [("p_user", "f_user")], "p_ts", "f_ts", 10 * HOUR, 0)
    return m.select(F.col("p_id").alias("event_id"), "n_matches", "match_state")


@query(f"""WITH {EVENTS} SELECT s.event_id AS s_id, p.event_id AS p_id FROM e s JOIN e p ON s.user_id = p.user_id AND p.ts BETWEEN s.ts AND s.ts + to_hours(least(s.k, 300)::INT)
WHERE s.event_type = 'signup' AND p.event_type = 'purchase'""")
def q36_row_range(spark, d):
    e = events(spark, d)
    own = tm.micros(F.col("p_ts")) - tm.micros(F.col("s_ts")) <= F.least(F.col("s_k"), F.lit(300)) * HOUR * sequence.SECOND
    return joins.interval_join(_side(e.filter(kind("signup")), "s"), _side(e.filter(kind("purchase")), "p"), [("s_user", "p_user")], "s_ts", "p_ts", 0, 300 * HOUR, own).select("s_id", "p_id")


@query("""SELECT f.event_id AS f_id, p.event_id AS p_id FROM events f JOIN events p ON f.user_id = p.user_id AND p.ts BETWEEN f.ts - INTERVAL 2 HOUR AND f.ts + INTERVAL 2 HOUR
WHERE f.event_type = 'error' AND p.event_type = 'purchase'""")
def q37_pivot(spark, d):
    e = events(spark, d)
    return joins.interval_join(_side(e.filter(kind("error")), "f"), _side(e.filter(kind("purchase")), "p"), [("f_user", "p_user")], "f_ts", "p_ts", 2 * HOUR, 2 * HOUR).select("f_id", "p_id")


SEGMENT_RANK = {"BUILDING": 4, "MACHINERY": 3, "AUTOMOBILE": 2}


@query("""WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS active, count(*) FILTER (WHERE o_orderstatus = 'P') AS gaps FROM orders GROUP BY 1),
c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 4 WHEN 'MACHINERY' THEN 3 WHEN 'AUTOMOBILE' THEN 2 ELSE 1 END AS r, coalesce(active, 0) AS active, coalesce(gaps, 0) AS gaps FROM customer LEFT JOIN o ON c_custkey = o_custkey)
SELECT c_custkey, CASE WHEN r >= 3 AND (active > 0 OR gaps > 0) THEN 'review_first' WHEN gaps > 0 THEN 'add_telemetry' WHEN active > 0 THEN 'queue' ELSE 'none' END AS priority FROM c""")
def q38_priority(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("active"), F.count_if(F.col("o_orderstatus") == "P").alias("gaps"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["active", "gaps"])
    rank = F.coalesce(*[F.when(F.col("c_mktsegment") == k, F.lit(v)) for k, v in SEGMENT_RANK.items()], F.lit(1))
    return c.select("c_custkey", readiness.priority(rank, F.col("active"), F.col("gaps")).alias("priority"))


REQUIREMENTS = [
    ("R1", "site", ["web"], "Shop", "Events", [1, 5], ["k"], 3600, 1800),
    ("R2", "site", ["web", "app"], "shop", "events", [3, 9], ["k", "session"], 60, 5400),
    ("R3", "site", ["app"], "shop", "events", [8], ["k"], 60, 60),
]
REQUIREMENT_COLUMNS = "id string, asset_id string, scopes array<string>, provider string, channel string, event_ids array<bigint>, required_fields array<string>, expected_activity_seconds bigint, max_ingest_lag_seconds bigint"
CODES = {"click": 1, "view": 2, "purchase": 3, "signup": 4, "error": 5}


@query(f"""WITH {EVENTS}, o AS (SELECT ts, ts + to_minutes(k::INT) AS received, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS code FROM e),
r(id, codes, fields, quiet, lag) AS (VALUES ('R1', [1, 5], 0, 3600, 1800), ('R2', [3, 9], 1, 60, 5400), ('R3', [8], 0, 60, 60)), n AS (SELECT TIMESTAMP '2024-01-29' AS now),
x AS (SELECT id, codes, quiet, count(code) AS observed_total, count(code) FILTER (WHERE ts BETWEEN now - INTERVAL 5 DAY AND now) AS in_window, max(ts) FILTER (WHERE ts <= now) AS latest,
  count(code) FILTER (WHERE fields > 0) AS missing_fields, count(code) FILTER (WHERE received - ts > to_seconds(lag)) AS late_records, count(code) FILTER (WHERE ts > now + INTERVAL 120 SECOND) AS future_records,
  coalesce(list(DISTINCT code) FILTER (WHERE ts BETWEEN now - INTERVAL 5 DAY AND now), []) AS seen FROM r CROSS JOIN n LEFT JOIN o ON list_contains(codes, code) GROUP BY id, codes, quiet, now),
y AS (SELECT *, date_diff('microsecond', latest, TIMESTAMP '2024-01-29') / 1e6 AS age, list_sort(list_filter(codes, lambda c: NOT list_contains(seen, c))) AS absent FROM x)
SELECT id, observed_total, in_window, round(age, 6) AS latest_age_seconds, missing_fields, late_records, future_records, array_to_string(absent, ',') AS absent_ids,
  ((observed_total = 0 OR coalesce(age > quiet, true))::INT + (len(absent) > 0)::INT + (missing_fields > 0)::INT + (late_records > 0)::INT + (future_records > 0)::INT)::BIGINT AS n_issues FROM y""")
def q39_readiness(spark, d):
    e = events(spark, d)
    code = F.coalesce(*[F.when(kind(k), F.lit(v)) for k, v in CODES.items()]).cast("long")
    seen = e.select(F.lit("site").alias("asset_id"), F.lit("web").alias("scope"), F.lit("SHOP").alias("provider"), F.lit("events").alias("channel"), code.alias("event_id"), "ts", (F.col("ts") + F.make_dt_interval(mins=F.col("k").cast("int"))).alias("received"), F.create_map(F.lit("k"), F.col("k").cast("string")).alias("fields"))
    m = readiness.requirement_matrix(seen, spark.createDataFrame(REQUIREMENTS, REQUIREMENT_COLUMNS), "2024-01-29 00:00:00", 5 * DAY)
    return m.select("id", "observed_total", "in_window", F.round("latest_age_seconds", 6).alias("latest_age_seconds"), "missing_fields", "late_records", "future_records", F.array_join("absent_ids", ",").alias("absent_ids"), "n_issues")


@query("""SELECT user_id, count(*) AS observations FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id""")
def q40_unmapped(spark, d):
    inventory = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return readiness.unmapped(table(spark, d, "events"), inventory, "user_id")


DUE_DAYS = {"1-URGENT": 1, "2-HIGH": 3, "3-MEDIUM": 7, "4-NOT SPECIFIED": 14, "5-LOW": 30}
_DUE = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 7 WHEN '4-NOT SPECIFIED' THEN 14 WHEN '5-LOW' THEN 30 END"
_QUEUE = f"""q AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'triaged' ELSE 'closed' END AS state, o_orderdate::TIMESTAMP AS created, o_orderdate::TIMESTAMP + to_days({_DUE}) AS due FROM orders)"""


def queue(spark, d):
    state = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "P", "triaged").otherwise("closed")
    o = table(spark, d, "orders").select("o_orderkey", state.alias("state"), F.col("o_orderdate").cast("timestamp_ntz").alias("created"), "o_orderpriority")
    return o.withColumn("due", tm.due(F.col("created"), F.col("o_orderpriority"), {k: v * DAY for k, v in DUE_DAYS.items()}))


@query(f"""WITH {_QUEUE} SELECT state, count(*) AS n_rows, max(date_diff('microsecond', created, TIMESTAMP '1999-01-01')) / 1e6 AS oldest_age_s, count(*) FILTER (WHERE state <> 'closed' AND due < TIMESTAMP '1999-01-01') AS n_overdue FROM q GROUP BY state""")
def q41_queue_health(spark, d):
    return readiness.queue_health(queue(spark, d), "state", "created", "due", F.lit("1999-01-01").cast("timestamp_ntz"))


@query(f"""WITH {EVENTS} SELECT event_id, k // 10 AS attempts, least(300, (1 << least(k // 10 + 1, 8)::INT))::BIGINT AS delay_s, CASE WHEN k // 10 >= 8 THEN 'dead_letter' ELSE 'pending' END AS state FROM e""")
def q42_retry(spark, d):
    tries = F.expr("k div 10")
    return events(spark, d).select("event_id", tries.alias("attempts"), tm.retry_delay(tries).alias("delay_s"), F.when(tries >= 8, "dead_letter").otherwise("pending").alias("state"))


_LINKS = """o AS (SELECT o_orderkey, o_custkey, o_orderkey || '|' || o_orderstatus AS payload, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sequence FROM orders),
c(o_orderkey, o_custkey, sequence, previous, sha256) AS (SELECT o_orderkey, o_custkey, sequence, repeat('0', 64), sha256(repeat('0', 64) || payload) FROM o WHERE sequence = 1
  UNION ALL SELECT o.o_orderkey, o.o_custkey, o.sequence, c.sha256, sha256(c.sha256 || o.payload) FROM c JOIN o ON o.o_custkey = c.o_custkey AND o.sequence = c.sequence + 1)"""


def links(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("payload"))
    return governance.chain(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("payload"))


@query(f"WITH RECURSIVE {_LINKS} SELECT o_orderkey, o_custkey, sequence, previous, sha256 FROM c")
def q43_hash_chain(spark, d):
    return links(spark, d).select("o_orderkey", "o_custkey", "sequence", "previous", "sha256")


@query("""SELECT o_orderkey, o_custkey, 'sha256' AS error FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'""")
def q43_chain_errors(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit(True).alias("urgent"))
    changed = links(spark, d).join(urgent, "o_orderkey", "left")
    changed = changed.withColumn("payload", F.when(F.col("urgent"), F.concat(F.split("payload", r"\|")[0], F.lit("|F"))).otherwise(F.col("payload")))
    return governance.chain_errors(changed, ["o_custkey"], F.col("payload")).select("o_orderkey", "o_custkey", "error")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def q44_latest(spark, d):
    return governance.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT date_trunc('day', ts) AS bin, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 10")
def q45_daily_bins(spark, d):
    return table(spark, d, "events").groupBy(tm.bin_start(F.col("ts"), DAY).alias("bin"), "event_type").agg(F.count("*").alias("n")).filter("n >= 10")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS bin, event_type, count(*) AS n FROM events GROUP BY ALL")
def q45_five_minute_bins(spark, d):
    return table(spark, d, "events").groupBy(tm.bin_start(F.col("ts"), 300).alias("bin"), "event_type").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events WHERE event_type = 'signup')
SELECT s.event_id, count(a.event_id) AS n_activity, min(a.ts) AS first_activity FROM s LEFT JOIN events a ON a.user_id = s.user_id AND a.event_type IN ('click', 'view') AND a.ts >= s.ts AND (s.next_ts IS NULL OR a.ts < s.next_ts) GROUP BY s.event_id""")
def q46_activity(spark, d):
    """One pass: activity carries its user's running number of starts, so no range join is made."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("signup", "click", "view"))
    s = sequence.sessions(e, ["user_id"], "ts", ["event_id"], kind("signup")).filter("session > 0")
    active = ~kind("signup")
    out = s.groupBy("user_id", "session").agg(F.min(F.when(kind("signup"), F.col("event_id"))).alias("event_id"), F.count_if(active).alias("n_activity"), F.min(F.when(active, F.col("ts"))).alias("first_activity"))
    return out.select("event_id", "n_activity", "first_activity")


@query(r"""SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '^ *[=+\-@]') THEN '''' || text ELSE text END) AS cell_sha256 FROM documents""")
def q47_csv_cells(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.csv_cell(F.col("text")), 256).alias("cell_sha256"))


@query("""SELECT event_id, event_type, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.target'), '') AS target FROM events""")
def q48_flatten(spark, d):
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", "event_type", F.coalesce(m["k"], F.lit("")).alias("k"), F.coalesce(m["target"], F.lit("")).alias("target"))


@query(f"WITH {_QUEUE} SELECT o_orderkey, due, state <> 'closed' AND due < TIMESTAMP '1999-01-01' AS overdue FROM q")
def q49_due(spark, d):
    late = (F.col("state") != "closed") & (F.col("due") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return queue(spark, d).select("o_orderkey", "due", late.alias("overdue"))


@query("SELECT event_type, round(median(value), 6) AS median_value FROM events GROUP BY event_type")
def q50_median(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"))


@query(f"WITH {_QUEUE} SELECT o_orderkey, state, created, due FROM q WHERE state = 'new' ORDER BY created DESC, o_orderkey LIMIT 100")
def q51_alert_list(spark, d):
    return review.alert_list(queue(spark, d), "o_orderkey", "new", 100).select("o_orderkey", "state", "created", "due")


_CASE = f"""h AS (SELECT o_orderkey, sha1(unhex('{review.CASES.hex}') || encode(o_orderkey::VARCHAR)) AS x FROM orders),
u AS (SELECT o_orderkey, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab', 1 + ((('0x' || x[17])::INTEGER) & 3), 1) || x[18:20] || '-' || x[21:32] AS case_id FROM h)"""


@query(f"WITH {_CASE} SELECT o_orderkey, case_id FROM u WHERE o_orderkey % 3 <> 0")
def q52_promote(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    known = review.promote(o.filter("o_orderkey % 3 = 0"), spark.createDataFrame([], "case_id string"), "o_orderkey")
    return review.promote(o, known, "o_orderkey").select("o_orderkey", "case_id")


_BOX = """b AS (SELECT event_id, CASE user_id % 2 WHEN 0 THEN 'lab' ELSE 'site' END AS scope, event_type AS kind, k // 10 AS attempts,
  CASE WHEN user_id % 7 = 0 THEN 'held_private' WHEN k // 10 >= 8 THEN 'dead_letter' WHEN event_id % 11 = 0 THEN 'delivered' ELSE 'pending' END AS state, ts::TIMESTAMP AS next_at FROM e)"""


def outbox(spark, d):
    tries = F.expr("k div 10").cast("int")
    state = F.when(F.expr("user_id % 7 = 0"), "held_private").when(tries >= 8, "dead_letter").when(F.expr("event_id % 11 = 0"), "delivered").otherwise("pending")
    return events(spark, d).select(F.col("event_id").alias("event_uid"), F.when(F.expr("user_id % 2 = 0"), "lab").otherwise("site").alias("scope"), F.col("event_type").alias("kind"), tries.alias("attempts"), state.alias("state"), F.col("ts").cast("timestamp").alias("next_at"), tm.micros(F.col("ts")).alias("stamp"))


def stored_queue(spark, d):
    """The outbox as a stored queue with a commit log."""
    queue = Queue(spark, new_path(spark, "queue"))
    queue.add(outbox(spark, d))
    return queue


@query(f"""WITH {EVENTS}, {_BOX}, r AS (SELECT * FROM b WHERE state = 'pending' AND next_at <= TIMESTAMP '2024-01-10'), f AS (SELECT scope, kind FROM r ORDER BY next_at, event_id LIMIT 1)
SELECT event_id, scope, kind, TIMESTAMP '2024-01-10 00:03:00' AS lease_until FROM r SEMI JOIN f USING (scope, kind) ORDER BY next_at, event_id LIMIT 100""")
def q53_claim(spark, d):
    claim = stored_queue(spark, d).claim(F.lit("2024-01-10").cast("timestamp"))
    return claim.rows.select(F.col("event_uid").cast("long").alias("event_id"), "scope", "kind", F.col("lease_until").cast("timestamp_ntz").alias("lease_until"))


@query(f"""WITH {EVENTS}, {_BOX} SELECT scope, state, attempts, count(*) AS n FROM (SELECT scope, CASE WHEN state = 'dead_letter' THEN 'pending' ELSE state END AS state, CASE WHEN state IN ('pending', 'dead_letter') THEN 0 ELSE attempts END AS attempts FROM b) GROUP BY ALL
UNION ALL SELECT scope, 'redrive', 0, count(*) FROM b WHERE state IN ('pending', 'dead_letter') GROUP BY scope""")
def q54_redrive(spark, d):
    queue = stored_queue(spark, d)
    stuck = queue.read().filter(F.col("state").isin("pending", "dead_letter")).groupBy("scope").agg(F.lit("redrive").alias("state"), F.lit(0).cast("long").alias("attempts"), F.count("*").alias("n"))
    stuck = written(stuck, "stuck")
    queue.redrive("operator", "destination repaired", F.lit("2024-01-10").cast("timestamp"))
    told = queue.read().groupBy("scope", "state", F.col("attempts").cast("long").alias("attempts")).agg(F.count("*").alias("n"))
    return told.unionByName(stuck.select(*told.columns))


@query(f"""WITH {EVENTS}, {_BOX}, r AS (SELECT * FROM b WHERE state = 'pending' AND next_at <= TIMESTAMP '2024-01-10'), f AS (SELECT scope, kind FROM r ORDER BY next_at, event_id LIMIT 1),
c AS (SELECT event_id FROM r SEMI JOIN f USING (scope, kind) ORDER BY next_at, event_id LIMIT 100)
SELECT event_id, CASE WHEN c.event_id IS NULL THEN b.state WHEN attempts >= 7 THEN 'dead_letter' ELSE 'pending' END AS state, attempts + (c.event_id IS NOT NULL)::INT AS attempts,
  CASE WHEN c.event_id IS NULL THEN next_at ELSE TIMESTAMP '2024-01-10' + to_seconds(least(300, 2 ** least(attempts + 1, 8))) END AS next_at, CASE WHEN c.event_id IS NOT NULL THEN 'HTTP_503' END AS error
FROM b LEFT JOIN c USING (event_id)""")
def q69_failed_delivery(spark, d):
    queue, now = stored_queue(spark, d), F.lit("2024-01-10").cast("timestamp")
    queue.failed(queue.claim(now).token, "HTTP_503", now)
    return queue.read().select(F.col("event_uid").cast("long").alias("event_id"), "state", F.col("attempts").cast("long").alias("attempts"), F.col("next_at").cast("timestamp_ntz").alias("next_at"), "error")


def aliases(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 4 <> 0")
    return c.select(F.concat(F.lit("WS"), F.col("c_custkey").cast("string")).alias("alias"), F.concat(F.lit("asset-"), (F.col("c_custkey") % 10).cast("string")).alias("asset_id"))


def hosted(spark, d):
    return table(spark, d, "events").withColumn("host", F.concat(F.lit("ws"), F.col("user_id").cast("string")))


_ASSETS = "a AS (SELECT event_id, user_id, event_type, CASE WHEN c_custkey IS NOT NULL THEN 'asset-' || (user_id % 10) END AS asset_id FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = user_id)"


@query(f"WITH {_ASSETS} SELECT asset_id AS subject, count(*) AS n FROM a WHERE asset_id IS NOT NULL GROUP BY 1 UNION ALL SELECT 'ws' || user_id, count(*) FROM a WHERE asset_id IS NULL GROUP BY user_id")
def q55_aliases(spark, d):
    told, rest = review.mapped_assets(hosted(spark, d), aliases(spark, d))
    return told.filter("asset_id is not null").groupBy(F.col("asset_id").alias("subject")).agg(F.count("*").alias("n")).unionByName(rest.select(F.col("host").alias("subject"), F.col("observations").alias("n")))


@query(f"""WITH {_ASSETS}, v AS (SELECT event_id // 5 AS alert, asset_id FROM a UNION ALL SELECT -1, NULL)
SELECT alert, coalesce(string_agg(DISTINCT asset_id, ',' ORDER BY asset_id), '') AS assets, count(DISTINCT asset_id) AS n_assets, count(*) FILTER (WHERE asset_id IS NULL) AS unmapped FROM v GROUP BY alert""")
def q56_alert_assets(spark, d):
    told, _ = review.mapped_assets(hosted(spark, d), aliases(spark, d))
    alerts = told.groupBy(F.expr("event_id div 5").alias("alert")).agg(F.collect_list("event_id").alias("evidence"))
    alerts = alerts.unionByName(spark.createDataFrame([(-1, [-5])], "alert long, evidence array<bigint>"))
    return review.alert_assets(alerts, told, "alert", "event_id").select("alert", F.array_join("assets", ",").alias("assets"), "n_assets", "unmapped")


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS anchors FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5 GROUP BY user_id")
def q57_anchors(spark, d):
    return review.sample_anchors(table(spark, d, "events"), "user_id", "event_id", "ts").select("user_id", F.array_join("anchors", ",").alias("anchors"))


_SUMS = " || ':' || ".join(f"sum(('0x' || h[{1 + 8 * i}:{8 + 8 * i}])::BIGINT)::VARCHAR" for i in range(8))


@query(f"""WITH r AS (SELECT sha256('{{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}}') AS h FROM customer)
SELECT count(*) AS n_rows, sha256(count(*)::VARCHAR || ':' || {_SUMS}) AS sha256 FROM r""")
def q58_fingerprint(spark, d):
    return review.fingerprint(table(spark, d, "customer").select("c_mktsegment", "c_custkey"))


_RANK = "CASE c_mktsegment WHEN 'BUILDING' THEN 4 WHEN 'MACHINERY' THEN 3 WHEN 'HOUSEHOLD' THEN 2 WHEN 'FURNITURE' THEN 1 ELSE 0 END"


@query(f"SELECT c_custkey, {_RANK} AS criticality_rank FROM customer")
def q59_criticality(spark, d):
    ranked = review.by_criticality(table(spark, d, "customer"), "c_mktsegment", "c_custkey", {"BUILDING": 4, "MACHINERY": 3, "HOUSEHOLD": 2, "FURNITURE": 1})
    return ranked.select("c_custkey", "criticality_rank")


@query("""WITH x AS (SELECT CASE WHEN doc_id % 5 < 3 THEN 'development' ELSE 'holdout' END AS split, toxic = 1 AS label, m.method, CASE m.method WHEN 'words' THEN contains(lower(text), 'the') ELSE length(text) > 500 END AS hit
  FROM labels JOIN documents USING (doc_id), (VALUES ('words'), ('length')) m(method)),
n AS (SELECT split, method, count(*) FILTER (WHERE label AND hit) AS tp, count(*) FILTER (WHERE NOT label AND hit) AS fp, count(*) FILTER (WHERE label AND NOT hit) AS fn, count(*) FILTER (WHERE NOT label AND NOT hit) AS tn FROM x GROUP BY ALL)
SELECT split, method, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM n""")
def q60_split_metrics(spark, d):
    from ..sources.corpus import evaluate

    docs = table(spark, d, "documents").select("doc_id", "text")
    s = table(spark, d, "labels").join(docs.select("doc_id"), "doc_id").select(F.col("doc_id").alias("id"), F.when(F.expr("doc_id % 5 < 3"), "development").otherwise("holdout").alias("split"), (F.col("toxic") == 1).alias("expected_review"))
    flagged = [docs.filter(c).select(F.col("doc_id").alias("scenario"), F.lit(m).alias("method")) for m, c in (("words", F.lower("text").contains("the")), ("length", F.length("text") > 500))]
    out = evaluate(s, flagged[0].unionByName(flagged[1]), ["words", "length"])
    return out.select("split", "method", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH f AS (SELECT event_id, user_id AS o, k AS p FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) WHERE event_type = 'error'),
c AS (SELECT c_custkey, c_name, c_mktsegment IN ('BUILDING', 'MACHINERY') AS urgent FROM customer WHERE c_custkey % 3 = 0),
x AS (SELECT event_id, c_name, urgent FROM (SELECT DISTINCT event_id, unnest([o, p]) AS a FROM f) JOIN c ON c_custkey = a)
SELECT f.event_id, coalesce(string_agg(c_name, ',' ORDER BY c_name), '') AS assets, CASE WHEN coalesce(bool_or(urgent), false) THEN 'review_first' ELSE 'context_needed' END AS priority
FROM f LEFT JOIN x USING (event_id) GROUP BY f.event_id""")
def q61_lead_context(spark, d):
    e = events(spark, d).filter(kind("error"))
    flows = e.select(F.lit("s").alias("source_sha256"), F.col("event_id").cast("string").alias("flow_id"), F.col("user_id").cast("string").alias("origin_ip"), F.col("k").cast("string").alias("peer_ip"))
    assets = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("ip"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "high").otherwise("low").alias("criticality"))
    leads = flows.select(F.lit("L").alias("lead"), "source_sha256", "flow_id")
    return network.with_asset_context(leads, flows, assets).select(F.col("flow_id").cast("long").alias("event_id"), F.array_join("assets", ",").alias("assets"), "priority")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-12' AND ts <= TIMESTAMP '2024-01-15' GROUP BY event_type")
def q62_count_over_time(spark, d):
    return sequence.count_over_time(table(spark, d, "events"), "ts", F.lit("2024-01-15").cast("timestamp_ntz"), 3 * DAY, "event_type")


@query(f"""WITH {_QUEUE} SELECT o_orderkey % 3 AS scope, state, count(*) AS n_rows, max(date_diff('microsecond', created, TIMESTAMP '1999-01-01')) / 1e6 AS oldest_age_s, count(*) FILTER (WHERE state <> 'closed' AND due < TIMESTAMP '1999-01-01') AS n_overdue FROM q GROUP BY ALL""")
def q63_scope_health(spark, d):
    q = queue(spark, d).withColumn("scope", F.col("o_orderkey") % 3)
    return readiness.queue_health(q, "state", "created", "due", F.lit("1999-01-01").cast("timestamp_ntz"), "scope")


@query("""WITH c AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderkey % 40))) AS old FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), a AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderkey % 40))) AS new FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL),
j AS (SELECT coalesce(c.o_custkey, a.o_custkey) AS o_custkey, old, len(list_distinct(list_concat(coalesce(old, []), coalesce(new, [])))) AS n FROM c FULL JOIN a USING (o_custkey))
SELECT o_custkey, CASE WHEN old IS NOT NULL AND n <= 9 THEN n ELSE len(old) END AS n_evidence, old IS NULL OR n > 9 AS refused FROM j WHERE old IS NOT NULL OR n > 0""")
def q64_attach(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 40).cast("string").alias("uid"))
    cases = o.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.array_sort(F.collect_set("uid")).alias("evidence"))
    now, refused = governance.attach_evidence(cases, o.filter("o_orderkey % 2 = 1"), "o_custkey", most=9)
    return now.join(refused.withColumn("refused", F.lit(True)), "o_custkey", "full").select("o_custkey", F.size("evidence").cast("long").alias("n_evidence"), F.coalesce("refused", F.lit(False)).alias("refused"))


@query(f"""WITH {EVENTS}, h AS (SELECT user_id, max(ts) AS updated, sum(k % 3)::BIGINT AS gaps, arg_max(CASE WHEN event_type = 'error' THEN event_type ELSE '' END, ts) AS error, max(event_id) AS cursor FROM e GROUP BY user_id)
SELECT user_id, updated, gaps, error, cursor, CASE WHEN error <> '' OR gaps > 95 OR date_diff('microsecond', updated, TIMESTAMP '2024-01-30') / 1e6 > 36000 OR updated > TIMESTAMP '2024-01-30' THEN 'needs review' ELSE 'healthy' END AS state FROM h""")
def q65_collectors(spark, d):
    e = events(spark, d).withColumn("gaps", F.col("k") % 3).withColumn("error", F.when(kind("error"), F.col("event_type")).otherwise(""))
    s = readiness.collector_states(e, "user_id", "ts", "gaps", "error", "event_id")
    state = readiness.heartbeat_state(F.col("error"), F.when(F.col("gaps") > 95, F.col("gaps")).otherwise(0), F.col("updated"), F.lit("2024-01-30").cast("timestamp_ntz"), F.lit(36000))
    return s.select("user_id", "updated", "gaps", "error", F.col("event_id").alias("cursor"), state.alias("state"))


@query("""WITH f AS (SELECT event_id, user_id % 40 AS c, user_id AS o, k AS p, event_type AS t FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)), s AS (SELECT DISTINCT c FROM f),
a AS (SELECT c, count(*) AS n FROM (SELECT DISTINCT c, unnest([o, p]) AS ip FROM f WHERE t = 'click') WHERE ip IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0) GROUP BY c),
d AS (SELECT c, count(*) AS n FROM f WHERE t = 'error' GROUP BY c), v AS (SELECT c, count(*) AS n FROM f WHERE t = 'click' AND event_id % 97 = 0 GROUP BY c)
SELECT c::VARCHAR AS source, k.check, CASE k.check WHEN 'integrity' THEN 'recorded' WHEN 'coverage' THEN 'needs_review' WHEN 'ownership' THEN if(a.n > 0, 'supplied_context', 'missing') WHEN 'endpoint' THEN if(v.n > 0, 'candidate_pivots', 'missing') ELSE 'missing' END AS state,
  CASE k.check WHEN 'coverage' THEN coalesce(d.n, 0) WHEN 'ownership' THEN coalesce(a.n, 0) WHEN 'endpoint' THEN coalesce(v.n, 0) ELSE 0 END AS n
FROM s LEFT JOIN a USING (c) LEFT JOIN d USING (c) LEFT JOIN v USING (c), (VALUES ('integrity'), ('coverage'), ('ownership'), ('endpoint'), ('intent'), ('response')) k("check")""")
def q71_capture_checks(spark, d):
    e = events(spark, d).withColumn("source_sha256", (F.col("user_id") % 40).cast("string"))
    flows = e.filter(kind("click")).select("source_sha256", F.col("event_id").alias("flow_id"), F.col("user_id").alias("origin_ip"), F.col("k").alias("peer_ip"))
    assets = table(spark, d, "customer").filter("c_custkey % 9 = 0").select(F.col("c_custkey").alias("ip"))
    checks = network.capture_checks(e, flows, e.filter(kind("error")), assets, flows.filter("flow_id % 97 = 0"))
    return checks.select(F.col("source_sha256").alias("source"), "check", "state", "n")


@query("""WITH s AS (SELECT TIMESTAMP '2024-01-03' + to_seconds(i * 5400) AS told FROM range(0, 321) t(i)),
l AS (SELECT DISTINCT event_type FROM events WHERE ts > TIMESTAMP '2024-01-03' - INTERVAL 4 HOUR AND ts <= TIMESTAMP '2024-01-23'), g AS (SELECT * FROM l, s)
SELECT g.event_type, told AS "at", count(e.event_id) AS n FROM g LEFT JOIN events e ON e.event_type = g.event_type AND e.ts <= told AND e.ts > told - INTERVAL 4 HOUR GROUP BY g.event_type, told""")
def q72_range_counts(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return sequence.count_over_range(table(spark, d, "events"), "ts", at("2024-01-03"), at("2024-01-23"), 5400, 4 * HOUR, "event_type")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 991 = 0 THEN 'changed' WHEN o_orderkey % 997 = 0 THEN 'gone' ELSE 'added' END AS state FROM orders WHERE o_orderkey > 0 AND (o_orderkey % 991 = 0 OR o_orderkey % 997 = 0)
UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey > 0 AND o_orderkey % 1009 = 0""")
def q74_changed_rows(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey > 0").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changes = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 991 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).filter("o_orderkey % 991 = 0 or o_orderkey % 997 != 0")
    changes = changes.unionByName(o.filter("o_orderkey % 1009 = 0").withColumn("o_orderkey", -F.col("o_orderkey")))
    depth = merkle.depth_for(o.count())
    odd = merkle.changed(merkle.build(o, ["o_orderkey"], depth=depth), merkle.build(changes, ["o_orderkey"], depth=depth))
    sides = odd.groupBy(F.col("key_o_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("side")).alias("s"))
    return sides.select("o_orderkey", F.when(F.size("s") == 2, "changed").when(F.col("s")[0] == "old", "gone").otherwise("added").alias("state"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')")
def q75_indexed_search(spark, d):
    """The documents as files by id, with an index of their texts: only files that may hold the term are read."""
    path, index = new_path(spark, "indexed"), new_path(spark, "index")
    table(spark, d, "documents").select("doc_id", "source", "text").repartitionByRange(64, "doc_id").write.parquet(path)
    textindex.build(spark, path, "text", index)
    return textindex.search(spark, path, "text", index, "License").select("doc_id", "source")
