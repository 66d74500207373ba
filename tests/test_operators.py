import random

from pyspark.sql import functions as F

from tracelake.functions import text as tx
from tracelake.functions import times as tm
from tracelake.operators import governance, graph, joins, readiness, sequence
from tracelake.operators.rules import load_rules


def stream(seed, n=400):
    """Events of few users, many with equal timestamps."""
    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 5, 60, 400])
        rows.append((i, t, rng.randrange(4), rng.choice(["fail", "fail", "fail", "ok", "other"]), rng.randrange(6)))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, t long, user long, kind string, target long")
    return df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).repartition(3)


def test_followed_by_equals_a_fold(spark):
    for seed in (1, 2):
        rows, state, expected = stream(seed), {}, []
        for i, t, u, kind, _ in rows:
            if kind == "fail":
                state.setdefault(u, []).append((t, i))
            elif kind == "ok":
                last = [x for x in state.pop(u, []) if t - x[0] <= 600][-3:]
                if len(last) == 3:
                    expected.append((i, [x[1] for x in last] + [i]))
        got = sequence.followed_by(frame(spark, rows), ["user"], "ts", ["id"], F.col("kind") == "fail", F.col("kind") == "ok", 3, 600, "id")
        assert sorted((r.id, list(r.evidence)) for r in got.collect()) == expected and expected


def test_burst_cooldown_and_distinct_equal_folds(spark):
    rows = stream(3)
    fails = [r for r in rows if r[3] == "fail"]
    recent, last, hits, fired, distinct = {}, {}, [], [], {}
    for i, t, u, _, target in fails:
        q = recent[u] = [x for x in recent.get(u, []) if t - x[0] <= 300] + [(t, i, target)]
        distinct[i] = len({x[2] for x in q})
        if len(q) >= 3:
            hits.append(i)
            if u not in last or t - last[u] > 300:
                fired.append(i)
                last[u] = t
    df = frame(spark, rows).filter("kind = 'fail'")
    found = sequence.burst(df, ["user"], "ts", ["id"], 3, 300, "id")
    assert sorted(r.id for r in found.collect()) == hits
    assert sorted(r.id for r in sequence.cooldown(found, ["user"], "ts", ["id"], 300).collect()) == fired
    got = sequence.distinct_in_window(df, ["user"], "ts", ["id"], "target", 300).collect()
    assert {r.id: r.distinct_values for r in got} == distinct


def test_interval_join_equals_a_cross_check(spark):
    rows = stream(4)
    left = frame(spark, rows).filter("kind = 'ok'").select(F.col("id").alias("a"), F.col("user").alias("ua"), F.col("ts").alias("ta"))
    right = frame(spark, rows).filter("kind = 'fail'").select(F.col("id").alias("b"), F.col("user").alias("ub"), F.col("ts").alias("tb"))
    got = sorted((r.a, r.b) for r in joins.interval_join(left, right, [("ua", "ub")], "ta", "tb", 100, 7).collect())
    want = [(x[0], y[0]) for x in rows if x[3] == "ok" for y in rows if y[3] == "fail" and x[2] == y[2] and -100 <= y[1] - x[1] <= 7]
    assert got == sorted(want) and want


def test_cycles_lose_their_last_edge(spark):
    rows = [("a", "c", 0, 1), ("b", "a", 0, 2), ("c", "b", 0, 3), ("d", "a", 1, 4), ("e", "zz", 1, 5), ("f", "d", 0, 6), ("g", "g", 0, 7)]
    df = spark.createDataFrame(rows, "id string, parent string, t long, n long").withColumn("ts", F.timestamp_seconds("t"))
    edges, wrong = graph.parent_edges(df, "id", "parent", "ts", ["n"])
    assert sorted(map(tuple, edges.collect())) == [("a", "c"), ("b", "a"), ("d", "a")]
    assert sorted((r.child, r.code) for r in wrong.collect()) == [("c", "invalid_parent_order_or_cycle"), ("e", "parent_not_observed"), ("f", "invalid_parent_order_or_cycle"), ("g", "invalid_parent_order_or_cycle")]


def test_ancestors_have_no_depth_limit(spark):
    n = 260
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "c long, p long")
    got = {(r.node, r.ancestor): r.depth for r in graph.ancestors(chain, "c", "p").collect()}
    assert got == {(i, k): k - i for i in range(n) for k in range(i + 1, n + 1)}
    # A cycle of 130 with a tail of one, and two ways of different length.
    m = 130
    rows = [(i, (i + 1) % m) for i in range(m)] + [(500, 0), (600, 601), (601, 602), (600, 602)]
    found = graph.ancestors(spark.createDataFrame(rows, "c long, p long"), "c", "p").collect()
    want = {(i, k): (k - i) % m or m for i in range(m) for k in range(m)} | {(500, k): k + 1 for k in range(m)} | {(600, 601): 1, (600, 602): 1, (601, 602): 1}
    assert {(r.node, r.ancestor): r.depth for r in found} == want and len(found) == len(want)
    ring = spark.createDataFrame([(i, (i + 1) % m, i) for i in range(m)], "id long, parent long, n long").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    edges, wrong = graph.parent_edges(ring, "id", "parent", "ts", ["n"])
    assert edges.count() == m - 1 and [tuple(r) for r in wrong.select("child", "code").collect()] == [(m - 1, "invalid_parent_order_or_cycle")]


def test_hash_chain_shows_tampering(spark):
    df = spark.createDataFrame([(k, i, f"p{k}{i}") for k in "ab" for i in range(5)], "k string, i long, payload string")
    links = governance.chain(df, ["k"], ["i"], F.col("payload"))
    assert governance.chain_errors(links, ["k"], F.col("payload")).count() == 0
    changed = links.withColumn("payload", F.when((F.col("k") == "a") & (F.col("i") == 2), "x").otherwise(F.col("payload")))
    assert [(r.k, r.sequence, r.error) for r in governance.chain_errors(changed, ["k"], F.col("payload")).collect()] == [("a", 3, "sha256")]
    gone = links.filter("not (k = 'b' and i = 1)")
    assert {r.error for r in governance.chain_errors(gone, ["k"], F.col("payload")).collect()} == {"sequence"}


def test_transitions_and_revisions(spark):
    log = spark.createDataFrame([("a", 1, "new", None), ("a", 2, "triaged", None), ("a", 3, "closed", "x"), ("b", 1, "triaged", None), ("c", 1, "new", None), ("c", 3, "triaged", None)], "id string, revision long, state string, verdict string")
    errors = governance.transition_errors(log, "id", "revision", "state", "verdict").collect()
    assert sorted((r.id, r.error) for r in errors) == [("a", "transition not allowed"), ("b", "does not begin as new"), ("c", "revision out of sequence")]
    changes = spark.createDataFrame([("a", 3, "n1"), ("a", 3, "n2"), ("b", 0, "n3"), ("d", 0, "n4")], "id string, revision long, note string")
    good, bad = governance.next_revision(log, changes, "id", "revision")
    assert sorted((r.id, r.revision, r.note) for r in good.collect()) == [("a", 4, "n1"), ("d", 1, "n4")] and bad.count() == 2


def test_text_functions(spark):
    rows = [
        (r'"C:\x y\MSHTA.exe" "https://a/b"', r"C:\x y\mshta.exe", "mshta remote or inline script", 2),
        (r"powershell -enc aABp", r"C:/w/powershell.exe", "powershell encoded command", 3),
        (r"powershell -file x -enc aABp", r"C:\powershell.exe", None, 5),
        ('open "quote', r"C:\mshta.exe", None, None),
    ]
    df = spark.createDataFrame([(c, i) for c, i, _, _ in rows], "c string, i string")
    got = df.select(tx.risk_marker(F.col("i"), F.col("c")).alias("r"), F.size(tx.tokens(F.col("c"))).alias("n")).collect()
    assert [(r.r, None if r.n in (-1, None) else r.n) for r in got] == [(m, n) for _, _, m, n in rows]
    one = spark.range(1).select(
        tx.encoded_command(F.lit("pwsh.exe -EncodedCommand aABpAA==")).alias("a"),
        tx.encoded_command(F.lit("pwsh.exe -enc aABp")).alias("b"),
        tx.guid(F.lit("{0000ABCD-0000-0000-0000-000000000001}")).alias("g"),
        tx.guid(F.lit("{00000000-0000-0000-0000-000000000000}")).alias("z"),
        tx.csv_cell(F.lit("  =1+1")).alias("c"),
        tm.utc_text(tm.utc_timestamp(F.lit("2024-01-01T02:00:00.1234567+02:00"))).alias("t"),
        tm.utc_timestamp(F.lit("2024-01-01T02:00:00")).alias("naive"),
    ).first()
    assert (one.a.script, one.a.error, one.b.script, one.b.error) == ("hi", None, None, "invalid Base64 / UTF-16LE argument")
    assert (one.g, one.z, one.c, one.t, one.naive) == ("0000abcd-0000-0000-0000-000000000001", None, "'  =1+1", "2024-01-01T00:00:00.123456Z", None)


def test_rules_are_checked_when_loaded():
    import pytest

    good = '[{"id": "A", "title": "t", "severity": "low", "conditions": [{"field": "x", "op": "contains_any", "value": ["y"]}]}]'
    assert load_rules(good)[0].conditions[0].value == ("y",)
    for bad in (good.replace("contains_any", "regex"), good.replace('["y"]', '"y"'), good[:-1] + "," + good[1:], good.replace('[{"field": "x", "op": "contains_any", "value": ["y"]}]', "[]")):
        with pytest.raises(ValueError):
            load_rules(bad)


def test_confusion_is_null_on_zero(spark):
    df = spark.createDataFrame([(True, False), (None, False)], "label boolean, hit boolean")
    r = readiness.confusion(df, F.col("label"), F.col("hit")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1) == (0, 0, 1, 1, None, 0.0, 0.0)


def test_sigma_documents_become_rules():
    import pytest

    from tracelake.operators.rules import sigma_rule

    document = {"id": "s", "title": "t", "level": "high", "tags": ["attack.t1218.005", "attack.execution"], "detection": {"image": {"Image|endswith": "\\mshta.exe"}, "line": {"CommandLine|contains": ["http://", "https://"], "event_id": "1"}, "condition": "image and line"}}
    rule = sigma_rule(document)
    assert [(c.field, c.op, c.value) for c in rule.conditions] == [("event_data.Image", "endswith_any", ("\\mshta.exe",)), ("event_data.CommandLine", "contains_any", ("http://", "https://")), ("event_id", "equals", "1")]
    assert (rule.severity, rule.attack) == ("high", ("T1218.005",))
    for condition in ("image or line", "not image", "1 of them"):
        with pytest.raises(ValueError):
            sigma_rule(document | {"detection": document["detection"] | {"condition": condition}})


def test_distinct_and_cooldown_across_batches(spark):
    rows = stream(6, 900)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    last, fired = {}, []
    for i, t, u, _, _ in rows:
        if u not in last or t - last[u] > 90:
            fired.append(i)
            last[u] = t
    try:
        assert sorted(r.id for r in sequence.cooldown(frame(spark, rows), ["user"], "ts", ["id"], 90).collect()) == fired
        links = governance.chain(frame(spark, rows), ["user"], ["id"], F.col("kind")).cache()
        assert links.count() == 900 and governance.chain_errors(links, ["user"], F.col("kind")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents_are_strict():
    import pytest

    from tracelake.functions import documents

    assert documents.read_strict('{"b": [1, "é"], "a": 2}') == {"a": 2, "b": [1, "é"]}
    assert documents.canonical({"b": [1, "é"], "a": 2}) == '{"a":2,"b":[1,"é"]}'
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', "[1e", b"\xff", " " * 2000):
        with pytest.raises(ValueError):
            documents.read_strict(bad, most=1000)
    assert (documents.checked_text("a b"), documents.checked_name("lab-1")) == ("a b", "lab-1")
    for f, bad in ((documents.checked_text, " "), (documents.checked_text, "a\x00"), (documents.checked_text, None), (documents.checked_name, "../x"), (documents.checked_name, "")):
        with pytest.raises(ValueError):
            f(bad)


def test_profiles_are_valid_for_a_time(spark):
    rows = [("ok", "2024-01-01", "2024-12-31"), ("long", "2024-01-01", "2026-01-01"), ("back", "2024-03-01", "2024-02-01"), ("old", "2023-01-01", "2023-06-01"), ("none", None, "2024-06-01")]
    df = spark.createDataFrame(rows, "id string, a string, b string").select("id", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    got = readiness.validity_errors(df, "id", "a", "b", F.lit("2024-05-01").cast("timestamp_ntz")).collect()
    assert sorted(map(tuple, got)) == [("back", "ends before it begins"), ("long", "valid for too long"), ("none", "no validity"), ("old", "not valid now")]


def test_positions_of_a_forest_tell_who_is_below(spark):
    rng = random.Random(9)
    up = {i: rng.randrange(max(0, i - rng.choice([1, 1, 30])), i) for i in range(1, 150) if i % 40}
    up |= {1000 + i: 0 for i in range(120)} | {5000 + i: 5001 + i for i in range(700)}  # one parent of many, one long chain
    df = spark.createDataFrame(sorted(up.items()), "c long, p long")
    got = {r.node: r for r in graph.positions(df, "c", "p").collect()}
    assert set(got) == set(up) | set(up.values())

    def above(x):
        while x in up:
            x = up[x]
            yield x

    some = sorted(rng.sample(sorted(got), 120)) + [0, 5000, 5700]
    for x in some:
        over = set(above(x))
        assert got[x].root == (max(over, key=lambda y: len(list(above(y))) == 0) if over else x)
        for y in some:
            inside = got[x].root == got[y].root and got[y].enter < got[x].enter and got[x].leave < got[y].leave
            assert inside == (y in over)
    assert graph.positions(df.limit(0), "c", "p").collect() == []


def test_range_counts_equal_single_ones(spark):
    df = frame(spark, stream(11, 400))
    at = lambda s: F.timestamp_seconds(F.lit(s))
    first = df.agg(F.min(F.unix_timestamp("ts"))).first()[0]
    got = sequence.count_over_range(df, "ts", at(first - 50), at(first + 4000), 130, 333, "user").collect()
    steps = sorted({r.at for r in got})
    assert len(steps) == 4050 // 130 + 1 and len(got) == len(steps) * len({r.user for r in got})
    for k in (0, 3, 11, len(steps) - 1):
        one = {r.user: r.n for r in sequence.count_over_time(df, "ts", at(first - 50 + 130 * k), 333, "user").collect()}
        assert {r.user: r.n for r in got if r.at == steps[k] and r.n} == one
    import pytest

    with pytest.raises(ValueError, match="steps"):
        sequence.count_over_range(df, "ts", at(0), at(-1), 1, 1)


def test_scopes_are_approved_by_hash_and_reason(spark):
    import pytest

    a, b = "a" * 64, "b" * 64
    df = spark.createDataFrame([(a,), (b,), (a,)], "source_sha256 string")
    good = {"id": "case", "collection_reason": "incident", "source_sha256": [a, b]}
    assert governance.approved_scope(df, good) is df
    for bad in ({"source_sha256": [a]}, {"source_sha256": [a, b, "c" * 64]}, {"source_sha256": [a, a, b]}, {"source_sha256": ["A" * 64, b]}, {"source_sha256": []}, {"id": " "}, {"collection_reason": None}):
        with pytest.raises(ValueError):
            governance.approved_scope(df, good | bad)


def test_folding_is_that_of_unicode(spark):
    import sys

    letters = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    words = ["STRASSE", "Straße", "ΣΊΣΥΦΟΣ", "Σίσυφος", "İstanbul", "ﬃ ŉ ẞ", "plain ASCII Text", "", "Ǆ Ꭰ 𐐀"]
    df = spark.createDataFrame([(x,) for x in letters + words + [None]], "c string")
    got = {r.c: r.f for r in df.select("c", tx.casefold(F.col("c")).alias("f")).collect()}
    assert got.pop(None) is None and [c for c, f in got.items() if f != c.casefold()] == []
    assert got["STRASSE"] == got["Straße"] and got["ΣΊΣΥΦΟΣ"] == got["Σίσυφος"]
