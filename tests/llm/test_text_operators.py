import os
import random

import brute
import pytest
from pyspark.sql import functions as F

from tracelake.llm import graph, keysets, minhash, quality, shared, substring, suffix

SCHEMA = "doc_id long, text string, lang string, part string, kept string"


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n)]


def corpus(seed=3, n=60):
    """Rows with copies, near copies, shared passages, periodic and long texts, nulls, blanks, ties and repeats."""
    rng = random.Random(seed)
    passage = prose(rng, 45)
    rows = []
    for i in range(n):
        w = prose(rng, rng.choice([3, 19, 20, 60, 200]))
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randrange(10) : 45 - rng.randrange(10)]
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(w)))
    base = prose(rng, 150)
    for i in range(n, n + 25):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, rows[5][1]) for i in range(4)]
    rows += [(1100, "a b " * 80), (1101, "b a " * 90), (1102, "aaaa" * 60), (1103, "aaaa" * 50), (1104, "tick " * 300)]
    rows += [(1200, None), (1201, ""), (1202, " \n\t "), (1203, "one two three"), (1204, "ONE two THREE"), (None, rows[7][1]), (None, None), (None, "only here " * 30)]
    rows += [(1300, " ".join(prose(rng, 20000, 90000))), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "p", "k") for i, t in rows], SCHEMA).repartition(5)


def compared(found, rows, expected):
    """Rows of found as a multiset against those expected."""
    got = sorted(([r[0], r[1], *r[2:]] for r in found), key=repr)
    want = sorted(([i, t, *e] for (i, t), e in zip(rows, expected)), key=repr)
    assert got == want


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_substring_matches_brute_force(spark, rows):
    out = substring.remove_repeats(frame(spark, rows))
    assert {"lang", "part", "kept"} <= set(out.columns)
    found = out.select("doc_id", "text", "n_words", "n_removed", "kept_text").collect()
    compared(found, rows, brute.substring(rows))


def test_suffix_matches_brute_force(spark, rows):
    out = suffix.remove_shared(frame(spark, rows))
    assert {"lang", "part"} <= set(out.columns)
    found = [(r[0], r[1], r[2], r[3], r[4], bytes(r[5])) for r in out.select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept").collect()]
    compared(found, rows, brute.shared_bytes(rows))


def test_hot_anchors_match_brute_force(spark, monkeypatch):
    """A passage of very many documents, with other text around it in each: its strings are sent one by one."""
    rng = random.Random(12)
    passage = " ".join(prose(rng, 25))
    rows = [(i, " ".join(prose(rng, 6)) + " " + passage[rng.randrange(3) :] + " " + " ".join(prose(rng, rng.randrange(8)))) for i in range(120)]
    rows += [(500 + i, rows[i][1]) for i in range(5)] + [(None, passage), (3, passage), (700, "x" * 300), (701, "x" * 90)]
    rows += corpus(seed=4, n=20)
    for hot, size in ((3, 50), (0, 100_000)):
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "SLICE", size)
        out = suffix.remove_shared(frame(spark, rows))
        found = [(r[0], r[1], r[2], r[3], r[4], bytes(r[5])) for r in out.select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept").collect()]
        compared(found, rows, brute.shared_bytes(rows))


def test_slices_hold_whole_keys(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (1, 5, 40, 1000):
        monkeypatch.setattr(suffix, "SLICE", size)
        keys, n = np.sort(rng.integers(0, 30, 200)), rng.integers(1, 28, 200)
        cuts = list(suffix._slices(np.cumsum(n), keys))
        assert cuts[0][0] == 0 and cuts[-1][1] == 200 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
        for a, b in cuts:
            assert (b == 200 or keys[b - 1] != keys[b]) and (n[a:b].sum() <= size or len(set(keys[a:b])) == 1)
    assert list(suffix._slices(np.empty(0, np.int64), np.empty(0, np.int64))) == []


def test_more_parts_than_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(keysets, "PART_BYTES", 4000)
    monkeypatch.setattr(keysets, "OWNER_BYTES", 9000)
    monkeypatch.setattr(keysets, "MOST_BUCKETS", 5)
    compared(substring.remove_repeats(frame(spark, rows)).select("doc_id", "text", "n_words", "n_removed", "kept_text").collect(), rows, brute.substring(rows))
    found = suffix.remove_shared(frame(spark, rows)).select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept").collect()
    compared([(*r[:5], bytes(r[5])) for r in found], rows, brute.shared_bytes(rows))


def test_release_drops_intermediate_tables(spark, rows):
    substring.remove_repeats(frame(spark, rows)).count()
    tables, paths = list(shared._made["tables"]), list(shared._made["paths"])
    assert tables and paths
    shared.release(spark)
    assert not any(spark.catalog.tableExists(t) for t in tables)
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)


def test_near_duplicates_match_brute_force(spark, rows):
    # Rows that share an id are one vertex; the fixture's repeated rows have equal texts.
    out = minhash.near_duplicates(frame(spark, rows))
    assert {"lang", "part"} <= set(out.columns)
    found = out.select("doc_id", "text", "n_shingles", "component_id", "kept").collect()
    compared(found, rows, [(n, c, c == i) for (i, _), (n, c) in zip(rows, brute.near(rows))])


def test_crowds_of_loosely_similar_documents(spark, monkeypatch):
    """More documents in a node than are listed: stars, blocks and branches find the same components."""
    rng = random.Random(8)
    base = prose(rng, 120)
    rows = []
    for i in range(260):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 9])):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    expected = [(i, c) for (i, _), (_, c) in zip(rows, brute.near(rows))]
    for settings in ({"SMALL": 3, "GROUP": 16, "SKETCH_GROUP": 32}, {"SMALL": 3, "OUTSIDE": 2}, {"SMALL": 3, "OUTSIDE_SKETCHED": 2, "DEPTH": 3}):
        for k, v in settings.items():
            monkeypatch.setattr(minhash, k, v)
        found = minhash.near_duplicates(frame(spark, rows)).select("doc_id", "component_id").collect()
        assert sorted(map(tuple, found)) == expected


def test_hot_keys_stay_in_place(spark, monkeypatch):
    """Keys are joined right whether their table is broadcast, partly broadcast or shuffled, and pairs of hot nodes are dealt out."""
    df = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)] + [(None, 1), (4, 1)], "key long, id long")
    table = df.groupBy("key").agg(F.count("*").alias("n")).filter("key < 4")
    for few, hot in ((10, 10), (0, 10), (0, 1000), (0, 0)):
        monkeypatch.setattr(shared, "FEW_KEYS", few)
        monkeypatch.setattr(shared, "HOT_ROWS", hot)
        got = shared.joined_by_key(df, table, "key", "n").collect()
        want = [(k, i, n) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)]
        assert sorted((r.key, r.id, r.n) for r in got) == want
        left = shared.joined_by_key(df, table, ["key"], "n", "left").collect()
        assert sorted((r.key or 0, r.id, r.n or 0) for r in left) == sorted([*want, (0, 1, 0), (4, 1, 0)])


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_stars_and_chains(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_KEYS", few)
    monkeypatch.setattr(shared, "FEW_KEYS", few)
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    links = [(i, i + 1) for i in range(30)] + [(200, i) for i in range(100, 140)] + [(139, 300), (7, 7), (3, 2)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in [*range(100, 140), 200, 300]}


def test_near_duplicates_with_hot_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(shared, "FEW_KEYS", 0)
    monkeypatch.setattr(graph, "FEW_KEYS", 0)
    monkeypatch.setattr(shared, "HOT_ROWS", 4)
    monkeypatch.setattr(minhash, "HOT_ROWS", 4)
    found = minhash.near_duplicates(frame(spark, rows)).select("doc_id", "text", "n_shingles", "component_id", "kept").collect()
    compared(found, rows, [(n, c, c == i) for (i, _), (n, c) in zip(rows, brute.near(rows))])


def test_large_nodes_are_never_listed(spark, monkeypatch):
    """Many documents that resemble each other below the threshold: they don't branch without end, nor are their pairs listed."""
    rng = random.Random(9)
    base = prose(rng, 200)
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(9):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    expected = [(i, c) for (i, _), (_, c) in zip(rows, brute.near(rows))]
    listed, list_pairs = [], minhash._listed_pairs

    def counted(members):
        pairs = list_pairs(members)
        listed.append((pairs.select("node", "a", "b").distinct().count(), members.count()))
        return pairs

    monkeypatch.setattr(minhash, "_listed_pairs", counted)
    for k, v in {"SMALL": 3, "OUTSIDE": 2, "OUTSIDE_SKETCHED": 2, "GROUP": 64}.items():
        monkeypatch.setattr(minhash, k, v)
    for depth in (1, 3):
        monkeypatch.setattr(minhash, "DEPTH", depth)
        listed.clear()
        found = minhash.near_duplicates(frame(spark, rows)).select("doc_id", "component_id").collect()
        assert sorted(map(tuple, found)) == expected
        assert all(pairs <= 3 * members for pairs, members in listed), (depth, listed)


def test_quality_counts_and_verdict(spark, rows):
    out = quality.judge(frame(spark, rows)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    compared(out.collect(), rows, [brute.quality(t) for _, t in rows])
    cases = [
        (1, "the and of " + " ".join(f"word{i}" for i in range(80))),
        (2, " ".join(f"$$$word{i}" for i in range(80))),
        (3, " ".join(f"zzz{i}" for i in range(80))),
        (4, "the same words again and again " * 20),
        (5, "the short text"),
        (6, None),
    ]
    kept = dict(quality.judge(frame(spark, cases)).select("doc_id", "kept").collect())
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


@pytest.mark.parametrize("operator", [substring.remove_repeats, suffix.remove_shared, minhash.near_duplicates, quality.judge])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = frame(spark, [(None, None), (1, None), (1, None), (2, "")])
    assert operator(nothing).count() == 4


def test_deep_shallow_order():
    import numpy as np

    rng = np.random.default_rng(2)
    texts = [rng.choice(list(b"ab"), 50).astype(np.uint8).tobytes() for _ in range(400)] + [b"a" * 50] * 9 + [b"a" * 49 + b"b"] * 3
    classes = np.sort(rng.integers(0, 3, len(texts)))
    words = np.frombuffer(b"".join(t + b"\0" * 6 for t in texts), ">u8").reshape(-1, 7).astype(np.uint64)
    order, group = suffix.equal_strings(words, classes)
    keys = [(classes[i], texts[i]) for i in order]
    assert keys == sorted(keys)
    assert [keys[i] == keys[i + 1] for i in range(len(keys) - 1)] == [group[i] == group[i + 1] for i in range(len(keys) - 1)]


def test_distinct_columns_survive(spark):
    docs = frame(spark, [(1, "a b c")]).withColumn("n_words", F.lit("clash")).withColumn("Part2", F.lit(5))
    row = substring.remove_repeats(docs).first()
    assert (row.n_words, row.Part2, row.part) == (3, 5, "p")


def test_an_id_with_several_texts_is_one_document(spark):
    words = [f"w{i}" for i in range(300)]
    a, b, c = (" ".join(words[k : k + 60]) for k in (0, 100, 200))
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (7, c), (11, "alone here"), (None, a)]
    df = spark.createDataFrame([(i, t, 0, "n", True) for i, t in rows], "doc_id long, text string, component long, d1 string, vertex boolean")
    got = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.doc_id) == [(3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (9, 3), (11, 11)]
    assert all(r.kept == (r.doc_id in (3, 11, None)) for r in got)
