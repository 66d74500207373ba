import collections
import itertools
import math
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import curve, hard_negatives, trie
from tracelake.llm.packing import default_vocabulary

ROWS = "vec_id long, embedding array<double>, label int, score string, anchor string"


def vectors(n=300, dim=6, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)], rng.randrange(4)) for i in range(n)]
    rows += [(5000 + i, rows[0][1], rng.randrange(3)) for i in range(n // 2)]  # a third of all rows have one vector
    rows += [(50, rows[50][1], 1), (50, rows[50][1], 1), (7, None, 1), (8, [], 2), (9, [1.0, None] * 3, 1), (10, [math.nan] * dim, 1), (11, [math.inf] * dim, 0)]
    return rows + [(None, rows[0][1], 1), (None, rows[3][1], None), (100, [1e30] * dim, 1), (150, [0.5] * 9, 1), (200, [], 3), (1, [-2e29] * dim, 2), (250, [3e9] * dim, 0), (251, [3e9] * dim, 0)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, "s", "a") for i, v, c in rows], ROWS).repartition(3)


def mined(spark, rows, **more):
    return sorted(map(tuple, hard_negatives.mine(table(spark, rows), F.col("vec_id") % 50 == 0, **more).collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 37, "slab_rows": 7}])
def test_hard_negatives_equal_brute_force(spark, sizes):
    rows = vectors()
    assert mined(spark, rows, **sizes) == sorted(brute.hard_negatives(rows), key=str)


def test_hard_negatives_of_small_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2), (3, [0.96], 2)]) == [(0, 1, 1, 2, 65536, 49152)]


def test_scores_are_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    for top in (10, 2**30, 2.0**90):
        a, b = np.floor(rng.normal(size=(3, 5)) * top), np.floor(rng.normal(size=(4, 5)) * top)
        exact = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
        assert hard_negatives._scores(a, b).tolist() == exact


def test_hilbert_keys_visit_neighbouring_cells():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curve.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def packed(spark, rows, capacity):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, start long, key string").repartition(3)
    return [r.asDict() for r in curve.pack(df, capacity=capacity, with_ids=True).collect()]


def encoded(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary().replace(".tiktoken", ".json")).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_curve_packing_loses_no_id_and_pads_nothing(spark, capacity):
    rng = random.Random(capacity)
    words = ["alpha", "beta", "gamma", "delta", "naïve", "東京", "x1", "\n\n"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60, 400])))) for i in range(120)]
    rows += [(500 + i, rows[3][1] + " copy") for i in range(60)] + [(None, None), (None, "no id"), (7, "twice"), (7, "twice"), (8, ""), (9, "a " * 30000)]
    rows += [(10, "a" + " " * 1_000_000 + "b")] if capacity > 1000 else []
    got = packed(spark, rows, capacity)
    pieces, sequences = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(r["ids"])))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    wanted = [(i, encoded(t)) for i, t in rows]
    assert collections.Counter(x for r in got for x in r["ids"]) == collections.Counter(x for _, ids in wanted for x in ids)
    times = collections.Counter((i, len(ids)) for i, ids in wanted)
    for i, ids in wanted:
        mine = sorted(pieces[i, len(ids)])
        if times[i, len(ids)] == 1:
            assert [x for _, p in mine for x in p] == ids
            assert [s for s, _ in mine] == list(itertools.accumulate([0, *[len(p) for _, p in mine[:-1]]]))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends == capacity or ends < capacity and ends & (ends - 1) == 0


def test_curve_packing_brings_like_documents_together(spark):
    rng = random.Random(4)
    topics = [[f"{a}{k}" for k in range(30)] for a in ("cat", "sun", "oak", "tin")]
    rows = [(i, " ".join(rng.choices(topics[i % 4], k=80))) for i in range(400)]
    got = packed(spark, rows, 1024)
    groups = {}
    for r in got:
        groups.setdefault(r["sequence_id"], []).extend([r["doc_id"] % 4] * r["length"])
    pure = sum(max(map(g.count, set(g))) for g in groups.values()) / sum(map(len, groups.values()))
    assert pure > 0.8  # a random order has about 0.35


def test_curve_packing_of_nothing(spark):
    assert packed(spark, [], 2048) == []


def conversations(seed, n=150):
    rng = random.Random(seed)
    lines = ["hi", "how are you ?", "a b  c", "", None, "fine\tthanks"]
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", rng.choice(lines[:2] if t < 2 else lines)))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(n // 2) for t in range(4)]  # a third of all conversations are copies
    rows += [(7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, None, "tie"), (None, 1, "user", "none"), (-5, None, "user", "x"), (-5, 1, None, None), (-20, 0, "user", "y")]
    return rows + [(500, t, "user", f"long {t}") for t in range(700)] + [(501, t, "user", f"long {t}") for t in range(650)] + [(502, t, "user", f"long {t}") for t in range(700)]


def trie_of(spark, rows, partitions=3, **more):
    df = spark.createDataFrame([(c, t, r, x, "n", 0) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, words string, part int").repartition(partitions)
    return sorted(map(tuple, trie.prefix_trie(df, **more).collect()), key=str)


@pytest.mark.parametrize("chunk, shuffles", [(4096, 4), (4096, 61), (64, 7), (3, 5)])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, chunk, shuffles):
    monkeypatch.setattr(trie, "IDS", 5)
    rows = [r for r in conversations(chunk) if chunk > 3 or r[0] is None or not 500 <= r[0] <= 502 or r[1] < 10]
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_of(spark, rows, chunk=chunk) == sorted(brute.prefix_trie(rows), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_trie_of_small_tables(spark):
    assert trie_of(spark, []) == []
    for rows in ([(None, 0, "user", "x")], [(3, None, None, None)], [(20, 0, "u", "a b"), (21, 0, "u", "c"), (21, 1, "u", "d")]):
        assert trie_of(spark, rows) == sorted(brute.prefix_trie(rows), key=str)
