import collections
import io
import math
import random
import textwrap
import zlib

import brute
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.llm import ann, licenses, mixing, packing, sharding, warc
from tracelake.llm.license_texts import KNOWN, known_texts
from tracelake.llm.shared import gapless_rank

ENCODERS = {}
DOCS = "doc_id long, text string, source string, shard string, rank string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "s", "r") for i, t, s in rows], DOCS).repartition(3)


def many(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, "x" * rng.choice([0, 1, 10, 300, 4000]) + str(i) * rng.randrange(3), rng.choice(["hot", "hot", "a", "b", None])) for i in range(n)]
    rows += [(1000 + i, "same text", "hot") for i in range(n // 3)]
    return rows + [(None, None, None), (None, "", "a"), (7, "again", "b"), (7, "again", "b"), (2000, "long " * 30000, "a")]


def test_shards_are_even_and_slots_gapless(spark):
    rows = many()
    got = sharding.shard(docs(spark, rows), shards=16).collect()
    assert len(got) == len(rows) and {"source", "rank"} <= set(got[0].asDict())
    assert sorted((r.doc_id, r.text, r.size) for r in got if r.doc_id is not None) == sorted((i, t, len((t or "").encode()) + 1) for i, t, _ in rows if i is not None)
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    even, largest = sum(sizes.values()) / 16, max(len(t or "") for _, t, _ in rows) + 1
    # Apart from the shard of the one long text, shards differ from their even part by no more than a text.
    assert sum(n > even + 4100 for n in sizes.values()) <= math.ceil(largest / even)


def test_shards_of_edge_tables(spark):
    assert sharding.shard(docs(spark, [])).count() == 0
    got = sharding.shard(docs(spark, [(1, "a", None)] * 5), shards=4, pieces=2).collect()
    assert len(got) == 5 and all(0 <= r.shard < 4 for r in got)
    assert len({(r.shard, r.slot) for r in got}) == 5


@given(st.lists(st.integers(1, 60), max_size=60), st.just(60))
@settings(max_examples=60, deadline=None)
def test_best_fit_runs_equal_best_fit_decreasing(lengths, capacity):
    runs = packing.best_fit_runs(dict(collections.Counter(lengths)), capacity)
    bins = collections.defaultdict(list)
    for length, _, n, first, offset, per in runs:
        for k in range(n):
            bins[first + k // per].append((offset + k % per * length, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(x for p in bins.values() for _, x in p) == sorted(lengths)
    rooms = brute.best_fit(lengths, capacity)
    assert sorted(capacity - sum(x for _, x in p) for p in bins.values()) == sorted(rooms)


def test_capacity_tree_finds_the_tightest():
    rng = random.Random(4)
    tree, have = packing.CapacityTree(37), collections.Counter()
    for _ in range(500):
        c = rng.randrange(38)
        d = 1 if not have[c] or rng.random() < 0.4 else -1
        have[c] += d
        tree.add(c, d)
        least = rng.randrange(38)
        assert tree.tightest(least) == min((x for x, n in have.items() if n and x >= least), default=None)


def test_pieces_hold_all_ids(spark):
    import public_tokenizers

    rows = many(40) + [(3000, "word " * 1023, "a"), (3001, "word " * 5000, "a"), (3002, "é日本語 \n\t <|endoftext|> don't", "a")]
    got = packing.pack(docs(spark, rows), with_ids=True).collect()
    encode = packing.load_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: [*encode([t or ""])[0], 2] for i, t, _ in rows if i is not None}
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for i, ids in expected.items():
        parts = sorted(pieces[i], key=lambda r: r.piece)
        if i != 7:
            assert [x for p in parts for x in p.ids] == ids
            assert [p.start for p in parts] == list(np.cumsum([0, *[p.length for p in parts[:-1]]]))
            assert all(p.length == 1024 for p in parts[1:]) and (len(parts) == 1) == (len(ids) <= 1024)
    assert len(pieces[7]) == 3 and len(pieces[None]) == 2
    for parts in bins.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 1024
    assert len(bins) == len(brute.best_fit([r.length for r in got], 1024))
    assert packing.pack(docs(spark, [])).count() == 0


def test_ranked_vocabulary_gives_the_tokenizer_s_ids():
    import public_tokenizers

    texts = [t or "" for _, t, _ in many(20)] + ["  a  b\n\n\tc ", "naïve Ünïcödé 日本語 🙂 x²", "I'm they'll 12345", "\x00\x01  "]
    a, b = (packing.load_encoder(public_tokenizers.path(f"byte_bpe_50k.{k}")) for k in ("json", "tiktoken"))
    assert a(texts) == b(texts)


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "'s", "'LL", "Don't", "word", "é", "e\u0301", "日本", "🙂", "12", "٣", "²", "_", "...", "\ufeff", "\U00020000"]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_both_vocabularies_agree_on_any_mixture(parts):
    import public_tokenizers

    a, b = (packing.load_encoder.__wrapped__(public_tokenizers.path(f"byte_bpe_50k.{k}")) if k not in ENCODERS else ENCODERS[k] for k in ("json", "tiktoken"))
    ENCODERS.update(json=a, tiktoken=b)
    assert a(["".join(parts)]) == b(["".join(parts)])


def test_added_tokens_get_the_tokenizer_s_ids(spark):
    import public_tokenizers

    end = "<|endoftext|>"
    texts = [f"a{end}b", end, end * 3, f"a  {end}  b", f" {end}\n\n{end} don't", f"<|{end}|>", "<|endoftext|", "<|ENDOFTEXT|>", f"é日本語{end[:-1]} {end}x", f"{'word ' * 1500}{end}{'word ' * 900}"]
    a, b = (packing.load_encoder(public_tokenizers.path(f"byte_bpe_50k.{k}")) for k in ("json", "tiktoken"))
    assert b(texts[:1]) == [[64, 50256, 65]]
    assert a(texts) == b(texts)
    got = collections.defaultdict(list)
    for r in packing.pack(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), with_ids=True).collect():
        got[r.doc_id].append((r.piece, r.ids))
    assert [[x for _, ids in sorted(got[i]) for x in ids] for i in range(len(texts))] == [[*ids, 2] for ids in a(texts)]


def test_archives_round_trip(spark):
    rng = random.Random(5)
    pages = [(i, f"http://x/{i}", "<p>" + "word " * rng.randrange(300) + str(i) + "é") for i in range(300)]
    pages += [(1000 + i, None, "<p>hot</p>") for i in range(150)] + [(2000, "u", None), (2001, "u", ""), (None, "n", "<p>hot</p>"), (None, "n", "lonely"), (3, "http://x/3", pages[3][2]), (4000, "big\r\nX: y", "z" * 3_000_000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string").repartition(4)
    archives = warc.write_archives(df)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(pages)
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(top.get(h or "", -1), i)
    by = {}
    for i, _, h in pages:
        by.setdefault(i, []).append(h or "")
    seen = collections.Counter()
    for r in got:
        match = [h for h in by[r.page_id] if warc.sha1_base32(h.encode()) == r.payload_digest]
        assert match and r.payload_bytes == len(match[0].encode())
        first = top.get(match[0])
        assert r.refers_to == (None if first in (None, r.page_id) else first)
        assert (r.record_type == "response") == (r.refers_to is None)
        assert bytes(r.payload) == match[0].encode() if r.record_type == "response" else r.payload is None
        seen[r.page_id] += 1
    assert seen == collections.Counter(p[0] for p in pages)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_archives_begin_with_a_dictionary_and_hold_a_frame_a_record(spark, tmp_path):
    import struct

    df = spark.createDataFrame([(i, "u", f"<html>{'body ' * 50}{i}</html>") for i in range(500)], "page_id long, url string, html string").coalesce(1)
    paths = [r.path for r in warc.write_archives(df, folder=f"file://{tmp_path}/w").collect()]
    for path in paths:
        with open(path.removeprefix("file://"), "rb") as f:
            data = f.read()
        magic, n = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and data[8:12] == struct.pack("<I", 0xEC30A437)
        assert data[8 + n :].count(struct.pack("<I", 0xFD2FB528)) >= 100
        with pytest.raises(Exception):  # noqa: B017
            broken = data[:-9] + b"\0" * 9
            list(warc.read_archive(io.BytesIO(broken)))
        records = list(warc.read_archive(io.BytesIO(data)))
        assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        named = [x for r in records for x in r.split(b"\r\n\r\n")[0].split(b"\r\n") if x.startswith(b"WARC-Record-ID: ")]
        assert len(named) == len(set(named)) == len(records)
        with pytest.raises(ValueError, match="block"):
            warc.decode(records[1].replace(b"body", b"Body", 1))


def test_revisits_name_their_response():
    response = warc.Record("response", "http://a", 5, warc.sha1_base32(b"x"), None, 1, b"x")
    revisit = warc.Record("revisit", "http://b\r\nX: y", 3, warc.sha1_base32(b"x"), 5, 1, None, "http://a")
    there, here = (warc.encode(r).decode().split("\r\n") for r in (response, revisit))
    own = next(x.split(": ", 1)[1] for x in there if x.startswith("WARC-Record-ID: "))
    assert {f"WARC-Refers-To: {own}", "WARC-Refers-To-Target-URI: http://a", "WARC-Target-URI: http://bX: y"} <= set(here)
    assert warc.decode(warc.encode(response)) == response and warc.decode(warc.encode(revisit)).refers_to_uri == "http://a"


def brute_nearest(ids, vectors, q, k=5):
    v = np.array(vectors, float)
    s = v @ v[q] / np.sqrt((v * v).sum(1) * (v[q] @ v[q]))
    ok = [i for i in range(len(ids)) if ids[i] != ids[q]]
    return sorted(ok, key=lambda i: (-s[i], ids[i]))[:k], s


def test_forest_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(1500)]
    rows += [(5000 + i, rows[3][1]) for i in range(400)]  # one very common vector
    odd = [(None, rows[0][1]), (9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0, None] * 8), (9005, [float("inf")] + [1.0] * 15), (50, rows[50][1]), (9050, [1.0, 2.0]), (9051, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for r in ann.search(df, block_rows=600, query_rows=20).collect():
        got[r.query_id].append(r)
    ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).astype(float)
    hit = total = 0
    for q in range(0, len(rows)):
        if ids[q] % 50 == 0:
            top, s = brute_nearest(ids, vectors, q)
            found = sorted(got[ids[q]], key=lambda r: r.rank)
            assert [r.rank for r in found] == [1, 2, 3, 4, 5]
            assert all(abs(r.score - s[ids.index(r.vec_id)]) < 1e-12 for r in found)
            assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
            hit += sum(any(abs(s[t] - r.score) < 1e-12 for r in found) for t in top)
            total += 5
    assert hit / total >= 0.9
    assert [r.vec_id for r in got[9050]] == [9051]  # its only comparable row
    assert not {9001, 9002, 9003, 9004, 9005} & {r.vec_id for rs in got.values() for r in rs}
    assert ann.search(df.limit(0)).count() == 0


def brute_top(rows, k=5, every=50):
    """{query: [(vec_id, score)]} in exact cosines of clean rows; a repeated query id is its least vector."""
    clean = [(i, np.array(v, float)) for i, v in rows]
    clean = [(i, np.ldexp(v, -np.frexp(np.abs(v).max())[1])) for i, v in clean]
    out = {}
    for q in {i for i, _ in clean if i % every == 0}:
        v = min((v.tolist() for i, v in rows if i == q))
        v = np.ldexp(np.array(v), -np.frexp(np.abs(v).max())[1])
        scores = [(-float((u * v).sum() / (np.sqrt((u * u).sum()) * np.sqrt((v * v).sum()))), i) for i, u in clean if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found_top(df, **parameters):
    got = collections.defaultdict(list)
    for r in sorted(ann.search(df, **parameters).collect(), key=lambda r: r.rank):
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return dict(got)


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def test_small_tables_return_every_neighbour(spark):
    """Blocks of up to least_visits vectors are compared in full: exact results, fewer than k only where there are no more."""
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 4, 5, 6, 7, 10, 30, 60, 64, 65, 100):
        rows = [(i, rng.standard_normal(16)) for i in range(n)]
        want = {q: top for q, top in brute_top(rows).items() if top}
        assert found_top(vector_frame(spark, rows)) == want, n
    assert found_top(vector_frame(spark, rows), block_rows=7) == brute_top(rows)


def test_magnitudes_ties_and_repeats_of_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 8))
    rows = [(i, base[i % 40] * 10.0 ** (0, 200, -200, -300, 100)[i % 5]) for i in range(120)]
    rows += [(50, base[3]), (50, base[3]), (50, -base[4]), (7, base[7]), (7, base[7])] + [(700 + i, base[10]) for i in range(30)]
    assert found_top(vector_frame(spark, rows)) == brute_top(rows)


def test_recall_on_clusters_and_copies(spark):
    """Blocks larger than least_visits: random directions, clusters, and one vector in a third of all rows."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 24))
    rows = [(i, centres[i % 20] + 0.3 * rng.standard_normal(24)) for i in range(1000)]
    rows += [(1000 + i, rng.standard_normal(24)) for i in range(1000)]
    hot = rng.standard_normal(24)
    rows += [(2000 + i, hot) for i in range(1000)]
    found, want = found_top(vector_frame(spark, rows), least_visits=50, block_rows=1500), brute_top(rows)
    assert found.keys() == want.keys() and all(len(x) == 5 for x in found.values())
    for low, high in ((0, 1000), (1000, 2000), (2000, 3000)):
        asked = [q for q in want if low <= q < high]
        assert sum(len(set(found[q]) & set(want[q])) for q in asked) >= 0.9 * 5 * len(asked), (low, high)


def test_mixing_meets_its_limit_and_loses_nothing(spark):
    rows = many(300)
    got = mixing.mix(docs(spark, rows), repeat_limit=2.0).collect()
    tokens, emitted, epochs = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, s in rows:
        tokens[s] += max(1, len(brute.words(t)))
    slots = collections.defaultdict(list)
    for r in got:
        emitted[r.source] += r.n_tokens
        epochs[(r.doc_id, r.text, r.epoch)] += 1
        slots[r.source, r.epoch].append(r.block_slot)
    assert collections.Counter((i, t) for i, t, e in epochs.elements() if e == 0) == collections.Counter((i, t) for i, t, _ in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len(brute.words(t)) for _, t, _ in rows)
    shares = {s: r.source_weight for r in got for s in [r.source]}
    budget = max(tokens[s] / shares[s] for s in tokens)
    for s in tokens:
        assert emitted[s] <= 2 * tokens[s] + largest
        assert abs(emitted[s] - budget * shares[s]) <= largest + 1
    assert mixing.mix(docs(spark, [])).count() == 0


def spark_hash(*values):
    """xxhash64() of Spark: each value's hash is the next one's seed, nulls change nothing."""
    h = 42
    for v, size in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(size, "little", signed=True), seed=h)
    return h


CLASHES = ("before", "cuts", "lead", "__piece", "piece_no", "sort_key", "size", "shard", "slot", "source_weight", "__rest", "__whole", "mix_cell", "n_tokens", "epoch", "block_slot", "cell", "__cut", "piece_base")


def clashing(spark, rows):
    """A table with every helper's and result's name among its columns."""
    df = docs(spark, rows).select("doc_id", "text", "source")
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def test_shards_match_brute_force(spark):
    """Keys sorted, slots in the order of (key, id, checksum), and every boundary as near to its even place as a key allows."""
    rows = many(250, seed=3)
    got = sharding.shard(clashing(spark, rows), shards=8, pieces=4, tolerance=0.001).collect()
    for c in set(CLASHES) - {"size", "shard", "slot"}:
        assert all(r[c] == f"own {c}" for r in got)

    def place(i, t):
        key = spark_hash((t or "", 0)) >> 25 << 24 | spark_hash((i, 8)) >> 40
        return key, -1 if i is None else i, zlib.crc32((t or "").encode())

    order = sorted(rows, key=lambda r: place(r[0], r[1]))
    found = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id, r.text or "") for r in found] == [(i, t or "") for i, t, _ in order]
    sizes = [len((t or "").encode()) + 1 for _, t, _ in order]
    total, below, edges = sum(sizes), 0, {0: 0}
    for k, (row, n) in enumerate(zip(order, sizes)):
        if k and place(row[0], row[1])[0] != place(order[k - 1][0], order[k - 1][1])[0]:
            edges[k] = below
        below += n
    edges[len(order)] = total
    for s in range(1, 8):
        at = sum(r.shard < s for r in found)
        off, best = abs(edges[at] - total * s / 8), min(abs(n - total * s / 8) for n in edges.values())
        assert off <= max(best, 0.001 * total / 8)


def test_mixing_matches_brute_force(spark, monkeypatch):
    """Every row of every epoch: whole passes, then the rows in the order of their hashes until the budget is used up."""
    monkeypatch.setattr(mixing, "CELL_TOKENS", 50)
    rows = many(200, seed=5)
    got = mixing.mix(clashing(spark, rows), repeat_limit=1.7).collect()
    for c in set(CLASHES) - {"n_tokens", "epoch", "block_slot", "source_weight"}:
        assert all(r[c] == f"own {c}" for r in got)
    sources = collections.defaultdict(list)
    for i, t, s in rows:
        sources[s].append((i, t, max(1, len(brute.words(t)))))
    names = sorted(sources, key=lambda s: (s is not None, s or ""))
    tokens = [sum(n for _, _, n in sources[s]) for s in names]
    low, high = 0.0, 1.0  # the least exponent at which no source is emitted more than 1.7 times
    for _ in range(60):
        a = (low + high) / 2
        per = [n ** (a - 1) for n in tokens]
        low, high = (a, high) if max(per) / min(per) > 1.7 else (low, a)
    per = [n ** (high - 1) for n in tokens]
    expected = collections.Counter()
    for s, n, p in zip(names, tokens, per):
        passes = p / min(per)
        for epoch in range(math.ceil(passes - 1e-9)):
            rest = n if epoch < math.floor(passes + 1e-9) else round((passes - math.floor(passes + 1e-9)) * n)
            order = sorted(sources[s], key=lambda r: (spark_hash((r[0], 8), (r[1], 0), (epoch, 4), (7, 4)), -1 if r[0] is None else r[0], r[2]))
            used, slot = 0, 0
            for i, t, m in order:
                if used >= rest:
                    break
                expected[i, t, s, m, epoch, slot] += 1
                used, slot = used + m, slot + 1
    assert collections.Counter((r.doc_id, r.text, r.source, r.n_tokens, r.epoch, r.block_slot) for r in got) == expected
    weights = {r.source: r.source_weight for r in got}
    assert all(abs(weights[s] - n**high / sum(x**high for x in tokens)) < 1e-9 for s, n in zip(names, tokens))


def test_mixing_without_broadcast_or_slots(spark, monkeypatch):
    rows = many(120, seed=6)
    want = collections.Counter((r.doc_id, r.text, r.epoch) for r in mixing.mix(docs(spark, rows)).collect())
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert collections.Counter((r.doc_id, r.text, r.epoch) for r in mixing.mix(docs(spark, rows), slots=False).collect()) == want
    assert mixing.mix(docs(spark, []), slots=False).columns == ["doc_id", "text", "source", "shard", "rank", "n_tokens", "epoch", "source_weight"]


def test_exponent_is_bisected_to_the_target():
    tokens = [10_000, 1000, 100, 10]
    a = mixing.solve_exponent(tokens, repeat_limit=4)
    assert abs(max(mixing.passes(tokens, mixing.weights(tokens, a), None)) - 4) < 1e-6
    a = mixing.solve_exponent(tokens, target_entropy=1.2)
    assert abs(mixing.entropy(mixing.weights(tokens, a)) - 1.2) < 1e-9
    assert mixing.solve_exponent([5, 5], repeat_limit=1.0) == 0.0 and mixing.solve_exponent([5]) == 1.0


def test_license_variants(spark):
    mit = KNOWN["MIT"]
    rows = [
        (1, mit, "x"),
        (2, mit.upper().replace("COPYRIGHT (C) [YEAR] [FULLNAME]", "Copyright 2020, Some One. All rights reserved."), "x"),
        (3, "\r\n".join(mit.replace('"', "''").split("\n")), "x"),
        (4, mit.replace("sublicense", "sublicence").replace("copyright notice", "copyright   notice"), "x"),
        (5, mit + " and more", "x"),
        (6, None, "x"),
        (7, "", "x"),
        (8, KNOWN["Zlib"], None),
        (8, KNOWN["Zlib"], None),
    ]
    got = collections.defaultdict(list)
    for r in licenses.scan(docs(spark, rows)).collect():
        got[r.doc_id].append(r.license_id)
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["MIT"], 4: ["MIT"], 5: [None], 6: [None], 7: [None], 8: ["Zlib"] * 2}
    names = {i: name for i, (name, _) in enumerate(known_texts())}
    found = licenses.scan(docs(spark, [(i, text, "x") for i, (_, text) in enumerate(known_texts())])).collect()
    assert {r.doc_id: r.license_id for r in found} == names and set(names.values()) == set(KNOWN)
    assert licenses.scan(docs(spark, [])).count() == 0


def test_wrapped_titled_and_long_licences(spark):
    def wrapped(text, width):
        return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))

    bodies = {k: KNOWN[k].split("\n\n", 2)[2] for k in ("MIT", "ISC", "BSD-3-Clause")}
    rows = [(100 * i + w, "(C) 1999 A\n© B\nCopyright 2001-2003 C\nCopyright by D, 2004\n\n" + wrapped(bodies[k], w), k) for i, k in enumerate(bodies) for w in range(20, 90)]
    rows += [(9000, "The MIT License (MIT)\n\n" + bodies["MIT"], "MIT"), (9001, bodies["MIT"].replace("copyright notice", "copyrights notice"), None)]
    rows += [(9002, KNOWN["Apache-2.0"].split("END OF TERMS")[0], "Apache-2.0"), (9003, KNOWN["GPL-2.0"].replace("\n", "\r\n"), "GPL-2.0"), (9004, KNOWN["MIT"] * 500, None)]
    clash = docs(spark, rows).withColumns({c: F.lit("own") for c in ("canonical_form", "known_sha256", "license_id")})
    got = licenses.scan(clash).collect()
    assert {r.doc_id: r.license_id for r in got} == {i: k for i, _, k in rows}
    assert all((r.canonical_form, r.known_sha256) == ("own", "own") for r in got)


def test_gapless_rank_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(500)] + [(1, "hot")] * 5
    df = spark.createDataFrame(rows, "id long, g string")
    got = collections.defaultdict(list)
    for r in gapless_rank(df, ["g"], [df["id"]], "rank", cells=8).collect():
        got[r.g].append(r["rank"])
    assert {g: sorted(x) for g, x in got.items()} == {g: list(range(len(x))) for g, x in got.items()} and len(got) == 2


def test_rows_that_repeat_are_spread_over_shards(spark):
    for rows in ([(7, "equal text", "a")] * 2000, [(None, None, None)] * 2000, [(7, "equal text " * 9, "a")] * 700 + [(i, f"text {i} " * (i % 7), "b") for i in range(1500)]):
        got = sharding.shard(docs(spark, rows), shards=16).collect()
        assert len(got) == len(rows)
        slots, sizes = collections.defaultdict(list), collections.Counter()
        for r in got:
            slots[r.shard].append(r.slot)
            sizes[r.shard] += r.size
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        even = sum(sizes.values()) / 16
        assert all(abs(sizes[s] - even) <= max(0.05 * even, 2 * max(r.size for r in got)) for s in range(16))


def test_a_repetition_limit_holds_for_rows_that_repeat(spark):
    rows = [(i, f"word {i} " * 20, "large") for i in range(400)] + [(5, "one two three", "small")] * 100
    got = mixing.mix(docs(spark, rows), repeat_limit=1.5).collect()
    times = collections.Counter(r.source for r in got)
    assert times["large"] >= 400 and 100 < times["small"] <= 151
    slots = [(r.epoch, r.block_slot) for r in got if r.source == "small"]
    assert sorted(slots) == [(0, k) for k in range(100)] + [(1, k) for k in range(len(slots) - 100)]
