"""Edge rows for the stages of the pipeline, other columns with clashing names, and texts beyond ASCII."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import licenses, minhash, packing, quality, queries, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, vertex string, kept boolean, piece string"
PROSE = " ".join(f"the word{i % 97} of that line{i % 89} and to be with have {i}" for i in range(40))


def edge_rows():
    texts = [(1, PROSE), (2, PROSE + " end"), (3, PROSE), (3, PROSE), (4, None), (5, ""), (6, " \n\t "), (None, PROSE + " more and more"), (None, None), (7, "long " * 200_000), (8, "a" + " " * 1_000_000 + "b"), (9, "naïve ß 東京 \U0001f600")]
    return [(i, t, "en", s, -1, "v", True, "p") for (i, t), s in zip(texts, ["hot", "hot", "hot", "hot", None, "a", "a", "b", None, "hot", "b", "a"])]


@pytest.mark.parametrize("stage", range(5))
def test_every_stage_takes_edge_rows(spark, stage):
    docs = spark.createDataFrame(edge_rows(), DOCS).repartition(3)
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, docs, "").collect()
    assert run(spark, docs.limit(0), "").collect() == []
    if stage < 4:
        assert list(got[0].asDict()) == list(corpus_pipeline.COLUMNS)
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    if stage == 0:
        verdicts = quality.judge(docs).select("doc_id", "kept").collect()
        assert ids == sorted((r.doc_id is not None, r.doc_id or 0) for r in verdicts if r.kept)
    if stage == 1:  # 1, 2 and 3 are alike; rows without an id stay
        assert [i for _, i in ids] == [0, 0, 1, 4, 5, 6, 7, 8, 9]
    if stage == 2:
        rows = [(r[0], r[1]) for r in edge_rows()]
        left = sorted((i or 0, (t or "") if not n else kept) for (i, t), (total, n, kept) in zip(rows, brute.substring(rows)) if n < total or not total)
        assert sorted((r.doc_id or 0, r.text or "") for r in got) == left
    if stage == 3:
        assert {r.doc_id for r in got} == {r[0] for r in edge_rows()}
    if stage == 4:
        assert {r.doc_id for r in got} == {r[0] for r in edge_rows()} and all(r.length <= 1024 for r in got)


def test_other_columns_may_have_any_name(spark):
    plain = [(i, f"some text {i} " * (i % 5 + 1) + "and a passage of more than fifty bytes that is in all of them") for i in range(30)]
    bare = spark.createDataFrame(plain, "doc_id long, text string")
    names = ("kept", "n_words", "n_bytes", "piece", "start", "length", "sequence_id", "rank", "cell", "n", "d1", "d2", "id", "vertex", "tokens", "component", "anchor", "part", "owner", "key", "content")
    full = bare.select("*", *[F.lit("x").alias(c) for c in names])
    for run, columns in (
        (lambda d: quality.judge(d), ["doc_id", "n_words", "kept"]),
        (lambda d: suffix.remove_shared(d), ["doc_id", "n_bytes", "n_removed", "kept"]),
        (lambda d: packing.pack(d), ["doc_id", "piece", "start", "length", "ids_crc32"]),
        (lambda d: minhash.near_duplicates(d), ["doc_id", "component_id", "kept"]),
    ):
        one, two = (sorted(map(str, run(d).select(*columns).collect())) for d in (bare, full))
        assert one == two and one


def test_licence_sql_beyond_ascii(spark):
    import duckdb

    texts = ["favouré licence LICENCE licence", "colour licence ünd behaviour", "sub-licence the the", "ß ſ İ K licence", None, ""]
    sql = queries.oracle_sql()["op9_license_scan"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    told = {r[0]: r for r in con.execute(f"SELECT doc_id, canonical_chars, canonical_sha256, license_id FROM ({sql}) WHERE doc_id >= 0").fetchall()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in licenses.scan(docs).select("doc_id", "canonical_chars", "canonical_sha256", "license_id").collect()}
    for i in (0, 1, 2, 4, 5):
        assert got[i] == told[i]
