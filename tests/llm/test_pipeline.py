import collections

import brute
import pytest

import corpus_pipeline
from tracelake.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
    return kept


def test_each_stage_decides_on_its_whole_input(spark, stages):
    documents, good, single, cut, mixed, packed = stages
    verdicts = dict(quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "kept").collect())
    assert {r.doc_id for r in good} == {r.doc_id for r in documents if verdicts[r.doc_id]}
    rows = [(r.doc_id, r.text) for r in good]
    assert {r.doc_id for r in single} == {i for (i, _), (_, c) in zip(rows, brute.near(rows)) if i == c}
    rows = [(r.doc_id, r.text) for r in single]
    left = {i: (t if not n else kept) for (i, t), (total, n, kept) in zip(rows, brute.substring(rows)) if n < total}
    assert {r.doc_id: r.text for r in cut} == left and all(r.n_chars == len(r.text) for r in cut)
    assert {r.doc_id for r in mixed} == set(left)
    assert all(r.text == left[r.doc_id] for r in mixed)
    sizes = collections.Counter()
    for r in packed:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 1024
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(r.doc_id for r in mixed)


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in stages[-1])
