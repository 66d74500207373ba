import pytest
from pyspark.sql import functions as F

from tracelake.operators import merkle


def table(spark, n=3000):
    rows = [(i, f"t{i % 700}" if i % 11 else None, float(i % 13)) for i in range(n)] + [(5, "twice", 1.0)] * 3
    return spark.createDataFrame(rows, "id long, text string, x double").repartition(5)


def test_a_change_is_found_from_the_roots(spark):
    df = table(spark)
    a = merkle.build(df, ["id"])
    assert a.depth > 1 and merkle.build(df.repartition(2), ["id"]).root() == a.root()
    other = df.withColumn("text", F.when(F.col("id") == 1234, "").otherwise(F.col("text"))).filter("id != 77")
    other = other.unionByName(df.filter("text = 'twice'").limit(1))
    b = merkle.build(other, ["id"], depth=a.depth)
    assert a.root() != b.root()
    got = sorted((r.side, r.key_id, r.times) for r in merkle.changed(a, b).collect())
    assert got == [("new", 5, 4), ("new", 1234, 1), ("old", 5, 3), ("old", 77, 1), ("old", 1234, 1)]
    assert merkle.changed(a, a).count() == 0
    with pytest.raises(ValueError):
        merkle.changed(a, merkle.build(df, ["id"], depth=a.depth + 1))


def test_proofs_of_single_rows(spark):
    df = table(spark)
    tree = merkle.build(df, ["id"])
    hashes = [r.hash for r in df.filter("id in (1, 11, 5)").select(merkle.row_hash(df.columns).alias("hash")).distinct().collect()]
    for h in hashes:
        proof = tree.proof(h)
        assert merkle.proves(h, proof, tree.root())
        assert not merkle.proves(h, proof, "0" * 64) and not merkle.proves(h[:-1] + ("0" if h[-1] != "0" else "1"), proof, tree.root())
        forged = [list(s) for s in proof]
        forged[0][0] = "f" * 64 + ":1"
        assert not merkle.proves("f" * 64, forged, tree.root())
    assert tree.proof("ab" * 32) is None
    empty = merkle.build(df.limit(0), ["id"])
    assert empty.root() != tree.root() and empty.proof(hashes[0]) is None
