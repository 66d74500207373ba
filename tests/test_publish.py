import os

import pytest
from pyspark.sql import functions as F

from tracelake.sources import publish


def test_a_publication_is_whole_or_not_there(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(0, 1000, 1, 5).select("id", F.col("id").cast("string").alias("text"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"))

    @F.udf("long")
    def dies(i):
        if i == 700:
            raise RuntimeError("a task is killed")
        return i

    with pytest.raises(Exception, match="a task is killed"):
        publish.publish(df.withColumn("id", dies("id")), path, file_rows=100)
    assert not os.path.exists(f"{path}/manifest.json")
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, path)
    os.makedirs(f"{path}/data", exist_ok=True)
    spark.range(3).select("id", F.lit("x").alias("text"), F.col("id").alias("half")).toPandas().to_parquet(f"{path}/data/part-00000-0000-left.parquet")  # as a killed task leaves it
    manifest = publish.publish(df, path, file_rows=100)
    assert manifest["rows"] == 1000 and len(manifest["files"]) == 10
    assert sorted(map(tuple, publish.read_published(spark, path).collect())) == sorted(map(tuple, df.collect()))
    assert publish.verify_published(path) == []
    before = publish.manifest_of(path)
    with pytest.raises(Exception, match="published already"):
        publish.publish(df.limit(5), path)
    assert publish.manifest_of(path) == before and publish.read_published(spark, path).count() == 1000
    with pytest.raises(Exception, match="not replaced"):
        df.write.format(publish.FORMAT).mode("overwrite").save(path)
    first, second = (f"{path}/{f['file']}" for f in manifest["files"][:2])
    os.unlink(first)
    with open(second, "ab") as f:
        f.write(b"x")
    assert sorted(p.split()[0] for p in publish.verify_published(path)) == ["changed", "missing"]


def test_an_empty_publication(spark, tmp_path):
    manifest = publish.publish(spark.range(0).select("id"), f"{tmp_path}/out")
    assert manifest["files"] == [] and publish.read_published(spark, f"{tmp_path}/out").columns == ["id"]
