import random

from pyspark.sql import functions as F

from tracelake.sources import textindex


def test_pruned_searches_lose_no_hit(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(4000)]
    rows = [(i, i // 50, " ".join(rng.choices(words[(i // 50) * 100 : (i // 50) * 100 + 200], k=12))) for i in range(1500)]
    rows[777] = (777, 15, "here lies the Planted-Täglich 東京 needle")
    rows[5] = (5, 0, None)
    path, index = f"{tmp_path}/table", f"{tmp_path}/index"
    spark.createDataFrame(rows, "id long, part long, text string").repartitionByRange(30, "id").write.partitionBy("part").parquet(path)
    textindex.build(spark, path, "text", index)
    textindex.build(spark, path, "text", index)  # nothing new
    table = spark.read.parquet(path)
    n = table.select(F.col("_metadata.file_path")).distinct().count()
    assert len(textindex.indexed_files(spark, index)) == n and textindex._index(spark, index).filter("bucket = -1").count() == n
    pruned = 0
    for term in ("planted-täglich", "東京", "needle", words[333], words[1500][:4], words[10] + " ", "ab", "", "not in any of them"):
        got = sorted(r.id for r in textindex.search(spark, path, "text", index, term).collect())
        assert got == sorted(i for i, _, t in rows if t is not None and term.lower() in t.lower())
        pruned += textindex.candidates(spark, index, term).count() < n / 4
    assert pruned >= 6
    spark.createDataFrame([(9000, 99, "a new NEEDLE")], "id long, part long, text string").write.mode("append").partitionBy("part").parquet(path)
    assert sorted(r.id for r in textindex.search(spark, path, "text", index, "needle").collect()) == [777, 9000]  # not indexed yet


def test_filters_are_the_bitmaps_of_all_groups_and_no_task_sorts_them(spark, tmp_path):
    rng = random.Random(5)
    letters = [chr(c) for c in range(97, 123)] + ["É", "東", "😀", "\n"]
    rows = [(i, "".join(rng.choices(letters, k=rng.choice([0, 2, 3, 40, 30_000])))) for i in range(40)] + [(40, None)]
    path = f"{tmp_path}/table"
    spark.createDataFrame(rows, "id long, text string").repartitionByRange(5, "id").write.parquet(path)
    table = spark.read.parquet(path)
    found = textindex.filters(table, "text")
    bits = table.select(F.col("_metadata.file_path").alias("file"), F.explode(textindex.groups(F.col("text"))).alias("g")).select("file", textindex._bit(F.col("g")).alias("b"))
    wanted = bits.groupBy("file", F.expr("bitmap_bucket_number(b + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b + 1))").alias("bitmap"))
    got = {(r.file, r.bucket): bytes(r.bitmap) for r in found.collect()}
    assert len(got) > 30 and got == {(r.file, r.bucket): bytes(r.bitmap) for r in wanted.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan
