"""A text index for data skipping: Bloom filters of three-letter groups, one for each file of a stored table.

A term can only be in a file that has all groups of three letters of the term. The groups of a file's texts are hashed into a bitmap
of ``BITS`` bits, so an index has some kilobytes a file whatever the file's texts are. A search reads the index first, then only the
files that may hold the term, and those that the index doesn't know yet, and tests every row of them: no hit is lost, a filter
that is too full only prunes less. Texts are compared in lower case. Terms of fewer than three letters prune nothing.

Null texts have no groups. All of it is Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap bucket (fixed by Spark's bitmap functions), and buckets of a filter.
BUCKET_BITS, BUCKETS = 32_768, 8
#: Words of a bucket.
WORDS = BUCKET_BITS // 64
BITS = BUCKET_BITS * BUCKETS
#: Files up to which a search names them to the reader.
MOST_FILES = 100_000
SCHEMA = "file string, bucket long, bitmap binary"


def groups(text: Column) -> Column:
    """All groups of three letters that follow each other, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1))


def _bit(group: Column) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(BITS))


def filters(table: DataFrame, text: str) -> DataFrame:
    """(file, bucket, bitmap) of the files of a table read from Parquet. Bits are set in words of 64, so a task holds 4096 numbers a file at most,
    whatever the texts are, and never sorts their groups (Spark's own bitmap aggregate sorts its input).
    """
    bits = table.select(F.col("_metadata.file_path").alias("file"), F.explode(F.array_distinct(groups(F.col(text)))).alias("g")).select("file", _bit(F.col("g")).alias("b"))
    # Bit 0 of byte 0 is the lowest one of the highest byte, so that a word's hexadecimal digits are its bytes in order.
    word = F.expr("bit_or(shiftleft(1L, cast(56 - (b & 56) + (b & 7) as int)))").alias("word")
    words = bits.groupBy("file", F.expr("b div 64").alias("at")).agg(word)
    buckets = words.groupBy("file", F.expr(f"at div {WORDS} + 1").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct((F.col("at") % WORDS).cast("int").alias("at"), "word"))).alias("w"))
    before = F.expr("transform(w, (x, i) -> x.at - if(i = 0, 0, w[i - 1].at + 1))")  # words without a bit before each one
    digits = F.zip_with("w", before, lambda x, n: F.concat(F.repeat(F.lit("0" * 16), n), F.lpad(F.hex(x["word"]), 16, "0")))
    return buckets.select("file", "bucket", F.unhex(F.rpad(F.array_join(digits, ""), 16 * WORDS, "0")).alias("bitmap"))


def build(spark: SparkSession, path: str, text: str, index: str) -> None:
    """Writes the filters of the table's files that the index doesn't have yet."""
    known = indexed_files(spark, index)
    files = [f for f in spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f")).distinct().toPandas()["f"] if f not in known]
    if files:
        new = spark.read.option("basePath", path).parquet(*files)
        marks = spark.createDataFrame([(f, -1, None) for f in files], SCHEMA)  # files without any group are known as well
        filters(new, text).unionByName(marks).write.mode("append").parquet(index)


def _index(spark: SparkSession, index: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(index)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def indexed_files(spark: SparkSession, index: str) -> set[str]:
    return {r.file for r in _index(spark, index).filter("bucket = -1").select("file").collect()}  # a name for each file


def candidates(spark: SparkSession, index: str, term: str) -> DataFrame:
    """(file) of the files that may hold the term, by the index."""
    needed = spark.createDataFrame([(term,)], "t string").select(F.explode(F.array_distinct(groups(F.col("t")))).alias("g")).select(_bit(F.col("g")).alias("b")).distinct()
    needed = needed.select(F.expr("bitmap_bucket_number(b + 1)").alias("bucket"), F.expr("bitmap_bit_position(b + 1)").alias("at"))
    wanted = {b: sorted(at) for b, at in needed.groupBy("bucket").agg(F.collect_set("at")).collect()}  # no more than the term's letters
    rows = _index(spark, index)
    if not wanted:
        return rows.filter("bucket = -1").select("file")

    def has(at: int) -> Column:
        return F.conv(F.hex(F.substring("bitmap", at // 8 + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(1 << at % 8)) != 0

    held = F.lit(False)
    for b, at in wanted.items():
        all_ = F.lit(True)
        for a in at:
            all_ = all_ & has(a)
        held = held | ((F.col("bucket") == b) & all_)
    return rows.filter(held).groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("file")


def search(spark: SparkSession, path: str, text: str, index: str, term: str) -> DataFrame:
    """The table's rows whose text holds the term, in any case: of the files that may hold it and of those that are not indexed."""
    table = spark.read.parquet(path)
    hit = F.lower(text).contains(term.lower())
    maybe = {r.file for r in candidates(spark, index, term).limit(MOST_FILES + 1).collect()}
    if len(maybe) > MOST_FILES:
        return table.filter(hit)
    known = indexed_files(spark, index)
    there = set(table.select(F.col("_metadata.file_path").alias("f")).distinct().toPandas()["f"])
    files = sorted(f for f in there if f in maybe or f not in known)
    if not files:
        return table.filter(F.lit(False))
    return spark.read.schema(table.schema).option("basePath", path).parquet(*files).filter(hit)
