"""A Merkle tree over a table: one hash for all rows, proofs for single rows, and changed rows found by descent.

A row's hash puts it into a leaf by its first digits, so a change of a row touches one leaf and the nodes above it, wherever it stands
in the table. A leaf's hash is that of its sorted row hashes, with how often each occurs; a node's is that of its sixteen children in
order. The levels are built upwards, one aggregation of a sixteenth of the rows each. A row that repeats is one hash with a count, and
different hashes spread evenly, so no group grows with the data: the depth does.

Two trees of equal depth are compared from their roots: only children of nodes that differ are looked at, and at the end only the
rows of leaves that differ.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, written

DIGITS = "0123456789abcdef"
#: Different rows of a leaf, about.
LEAF_ROWS = 64
NOTHING = ""


def row_hash(columns: list[str]):
    """SHA-256 of a row; null, empty text and missing parts of a struct are told apart."""
    return F.sha2(F.to_json(F.struct(*[F.struct(F.col(c).isNull().alias("null"), F.col(c).alias("value")).alias(c) for c in columns])), 256)


@dataclass
class Tree:
    """nodes: level, prefix, digest (level 0 is the root); rows: prefix, hash, times and the key columns of one such row."""

    spark: SparkSession
    path: str
    depth: int

    def nodes(self, level: int) -> DataFrame:
        return self.spark.read.schema("prefix string, digest string").parquet(f"{self.path}/level={level}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def root(self) -> str:
        first = self.nodes(0).first()
        return first.digest if first else hashlib.sha256(NOTHING.encode()).hexdigest()

    def proof(self, hash_: str) -> list[list[str]] | None:
        """What shows that a row is in the tree: the entries of its leaf, then the children of each node above it; None if it isn't."""
        leaf = hash_[: self.depth]
        entries = sorted(f"{r.hash}:{r.times}" for r in self.rows().filter(F.col("prefix") == leaf).select("hash", "times").collect())
        if not any(e.startswith(hash_) for e in entries):
            return None
        steps = [entries]
        for level in range(self.depth, 0, -1):
            children = {r.prefix: r.digest for r in self.nodes(level).filter(F.col("prefix").startswith(leaf[: level - 1])).collect()}
            steps.append([children.get(leaf[: level - 1] + d, NOTHING) for d in DIGITS])
        return steps


def proves(hash_: str, proof: list[list[str]], root: str) -> bool:
    """Whether the proof leads from the row's hash to the root. Needs neither the table nor the tree."""
    if not proof or not any(e.split(":")[0] == hash_ for e in proof[0]):
        return False
    now = hashlib.sha256(",".join(proof[0]).encode()).hexdigest()
    for level, children in zip(range(len(proof) - 1, 0, -1), proof[1:]):
        if len(children) != len(DIGITS) or children[DIGITS.index(hash_[level - 1])] != now:
            return False
        now = hashlib.sha256(",".join(children).encode()).hexdigest()
    return now == root


def depth_for(rows: int) -> int:
    return max(1, math.ceil(math.log(max(1, rows / LEAF_ROWS), len(DIGITS))))


def build(df: DataFrame, keys: list[str], columns: list[str] | None = None, depth: int | None = None, path: str | None = None) -> Tree:
    """The tree of df's rows over ``columns`` (all of them), written to ``path``. ``keys`` are kept with each row, to name it.

    Trees to be compared need equal columns and depth.
    """
    spark, columns = df.sparkSession, columns or df.columns
    depth = depth if depth is not None else depth_for(df.count())
    path = path or new_path(spark, "merkle")
    hashed = df.withColumn("hash", row_hash(columns)).groupBy("hash").agg(F.count("*").alias("times"), *[F.first(k).alias(f"key_{k}") for k in keys])
    # In the order of the hashes, so a leaf's rows lie together and are found by the files' statistics.
    hashed.withColumn("prefix", F.substring("hash", 1, depth)).repartitionByRange("prefix", "hash").sortWithinPartitions("prefix", "hash").write.parquet(f"{path}/rows")
    tree = Tree(spark, path, depth)
    entry = F.concat_ws(":", "hash", "times")
    leaves = tree.rows().groupBy("prefix").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ","), 256).alias("digest"))
    leaves.write.parquet(f"{path}/level={depth}")
    for level in range(depth - 1, -1, -1):
        children = F.map_from_entries(F.collect_list(F.struct(F.substring("prefix", level + 1, 1), "digest")))
        below = tree.nodes(level + 1).groupBy(F.substring("prefix", 1, level).alias("prefix")).agg(children.alias("of"))
        digests = F.transform(F.array(*[F.lit(d) for d in DIGITS]), lambda d: F.coalesce(F.try_element_at("of", d), F.lit(NOTHING)))
        below.select("prefix", F.sha2(F.array_join(digests, ","), 256).alias("digest")).write.parquet(f"{path}/level={level}")
    return tree


def changed(old: Tree, new: Tree) -> DataFrame:
    """(side, hash, times, keys) of the rows that only one tree has, or that it has more or less often: ``old`` or ``new`` for each side's own."""
    if old.depth != new.depth:
        raise ValueError("trees of different depth are not compared")
    odd = None
    for level in range(old.depth + 1):
        a, b = old.nodes(level), new.nodes(level).withColumnRenamed("digest", "other")
        if odd is not None:  # only below nodes that differ
            a, b = (x.join(odd, F.substring("prefix", 1, level - 1) == odd["above"], "left_semi") for x in (a, b))
        odd = written(a.join(b, "prefix", "full").filter("not (digest <=> other)").select(F.col("prefix").alias("above")), "differences")
        if odd.isEmpty():
            break
    leaves = odd.withColumnRenamed("above", "prefix")
    there = lambda t, side: t.rows().join(leaves, "prefix", "left_semi").withColumn("side", F.lit(side))
    a, b = there(old, "old"), there(new, "new")
    only = lambda x, y: x.join(y.select("hash", "times"), ["hash", "times"], "left_anti")
    return only(a, b).unionByName(only(b, a)).drop("prefix")
