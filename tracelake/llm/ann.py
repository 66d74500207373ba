"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt into blocks. In a block every tree keeps a long random-hyperplane hash string of each different
vector in one sorted array. A query descends in all trees to its longest matching prefix, by binary search; the
matches of a prefix are a range of the array. Then all trees ascend together, one prefix bit at a time, until
the ranges hold enough different vectors other than the query's own row. These candidates are scored exactly and
the best of each block are merged. A block of vectors and a block of queries meet in one task, so memory is
bounded by the two block sizes; equal vectors of a block are one entry with their ids, so copies neither cost
work nor crowd others out.

Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without an id.
Vectors are compared with those of their own length. A query's own id is no candidate of it; other repeated
rows are candidates each; if a query's id is repeated, its least vector is the query. Ties go to the smaller
id. Before norms are taken, vectors are scaled by a power of two, which changes no cosine, so that components of
any magnitude neither overflow nor vanish. With fewer than k candidates all are returned; empty tables give no
rows. Other columns, whatever their names, are not returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

HASH_BITS = 32


def clean_vectors(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part; v has doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    some = F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad & some).withColumn("dim", F.size("v"))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their largest component is in [1/2, 1)."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


class Forest:
    """Sorted hash strings of the different vectors of one block."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int):
        dim = vectors.shape[1]
        self.size = len(vectors)
        self.planes = [np.random.default_rng([seed, dim, t]).standard_normal((dim, HASH_BITS)) for t in range(trees)]
        self.sorted, self.order = [], []
        for p in self.planes:
            h = self.strings(vectors, p)
            order = np.argsort(h, kind="stable")
            self.order.append(order)
            self.sorted.append(h[order])

    @staticmethod
    def strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
        bits = vectors @ planes > 0
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(HASH_BITS - 1, -1, -1, dtype=np.uint64))

    def candidates(self, queries: np.ndarray, own: list[list[int]], enough: int) -> list[np.ndarray]:
        """Vector numbers for each query: all that share, in some tree, the longest prefix length at which that makes ``enough`` of them.

        ``own`` are the vectors that are no candidates of each query. At length 0 the ranges hold all vectors.
        """
        hashes = [self.strings(queries, p) for p in self.planes]
        found: list = [None] * len(queries)
        open_ = np.arange(len(queries))
        for length in range(HASH_BITS, -1, -1):
            shift = np.uint64(HASH_BITS - length)
            low, high = [], []
            for h, s in zip(hashes, self.sorted):
                prefix = h[open_] >> shift
                low.append(np.searchsorted(s, prefix << shift, "left"))
                high.append(np.searchsorted(s, ((prefix + np.uint64(1)) << shift) - np.uint64(1), "right"))
            low, high = np.array(low), np.array(high)
            done = np.zeros(len(open_), bool)
            for i in np.flatnonzero(((high - low).sum(0) >= enough) | (length == 0)):
                there = np.zeros(self.size, bool)
                for o, a, b in zip(self.order, low[:, i], high[:, i]):
                    there[o[a:b]] = True
                there[own[open_[i]]] = False
                at = np.flatnonzero(there)
                if len(at) >= enough or length == 0:
                    found[open_[i]], done[i] = at, True
            open_ = open_[~done]
            if not len(open_):
                break
        return found


def search(df: DataFrame, queries: DataFrame | None = None, id_: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, trees: int = 64, visit_share: float = 0.4, least_visits: int = 512, block_rows: int = 16384, query_rows: int = 16384, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine that the forest finds.

    Queries are the rows whose id is divisible by ``every``, or those of ``queries``. The ascent ends with ``visit_share``
    of a block's different vectors, and not before ``least_visits`` (at least k), so smaller blocks are compared in full.
    """
    rows = written(clean_vectors(df, id_, vector).groupBy("vec_id", "v", "dim").agg(F.count("*").alias("times")), "vectors")
    asked = clean_vectors(queries, id_, vector) if queries is not None else rows.filter(F.col("vec_id") % every == 0)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    blocks = max(1, math.ceil(rows.count() / block_rows))
    groups = max(1, math.ceil(asked.count() / query_rows))

    def dealt(x: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        placed: Column = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
        return x.withColumn(own, placed).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left, right = dealt(rows, "block", blocks, "asked", groups), dealt(asked, "asked", groups, "block", blocks)

    def best(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(there):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        # Different vectors, and the ids of each in order, no more of each row than can be returned.
        here = here.sort_values("vec_id", kind="stable")
        vectors, which = np.unique(np.stack(here["v"].to_numpy()) + 0.0, axis=0, return_inverse=True)
        times = np.minimum(here["times"].to_numpy(), k)
        ids, which = np.repeat(here["vec_id"].to_numpy(), times), np.repeat(which.ravel(), times)
        order = np.argsort(which, kind="stable")
        ids, firsts = ids[order], np.searchsorted(which[order], np.arange(len(vectors) + 1))
        vectors = scaled(vectors)
        size = norms(vectors)
        forest = Forest(vectors / size[:, None], trees, seed)
        enough = max(k, least_visits, math.ceil(visit_share * len(vectors)))
        last = ids[firsts[1:] - 1]
        single = np.flatnonzero(ids[firsts[:-1]] == last)  # vectors that only one id has
        of = pd.Series(single).groupby(last[single]).agg(list).to_dict()
        out = []
        asked_ids, asked_v = there["vec_id"].to_numpy(), scaled(np.stack(there["v"].to_numpy()))
        for a in range(0, len(asked_ids), 256):
            part, of_part = asked_v[a : a + 256], asked_ids[a : a + 256]
            length = norms(part)
            found = forest.candidates(part / length[:, None], [of.get(q, []) for q in of_part], enough)
            for q, v, n, at in zip(of_part, part, length, found):
                score = (vectors[at] * v).sum(1) / (size[at] * n)
                if len(at) > k:
                    near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                    at, score = at[near], score[near]
                some = [x[x != q][:k] for x in (ids[firsts[w] : firsts[w + 1]] for w in at)]
                score = np.repeat(score, [len(x) for x in some])
                some = np.concatenate(some) if some else np.empty(0, np.int64)
                order = np.lexsort((some, -score))[:k]
                out.append((np.full(len(order), q), some[order], score[order]))
        q, v, s = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    by = ["dim", "block", "asked"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
