"""Hard-negative mining with exact integer scores.

Components are scaled and rounded down, so that scores are integers and equal on every machine. The rows lie in packed
blocks. A bounded slab of anchors goes to every task (``slab_rows`` anchors, whatever the table's size), and the blocks
are read where they are: nothing is shuffled but what is found. In each block every anchor's scores are sorted in full,
by score and id. The first pass reads the first rows of the anchor's own label from that order, its positives; the second
one finds each positive's upper limit by binary search among the rows of other labels and reads on from there, down to the
lower limit. A task keeps the best of all its blocks, and those of the tasks are merged slab by slab, as a stream.

Rows with a null label, a null vector, or any null or non-finite component take no part. A row without an id does, after
all others of its score, and is returned as null; an anchor without an id is one of no condition on ids. Rows that repeat
are rows of their own, each other's candidates, and anchors on their own. Vectors of different lengths are compared over
the components that both have, empty ones score 0. Scores outside of 64 bits are taken as the nearest of them. Very long
vectors make blocks of fewer rows. An empty table, or one without anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import made, new_path, planes, unplanes, written

#: Components of a block, scores that are sorted at a time, and anchors of one message between tasks.
BLOCK_VALUES, SORTED, MESSAGE = 1 << 22, 1 << 21, 256
FIRST, LAST = -(2**63) + 1, 2**63 - 1
_PACKED = "dim int, n int, rid binary, ids binary, known binary, labels binary, anchor binary, v binary, small boolean"
_BEST = "message int, n int, width int, score binary, ids binary, known binary, valid binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _packed(rows: DataFrame, scale: float, block_rows: int) -> DataFrame:
    """Blocks of rows (rid, id, label, anchor, v) of equal length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            rid, ids, known, labels, anchor, v = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            small = bool((np.abs(v) < 1 << 15).all())
            columns = [planes(rid), planes(ids), known.tobytes(), planes(labels), anchor.tobytes(), v.astype(np.int16 if small else np.float64).tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(("dim", "n", "rid", "ids", "known", "labels", "anchor", "v", "small"), (dim, len(rid), *columns, small)))], schema)

        schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("rid", "ids", "known", "labels", "anchor", "v")], ("small", pa.bool_())])
        for batch in batches:
            rid, labels, anchor = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(1).fill_null(LAST).to_numpy(zero_copy_only=False)
            lists = batch.column(4)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                v = values[(ends[of] - dim)[:, None] + np.arange(dim)]
                most = max(1, min(block_rows, BLOCK_VALUES // max(1, dim)))
                for a in range(0, len(of), most):
                    some = of[a : a + most]
                    if dim in waiting and sum(len(x[0]) for x in waiting[dim]) + len(some) > most:
                        yield block(dim)
                    waiting.setdefault(dim, []).append((rid[some], ids[some], known[some], labels[some], anchor[some], v[a : a + most]))
        for dim in list(waiting):
            yield block(dim)

    return rows.mapInArrow(pack, _PACKED)


def _unpacked(r: dict) -> dict:
    v = np.frombuffer(r["v"], np.int16 if r["small"] else np.float64).reshape(r["n"], r["dim"]).astype(np.float64)
    return {"rid": unplanes(r["rid"], np.int64), "ids": unplanes(r["ids"], np.int64), "known": np.frombuffer(r["known"], bool), "labels": unplanes(r["labels"], np.int64), "anchor": np.frombuffer(r["anchor"], bool), "v": v}


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of two blocks of whole numbers, over the components that both have."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(c) for c in r] for r in x.tolist()], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, FIRST, LAST).astype(np.int64) if dim else np.zeros((len(a), len(b)), np.int64)


class Best:
    """The ``width`` best entries of each of n lists: larger scores first, then smaller ids, rows without one last."""

    def __init__(self, n: int, width: int):
        shape = (n, width)
        self.score, self.ids, self.known, self.valid = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(shape, bool)

    def fields(self) -> list[np.ndarray]:
        return [self.score, self.ids, self.known, self.valid]

    def merge(self, rows: slice, others: list[np.ndarray]) -> None:
        both = [np.concatenate([x[rows], y], 1) for x, y in zip(self.fields(), others)]
        order = np.lexsort((~both[2], both[1], -both[0], ~both[3]))[:, : self.score.shape[1]]
        for x, y in zip(self.fields(), both):
            x[rows] = np.take_along_axis(y, order, 1)

    def messages(self, per_anchor: int) -> Iterator[pa.RecordBatch]:
        n, width = self.score.shape[0] // per_anchor, self.score.shape[1] * per_anchor
        for m, a in enumerate(range(0, n, MESSAGE)):
            part = [x.reshape(n, width)[a : a + MESSAGE] for x in self.fields()]
            data = [planes(part[0].ravel()), planes(part[1].ravel()), part[2].tobytes(), part[3].tobytes()]
            yield pa.RecordBatch.from_pydict(dict(zip(("message", "n", "width", "score", "ids", "known", "valid"), [pa.array([m], pa.int32()), pa.array([len(part[0])], pa.int32()), pa.array([width], pa.int32()), *[pa.array([x], pa.binary()) for x in data]])))


def _from_message(r: dict, width: int) -> list[np.ndarray]:
    read = [unplanes(r["score"], np.int64), unplanes(r["ids"], np.int64), np.frombuffer(r["known"], bool), np.frombuffer(r["valid"], bool)]
    return [x.reshape(-1, width) for x in read]


def _merged(found: DataFrame, width: int) -> DataFrame:
    """One message of each number: the best of those of all tasks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, best, per = None, None, 1
        for batch in batches:
            for r in batch.to_pylist():
                if r["message"] != number:
                    if best is not None:
                        yield from renumbered(best, per, number)
                    number, per = r["message"], r["width"] // width
                    best = Best(r["n"] * per, width)
                best.merge(slice(None), _from_message(r, width))
        if best is not None:
            yield from renumbered(best, per, number)

    def renumbered(best: Best, per: int, number: int) -> Iterator[pa.RecordBatch]:
        for batch in best.messages(per):
            yield batch.set_column(0, "message", pa.array([number], pa.int32()))

    return found.repartition("message").sortWithinPartitions("message").mapInArrow(merge, _BEST)


def _sorted_by_score(slab: dict, block: dict) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For some anchors of the slab at a time: all scores of the block, and their order by score, then id."""
    n = len(block["ids"])
    for part in slab["parts"]:
        step = max(1, SORTED // max(1, n))
        for a in range(part.start, part.stop, step):
            rows = slice(a, min(part.stop, a + step))
            scores = _scores(slab["v"][part.start][rows.start - part.start : rows.stop - part.start], block["v"])
            keys = [np.broadcast_to(x, scores.shape) for x in (~block["known"], block["ids"])]
            yield rows, scores, np.lexsort((*keys, -scores), axis=-1)


def _positives(slab: dict, block: dict, k: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """The first k rows of each anchor's label but the anchor itself."""
    for rows, scores, order in _sorted_by_score(slab, block):
        mine = (block["labels"][order] == slab["labels"][rows, None]) & (block["rid"][order] != slab["rid"][rows, None])
        nth = np.cumsum(mine, 1)
        at, place = np.nonzero(mine & (nth <= k))
        out = Best(len(scores), k)
        slot, col = nth[at, place] - 1, order[at, place]
        out.score[at, slot], out.ids[at, slot], out.known[at, slot], out.valid[at, slot] = scores[at, col], block["ids"][col], block["known"][col], True
        yield rows, out.fields()


def _negatives(slab: dict, block: dict, k: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """For each positive, the first k rows of other labels between its limits: the upper one is found by binary search."""
    p = slab["upper"].shape[1]
    for rows, scores, order in _sorted_by_score(slab, block):
        other = block["labels"][order] != slab["labels"][rows, None]
        out = Best(len(scores) * p, k)
        for i in range(len(scores)):
            cols = order[i, other[i]]
            down = -scores[i, cols]  # ascending
            upper, lower, has = (slab[x][rows.start + i] for x in ("upper", "lower", "has"))
            at = np.searchsorted(down, -upper, "left")[:, None] + np.arange(k)
            fits = (at < len(down)) & has[:, None]
            at = np.where(fits, at, 0)
            if not len(down):
                continue
            fits &= down[at] <= -lower[:, None]
            here, take = slice(i * p, i * p + p), cols[at]
            out.score[here], out.ids[here], out.known[here], out.valid[here] = -down[at], block["ids"][take], block["known"][take], fits
        yield slice(rows.start * p, rows.stop * p), out.fields()


def _pass(blocks: DataFrame, slab, find, per_anchor: int, width: int) -> DataFrame:
    """The best of each task's blocks, as messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = slab.value
        best = Best(len(here["ids"]) * per_anchor, width)
        empty = True
        for batch in batches:
            for i in range(batch.num_rows):
                empty = False
                for rows, found in find(here, _unpacked(batch.slice(i, 1).to_pylist()[0]), width):
                    best.merge(rows, found)
        if not empty:
            yield from best.messages(per_anchor)

    return blocks.mapInArrow(run, _BEST)


def _limits(score: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers n with least * score <= 100 * n <= most * score: (smallest, largest)."""
    low = [[-(-int(s) * least // 100) for s in r] for r in score.tolist()]
    high = [[int(s) * most // 100 for s in r] for r in score.tolist()]
    return np.array(low, np.int64).reshape(score.shape), np.array(high, np.int64).reshape(score.shape)


def mine(df: DataFrame, anchors: Column, id_: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 3, scale: float = 256.0, least: int = 50, most: int = 95, block_rows: int = 8192, slab_rows: int = 65536) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that meet ``anchors``.

    An anchor's positives are its ``positives`` first other rows of the same label; for each, the first ``negatives`` rows
    of another label whose score is between ``least`` and ``most`` percent of the positive's.
    """
    spark = df.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(id_).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    n, asked = rows.agg(F.count("*"), F.count_if("anchor")).first()
    result = T.StructType.fromDDL(RESULT)
    if not asked:
        return spark.createDataFrame([], result)
    rows = rows.repartition(math.ceil(n / block_rows)).select(F.monotonically_increasing_id().alias("rid"), "id", "label", "anchor", "v")
    blocks = written(_packed(rows, scale, block_rows), "blocks")
    slabs, at, out = math.ceil(asked / slab_rows), new_path(spark, "anchors"), new_path(spark, "negatives")
    made(at), made(out)
    _anchors(blocks, slabs).write.partitionBy("slab").parquet(at)
    for s in range(slabs):
        here = _slab(spark.read.parquet(at).filter(F.col("slab") == s).drop("slab").toArrow().to_pylist())
        if here is None:
            continue
        sent = spark.sparkContext.broadcast(here)
        found = _merged(_pass(blocks, sent, _positives, 1, positives), positives).collect()  # a slab's positives
        first = Best(len(here["ids"]), positives)
        for r in found:
            first.merge(slice(r["message"] * MESSAGE, r["message"] * MESSAGE + r["n"]), _from_message(r, positives))
        lower, upper = _limits(first.score, least, most)
        again = spark.sparkContext.broadcast(here | {"lower": lower, "upper": upper, "has": first.valid, "first": first})
        _rows(_merged(_pass(blocks, again, _negatives, positives, negatives), negatives), again, negatives).write.parquet(f"{out}/slab={s}")
        sent.destroy(), again.destroy()
    return spark.read.schema(result).parquet(out).select(*result.names)


def _anchors(blocks: DataFrame, slabs: int) -> DataFrame:
    """The anchors of all blocks as packs of their own, dealt into slabs by row."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                b = _unpacked(r)
                slab = (b["rid"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slabs)
                for s in range(slabs):
                    x = np.flatnonzero(b["anchor"] & (slab == s))
                    if len(x):
                        v = b["v"][x].astype(np.int16 if r["small"] else np.float64).tobytes()
                        row = {"dim": r["dim"], "n": len(x), "rid": planes(b["rid"][x]), "ids": planes(b["ids"][x]), "known": b["known"][x].tobytes(), "labels": planes(b["labels"][x]), "anchor": b["anchor"][x].tobytes(), "v": v, "small": r["small"], "slab": s}
                        yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("rid", "ids", "known", "labels", "anchor", "v")], ("small", pa.bool_()), ("slab", pa.int32())])
    return blocks.mapInArrow(take, _PACKED + ", slab int")


def _slab(packs: list[dict]) -> dict | None:
    """The packs of a slab as one, those of equal vector length together."""
    if not packs:
        return None
    packs = sorted(packs, key=lambda r: r["dim"])
    read = [_unpacked(r) for r in packs]
    out = {c: np.concatenate([r[c] for r in read]) for c in ("rid", "ids", "known", "labels")}
    out["parts"], out["v"], begin = [], {}, 0
    for dim in sorted({r["dim"] for r in packs}):
        v = np.concatenate([x["v"] for r, x in zip(packs, read) if r["dim"] == dim])
        out["parts"].append(slice(begin, begin + len(v)))
        out["v"][begin] = v
        begin += len(v)
    return out


def _rows(found: DataFrame, slab, k: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = slab.value
        first, p = here["first"], here["has"].shape[1]
        nullable = lambda x, known: pa.array(x, pa.int64(), mask=~known)
        for batch in batches:
            for r in batch.to_pylist():
                score, ids, known, valid = _from_message(r, k)
                which, rank = np.nonzero(valid)
                anchor, positive = r["message"] * MESSAGE + which // p, which % p
                out = [nullable(here["ids"][anchor], here["known"][anchor]), nullable(first.ids[anchor, positive], first.known[anchor, positive]), pa.array(rank + 1, pa.int32())]
                out += [nullable(ids[which, rank], known[which, rank]), pa.array(first.score[anchor, positive]), pa.array(score[which, rank])]
                yield pa.RecordBatch.from_arrays(out, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return found.mapInArrow(rows, RESULT)
