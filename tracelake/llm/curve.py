"""Packing along a space-filling curve: neighbouring sequences hold similar documents, and next to nothing is padding.

Documents are tokenised once. A document's vector are the square roots of its token counts in hashed buckets, scaled to
length 1; a fixed random matrix projects it to a few dimensions, which are centred and scaled by their mean and deviation
over all documents and cut into cells. The cell's place on the Hilbert curve is the sort key, so documents with similar
words come close to each other, copies next to each other. Only key, id and number of tokens are sorted by range;
running sums within the partitions and the partitions' totals give each document its place in one stream of all tokens,
which is cut every ``capacity`` tokens. What is left at the end is cut into powers of two, so no sequence is padded at all.
The ids stay where they were written and meet their places by row number.

Null texts count as empty: a document of the end token alone. Rows without an id and repeated rows are packed like
others; documents of one cell are ordered by id (null first), then by place in the table. Copies of one document are
spread over partitions by id and row number. A very long text is one row, tokenised whole. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import default_vocabulary, load_encoder, text_slices
from .shared import trimmed, written

#: Buckets of hashed tokens, dimensions of the projection, bits of each on the curve, seed of the matrix.
BUCKETS, DIMENSIONS, BITS, SEED = 4096, 4, 12, 5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole coordinates below 2**bits (Skilling's transform, 2004)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(1, bits):
        turn ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _matrix() -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(BUCKETS, DIMENSIONS))


def hashed(ids: np.ndarray) -> np.ndarray:
    """A document's vector of length 1 (all zero if it has no token)."""
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BUCKETS)
    v = np.sqrt(np.bincount(bucket.astype(np.int64), minlength=BUCKETS))
    return v / max(1.0, np.sqrt((v * v).sum()))


def _tokens(docs: DataFrame, id_: str, text: str, end_id: int, vocabulary: str) -> DataFrame:
    """(rid, id, n, ids, wide, p): the token ids of each row as 16 or 32 bits each, and its projection."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("id", docs.schema[id_].dataType), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("wide", T.BooleanType()), T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, matrix = load_encoder(vocabulary), _matrix()
        for batch in batches:
            for first, texts in text_slices(batch.column(2)):
                n, blobs, wide, p = [], [], [], []
                for ids in encode(texts):
                    ids = np.asarray([*ids, end_id], "<u4")
                    n.append(len(ids))
                    wide.append(bool(ids.max() >= 1 << 16))
                    blobs.append((ids if wide[-1] else ids.astype("<u2")).tobytes())
                    p.append(hashed(ids[:-1]) @ matrix)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(blobs, pa.binary()), pa.array(wide), pa.array([x.tolist() for x in p], pa.list_(pa.float64()))], schema.names)
            trimmed(bool)

    return rows.mapInArrow(run, schema)


def _keyed(tokens: DataFrame) -> DataFrame:
    """(rid, id, n, key): each document's place on the curve."""
    stats = tokens.agg(*[f(F.col("p")[i]).alias(f"{f.__name__}{i}") for i in range(DIMENSIONS) for f in (F.avg, F.stddev_pop)]).first()
    centre = np.array([stats[2 * i] or 0.0 for i in range(DIMENSIONS)])
    spread = np.array([stats[2 * i + 1] or 1.0 for i in range(DIMENSIONS)])

    @F.pandas_udf("long")
    def key(p):
        z = (np.stack(p.to_numpy()) - centre) / spread if len(p) else np.zeros((0, DIMENSIONS))
        cells = np.floor((1 << BITS) / (1 + np.exp(-1.702 * z)))  # close to the share of a normal distribution below z
        import pandas as pd

        return pd.Series(hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS))

    return tokens.select("rid", "id", "n", key("p").alias("key"))


def _placed(keyed: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(rid, part, before) in the order of the curve, and the tokens of each part."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            before = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before), batch.column(1)], ["rid", "part", "before", "tokens"])

    order = ["key", "id", "rid"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("rid", "n")
    placed = written(ordered.mapInArrow(sums, "rid long, part int, before long, tokens long"), "placed")
    return placed.drop("tokens"), dict(placed.groupBy("part").agg(F.sum("tokens")).collect())  # a row a part


def tail_starts(total: int, capacity: int) -> list[int]:
    """Where the sequences begin that follow the full ones: the rest of the stream in powers of two, larger ones first."""
    at, starts = total // capacity * capacity, []
    for b in range(capacity.bit_length(), -1, -1):
        if (total % capacity) >> b & 1:
            starts.append(at)
            at += 1 << b
    return starts


def pack(docs: DataFrame, id_: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids if asked for) of all pieces of all documents."""
    tokens = written(_tokens(docs, id_, text, end_id, vocabulary or default_vocabulary()), "tokens")
    placed, totals = _placed(_keyed(tokens))
    bases, total = {}, 0
    for part in sorted(totals):
        bases[part] = total
        total += totals[part]
    full = total // capacity
    tail = np.array(tail_starts(total, capacity), np.int64)
    fields = [T.StructField(id_, docs.schema[id_].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide, part, before = (batch.column(i).to_pylist() for i in (2, 3, 4))
            rows, out, kept = [], [], []
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[i].as_buffer(), "<u4" if wide[i] else "<u2").astype("<u4")
                begin = bases[part[i]] + before[i]
                end = begin + len(ids)
                cuts = [*range(begin // capacity * capacity + capacity, min(end - 1, full * capacity) + 1, capacity), *tail[(tail > begin) & (tail < end)].tolist()]
                cuts = sorted({begin, *cuts})
                for a, b in zip(cuts, [*cuts[1:], end]):
                    if a < full * capacity:
                        sequence, offset = divmod(a, capacity)
                    else:
                        t = int(np.searchsorted(tail, a, "right")) - 1
                        sequence, offset = full + t, a - int(tail[t])
                    piece = ids[a - begin : b - begin]
                    rows.append(i)
                    out.append((a - begin, b - a, zlib.crc32(piece.tobytes()), len(ids), sequence, offset))
                    if with_ids:
                        kept.append(piece.astype(np.int32))
            columns = [pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns] + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, [f.name for f in fields])

    met = tokens.select("rid", "id", "ids", "wide").join(placed, "rid").select("id", "ids", "wide", "part", "before")
    return met.mapInArrow(cut, T.StructType(fields))
