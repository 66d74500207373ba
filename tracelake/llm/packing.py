"""Best-fit packing of token sequences.

Documents are tokenised in Arrow batches and closed by an end token; only those longer than a sequence are
cut, so that every piece but the first is a full sequence. Best-fit decreasing then needs no more than the
number of pieces of each length: it takes lengths from the longest down and puts every piece into the
tightest open bin that holds it. Bins with equal room are interchangeable, so a segment tree over the
remaining capacities (1 .. capacity) with the number of open bins of each finds the tightest one in
logarithmic time, and pieces of one length that go into bins of one room move as a run. The driver so plans
runs from ``capacity`` counts, whatever the number of pieces: the placement is that of best-fit decreasing
over the whole corpus. The pieces themselves are numbered within their length and find their run by binary
search, on the executors.

Null texts count as empty: a sequence of the end token alone. Rows without an id and repeated rows are packed
like others; pieces of one length are ordered by id and piece, and equal ones arbitrarily. Very long texts, and
long runs of one character, are encoded whole. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import gapless_rank, trimmed, written

#: Texts are encoded in slices of so many bytes, which bounds a task's ids in memory.
SLICE_BYTES = 1 << 20
#: The pieces of one length are dealt into cells of about so many, and into so many cells at least.
CELL_PIECES, LEAST_CELLS = 1 << 19, 64


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of a JSON vocabulary, none if there is no such file. The tokenizers library finds them in any text."""
    if not os.path.exists(vocabulary):
        return {}
    with open(vocabulary, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError(f"{vocabulary}: added tokens that take more than their own text need the JSON file as vocabulary")
    return {t["content"]: t["id"] for t in tokens}


@functools.lru_cache(2)
def load_encoder(vocabulary: str):
    """A function from texts to lists of ids.

    ``*.json`` files are read by the tokenizers library. A ``*.tiktoken`` file has the same merges as ranks
    and gives the same ids about four times as fast; it lacks the added tokens, which come from the JSON file
    beside it. A text that tiktoken refuses (a million blanks on end) is read through the JSON file alone.
    """
    if vocabulary.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        added = added_tokens(vocabulary.removesuffix(".tiktoken") + ".json")
        encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

        def ids(t: str) -> list[int]:
            try:
                return encoding.encode(t, allowed_special="all", disallowed_special=())
            except ValueError:  # a run of blanks that is too long for its matcher
                return load_encoder(vocabulary.removesuffix(".tiktoken") + ".json")([t])[0]

        return lambda texts: [ids(t) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def text_slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of slices of about SLICE_BYTES; nulls are empty texts."""
    texts = [x or "" for x in texts.to_pylist()]
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, texts[first:]


def tokenise(docs: DataFrame, id_: str, text: str, capacity: int, end_id: int, vocabulary: str, with_ids: bool) -> DataFrame:
    """A row for every piece: id, piece, start, length, ids_crc32 and, if asked for, ids."""
    id_type = docs.schema[id_].dataType
    fields = [T.StructField(id_, id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def pieces(batches):
        encode = load_encoder(vocabulary)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                rows, numbers, starts, lengths, sums, kept = [], [], [], [], [], []
                for i, ids in enumerate(encode(texts)):
                    ids = np.asarray([*ids, end_id], "<u4")
                    head = len(ids) % capacity or min(capacity, len(ids))
                    for piece, start in enumerate([0, *range(head, len(ids), capacity)]):
                        part = ids[start : head if piece == 0 else start + capacity]
                        rows.append(first + i)
                        numbers.append(piece)
                        starts.append(start)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, [f.name for f in fields])
            trimmed(bool)

    return docs.select(id_, text).mapInArrow(pieces, T.StructType(fields))


class CapacityTree:
    """A segment tree over capacities 0 .. n with the number of open bins of each."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.sums[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has open bins."""
        i = least + self.leaves
        if self.sums[i]:
            return least
        while i > 1:
            if not i & 1 and self.sums[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: (length, first rank, ranks, first bin, offset, pieces a bin) runs.

    The pieces of that length with those ranks go into consecutive bins, so many into each, from that offset
    on. A bin that was the tightest stays it while it holds another piece of the length, so it is filled first.
    """
    tree = CapacityTree(capacity)
    open_: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]  # runs of bins by room left
    runs, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            queue = open_[room]
            if queue and queue[-1][0] + queue[-1][1] == first:
                queue[-1] = (queue[-1][0], queue[-1][1] + n)
            else:
                queue.append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, have = bins, -(-left // per)
                bins += have
            else:
                per = room // length
                first, have = open_[room].popleft()
                tree.add(room, -have)
            full = min(have, left // per)
            over = min(left - full * per, per - 1) if full < have else 0
            used = full + (over > 0)
            runs.append((length, rank, full * per + over, first, capacity - room, per))
            put(room - per * length, first, full)
            put(room - over * length, first + full, used - full)
            if used < have:
                open_[room].appendleft((first + used, have - used))
                tree.add(room, have - used)
            rank, left = rank + full * per + over, left - full * per - over
    return runs


def pack(docs: DataFrame, id_: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = written(tokenise(docs, id_, text, capacity, end_id, vocabulary or default_vocabulary(), with_ids), "pieces")
    counts = dict(pieces.groupBy("length").count().collect())  # at most capacity rows
    runs = best_fit_runs(counts, capacity)
    # Runs by (length, first rank); no more than the plan's states, whatever the number of pieces.
    keys = np.array([r[0] << 44 | r[1] for r in runs], np.int64)
    order = np.argsort(keys)
    plan = spark.sparkContext.broadcast((keys[order], *(np.array([r[c] for r in runs], np.int64)[order] for c in (1, 3, 4, 5))))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first_rank, first_bin, offset, per = plan.value
        n, k = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(keys, n << 44 | k, "right") - 1
        bins, place = np.divmod(k - first_rank[at], per[at])
        return pd.DataFrame({"sequence_id": first_bin[at] + bins, "offset": offset[at] + place * n})

    by = [F.col(id_), F.col("piece"), F.col("ids_crc32")]
    cells = max(LEAST_CELLS, -(-max(counts.values(), default=0) // CELL_PIECES))
    ranked = gapless_rank(pieces, ["length"], by, "__rank", cells=cells, spread=by)
    return ranked.withColumn("__at", place("length", "__rank")).select(*pieces.columns, "__at.*")
