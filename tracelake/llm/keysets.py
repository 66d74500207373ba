"""Which keys of a part of the corpus also occur in other parts.

The corpus lies in parts of bounded size, in a table bucketed by part, so every pass over it joins what
came back for a part without moving texts again. A part sends each of its keys once, sorted and packed, to
the task that owns a range of the key space; the task sees one sorted list from each part and answers with a
bit for each key. So a key that fills a third of the corpus costs one entry a part, no text is sent, and
nothing meets in the driver.

Sizes: parts and owners grow with the corpus, so a task's memory doesn't. A part writes to an owner only if it has
keys of it, so there are never more messages than entries: their number first grows with parts times owners, while
each still packs many entries, and then in proportion to the corpus. The table has at most MOST_BUCKETS buckets,
each with several parts beyond that, one after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import made, new_path, planes, sorted_planes, trimmed, unsorted_planes

#: Bytes of text in a part, and of text for each owner of keys.
PART_BYTES, OWNER_BYTES = 6 << 20, 24 << 20
#: Buckets of the table: below Spark's own limit of 100 000, and a few GB each at 100 TB.
MOST_BUCKETS = 1 << 16

SENT = pa.schema([("owner", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("flags", pa.binary()), ("body", pa.binary())])
SENT_DDL = "owner int, part int, keys binary, flags binary, body binary"
ANSWER = pa.schema([("part", pa.int32()), ("owner", pa.int32()), ("step", pa.int32()), ("bits", pa.binary())])
ANSWER_DDL = "part int, owner int, step int, bits binary"


def in_parts(rows: DataFrame, text: str, spread: list[Column]) -> tuple[DataFrame, int]:
    """rows with ``part``, written once to a table bucketed by it, and the number of owners of keys."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts, owners = max(16, -(-total // PART_BYTES)), max(16, -(-total // OWNER_BYTES))
    buckets = min(parts, MOST_BUCKETS)
    name, path = f"parts_{uuid.uuid4().hex}", new_path(spark, "parts")
    made(path, name)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
    dealt.repartition(buckets, "part").write.format("parquet").option("path", path).bucketBy(buckets, "part").saveAsTable(name)
    return spark.table(name), owners


def send(part: int, owners: np.ndarray, keys: np.ndarray, flags: np.ndarray, n: int, body: np.ndarray | None = None) -> Iterator[dict]:
    """Rows for SENT. The entries are sorted by owner, then key; flags has one or more bits an entry, body further columns, as one row of bytes an entry."""
    cuts = np.searchsorted(owners, np.arange(n + 1))
    for o in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[o], cuts[o + 1]
        yield {"owner": int(o), "part": part, "keys": sorted_planes(keys[a:b]), "flags": np.packbits(flags[a:b]).tobytes(), "body": None if body is None else planes(body[a:b])}


def table_of(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def received(sent: pa.Table, dtype, each: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The keys and the flags, ``each`` an entry, of each row of SENT."""
    keys = [unsorted_planes(x.as_py(), dtype) for x in sent["keys"]]
    flags = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(k) * each).astype(bool) for x, k in zip(sent["flags"], keys)]
    return keys, [f.reshape(-1, each) if each > 1 else f for f in flags]


def answers(sent: pa.Table, bits: list[np.ndarray], step: int) -> pa.Table:
    rows = [{"part": p, "owner": o, "step": step, "bits": np.packbits(b).tobytes()} for p, o, b in zip(sent["part"].to_pylist(), sent["owner"].to_pylist(), bits)]
    return table_of(rows, ANSWER)


def shared_keys(sent: DataFrame, step: int, indexed: bool = False) -> DataFrame:
    """Answers with a bit for each key that two parts hold, or one part holds twice (its flag).

    With ``indexed``, a second flag tells the keys that are in the index from those that only probe it; answers
    are given for the index alone.
    """

    def own(table: pa.Table) -> pa.Table:
        keys, flags = received(table, np.uint32, 1 + indexed)
        unique, counts = np.unique(np.concatenate(keys), return_counts=True)
        shared = counts > 1
        for k, f in zip(keys, flags):
            shared[np.searchsorted(unique, k[f[:, 0] if indexed else f])] = True
        return answers(table, [shared[np.searchsorted(unique, k[f[:, 1]] if indexed else k)] for k, f in zip(keys, flags)], step)

    return sent.groupBy("owner").applyInArrow(lambda table: trimmed(own, table), ANSWER_DDL)


def answered(returned: pa.Table, step: int, owners: np.ndarray, n: int, each: int = 1) -> np.ndarray:
    """The bits that came back for a part's entries, which are sorted by owner; ``each`` bits an entry."""
    out = np.zeros((len(owners), each), bool)
    cuts = np.searchsorted(owners, np.arange(n + 1))
    for o, s, bits in zip(returned["owner"].to_pylist(), returned["step"].to_pylist(), returned["bits"]):
        if s == step:
            a, b = cuts[o], cuts[o + 1]
            out[a:b] = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=(b - a) * each).reshape(-1, each)
    return out if each > 1 else out[:, 0]

