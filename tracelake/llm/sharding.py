"""Sharding by histogram sort, in DataFrame functions alone.

Every row gets a sort key: the hash of its text, then the hash of its id. Equal texts are neighbours in
this order, and a hot text is still spread over many keys. The exact bytes below candidate keys are
counted in all partitions at once; where a splitter's place isn't known to within the tolerance, only
the cell of keys that holds it is probed again, more finely, until every splitter is close enough or
lies between two neighbouring keys. Then the rows are exchanged once.

Null texts count as empty. Rows without an id, repeated rows and equal keys are kept, each with a slot of
its own; their order among each other is that of their id and text checksum. Where a boundary falls into rows that repeat, their
places in the table go into the key, so they are spread as evenly as others. Texts of any length are one row; one
that is longer than a shard fills a shard alone. Other columns pass through, whatever their names; columns named size,
shard or slot are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import column_name, written

#: Bits of a sort key: TEXT_BITS of the text's hash, then ID_BITS of the id's.
TEXT_BITS, ID_BITS = 39, 24
KEY_BITS = TEXT_BITS + ID_BITS
#: Bits of a key that tell repeated rows apart, where these are too many for one boundary.
TIE_BITS = 16
#: Bits by which the first probe divides the keys, and by which later ones refine a cell.
FIRST_BITS, STEP_BITS = 13, 10


def text_bytes(text: str) -> Column:
    return F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")


def sort_key(id_: str, text: str) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 64 - TEXT_BITS)
    low = F.shiftrightunsigned(F.xxhash64(F.col(id_)), 64 - ID_BITS)
    return F.shiftleft(high, ID_BITS).bitwiseOR(low)


def tied_key(key: str) -> Column:
    """The key with TIE_BITS of a row's place in the table in the place of as many of the id's."""
    tie = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - TIE_BITS)
    return F.shiftleft(F.shiftrightunsigned(key, TIE_BITS), TIE_BITS).bitwiseOR(tie)


@dataclass
class _Splitter:
    """A boundary looked for: ``target`` bytes shall lie below it. The cell [low, low + 2**bits) holds it."""

    target: float
    slack: float
    low: int = 0
    bits: int = KEY_BITS
    below: int = 0
    key: int | None = None


def splitters(rows: DataFrame, key: str, size: str, targets: list[tuple[float, float]]) -> tuple[list[int], list[int]]:
    """For each (target, slack), a key below which the bytes are within slack of the target, or else as near as any key; and the keys that span a target beyond its slack.

    One job a round. The first counts 2 ** FIRST_BITS cells and later ones at most 2 ** STEP_BITS for each
    splitter that is still open, whatever the number of rows; there are at most six rounds.
    """
    found, spanning = [_Splitter(*t) for t in targets], set()
    while open_ := [s for s in found if s.key is None]:
        bits = open_[0].bits  # all open ones are equally fine
        step = bits - (FIRST_BITS if bits == KEY_BITS else STEP_BITS)
        lows = sorted({s.low >> bits for s in open_})
        probed = rows if bits == KEY_BITS else rows.filter(F.shiftrightunsigned(key, bits).isin(lows))
        counts: dict[int, dict[int, int]] = {}
        for cell, n in probed.groupBy(F.shiftrightunsigned(key, step).alias("cell")).agg(F.sum(size).alias("n")).collect():
            counts.setdefault(cell >> (bits - step), {})[cell] = n
        for s in open_:
            cells = counts.get(s.low >> bits, {})
            edges = [(s.low, s.below)]  # (key, bytes below it)
            for cell in sorted(cells):
                edges.append(((cell + 1) << step, edges[-1][1] + cells[cell]))
                if edges[-1][1] >= s.target:
                    break
            near = min(edges, key=lambda e: (abs(e[1] - s.target), e[0]))
            if abs(near[1] - s.target) <= s.slack or step == 0 or len(edges) < 2 or edges[-1][1] < s.target:
                s.key = near[0]
                if step == 0 and abs(near[1] - s.target) > s.slack and edges[-1][1] >= s.target:
                    spanning.add(edges[-1][0] - 1)
            else:
                last = edges[-1][0] - (1 << step)
                s.low, s.bits, s.below = last, step, edges[-2][1]
    return [s.key for s in found], sorted(spanning)


def shard(docs: DataFrame, shards: int = 16, id_: str = "doc_id", text: str = "text", tolerance: float = 0.002, pieces: int = 64) -> DataFrame:
    """docs with size, shard and slot (long, int, long): shards of nearly equal bytes, slots gapless from 0.

    Boundaries of shards are within ``tolerance`` of a shard's bytes of their even place, or as near as
    whole rows allow. Each shard is cut into ``pieces`` ranges, placed loosely, so that no task sorts a
    whole shard; slots are numbered from the pieces' exact counts (shards * pieces numbers in all).
    """
    docs = docs.drop("shard", "slot")
    key, size = column_name(docs, "sort_key"), "size"
    rows = docs.withColumn(size, text_bytes(text) + 1).withColumn(key, sort_key(id_, text))
    slim = written(rows.select(key, size), "shard-keys")
    total = slim.agg(F.sum(size)).first()[0] or 0
    even, n = total / shards, shards * pieces
    targets = [(total * i / n, even * (tolerance if i % pieces == 0 else 0.25 / pieces)) for i in range(1, n)]
    cuts, spanning = splitters(slim, key, size, targets)
    if spanning and slim.filter(F.col(key).isin(spanning)).groupBy(key).count().filter("count > 1").limit(1).count():
        # Rows that repeat fill a boundary: they are told apart by their place in the table, which is written so that it stays.
        rows = written(rows.withColumn(key, tied_key(key)), "shard-rows")
        slim = rows.select(key, size)
        cuts, _ = splitters(slim, key, size, targets)
    for i in range(1, len(cuts)):  # loose cuts never pass the exact ones
        cuts[i] = max(cuts[i], cuts[i - 1])
    exact = [cuts[i * pieces - 1] for i in range(1, shards)]
    cuts = sorted(min(max(c, exact[i // pieces - 1] if i >= pieces else 0), exact[i // pieces] if i // pieces < len(exact) else 1 << KEY_BITS) for i, c in enumerate(cuts, 1))

    # A key's piece: the cuts at or below it. Found from its leading bits and the few cuts that share them.
    lead = 12
    spark = docs.sparkSession
    table = []
    for c in range(1 << lead):
        lo, hi = bisect.bisect_right(cuts, c << (KEY_BITS - lead)), bisect.bisect_left(cuts, (c + 1) << (KEY_BITS - lead))
        table.append((c, lo, cuts[lo:hi]))
    piece, base, own, before, few, there = (column_name(docs, c) for c in ("piece_no", "piece_base", "key_lead", "cuts_before", "near_cuts", "piece_there"))
    cells = spark.createDataFrame(table, f"`{own}` long, `{before}` int, `{few}` array<long>")  # always 2 ** lead rows

    def placed(df: DataFrame) -> DataFrame:
        at = df.join(F.broadcast(cells), F.shiftrightunsigned(df[key], KEY_BITS - lead) == cells[own])
        return at.withColumn(piece, F.col(before) + F.size(F.filter(few, lambda c: c <= F.col(key)))).drop(own, before, few)

    counts = dict(placed(slim).groupBy(piece).count().collect())  # shards * pieces rows
    bases, seen = [], 0
    for i in range(n):
        seen = 0 if i % pieces == 0 else seen
        bases.append((i, seen))
        seen += counts.get(i, 0)
    starts = spark.createDataFrame(bases, f"`{there}` int, `{base}` long")  # shards * pieces rows
    within = Window.partitionBy(piece).orderBy(key, id_, F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    out = placed(rows).withColumn("slot", F.row_number().over(within) - 1)
    out = out.join(F.broadcast(starts), out[piece] == starts[there])
    return out.withColumn("slot", F.col("slot") + F.col(base)).withColumn("shard", F.expr(f"int(`{piece}` div {pieces})")).drop(there, base, piece, key)
