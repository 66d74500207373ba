"""The prefix trie of conversations: every distinct sequence of first turns is a node.

Turns become digests and word counts before anything is sorted, so texts are read once and never shuffled. A range sort
by conversation, turn and role numbers them (turns that tie are in the order of role, then of digest); a conversation that
lies in several partitions is put together from their counts. Conversations are then arrays of digests. They are range-sorted
as such, ties by id, and each partition sweeps its arrays once: the longest common prefix with the array before closes
the intervals on the stack that are deeper, and each closed interval is an edge of nodes with the same members. Sums
(members, leaves, saved words) pass from an interval to the one around it as it closes. The intervals that touch a
partition's first or last array stay open; the driver stitches them, from the common prefixes of neighbouring partitions: a few
records for each partition, whatever it holds. Ids that end in an interval are hashed as they come, in order; those of an
interval over several partitions are hashed again as one stream. Edges become nodes on the executors.

Arrays have at most ``chunk`` turns. Of longer conversations each chunk is an array of its own in the trie below the digest of
the chunks before it; these tries are swept from the deepest level up and hand their sums to the node they hang from.
So no conversation, group of copies or node is ever held by a task as a whole.

Null turns come first, null roles and texts are empty; rows without a conversation's id take no part. Repeated rows are turns of
their own. A conversation may be rebuilt without any turn: it is a member of the root alone. Ids below 0 are taken over 20
as in SQL (c % 20 has the sign of c). An empty table gives no rows, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
DIGEST, NUMBER = 16, 4  # bytes of a turn's digest and of its count of words
NOTHING = hashlib.sha256(b"").hexdigest()
#: Ids of one message of those that end in an interval.
IDS = 4096
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FRAGMENT = "conv_id long, part int, piece int, n int, digests binary, words binary"
_SWEPT = "kind string, part int, serial long, parent long, top int, depth int, n long, least long, children long, leaves long, saved long, ends string, words binary, p string, first binary, first_words binary, first_p string, low int, ids binary"
_COLUMNS = [x.split()[0] for x in _SWEPT.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _fragments(df: DataFrame, conv: str, turn: str, role: str, text: str, most: int) -> DataFrame:
    """(conv_id, part, piece, n, digests, words): the turns of each conversation in order, in runs of at most ``most``."""
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256), 1, 2 * DIGEST)
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), F.unhex(digest).alias("digest"), F.regexp_count(text_, F.lit(WORD)).cast("int").alias("words"), F.monotonically_increasing_id().alias("rid"))
    rows = written(rows.filter("conv_id is not null"), "turns")
    order = ["conv_id", "turn", "role", "digest", "rid"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, open_ = TaskContext.get().partitionId(), 0, None
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("n", pa.int32()), ("digests", pa.binary()), ("words", pa.binary())])
        for batch in batches:
            convs, words, digests = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype("<i4"), b"".join(batch.column(1).to_pylist())
            out = []
            ends = [*(np.flatnonzero(np.diff(convs)) + 1).tolist(), len(convs)]
            at = 0
            for end in ends:
                while at < end:
                    c = int(convs[at])
                    if open_ is not None and (open_[0] != c or open_[1] >= most):
                        out.append((open_[0], part, piece, open_[1], b"".join(open_[2]), b"".join(open_[3])))
                        open_, piece = None, piece + 1
                    open_ = open_ or [c, 0, [], []]
                    stop = min(end, at + most - open_[1])
                    open_[1] += stop - at
                    open_[2].append(digests[DIGEST * at : DIGEST * stop])
                    open_[3].append(words[at:stop].tobytes())
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 6, schema)], schema=schema)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((open_[0], part, piece, open_[1], b"".join(open_[2]), b"".join(open_[3])), schema)], schema=schema)

    found = written(ordered.mapInArrow(run, _FRAGMENT), "fragments")
    before = Window.partitionBy("conv_id").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _rebuilt(fragments: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, chunk, at, digests, words): the runs of the rebuilt conversations, none across a chunk's end; one at least of each."""
    heads = fragments.filter("conv_id % 20 = 0 and start < 3").groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("start", F.substring("digests", 1, 3 * DIGEST).alias("digests"), F.substring("words", 1, 3 * NUMBER).alias("words")))).alias("head"))  # three runs at most
    rows = fragments.withColumn("base", F.expr("conv_id - conv_id % 20")).withColumn("h", F.expr("crc32(cast(cast(conv_id as string) as binary)) % 4").cast("int"))
    rows = rows.join(heads, "base", "left").select("conv_id", "start", "digests", "words", "h", F.expr("transform(head, x -> x.digests)").alias("hd"), F.expr("transform(head, x -> x.words)").alias("hw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("at", pa.int32()), ("digests", pa.binary()), ("words", pa.binary())])
        for batch in batches:
            out = []
            for conv, start, digests, words, h, hd, hw in zip(*[c.to_pylist() for c in batch.columns]):
                hd, hw = b"".join(hd or [])[: DIGEST * h], b"".join(hw or [])[: NUMBER * h]
                own = max(0, h - start)
                digests, words, at = digests[DIGEST * own :], words[NUMBER * own :], start + own - h + len(hd) // DIGEST
                if start == 0:
                    digests, words, at = hd + digests, hw + words, 0
                elif not digests:
                    continue
                n, done = len(digests) // DIGEST, 0
                while done < n or n == 0 == done:
                    take = min(n - done, chunk - (at + done) % chunk)
                    out.append((conv, (at + done) // chunk, (at + done) % chunk, digests[DIGEST * done : DIGEST * (done + take)], words[NUMBER * done : NUMBER * (done + take)]))
                    done += take
                    if n == 0:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    return rows.mapInArrow(run, "conv_id long, chunk long, at int, digests binary, words binary")


def _chunks(runs: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, chunk, digests, words, p, next, more): whole chunks; p stands for all chunks before, next for those and this one, if it is full."""
    parts = F.array_sort(F.collect_list(F.struct("at", "digests", "words")))
    glued = lambda c: F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x[c]))
    rows = runs.groupBy("conv_id", "chunk").agg(parts.alias("parts")).select("conv_id", "chunk", glued("digests").alias("digests"), glued("words").alias("words"))
    rows = written(rows, "chunks")
    if not rows.filter("chunk > 0").limit(1).count():
        return rows.withColumns({"p": F.lit(""), "next": F.lit(None).cast("string"), "more": F.lit(False)})
    own = Window.partitionBy("conv_id").orderBy("chunk")
    upto = lambda last: [F.sum(F.xxhash64(F.lit(seed), "chunk", F.sha2("digests", 256)).cast("decimal(38,0)")).over(own.rowsBetween(Window.unboundedPreceding, last)) for seed in (1, 2)]
    full = F.octet_length("digests") == DIGEST * chunk
    names = {"p": F.when(F.col("chunk") == 0, "").otherwise(F.concat_ws(":", "chunk", *upto(-1))), "next": F.when(full, F.concat_ws(":", F.col("chunk") + 1, *upto(0))), "more": F.lead("chunk").over(own).isNotNull()}
    return written(rows.withColumns(names), "chunks")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two arrays have in common at their begin."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    if n <= 32 * DIGEST:
        return next(i for i in range(n // DIGEST) if a[DIGEST * i : DIGEST * (i + 1)] != b[DIGEST * i : DIGEST * (i + 1)])
    x, y = (np.frombuffer(v, np.uint8, n) for v in (a, b))
    return int(np.argmax(x != y)) // DIGEST


def _sum(words: bytes, a: int, b: int) -> int:
    return int(np.frombuffer(words, "<i4")[a:b].sum(dtype=np.int64)) if b > a else 0


@dataclass
class Interval:
    """An open interval: what has ended in it or closed below it. ``below``: children, leaves and saved words of the trie that hangs from it."""

    depth: int
    serial: int = 0
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    below: tuple[int, int, int] | None = None
    touches: bool = False
    sha: object = None
    runs: list = field(default_factory=list)

    def take(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)

    def close(self) -> None:
        if self.below:
            self.children, self.leaves, self.saved, self.below = self.children + self.below[0], self.leaves + self.below[1], self.saved + self.below[2], None
        if not self.children:
            self.leaves = 1

    def ends(self) -> str | None:
        return self.sha.hexdigest() if self.sha else None


def _close_down(stack: list, common: int, new, closed) -> None:
    """Closes what is deeper than ``common``; where there is no interval of that depth, one is opened under what closes."""
    while stack and stack[-1].depth > common:
        e = stack.pop()
        if common >= 0 and (not stack or stack[-1].depth < common):
            stack.append(new(common, e))
        closed(e, stack[-1] if stack else None)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p, digests, words, conv_id, below) in order to closed edges, open intervals and ids at a partition's ends."""
    part, serials, stack, left, out = TaskContext.get().partitionId(), iter(range(1 << 62)), [], [], []
    last = first = None
    low, run, blocks, first_run = 1 << 30, [], 0, None

    def record(kind: str, **values) -> None:
        out.append({"kind": kind, "part": part, **values})

    def new(depth: int, under: Interval | None = None) -> Interval:
        return Interval(depth, next(serials), touches=under.touches if under else last is None)

    def closed(e: Interval, parent: Interval | None) -> None:
        if e.touches:
            left.append(e)
            return
        e.close()
        top = parent.depth if parent else -1
        begin = max(top, 0)
        record("edge", serial=e.serial, parent=parent.serial if parent else None, top=top, depth=e.depth, n=e.n, least=e.least, children=e.children, leaves=e.leaves, saved=e.saved, ends=e.ends() or NOTHING, words=last[2][NUMBER * begin : NUMBER * e.depth], p=last[0])
        if parent:
            parent.take(e.n, e.least, 1, e.leaves, e.saved + (e.n - 1) * _sum(last[2], begin, e.depth))

    def flush(final: bool) -> None:
        nonlocal run, blocks
        if run and (final or len(run) >= IDS):
            record("ids", serial=stack[-1].serial, top=blocks, ids=",".join(map(str, run)).encode())
            run, blocks = [], blocks + 1

    def opened(e: Interval) -> None:
        b = e.below or (None, None, None)
        values = {"parent": b[0], "first_p": f"{b[1]}:{b[2]}" if e.below else None}
        record("open", serial=e.serial, depth=e.depth, n=e.n, least=e.least, children=e.children, leaves=e.leaves, saved=e.saved, ends=e.ends(), top=0 if e.touches else 1, **values)

    def arrays() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], _TYPES[t]) for c, t in (x.split() for x in _SWEPT.split(", "))], _COLUMNS)
        out.clear()
        return batch

    for batch in batches:
        for p, digests, words, conv, b0, b1, b2 in zip(*[c.to_pylist() for c in batch.columns]):
            length = len(digests) // DIGEST
            if last is None:
                first = (p, digests, words)
            else:
                common = _common(last[1], digests) if last[0] == p else -1
                low = min(low, common)
                if last[0] != p or last[1] != digests:
                    flush(first_run == stack[-1].serial)
                    run, blocks = [], 0
                _close_down(stack, common, new, closed)
            if not stack:
                stack.append(new(0))
            if length > stack[-1].depth:
                stack.append(new(length))
            here = stack[-1]
            if last is None:
                first_run = here.serial
            last = (p, digests, words)
            here.take(1, conv, 0, 0, 0)
            if b0 is not None:
                here.below = (b0, b1, b2)
            else:
                if here.sha:
                    here.sha.update(f",{conv}".encode())
                else:
                    here.sha = hashlib.sha256(str(conv).encode())
                run.append(conv)
                flush(False)
            if len(out) >= 4096:
                yield arrays()
    if last is not None:
        flush(True)
        for e in (*left, *stack):
            opened(e)
        record("part", p=last[0], ids=last[1], words=last[2], first=first[1], first_words=first[2], first_p=first[0], low=low)
    yield arrays()


def _stitched(records: list) -> tuple[list[dict], list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The edges of all open intervals; (group, part, serial) of ids that end in one over several partitions; (part, serial, least) of each.

    ``records`` are the open intervals and a row for each partition.
    """
    parts = sorted((r for r in records if r["kind"] == "part"), key=lambda r: r["part"])
    by_part: dict[int, list] = {}
    for r in records:
        if r["kind"] == "open":
            by_part.setdefault(r["part"], []).append(r)
    stack, edges, alias, last = [], [], [], None

    def new(depth: int, under: Interval | None = None) -> Interval:
        return Interval(depth)

    def closer(p: str, words: bytes):
        def closed(e: Interval, parent: Interval | None) -> None:
            e.close()
            top = parent.depth if parent else -1
            begin = max(top, 0)
            edges.append((e, parent, top, words[NUMBER * begin : NUMBER * e.depth], p))
            if parent:
                parent.take(e.n, e.least, 1, e.leaves, e.saved + (e.n - 1) * _sum(words, begin, e.depth))

        return closed

    def put(r: dict) -> None:
        at = next((i for i, e in enumerate(stack) if e.depth >= r["depth"]), len(stack))
        if at == len(stack) or stack[at].depth != r["depth"]:
            stack.insert(at, Interval(r["depth"]))
        e = stack[at]
        e.take(r["n"], r["least"], r["children"], r["leaves"], r["saved"])
        if r["parent"] is not None:
            e.below = (r["parent"], *map(int, r["first_p"].split(":")))
        if r["ends"] is not None:
            e.runs.append((r["part"], r["serial"], r["ends"]))
        alias.append((r["part"], r["serial"], e))

    for x in parts:
        mine = sorted(by_part.get(x["part"], []), key=lambda r: r["depth"])
        if last is not None:
            common = _common(last["ids"], x["first"]) if last["p"] == x["first_p"] else -1
            _close_down(stack, common, new, closer(last["p"], last["words"]))
        for r in mine:
            if r["top"] == 0:
                put(r)
        _close_down(stack, x["low"], new, closer(x["first_p"], x["first_words"]))
        for r in mine:
            if r["top"] == 1:
                put(r)
        last = x
    if last is not None:
        _close_down(stack, -1, new, closer(last["p"], last["words"]))
    crossing = [(g, part, serial) for g, (e, *_) in enumerate(edges) if len(e.runs) > 1 for part, serial, _ in e.runs]
    rows = [{"group": g, "least": e.least, "parent_least": parent.least if parent else None, "top": top, "depth": e.depth, "n": e.n, "children": e.children, "leaves": e.leaves, "saved": e.saved, "ends": e.runs[0][2] if len(e.runs) == 1 else NOTHING, "words": words, "p": p} for g, (e, parent, top, words, p) in enumerate(edges)]
    return rows, crossing, [(part, serial, e.least) for part, serial, e in alias]


def _hashed_ids(ids: DataFrame, crossing: list) -> dict[int, str]:
    """SHA-256 of all ids of each group, from the messages of its partitions in order."""
    groups = ids.sparkSession.createDataFrame(crossing, "group int, part int, serial long")
    rows = ids.filter("kind = 'ids'").select("part", "serial", F.col("top").alias("block"), "ids").join(F.broadcast(groups), ["part", "serial"])  # two rows a part at most
    order = ["group", "part", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sha = None, None
        for batch in batches:
            for g, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g != group:
                    if sha:
                        yield pa.RecordBatch.from_pydict({"group": pa.array([group], pa.int32()), "ends": [sha.hexdigest()]})
                    group, sha = g, hashlib.sha256(data)
                else:
                    sha.update(b"," + data)
        if sha:
            yield pa.RecordBatch.from_pydict({"group": pa.array([group], pa.int32()), "ends": [sha.hexdigest()]})

    found = rows.repartition("group").sortWithinPartitions(*order).select("group", "ids").mapInArrow(run, "group int, ends string")
    return {r["group"]: r["ends"] for r in found.collect()}  # a row for each pair of neighbouring partitions at most


_EDGE = "top int, depth int, n long, least long, children long, leaves long, saved long, ends string, words binary, p string, parent_least long"


def _level(rows: DataFrame) -> DataFrame:
    """All edges of the tries of rows (p, digests, words, conv_id, more, b0, b1, b2)."""
    spark, order = rows.sparkSession, ["p", "digests", "more", "conv_id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("p", "digests", "words", "conv_id", "b0", "b1", "b2")
    swept = written(ordered.mapInArrow(_sweep, _SWEPT), "swept")
    records = [r.asDict() for r in swept.filter("kind in ('open', 'part')").collect()]  # a few for each partition
    open_, crossing, leasts = _stitched(records)
    if crossing:
        ends = _hashed_ids(swept, crossing)
        for r in open_:
            r["ends"] = ends.get(r["group"], r["ends"])
    names = [x.split()[0] for x in _EDGE.split(", ")]
    stitched = spark.createDataFrame([tuple(r[c] for c in names) for r in open_], _EDGE)
    edges = swept.filter("kind = 'edge'")
    parents = edges.select("part", F.col("serial").alias("parent"), F.col("least").alias("parent_least"))
    parents = parents.unionByName(spark.createDataFrame(leasts, "part int, parent long, parent_least long"))
    closed = edges.join(parents, ["part", "parent"], "left").select(*names)
    return closed.unionByName(stitched)


def _nodes(edges: DataFrame, base: int) -> DataFrame:
    """A row for each node of the edges; the textless roots only where they are the trie's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in NODES.split(", ")]
        for batch in batches:
            out = []
            for top, depth, n, least, children, leaves, saved, ends, words, _, parent in zip(*[c.to_pylist() for c in batch.columns]):
                counts = np.frombuffer(words, "<i4").tolist()
                for d in range(depth, top, -1):
                    saved += (n - 1) * counts[d - max(top, 0) - 1] if d else 0
                    out.append((least, base + d, parent if d == top + 1 else least, n, children if d == depth else 1, leaves, saved, ends if d == depth else NOTHING))
            types = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 8, types)], names)

    rows = edges.filter("depth > 0") if base else edges
    return rows.mapInArrow(run, NODES)


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 4096) -> DataFrame:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the rebuilt conversations."""
    spark = df.sparkSession
    chunks = _chunks(_rebuilt(_fragments(df, conv, turn, role, text, chunk), chunk), chunk)
    deepest = chunks.agg(F.max("chunk")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], NODES)
    below, found = None, None
    for level in range(deepest, -1, -1):
        rows = chunks.filter(F.col("chunk") == level)
        if below is None:
            rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("b0", "b1", "b2")})
        else:
            ended = rows.filter("not more").withColumns({c: F.lit(None).cast("long") for c in ("b0", "b1", "b2")})
            rows = rows.filter("more").join(below, "next").unionByName(ended)
        edges = _level(rows)
        if deepest:
            edges = written(edges, "edges")
            below = edges.filter("depth = 0").select(F.col("p").alias("next"), F.col("children").alias("b0"), F.col("leaves").alias("b1"), F.col("saved").alias("b2"))
        if level:  # the node that these tries hang from has the members that end in it, too
            above = chunks.filter((F.col("chunk") == level - 1) & F.col("next").isNotNull()).groupBy(F.col("next").alias("p")).agg(F.min("conv_id").alias("node_least"))
            parent = F.when(F.col("top") == 0, F.col("node_least")).otherwise(F.col("parent_least")).alias("parent_least")
            edges = edges.join(above, "p", "left").select(*[c for c in edges.columns if c != "parent_least"], parent)
        nodes = _nodes(edges, level * chunk)
        found = nodes if found is None else found.unionByName(nodes)
    return found
