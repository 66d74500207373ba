"""The sequence operators on streams, with state for each key instead of a look-back over what is stored.

Each takes the arguments of its namesake in ``operators.sequence`` and gives, whatever the batches are, the rows that that one
gives on the whole table. Between batches a key keeps what its next row can need: the last n failures, the latest time of
each value, the time of the last alert. State that no row can need any more goes with the watermark, so keys that
fall silent cost nothing.

With ``delay``, rows may come in any order within that time: they wait in the state store until the watermark has passed
them, and are then taken in order; later ones are left out, as by every streaming aggregation. So the rows of the last
``delay`` are told when newer ones have come. Without it, batches must follow each other in time, as from a log that is read in
order: every batch is evaluated at once, and a row that is earlier than its key's last one is left out.

Rows without a timestamp are left out. All columns of a row go through Python: give these functions no more than the result needs. The state store is RocksDB, which these functions select for the session.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict, deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.times import micros

SECOND = 1_000_000
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELPERS = ("__t", "__failure", "__success", "__counted", "__at")


class Sequence:
    """The last n failures since the last success."""

    def __init__(self, n: int, within: int, uid: str, uid_type: T.DataType):
        self.n, self.width, self.uid = n, within * SECOND, uid
        self.schema = T.StructType([T.StructField("times", T.ArrayType(T.LongType())), T.StructField("uids", T.ArrayType(uid_type))])
        self.added = [T.StructField("evidence", T.ArrayType(uid_type))]

    def load(self, state: tuple | None) -> None:
        self.last = deque(zip(*state), self.n) if state else deque((), self.n)

    def dump(self) -> tuple | None:
        return ([t for t, _ in self.last], [u for _, u in self.last]) if self.last else None

    def step(self, t: int, row: Row) -> tuple | None:
        if not row["__success"]:
            self.last.append((t, row[self.uid]))
            return None
        fires = len(self.last) == self.n and t - self.last[0][0] <= self.width
        evidence = [u for _, u in self.last] + [row[self.uid]]
        self.last.clear()
        return (evidence,) if fires else None

    def needed_until(self) -> int | None:
        return self.last[-1][0] + self.width if self.last else None

    def expire(self, t: int) -> None:
        while self.last and t - self.last[0][0] > self.width:
            self.last.popleft()


class Burst(Sequence):
    """The last n - 1 events, whatever they led to."""

    def __init__(self, n: int, within: int, uid: str, uid_type: T.DataType):
        super().__init__(n - 1, within, uid, uid_type)

    def step(self, t: int, row: Row) -> tuple | None:
        fires = len(self.last) == self.n and (not self.n or t - self.last[0][0] <= self.width)
        evidence = [u for _, u in self.last] + [row[self.uid]]
        self.last.append((t, row[self.uid]))
        return (evidence,) if fires else None


class BurstOnce(Burst):
    """The last n - 1 events, and until when the key stays silent: the first event of a burst fires, and the next one after the silence."""

    def __init__(self, n: int, within: int, uid: str, uid_type: T.DataType, silent: int):
        super().__init__(n, within, uid, uid_type)
        self.silence = Cooldown(silent)
        self.schema = T.StructType([*self.schema.fields, *Cooldown.schema.fields])

    def load(self, state: tuple | None) -> None:
        super().load(state[:2] if state else None)
        self.silence.load(state[2:] if state else None)

    def dump(self) -> tuple | None:
        last, silent = super().dump(), self.silence.dump()
        return (*(last or ([], [])), *(silent or (None,))) if last or silent else None

    def step(self, t: int, row: Row) -> tuple | None:
        fires = super().step(t, row)
        return fires if fires and self.silence.step(t, row) is not None else None

    def needed_until(self) -> int | None:
        return max(x for x in (super().needed_until(), self.silence.needed_until()) if x is not None)

    def expire(self, t: int) -> None:
        super().expire(t)
        self.silence.expire(t)


class Distinct:
    """The latest time of each value, oldest first."""

    def __init__(self, value: str, within: int, value_type: T.DataType):
        self.value, self.width = value, within * SECOND
        self.schema = T.StructType([T.StructField("values", T.ArrayType(value_type)), T.StructField("times", T.ArrayType(T.LongType()))])
        self.added = [T.StructField("distinct_values", T.LongType())]

    def load(self, state: tuple | None) -> None:
        self.seen = OrderedDict(zip(*state)) if state else OrderedDict()

    def dump(self) -> tuple | None:
        return (list(self.seen), list(self.seen.values())) if self.seen else None

    def step(self, t: int, row: Row) -> tuple:
        v = row[self.value]
        if v is not None:
            self.seen[v] = t
            self.seen.move_to_end(v)
        self.expire(t)
        return (len(self.seen),)

    def needed_until(self) -> int | None:
        return next(reversed(self.seen.values())) + self.width if self.seen else None

    def expire(self, t: int) -> None:
        while self.seen and t - next(iter(self.seen.values())) > self.width:
            self.seen.popitem(last=False)


class Cooldown:
    """Until when the key stays silent."""

    schema = T.StructType([T.StructField("silent_to", T.LongType())])
    added: list[T.StructField] = []

    def __init__(self, within: int):
        self.width = within * SECOND

    def load(self, state: tuple | None) -> None:
        self.silent_to = state[0] if state else None

    def dump(self) -> tuple | None:
        return None if self.silent_to is None else (self.silent_to,)

    def step(self, t: int, row: Row) -> tuple | None:
        if self.silent_to is not None and t <= self.silent_to:
            return None
        self.silent_to = t + self.width
        return ()

    def needed_until(self) -> int | None:
        return self.silent_to

    def expire(self, t: int) -> None:
        if self.silent_to is not None and t > self.silent_to:
            self.silent_to = None


class InOrder(StatefulProcessor):
    """Hands a key's rows to one or more folds in the order of time and ``order``; nulls come first in it.

    A fold with a column beside it sees the rows where that one is true. The states of all folds, and the time of the last row
    of each, are one value: a key costs one read and one write of the state store in a batch.
    """

    def __init__(self, folds: list[tuple], rows: list[str], order: list[str], out: list[str], waits: bool):
        self.folds, self.rows, self.order, self.out, self.waits = folds, rows, order, out, waits
        fields = [T.StructField(f"{f.name}_{i}", f.dataType) for i, (fold, _) in enumerate(folds) for f in [*fold.schema.fields, T.StructField("last", T.LongType())]]
        self.schema = T.StructType(fields)

    def init(self, handle) -> None:
        self.handle = handle
        if self.waits:
            # Rows as bytes: the state store's Python side gives no maps back.
            self.waiting = handle.getListState("waiting", T.StructType([T.StructField("t", T.LongType()), T.StructField("row", T.BinaryType())]))
        self.state = handle.getValueState("folds", self.schema)

    def close(self) -> None:
        pass

    def sort_key(self, row) -> tuple:
        return (row["__t"], *[(row[c] is not None, row[c] if row[c] is not None else 0) for c in self.order])

    def load(self, state: tuple | None) -> list[int | None]:
        """Sets the folds to what is stored and gives the time of each one's last row."""
        last, at = [], 0
        for fold, _ in self.folds:
            n = len(fold.schema.fields)
            part = tuple(state[at : at + n]) if state is not None else ()
            fold.load(part if any(x is not None for x in part) else None)
            last.append(state[at + n] if state is not None else None)
            at += n + 1
        return last

    def tell(self, rows: list, known_to: int | None) -> Iterator[Row]:
        """What the folds say to these rows; then their state is stored, without what is over at ``known_to``."""
        state = self.state.get()
        last = self.load(state)
        result = Row(*self.out)
        for row in sorted(rows, key=self.sort_key):
            t = row["__t"]
            for i, (fold, sees) in enumerate(self.folds):
                if (sees is not None and not row[sees]) or (not self.waits and last[i] is not None and t < last[i]):
                    continue
                last[i] = None if self.waits else t
                more = fold.step(t, row)
                if more is not None:
                    more = more if len(self.folds) == 1 else (i, *more)
                    yield result(*[row[c] for c in self.out[: len(self.out) - len(more)]], *more)
        left, until = [], []
        for (fold, _), t in zip(self.folds, last):
            if known_to is not None:
                fold.expire(known_to)
            kept = fold.dump()
            if kept is not None:
                until.append(fold.needed_until())
            left += [*(kept if kept is not None else [None] * len(fold.schema.fields)), t]
        if all(x is None for x in left):
            if state is not None:
                self.state.clear()
            return
        self.state.update(tuple(left))
        if self.waits:
            self.wake(max(until) + 1)

    def wake(self, t: int) -> None:
        self.handle.registerTimer(-(-t // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.waits:
            here = list(rows)
            self.waiting.appendList([(r["__t"], pickle.dumps(tuple(r))) for r in here])
            self.wake(min(r["__t"] for r in here))
            return
        yield from self.tell(list(rows), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known_to = timerValues.getCurrentWatermarkInMs() * 1000
        kept = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = [Row(*self.rows)(*pickle.loads(row)) for t, row in kept if t <= known_to]
        later = [r for r in kept if r[0] > known_to]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.wake(min(t for t, _ in later))
        yield from self.tell(due, known_to)


def _folded(df: DataFrame, keys: list[str], order: list[str], folds: list[tuple], delay: str | None, only: Column | None = None) -> DataFrame:
    """``folds``: each with the column of the rows that it sees, or None for all; with several, all add the same columns, and ``which`` is the number
    of the one that fired. ``only`` are the rows that any fold sees; time passes with the others, too.
    """
    spark, names = df.sparkSession, [c for c in df.columns if c not in HELPERS]
    if spark.conf.get(PROVIDER, None) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    rows = df.filter(F.col("__t").isNotNull())
    if delay is not None:
        rows = rows.withColumn("__at", F.timestamp_micros("__t")).withWatermark("__at", delay)
        only = None if only is None else F.when(F.col("__at").isNotNull(), only)  # so it isn't moved below the watermark
    rows = (rows if only is None else rows.filter(only)).drop("__failure")
    which = [T.StructField("which", T.IntegerType())] if len(folds) > 1 else []
    out = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name in names] + which + folds[0][0].added)
    processor = InOrder(folds, rows.columns, order, out.names, delay is not None)
    return rows.groupBy(*keys).transformWithState(processor, out, "Append", "None" if delay is None else "EventTime")


def _outcomes(df: DataFrame, ts: str, failure: Column, success: Column) -> DataFrame:
    return df.withColumn("__success", F.coalesce(success, F.lit(False))).withColumn("__failure", F.coalesce(failure, F.lit(False))).withColumn("__t", micros(F.col(ts)))


def followed_by(df: DataFrame, keys: list[str], ts: str, order: list[str], failure: Column, success: Column, n: int, within: int, uid: str, delay: str | None = None) -> DataFrame:
    rows = _outcomes(df, ts, failure, success)
    return _folded(rows, keys, order, [(Sequence(n, within, uid, df.schema[uid].dataType), None)], delay, F.col("__failure") | F.col("__success"))


def followed_by_and_burst_once(
    df: DataFrame, keys: list[str], ts: str, order: list[str], failure: Column, success: Column, n: int, within: int, counted: Column, burst_n: int, burst_within: int, silent: int, uid: str, kept: list[str], delay: str | None = None
) -> DataFrame:
    """followed_by, and burst_once of the ``counted`` failures, by one pass over the rows with one state for a key: ``which`` is 0 and 1.

    Of the columns, keys, order, uid and ``kept`` go through the state.
    """
    rows = _outcomes(df, ts, failure, success).withColumn("__counted", F.coalesce(counted, F.lit(False)) & F.col("__failure"))
    rows = rows.select(*dict.fromkeys([*keys, *order, uid, *kept]), "__success", "__failure", "__counted", "__t")
    kind = df.schema[uid].dataType
    folds = [(Sequence(n, within, uid, kind), None), (BurstOnce(burst_n, burst_within, uid, kind, silent), "__counted")]
    return _folded(rows, keys, order, folds, delay, F.col("__failure") | F.col("__success"))


def burst(df: DataFrame, keys: list[str], ts: str, order: list[str], n: int, within: int, uid: str, delay: str | None = None) -> DataFrame:
    return _folded(df.withColumn("__t", micros(F.col(ts))), keys, order, [(Burst(n, within, uid, df.schema[uid].dataType), None)], delay)


def burst_once(df: DataFrame, keys: list[str], ts: str, order: list[str], n: int, within: int, silent: int, uid: str, delay: str | None = None) -> DataFrame:
    """sequence.cooldown of sequence.burst with one state: of a key's bursts one fires in ``silent`` seconds."""
    return _folded(df.withColumn("__t", micros(F.col(ts))), keys, order, [(BurstOnce(n, within, uid, df.schema[uid].dataType, silent), None)], delay)


def distinct_in_window(df: DataFrame, keys: list[str], ts: str, order: list[str], value: str, within: int, delay: str | None = None) -> DataFrame:
    return _folded(df.withColumn("__t", micros(F.col(ts))), keys, order, [(Distinct(value, within, df.schema[value].dataType), None)], delay)


def cooldown(df: DataFrame, keys: list[str], ts: str, order: list[str], within: int, delay: str | None = None) -> DataFrame:
    return _folded(df.withColumn("__t", micros(F.col(ts))), keys, order, [(Cooldown(within), None)], delay)
