"""Removal of byte strings that a document with a smaller id also has, by suffix sorting.

Every string of WIDTH bytes belongs to the least hashed GRAM bytes within it, its anchor, so equal strings meet
at equal anchors; consecutive strings with one anchor are a run, about one for fourteen bytes. Three exchanges
narrow the runs down. First, anchors that only one document has are dropped. Second, runs whose whole bytes
agree are settled by their smallest id, and so are anchors around which all documents have the same bytes.
What is left are runs at the edges of repeats. The suffixes in them are sorted deep-shallow: multikey
quicksort, a machine word at a time, to SHALLOW words; then the groups that still agree are put into blind
tries, which look only at the byte where a group first branches, until all WIDTH bytes are told apart. Strings
that remain together are equal, and all but those of the smallest id are removed.

The runs of one anchor are sorted in one task, unless it is hot: an anchor that stands in more than HOT different
surroundings, as within a passage of very many documents. Runs of hot anchors are sent string by string to the
owner of the string's own hash, each different string of a part once with its smallest id, and are sorted there.

Matches never cross documents and are judged on the input. A null id counts as larger than all others and rows
of one id never count against each other. Null texts count as empty. Texts are handled whole. Other columns pass
through; n_bytes, n_removed, n_spans and kept are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .keysets import ANSWER_DDL, SENT, SENT_DDL, answered, answers, in_parts, received, send, table_of
from .shared import column_name, trimmed, unplanes, written

WIDTH, GRAM = 50, 24
#: Strings of WIDTH bytes that hold a given gram; no run is longer.
REACH = WIDTH - GRAM + 1
#: Bytes that a run's strings cover at most, rounded up to words.
COVER = -(-(WIDTH + REACH - 1) // 8) * 8
#: 8-byte words that multikey quicksort orders before the blind tries take over.
SHALLOW = 2
#: Different surroundings of an anchor, summed over parts, up to which all its strings are sorted together.
HOT = 4096
#: Strings that are sorted at a time, at most HOT * REACH more.
SLICE = 100_000
LAST_ID = np.iinfo(np.int64).max

RUN = np.dtype([("hash", "<u8"), ("doc", "<i8")])
EDGE = np.dtype([("n", "u1"), ("doc", "<i8"), ("bytes", "u1", (COVER,))])
STRING = np.dtype([("doc", "<i8"), ("bytes", "u1", (WIDTH,))])


def _hash_words(words: list[np.ndarray], salt: int = 0) -> np.ndarray:
    total = np.full(len(words[0]), salt, np.uint64)
    for i, w in enumerate(words):
        total += w * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
        total ^= total >> np.uint64(29)
    return tb.mix(total)


def anchored_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first string, strings, text) of the runs of WIDTH-byte strings in data."""
    empty = np.empty(0, np.int64)
    if len(data) < WIDTH:
        return empty.astype(np.uint64), empty, empty, empty
    last = len(data) - 7
    word = np.ndarray((last,), "<u8", data.tobytes(), 0, (1,)).copy()
    h = _hash_words([word[: last - 16], word[8 : last - 8], word[16:]])  # of the GRAM bytes from each place
    least, span = h, 1
    while span * 2 <= REACH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (REACH - span)], least[REACH - span :]) if span < REACH else least
    ok = np.ones(len(least), bool)  # strings [j, j + WIDTH); least has one for each
    for e in offsets[1:-1]:
        ok[max(0, e - WIDTH + 1) : e] = False
    at = np.flatnonzero(ok)
    if not len(at):
        return empty.astype(np.uint64), empty, empty, empty
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1])
    begins = np.flatnonzero(new)
    within = np.arange(len(at)) - begins[np.cumsum(new) - 1]
    begins = np.flatnonzero(within % REACH == 0)
    first, n = at[begins], np.diff(np.append(begins, len(at)))
    return value[begins], first, n, np.searchsorted(offsets, first, "right") - 1


class _Part:
    """The runs of one part, computed anew in every pass."""

    def __init__(self, table: pa.Table, id_: str, text: str, owners: int):
        self.n_owners = owners
        ids = table[id_].combine_chunks().fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.pieces, anchors, runs, docs = [], [], [], []
        for i, j, data, offsets in tb.chunks(table[text]):
            value, first, n, which = anchored_runs(data, offsets)
            self.pieces.append((data, offsets, len(value)))
            anchors.append(value)
            runs.append(np.stack([np.full(len(first), len(self.pieces) - 1), first, n]) if len(first) else np.empty((3, 0), np.int64))
            docs.append(ids[i + which])
        none = np.empty(0, np.int64)
        anchor = np.concatenate(anchors) if anchors else none.astype(np.uint64)
        self.piece, self.first, self.n = np.concatenate(runs, 1).astype(np.int64) if runs else (none, none, none)
        self.doc = np.concatenate(docs) if docs else none
        self.key = (anchor >> np.uint64(32)) % np.uint64(owners) << np.uint64(32) | (anchor & np.uint64(0xFFFFFFFF))

    def anchors(self):
        """Distinct keys, whether two documents of the part have one, and each run's key."""
        unique, inverse = np.unique(self.key, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        begins = np.searchsorted(inverse[order], np.arange(len(unique)))
        doc = self.doc[order]
        several = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins) if len(unique) else np.empty(0, bool)
        return unique, several, inverse

    def covers(self, runs: np.ndarray) -> np.ndarray:
        """The bytes that the strings of runs cover, filled up with zeros."""
        out = np.zeros((len(runs), COVER), np.uint8)
        for p in np.unique(self.piece[runs]):
            mine = np.flatnonzero(self.piece[runs] == p)
            padded = np.concatenate([self.pieces[p][0], np.zeros(COVER, np.uint8)])
            views = np.lib.stride_tricks.as_strided(padded, (len(self.pieces[p][0]), COVER), (1, 1))
            out[mine] = views[self.first[runs[mine]]]
        out[np.arange(COVER) >= (self.n[runs] + WIDTH - 1)[:, None]] = 0
        return out

    def contexts(self, returned: pa.Table):
        """Distinct (key, bytes) of the runs that other documents may share: runs, their context, and each context's key, hash, smallest id and first run."""
        unique, _, inverse = self.anchors()
        runs = np.flatnonzero(answered(returned, 1, unique >> np.uint64(32), self.n_owners)[inverse])
        words = self.covers(runs).view("<u8")
        h = _hash_words([words[:, i] for i in range(words.shape[1])] + [self.n[runs].astype(np.uint64)], 1)
        order = np.lexsort((self.doc[runs], h, self.key[runs]))
        runs, h = runs[order], h[order]
        key = self.key[runs]
        new = np.ones(len(runs), bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        return runs, np.cumsum(new) - 1, key[first], h[first], self.doc[runs[first]] if len(runs) else self.doc[:0], runs[first]


    def strings(self, runs: np.ndarray, docs: np.ndarray):
        """The strings of runs with these ids, sorted: their run and step, their entry, whether their entry has a smaller id, and the entries' keys, ids and bytes."""
        n = self.n[runs]
        run, step, found = _strings(self.covers(runs), n)
        words = found.view("<u8")
        h = _hash_words([words[:, i] for i in range(words.shape[1])], 2)
        key = (h >> np.uint64(32)) % np.uint64(self.n_owners) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        doc = docs[run]
        order = np.lexsort((doc, h, key))
        run, step, found, key, doc = run[order], step[order], found[order], key[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (found[1:] != found[:-1]).any(1)
        first = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        return run, step, which, doc > doc[first][which] if len(order) else new, key[first], doc[first], found[first, :WIDTH]


def _strings(covers: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, step, bytes, filled up with zeros to whole words) of all strings of runs of n strings."""
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    flat = np.concatenate([np.ascontiguousarray(covers).ravel(), np.zeros(64, np.uint8)])
    found = np.lib.stride_tricks.as_strided(flat, (len(flat) - 63, 56), (1, 1))[run * COVER + step]
    found[:, WIDTH:] = 0
    return run, step, found


def settle(sent: DataFrame) -> DataFrame:
    """For each context: (step 2) a smaller id has the same bytes; (step 3) none has, but other bytes stand around the anchor elsewhere; (step 5) very many."""

    def own(table: pa.Table) -> pa.Table:
        keys, _ = received(table, np.uint32)
        bodies = [unplanes(x.as_py(), RUN) for x in table["body"]]
        key, body = np.concatenate(keys), np.concatenate(bodies)
        h, doc = body["hash"], body["doc"]
        order = np.lexsort((doc, h, key))
        k, c = key[order], h[order]
        new_key = np.ones(len(order), bool)
        new_key[1:] = k[1:] != k[:-1]
        new = new_key.copy()
        new[1:] |= c[1:] != c[:-1]
        later = np.empty(len(order), bool)
        later[order] = doc[order] != doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))
        open_ = np.empty(len(order), bool)
        open_[order] = (kinds > 1)[np.cumsum(new_key) - 1]
        open_ &= ~later
        hot = np.empty(len(order), bool)
        hot[order] = (kinds > HOT)[np.cumsum(new_key) - 1]
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        return pa.concat_tables([answers(table, np.split(x, cuts), k) for k, x in ((2, later), (3, open_), (5, open_ & hot))])

    return sent.groupBy("owner").applyInArrow(lambda table: trimmed(own, table), ANSWER_DDL)


def multikey_quicksort(words: np.ndarray, order: np.ndarray, segment: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings of each segment by their first ``depth`` words, all segments at a time.

    In each round every unsorted segment parts into smaller, equal and larger around a pivot's word; equal
    ones go on with the next word. Returns the order and segments of equal strings.
    """
    level = np.zeros(len(order), np.int64)
    done = np.zeros(len(order), bool)
    while True:
        begins = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        sizes = np.diff(np.append(begins, len(segment)))
        active = np.repeat(sizes > 1, sizes) & (level < depth) & ~done
        if not active.any():
            return order, segment
        at = np.flatnonzero(active)
        w = words[order[at], level[at]]
        head = np.flatnonzero(np.append(True, segment[at][1:] != segment[at][:-1]))
        size = np.diff(np.append(head, len(at)))
        picks = np.stack([w[head], w[head + size // 2], w[head + size - 1]])
        pivot = np.repeat(np.sort(picks, 0)[1], size)
        side = np.where(w < pivot, 0, np.where(w == pivot, 1, 2))
        moved = np.argsort(np.repeat(np.arange(len(head)), size) * 3 + side, kind="stable")
        order[at], level[at] = order[at][moved], (level[at] + (side == 1))[moved]
        parted = np.repeat(np.arange(len(head)), size) * 3 + side[moved]
        starts = np.append(True, segment[1:] != segment[:-1])
        inner = np.flatnonzero(np.append(False, (parted[1:] != parted[:-1]) & (at[1:] == at[:-1] + 1)))
        starts[at[inner]] = True
        segment = np.cumsum(starts) - 1


def blind_tries(words: np.ndarray, order: np.ndarray, segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tells the strings of each segment apart, each by a blind trie, all tries a level at a time.

    A node skips to the first byte at which any of its strings differs from the first one and branches on
    that byte alone; nodes whose strings don't differ are leaves.
    """
    bytes_ = np.ascontiguousarray(words.astype(">u8")).view(np.uint8).reshape(len(words), -1)
    leaf = np.zeros(len(order), bool)
    while True:
        starts = np.append(True, segment[1:] != segment[:-1])
        begins = np.flatnonzero(starts)
        sizes = np.diff(np.append(begins, len(segment)))
        at = np.flatnonzero(np.repeat(sizes > 1, sizes) & ~leaf)
        if not len(at):
            return order, segment
        head = np.flatnonzero(np.append(True, segment[at][1:] != segment[at][:-1]))
        size = np.diff(np.append(head, len(at)))
        node = np.repeat(np.arange(len(head)), size)
        mine = order[at]
        differs = words[mine] != words[mine[head]][node]
        column = np.where(differs.any(1), differs.argmax(1), words.shape[1])
        some = column < words.shape[1]
        skip = np.full(len(mine), width)
        x = words[mine[some], column[some]] ^ words[mine[head][node[some]], column[some]]
        zeros = sum((x < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        skip[some] = column[some] * 8 + zeros
        branch = np.minimum.reduceat(skip, head)  # the depth at which each node branches
        leaf[at] = branch[node] >= width
        go = branch[node] < width
        if not go.any():
            return order, segment
        byte = bytes_[mine, np.minimum(branch[node], width - 1)].astype(np.int64)
        moved = np.argsort(node * 256 + np.where(go, byte, 0), kind="stable")
        order[at] = mine[moved]
        parted = (node * 256 + np.where(go, byte, 0))[moved]
        inner = np.flatnonzero(np.append(False, (parted[1:] != parted[:-1]) & (at[1:] == at[:-1] + 1)))
        starts[at[inner]] = True
        segment = np.cumsum(starts) - 1


def equal_strings(words: np.ndarray, classes: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the strings of each class sorted, and a number for each place of the order that equal strings share.

    ``words`` are the strings as rows of big-endian numbers, ``classes`` ascend.
    """
    order = np.arange(len(words))
    segment = np.cumsum(np.append(True, classes[1:] != classes[:-1])) - 1
    order, segment = multikey_quicksort(words, order, segment, SHALLOW)
    return blind_tries(words, order, segment, width)


def _slices(ends: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries in the order of their keys, with whole keys and about SLICE strings each; ends are the strings up to each entry's end."""
    changes = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    a = 0
    while a < len(keys):
        full = np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")
        b = changes[np.searchsorted(changes, full, "right") - 1]
        if b <= a:
            b = changes[np.searchsorted(changes, a, "right")]
        yield a, int(b)
        a = int(b)


def _later(strings: np.ndarray, classes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each string, whether an equal one of its class has a smaller id. Classes ascend."""
    order, group = equal_strings(strings.view(">u8").astype(np.uint64), classes)
    doc = doc[order]
    least = np.minimum.reduceat(doc, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    out = np.empty(len(order), bool)
    out[order] = doc > least[group - group[0]]
    return out


def sort_edges(sent: DataFrame, owners: int) -> DataFrame:
    """Whether a smaller id has it too: (step 4) for each string of each run, 32 bits a run; (step 6) for each string.

    Runs come to the first ``owners`` owners, strings of hot anchors to as many further ones.
    """

    def own(table: pa.Table) -> pa.Table:
        single = table["owner"][0].as_py() >= owners
        keys, _ = received(table, np.uint32)
        bodies = [unplanes(x.as_py(), STRING if single else EDGE) for x in table["body"]]
        key, body = np.concatenate(keys), np.concatenate(bodies)
        by_key = np.argsort(key, kind="stable")
        n = np.ones(len(key), np.int64) if single else body["n"].astype(np.int64)
        found = np.zeros((len(key), 1 if single else 32), bool)
        for a, b in _slices(np.cumsum(n[by_key]), key[by_key]):
            at = by_key[a:b]
            if single:
                run, step, strings = np.arange(b - a), 0, np.zeros((b - a, 56), np.uint8)
                strings[:, :WIDTH] = body["bytes"][at]
            else:
                run, step, strings = _strings(body["bytes"][at], n[at])
            found[at[run], step] = _later(strings, key[at][run], body["doc"][at][run])
        return answers(table, [x.ravel() for x in np.split(found, np.cumsum([len(k) for k in keys])[:-1])], 6 if single else 4)

    return sent.groupBy("owner").applyInArrow(lambda table: trimmed(own, table), ANSWER_DDL)


def two_documents(sent: DataFrame) -> DataFrame:
    """Step 1: whether two documents have an anchor: two parts, or two documents of a part. Rows of one id may
    lie in two parts and let an anchor through needlessly; the later steps compare ids."""
    from .keysets import shared_keys

    return shared_keys(sent, 1)


def remove_shared(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (long) and kept (the bytes left, which may cut a character)."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept").withColumn(id_, F.col(id_).cast("long"))
    names = docs.columns
    docs = docs.withColumnsRenamed({c: column_name(docs, c) for c in names if c.lower() == "part"})
    inner = docs.schema
    table, owners = in_parts(docs, text, [F.col(id_), F.col(text)])
    low = np.uint64(0xFFFFFFFF)

    def anchors(key: tuple, rows: pa.Table) -> pa.Table:
        unique, twice, _ = _Part(rows, id_, text, owners).anchors()
        return table_of(list(send(key[0].as_py(), unique >> np.uint64(32), (unique & low).astype(np.uint32), twice, owners)), SENT)

    def contexts(key: tuple, rows: pa.Table, returned: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return SENT.empty_table()
        _, _, k, h, doc, _ = _Part(rows, id_, text, owners).contexts(returned)
        body = np.empty(len(k), RUN)
        body["hash"], body["doc"] = h, doc
        return table_of(list(send(key[0].as_py(), k >> np.uint64(32), (k & low).astype(np.uint32), np.zeros(len(k), bool), owners, body)), SENT)

    def edges(key: tuple, rows: pa.Table, returned: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return SENT.empty_table()
        part = _Part(rows, id_, text, owners)
        _, _, k, _, doc, first = part.contexts(returned)
        open_, hot = (answered(returned, step, k >> np.uint64(32), owners) for step in (3, 5))
        open_ &= ~hot
        body = np.empty(open_.sum(), EDGE)
        body["n"], body["doc"], body["bytes"] = part.n[first[open_]], doc[open_], part.covers(first[open_])
        out = list(send(key[0].as_py(), k[open_] >> np.uint64(32), (k[open_] & low).astype(np.uint32), np.zeros(len(body), bool), owners, body))
        if hot.any():
            _, _, _, _, k, doc, bytes_ = part.strings(first[hot], doc[hot])
            body = np.empty(len(k), STRING)
            body["doc"], body["bytes"] = doc, bytes_
            out += [r | {"owner": r["owner"] + owners} for r in send(key[0].as_py(), k >> np.uint64(32), (k & low).astype(np.uint32), np.zeros(len(k), bool), owners, body)]
        return table_of(out, SENT)

    def cut(key: tuple, rows: pa.Table, returned: pa.Table) -> pa.Table:
        part = _Part(rows, id_, text, owners)
        runs, which, k, _, doc, first = part.contexts(returned)
        owner = k >> np.uint64(32)
        later, open_, hot = (answered(returned, step, owner, owners) for step in (2, 3, 5))
        open_ &= ~hot
        each = np.zeros((len(k), 32), bool)
        each[open_] = answered(returned, 4, owner[open_], owners, 32)
        if hot.any():
            run, step, entry, larger, string_key, _, _ = part.strings(first[hot], doc[hot])
            away = answered(returned, 6, (string_key >> np.uint64(32)) + np.uint64(owners), 2 * owners)
            each[np.flatnonzero(hot)[run], step] = larger | away[entry]
        each[later] = True
        gone = each[which]
        gone[part.doc[runs] > doc[which]] = True  # the part's own smaller id has the same bytes
        gone &= np.arange(32) < part.n[runs][:, None]
        columns = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for p, (data, offsets, _) in enumerate(part.pieces):
            mine = part.piece[runs] == p
            run, step = np.nonzero(gone[mine])
            at = part.first[runs[mine]][run] + step
            edge = np.zeros(len(data) + WIDTH + 1, np.int32)
            edge[at] += 1  # every string begins at a place of its own
            edge[at + WIDTH] -= 1
            removed = np.cumsum(edge)[: len(data)] > 0
            begins = removed.copy()
            begins[1:] &= ~removed[:-1]
            inside = offsets[(offsets > 0) & (offsets < len(data))]
            begins[inside] |= removed[inside]  # a run ends with its document
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]).astype(np.int64)  # noqa: B023, E731
            n, m = np.diff(offsets), total(removed)
            columns["n_bytes"].append(pa.array(n, pa.int64()))
            columns["n_removed"].append(pa.array(m, pa.int64()))
            columns["n_spans"].append(pa.array(total(begins), pa.int64()))
            ends = np.concatenate([[0], np.cumsum(n - m)]).astype(np.int32)
            columns["kept"].append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data[~removed])]))
        added = {c: pa.concat_arrays(x) if x else pa.array([], pa.binary() if c == "kept" else pa.int64()) for c, x in columns.items()}
        return pa.Table.from_arrays([*[rows[f.name].combine_chunks() for f in inner], *added.values()], names=[*[f.name for f in inner], *added])

    def pass_over(f, back: DataFrame) -> DataFrame:
        return table.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(lambda key, rows, returned: trimmed(f, key, rows, returned), SENT_DDL)

    back = written(two_documents(table.groupBy("part").applyInArrow(lambda key, rows: trimmed(anchors, key, rows), SENT_DDL)), "anchors")
    back = back.unionByName(written(settle(pass_over(contexts, back)), "contexts"))
    back = back.unionByName(written(sort_edges(pass_over(edges, back), owners), "edges"))
    added = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())]
    found = table.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(lambda key, rows, returned: trimmed(cut, key, rows, returned), T.StructType([*inner.fields, *added]))
    return found.toDF(*names, "n_bytes", "n_removed", "n_spans", "kept")
