"""Removal of repeated passages of words, by fixed-block anchors.

A passage of WINDOW words that occurs twice holds, at each of its places, a whole block of WINDOW / 2 words that
begins at a multiple of WINDOW / 2 in its document. These non-overlapping blocks are the index. Every rolling
window of the block's width in the corpus probes it; a block that no other place probes can't lie in a
repeat, and only blocks are answered. Hits are then extended, word by word, to both sides: every passage of WINDOW
words that holds a block that was hit is compared across the corpus in full width (a 64-bit hash within the range
of a second, independent one), and all but the first place of each are removed. Runs of such passages are the
maximal repeats. A hit is extended against all other places of its passages at once, never pair by pair, so a
passage in a third of all documents costs no more than others.

"First" is the smaller id, or the earlier word in the same document. A null id counts as larger than all
others. Rows that share an id are one document to this order: of two equal passages at the same word of both,
neither is earlier. Null, empty and short texts lose nothing. Texts are handled whole, whatever their length.
Other columns pass through; those named n_words, n_removed or kept_text are replaced. An empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .keysets import ANSWER_DDL, SENT, SENT_DDL, answered, answers, in_parts, received, send, shared_keys, table_of
from .shared import column_name, trimmed, unplanes, written

BODY = np.dtype([("doc", "<i8"), ("at", "<i4")])
LAST_ID = np.iinfo(np.int64).max


def _owners(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) % np.uint64(n)


class _Part:
    """Everything that a pass knows of the texts of one part; recomputed from them in every pass."""

    def __init__(self, table: pa.Table, id_: str, text: str, window: int, owners: int):
        self.window, self.block, self.n = window, window // 2, owners
        ids = table[id_].combine_chunks()
        docs = ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.pieces = []  # (first row, last row, data, offsets, word starts, word ends, words before each text)
        hashes, firsts, base = [], [0], 0
        for i, j, data, offsets in tb.chunks(table[text]):
            starts, ends, first = tb.words(data, offsets)
            self.pieces.append((i, j, data, offsets, starts, ends, first))
            hashes.append(tb.word_hashes(data, starts, ends))
            firsts.extend((first[1:] + base).tolist())
            base += len(starts)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.firsts = np.array(firsts)
        self.n_words = np.diff(self.firsts)
        of = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.place = np.arange(len(self.hashes)) - self.firsts[:-1][of] if len(of) else np.empty(0, np.int64)
        self.doc = docs[: len(self.n_words)][of] if len(of) else np.empty(0, np.int64)

    def probes(self):
        """Distinct rolling windows as owner << 32 | key, their flags (twice here, in the index), the windows' places and which key each has."""
        h, at = tb.window_hashes(self.hashes, self.firsts, self.block)
        key = _owners(h, self.n) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        unique, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        flags = np.zeros((len(unique), 2), bool)
        flags[:, 0] = counts > 1
        flags[inverse[self.place[at] % self.block == 0], 1] = True
        return unique, flags, at, inverse

    def repeats(self, returned: pa.Table):
        """The passages that hold a hit block: order of entries, first entry of each class, classes' owners, keys and bodies."""
        unique, flags, at, inverse = self.probes()
        index = np.zeros(len(unique), bool)
        index[flags[:, 1]] = answered(returned, 1, unique[flags[:, 1]] >> np.uint64(32), self.n)
        hit = index[inverse] & (self.place[at] % self.block == 0)
        hits = np.zeros(len(self.hashes) + 1, np.int64)
        hits[at[hit] + 1] = 1
        hits = np.cumsum(hits)  # hit blocks that begin before each word
        windows = tb.window_starts(self.firsts, self.window, len(self.hashes))
        holds = hits[windows + self.window - self.block + 1] > hits[windows]
        windows = windows[holds]
        h = tb.span_hashes(self.hashes, windows, windows + self.window, 0xD6E8FEB86659FD93)
        owner = _owners(tb.span_hashes(self.hashes, windows, windows + self.window, 0xA24BAED4963EE407), self.n)
        doc, place = self.doc[windows], self.place[windows]
        order = np.lexsort((place, doc, h, owner))
        windows, h, owner, doc, place = windows[order], h[order], owner[order], doc[order], place[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        later = (doc != doc[first][which]) | (place != place[first][which]) if len(order) else new
        body = np.empty(len(first), BODY)
        body["doc"], body["at"] = doc[first], place[first]
        return windows, which, later, owner[first], h[first], body


def first_places(sent: DataFrame, step: int) -> DataFrame:
    """For each key of each part, whether an earlier (doc, at) has it."""

    def own(table: pa.Table) -> pa.Table:
        keys, _ = received(table, np.uint64)
        bodies = [unplanes(x.as_py(), BODY) for x in table["body"]]
        key, body = np.concatenate(keys), np.concatenate(bodies)
        doc, at = body["doc"], body["at"]
        order = np.lexsort((at, doc, key))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.empty(len(order), bool)
        later[order] = (doc[order] != doc[first]) | (at[order] != at[first])
        return answers(table, np.split(later, np.cumsum([len(k) for k in keys])[:-1]), step)

    return sent.groupBy("owner").applyInArrow(lambda table: trimmed(own, table), ANSWER_DDL)


def remove_repeats(docs: DataFrame, id_: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """docs with n_words, n_removed (long) and kept_text: the words left, joined by one space."""
    docs = docs.drop("n_words", "n_removed", "kept_text").withColumn(id_, F.col(id_).cast("long"))
    schema = docs.schema
    docs = docs.withColumnsRenamed({c: column_name(docs, c) for c in docs.columns if c.lower() == "part"})
    inner = docs.schema
    table, owners = in_parts(docs, text, [F.col(id_), F.col(text)])

    def probe(key: tuple, rows: pa.Table) -> pa.Table:
        unique, flags, _, _ = _Part(rows, id_, text, window, owners).probes()
        return table_of(list(send(key[0].as_py(), unique >> np.uint64(32), (unique & np.uint64(0xFFFFFFFF)).astype(np.uint32), flags, owners)), SENT)

    def extend(key: tuple, rows: pa.Table, returned: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return SENT.empty_table()
        _, _, _, owner, h, body = _Part(rows, id_, text, window, owners).repeats(returned)
        return table_of(list(send(key[0].as_py(), owner, h, np.zeros(len(h), bool), owners, body)), SENT)

    def cut(key: tuple, rows: pa.Table, returned: pa.Table) -> pa.Table:
        part = _Part(rows, id_, text, window, owners)
        windows, which, later, owner, _, _ = part.repeats(returned)
        gone = later | answered(returned, 2, owner, owners)[which]
        edge = np.zeros(len(part.hashes) + window + 1, np.int32)
        edge[windows[gone]] += 1  # every passage begins at a word of its own
        edge[windows[gone] + window] -= 1
        kept = np.cumsum(edge)[: len(part.hashes)] == 0
        removed = part.n_words - np.add.reduceat(np.append(kept, False), np.minimum(part.firsts[:-1], len(kept))).astype(np.int64) * (part.n_words > 0)
        texts, base = [], 0
        for i, j, data, offsets, starts, ends, first in part.pieces:
            mine = kept[base : base + len(starts)]
            base += len(starts)
            texts.append(joined(data, starts[mine], ends[mine], np.concatenate([[0], np.cumsum(mine)])[first]))
        columns = [rows[f.name].combine_chunks() for f in inner]
        added = [pa.array(part.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.concat_arrays(texts) if texts else pa.array([], pa.string())]
        return pa.Table.from_arrays([*columns, *added], names=[*[f.name for f in inner], "n_words", "n_removed", "kept_text"])

    probed = shared_keys(table.groupBy("part").applyInArrow(lambda key, rows: trimmed(probe, key, rows), SENT_DDL), 1, indexed=True)
    back = written(probed, "answers")
    repeats = first_places(table.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(lambda key, rows, returned: trimmed(extend, key, rows, returned), SENT_DDL), 2)
    both = back.unionByName(written(repeats, "answers"))
    out = T.StructType([*inner.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    found = table.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(lambda key, rows, returned: trimmed(cut, key, rows, returned), out)
    return found.toDF(*schema.names, "n_words", "n_removed", "kept_text")


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """The words of each text joined by one space; firsts are the words before each text."""
    lengths = ends - starts
    gaps = np.ones(len(starts), np.int64)
    filled = firsts[1:][np.diff(firsts) > 0]
    gaps[filled - 1] = 0  # no space after a text's last word
    after = np.concatenate([[0], np.cumsum(lengths + gaps)])
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    space = ends[gaps > 0]
    take = inside
    take[space] = True
    out = data.copy()
    out[space] = 0x20
    out = out[take]
    offsets = after[firsts].astype(np.int32)
    return pa.StringArray.from_buffers(len(firsts) - 1, pa.py_buffer(offsets), pa.py_buffer(out))
