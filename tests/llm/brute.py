"""Plain Python versions of what the operators of tracelake.llm return."""

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def words(text):
    return WORD.findall(text or "")


def substring(rows, width=20):
    """[(n_words, n_removed, kept)] for (doc_id, text) rows; a null id is larger than all others."""
    first = {}
    key = lambda i: LAST if i is None else i
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            first[k] = min(first.get(k, (LAST, LAST)), (key(i), j))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < (key(i), j):
                gone[j : j + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shared_bytes(rows, width=50):
    """[(n_bytes, n_removed, n_spans, kept)]."""
    first = {}
    key = lambda i: LAST if i is None else i
    texts = [(key(i), (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for j in range(len(b) - width + 1):
            k = b[j : j + width]
            first[k] = min(first.get(k, LAST), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if first[b[j : j + width]] < i:
                gone[j : j + width] = b"\1" * width
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows, percent=75):
    """[(n_shingles, component)] for (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), None if i is None else root(i)) for s, (i, _) in zip(sets, rows)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    t = text or ""
    w = words(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def best_fit(lengths, capacity):
    """Bins of best-fit decreasing, the rooms left searched one by one."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return rooms


def hard_negatives(rows, k=5, m=3):
    """Rows of mined negatives for (vec_id, embedding, label) rows; anchors have an id divisible by 50."""
    good = [(i, [math.floor(256.0 * x) for x in v], c) for i, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, c) in enumerate(good):
        if i is None or i % 50:
            continue
        near = []
        for b, (j, w, d) in enumerate(good):
            if a != b:
                score = max(-LAST + 1, min(LAST - 1, sum(x * y for x, y in zip(v, w))))
                near.append((-score, j is None, j or 0, j, d))
        near.sort(key=lambda x: x[:3])
        for p in [x for x in near if x[4] == c][:k]:
            fits = [x for x in near if x[4] != c and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]][:m]
            out += [(i, p[3], r, x[3], -p[0], -x[0]) for r, x in enumerate(fits, 1)]
    return out


def prefix_trie(rows):
    """Nodes of the rebuilt conversations of (conv_id, turn, role, text) rows."""
    import hashlib
    import zlib

    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), digest, x or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    members, ends = {}, {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        full = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
        ends.setdefault(full, []).append(c)
        for d in range(len(full) + 1):
            members.setdefault(full[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for k in sorted(members, key=len, reverse=True):
        children.setdefault(k, 0)
        leaves[k] = leaves.get(k, 0) or 1
        saved[k] = saved.get(k, 0) + ((len(members[k]) - 1) * len(words(k[-1][1])) if k else 0)
        if k:
            for table, n in ((children, 1), (leaves, leaves[k]), (saved, saved[k])):
                table[k[:-1]] = table.get(k[:-1], 0) + n
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], digest(k)) for k, m in members.items()]
