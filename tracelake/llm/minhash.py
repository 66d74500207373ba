"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its shingles of five words, or of the whole word sequence if it has fewer. Its minwise
tokens are the least hashes of the set under independent hash functions. A tree starts from one of them: documents
with the same token share a node. A node of few documents is compared exhaustively; a larger one branches by two
further tokens that the node chooses, and so on. A pair of similarity s is together at the first level with
probability s, and each later level keeps it with probability 1 - (1 - s)^2 or so; TREES independent trees miss
a pair of similarity 0.75 with a probability below 1e-6 where nodes are small.

So that groups of thousands of copies don't make all their pairs, every document of a node is first compared with
one document of it, and linked documents become components. From then on only pairs of different components
count: a node lists them all where they are few for its size; a larger one is given another such star. Where
few documents then remain outside a node's main component, these are compared with all of the crowd, block by
block; other nodes branch. Documents that resemble each other below the threshold share most branches, so that
branching gives more comparisons than it saves: nodes whose branches don't have clearly fewer pairs between
components, and all large nodes of the last level, are compared block by block too. Candidates whose minwise
tokens agree too seldom for the threshold, by a margin of five deviations, are left out; all others are compared
on their full sets. Texts of equal word sequences are one vertex from the beginning.

A null or blank text has an empty set and links with nothing. Rows without an id have no component (null) and
are kept. Rows that share an id are one vertex, linked by any of their texts. Other columns pass through; those
named n_shingles, component_id or kept are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .graph import components
from .shared import HOT_ROWS, joined_by_key, trimmed, written

SHINGLE = 5
#: Minwise tokens of a document, trees, and tokens by which a larger node branches.
TOKENS, TREES, BRANCHES = 48, 12, 2
#: Comparisons for each document up to which a node's pairs are listed, and levels; at the last level larger
#: nodes are compared in blocks.
SMALL, DEPTH = 48, 8
#: Pairs between components in a node's branches, of those in the node, up to which it branches.
BRANCHED = 0.75
#: Documents outside a crowd's main component up to which they are compared with the whole crowd, in blocks.
OUTSIDE = 4096
#: The same for the comparison of their tokens alone, which comes first.
OUTSIDE_SKETCHED = 32768
#: Rows of pairs or blocks up to which they are broadcast to texts and sketches: some megabytes.
FEW_ROWS = 150_000
#: Documents of a side of a comparison task, of texts and of tokens alone.
GROUP, SKETCH_GROUP = 256, 4096

_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(6).integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(first row, each text's distinct shingle hashes, two hashes of each text's word sequence) for slices of the column."""
    for i, _, data, offsets in tb.chunks(column):
        starts, ends, firsts = tb.words(data, offsets)
        h = tb.word_hashes(data, starts, ends, lower=True)
        shingles, at = tb.window_hashes(h, firsts, SHINGLE)
        cuts = np.searchsorted(at, firsts)
        one, two = tb.span_hashes(h, firsts[:-1], firsts[1:], 0xD6E8FEB86659FD93), tb.span_hashes(h, firsts[:-1], firsts[1:], 0xA24BAED4963EE407)
        sets = []
        for k, n in enumerate(np.diff(firsts)):
            sets.append(np.unique(shingles[cuts[k] : cuts[k + 1]]) if n >= SHINGLE else one[k : k + 1] if n else one[:0])
        yield i, sets, one, two


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of non-empty sets, a row each."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), TOKENS), np.uint64)
    for k in range(TOKENS):
        out[:, k] = np.minimum.reduceat(flat * _ODD[k] + _ADD[k], begins)
    return out


def signatures(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, content, n, d1, d2, tokens): a hash of the text, set size, two hashes of the word sequence, and minwise tokens (null for empty sets)."""
    schema = pa.schema([("id", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets, one, two in shingle_sets(batch.column(2)):
                n = np.array([len(s) for s in sets], np.int64)
                some = n > 0
                tokens = minwise([s for s in sets if len(s)]).view(np.int64) if some.any() else np.empty((0, TOKENS), np.int64)
                ends = np.concatenate([[0], np.cumsum(some * TOKENS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.ravel()), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(n)), batch.column(1).slice(i, len(n)), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], schema=schema)
            del sets
            trimmed(bool)

    return docs.select(F.col(id_).cast("long").alias("id"), F.xxhash64(text), text).mapInArrow(sign, "id long, content long, n long, d1 long, d2 long, tokens array<long>")


def _least_agreeing(percent: int) -> int:
    """The number of agreeing tokens that a pair at the threshold falls short of by five deviations."""
    t = percent / 100
    return int(TOKENS * (t - 5 * (t * (1 - t) / TOKENS) ** 0.5))


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose sizes allow the threshold and whose tokens agree often enough."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    few = pairs.count() <= FEW_ROWS

    def sent(x: DataFrame) -> DataFrame:
        return F.broadcast(x) if few else x

    left = sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = right.join(sent(left.join(sent(pairs), "a")), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    same = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda x: x))
    return both.filter(same >= _least_agreeing(percent)).select("a", "b")


def _similar(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of the other sets, whether 100 * intersection >= percent * union."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), max(0, len(one) - 1))
    hit = one[at] == flat if len(one) else np.zeros(len(flat), bool)
    common = np.bincount(np.repeat(np.arange(len(others)), sizes)[hit], minlength=len(others))
    return (common > 0) & (100 * common >= percent * (len(one) + sizes - common))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Each b goes to the tasks of its a with its text; an a with many partners is dealt out over several.
    """
    pairs = written(pairs, "pairs")
    n = pairs.count()
    if not n:
        return pairs
    few = n <= FEW_ROWS
    counts = pairs.groupBy("a").agg((F.floor((F.count("*") - 1) / GROUP) + 1).cast("int").alias("deals"))
    deal = F.pmod(F.xxhash64("b"), F.col("deals")).cast("int")
    members = pairs.join(counts, "a").select("a", F.col("b").alias("id"), deal.alias("deal"))
    centres = counts.select("a", F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    wanted = members.unionByName(centres)
    # Few pairs go to the texts; for many, texts and pairs are shuffled.
    rows = texts.join(F.broadcast(wanted) if few else wanted, "id").select("a", "deal", "id", "text")

    def compare(table: pa.Table) -> pa.Table:
        a = table["a"][0].as_py()
        ids = table["id"].to_numpy()
        sets = [s for _, some, _, _ in shingle_sets(table["text"]) for s in some]
        others = [i for i in range(len(ids)) if ids[i] != a]
        found: set[int] = set()
        for centre in (s for i, s in zip(ids, sets) if i == a):
            found.update(ids[others][_similar(centre, [sets[i] for i in others], percent)].tolist() if others else [])
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return written(rows.groupBy("a", "deal").applyInArrow(lambda table: trimmed(compare, table), "a long, b long"), "links")


def _chosen(node: Column, tokens: Column, depth: int, branch: int) -> Column:
    """The branch of a document in a node: the node's own choice of a token's place, and the document's token there."""
    place = F.pmod(F.xxhash64(node, F.lit(depth), F.lit(branch)), F.lit(TOKENS)).cast("int")
    return F.xxhash64(node, place, F.get(tokens, place))


def _star_pairs(own: DataFrame, turn: int) -> DataFrame:
    """(node, a, b): a document of each node, another one in each turn, with all that are in other components."""
    centre = F.min_by(F.struct(F.col("id").alias("a"), F.col("component").alias("c")), F.xxhash64("id", F.lit(turn))).alias("centre")
    both = joined_by_key(own, own.groupBy("node").agg(centre, F.count("*").alias("n_here")), "node", "n_here").filter("component != centre.c")
    return both.select("node", F.col("centre.a").alias("a"), F.col("id").alias("b"))


def _split(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of nodes to be listed, members of those that are too large): nodes in one component are done with.

    A node is listed if its pairs between components are no more than SMALL for each document of it.
    """
    parts = own.groupBy("node", "component").agg(F.count("*").alias("n"))
    nodes = parts.groupBy("node").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("within"), F.max_by("component", "n").alias("main"))
    nodes = nodes.withColumn("across", (F.col("size") * F.col("size") - F.col("within")) / 2).filter("across > 0")
    small = F.col("across") <= SMALL * F.col("size")
    told = written(joined_by_key(own, nodes.select("node", "main", "size", small.alias("small")), "node", "size"), "mixed")
    return told.filter("small"), told.filter("not small")


def _listed_pairs(listed: DataFrame) -> DataFrame:
    """All pairs between components: documents outside a node's main component with all others of the node, which are dealt out where they are many."""
    deals = (F.floor(F.col("size") / HOT_ROWS) + 1).cast("int")
    rest = listed.filter("component != main").select("node", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), F.col("id").alias("x"), F.col("component").alias("c_x"))
    there = listed.select("node", F.pmod(F.xxhash64("id"), deals).cast("int").alias("deal"), "id", "component")
    both = rest.join(there, ["node", "deal"]).filter("c_x != component")
    return both.select("node", F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))


def _blocks(crowds: DataFrame, group: int) -> DataFrame:
    """(crowd, block_out, block_all, id, component, asks): the outside documents of each crowd and all its members, dealt into blocks of ``group``; a row for each pair of blocks that a document is in."""
    blocks = lambda n: (F.floor((n - 1) / group) + 1).cast("int")
    counts = crowds.groupBy("crowd").agg(F.count("*").alias("n_here"), blocks(F.count("*")).alias("n_all"), blocks(F.count_if(F.col("outside"))).alias("n_out"))
    dealt = joined_by_key(crowds, counts, "crowd", "n_here")

    def side(df: DataFrame, own: str, n: str, other: str, m: str, asks: bool) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("id"), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
        return placed.select("crowd", "block_out", "block_all", "id", "component", F.lit(asks).alias("asks"))

    return side(dealt.filter("outside"), "block_out", "n_out", "block_all", "n_all", True).unionByName(side(dealt.filter("n_out > 0"), "block_all", "n_all", "block_out", "n_out", False))


def with_candidates(crowds: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """crowds without the outside documents whose tokens agree too seldom with those of every member of another component."""
    rows = _blocks(crowds, SKETCH_GROUP).join(sketches.select("id", "sketch"), "id")
    least = _least_agreeing(percent)

    def compare(table: pa.Table) -> pa.Table:
        component, asks = table["component"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, TOKENS)
        out, there = np.flatnonzero(asks), np.flatnonzero(~asks)
        some = [i for i in out if (((sketch[there] == sketch[i]).sum(1) >= least) & (component[there] != component[i])).any()]
        return pa.table({"crowd": table["crowd"].take(pa.array(some, pa.int64())), "id": table["id"].take(pa.array(some, pa.int64()))})

    found = rows.groupBy("crowd", "block_out", "block_all").applyInArrow(lambda table: trimmed(compare, table), "crowd long, id long").distinct().withColumn("some", F.lit(True))
    return crowds.join(found, ["crowd", "id"], "left").filter(F.col("some") | ~F.col("outside")).drop("some")


def blocked_links(crowds: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links of crowds (crowd, id, component, outside): every outside document with all members of other components.

    Each pair of blocks is one task, which gives no more links than join its documents' components.
    """
    rows = written(_blocks(crowds, GROUP), "blocks")
    rows = texts.join(F.broadcast(rows) if rows.count() <= FEW_ROWS else rows, "id").select("crowd", "block_out", "block_all", "id", "component", "asks", "text")

    def compare(table: pa.Table) -> pa.Table:
        ids, component, asks = table["id"].to_numpy(), table["component"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        sets = [s for _, some, _, _ in shingle_sets(table["text"]) for s in some]
        there = np.flatnonzero(~asks)
        others = [sets[i] for i in there]
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while up.setdefault(c, c) != c:
                up[c] = c = up[up[c]]
            return c

        found = []
        for i in np.flatnonzero(asks) if others else ():
            ok = there[_similar(sets[i], others, percent) & (component[there] != component[i])]
            for k in np.unique(component[ok], return_index=True)[1]:
                a, b = root(int(component[i])), root(int(component[ok[k]]))
                if a != b:  # a link within what this task has joined adds nothing
                    up[a] = b
                    found.append((ids[i], ids[ok[k]]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return written(rows.groupBy("crowd", "block_out", "block_all").applyInArrow(lambda table: trimmed(compare, table), "a long, b long"), "links")


def _merged(large: DataFrame) -> DataFrame:
    """Crowds (crowd, id, component, outside) of the members of large nodes: nodes with one main component are one, whatever their trees."""
    members = large.groupBy(F.col("main").alias("crowd"), "id").agg(F.first("component").alias("component"))
    return written(members.withColumn("outside", F.col("component") != F.col("crowd")), "crowds")


def _crowds(large: DataFrame, sketches: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(crowds, large members of nodes that may branch) of the members of large nodes.

    Documents that are no candidate for any other component in the crowd are done with. The rest is compared
    in blocks if no more than OUTSIDE documents are outside the component.
    """

    def fits(crowds: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        counts = crowds.groupBy("crowd").agg(F.count("*").alias("n_here"), (F.count_if(F.col("outside")) <= most).alias("few"))
        told = joined_by_key(crowds, counts, "crowd", "n_here").select(*crowds.columns, "few")
        return told.filter("few").drop("few"), told.filter("not few").drop("few")

    few, many = fits(_merged(large), OUTSIDE_SKETCHED)
    few, still = fits(written(with_candidates(few, sketches, percent), "crowds"), OUTSIDE)
    rest = large.join(many.union(still).select(F.col("crowd").alias("main"), "id"), ["main", "id"], "left_semi")
    return few, written(rest.select("node", "id", "component", "main"), "rest")


def _branched(rest: DataFrame, tokens: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(members (node, id) of the branches, members of the nodes that would hardly have fewer pairs by branching)."""
    branches = F.explode(F.array(*[_chosen(F.col("node"), F.col("tokens"), depth, b) for b in range(BRANCHES)]))
    below = written(rest.join(tokens, "id").select("node", "id", "component", branches.alias("branch")).distinct(), "branches")

    def across(members: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Twice the pairs between components, a row for each node."""
        parts = members.groupBy(*keys, "component").agg(F.count("*").cast("double").alias("n"))
        sizes = parts.groupBy(*keys).agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs"))
        return sizes.groupBy("node").agg(F.sum("pairs").alias(name))

    nodes = across(rest, ["node"], "pairs").join(across(below, ["node", "branch"], "branch_pairs"), "node").join(rest.groupBy("node").agg(F.count("*").alias("n_here")), "node")
    nodes = written(nodes.select("node", "n_here", (F.col("branch_pairs") <= BRANCHED * F.col("pairs")).alias("fewer")), "fewer")
    down = joined_by_key(below, nodes, "node", "n_here").filter("fewer").select(F.col("branch").alias("node"), "id").distinct()
    return down, joined_by_key(rest, nodes, "node", "n_here").filter("not fewer").select(*rest.columns)


def _same_id(signed: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) between the vertices of an id that has several word sequences."""
    sequence = F.struct("d1", "d2")
    several = signed.filter("id is not null and n > 0").groupBy("id").agg(F.min(sequence).alias("low"), F.max(sequence).alias("high")).filter("low != high")
    several = written(several.select("id"), "several")
    if several.isEmpty():
        return several.select(F.col("id").alias("a"), F.col("id").alias("b"))
    rows = signed.join(several, "id").filter("n > 0").select("id", "d1", "d2").distinct()
    of = written(rows.join(groups, ["d1", "d2"]).select("id", "vertex").distinct(), "vertices-of-ids")
    first = of.groupBy("id").agg(F.min("vertex").alias("a"))
    return of.join(first, "id").filter("a != vertex").select("a", F.col("vertex").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """docs with n_shingles (long), component_id (long) and kept (boolean)."""
    docs = docs.drop("n_shingles", "component_id", "kept")
    signed = written(signatures(docs, id_, text), "signatures")
    # One vertex for each word sequence: its smallest id.
    groups = written(signed.filter("id is not null and n > 0").groupBy("d1", "d2").agg(F.min("id").alias("vertex"), F.count("*").alias("copies")), "groups")
    vertices = written(joined_by_key(signed, groups, ["d1", "d2"], "copies").filter("id = vertex").select("id", "n", "tokens"), "vertices")
    sketches = vertices.select("id", "n", F.transform("tokens", lambda x: (x.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("short")).alias("sketch"))
    texts = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")

    def shared_nodes(members: DataFrame) -> DataFrame:
        """Members (node, id) of nodes that hold more than one document."""
        members = written(members, "members")
        nodes = members.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        return written(joined_by_key(members, nodes, "node", "size").select("node", "id"), "nodes")

    roots = vertices.select("id", F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "token"))
    nodes = shared_nodes(roots.select("id", F.xxhash64("tree", "token").alias("node")))
    stars = _star_pairs(nodes.withColumn("component", F.col("id")), 0)
    links = confirmed(likely(stars, sketches, percent), texts, percent).union(_same_id(signed, groups))
    joined, depth = written(components(links), "components"), 1

    while True:
        members = nodes.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
        small, large = _split(written(members, "members"))
        pairs = _listed_pairs(small).union(_star_pairs(large, depth))
        links = links.union(confirmed(likely(pairs, sketches, percent), texts, percent))
        if large.isEmpty():
            break
        joined = written(components(links), "components")
        name = joined.select(F.col("id").alias("__id"), F.col("component").alias("__now"))
        for c, own in (("component", "id"), ("main", "main")):  # what the new links have joined
            large = large.join(name, F.col(own) == F.col("__id"), "left").withColumn(c, F.coalesce("__now", c)).drop("__id", "__now")
        crowds, rest = _crowds(large, sketches, percent)
        links = links.union(blocked_links(crowds, texts, percent))
        if rest.isEmpty():
            break
        nodes, alike = (None, rest) if depth == DEPTH else _branched(rest, vertices.select("id", "tokens"), depth)
        if not alike.isEmpty():
            links = links.union(blocked_links(written(with_candidates(_merged(alike), sketches, percent), "crowds"), texts, percent))
        if nodes is None or nodes.isEmpty():
            break
        joined = written(components(links), "components")
        nodes = shared_nodes(nodes)
        depth += 1
    joined = written(components(links), "components")
    joined = joined.withColumnRenamed("id", "vertex")
    found = joined_by_key(signed.select("id", "content", "n", "d1", "d2"), groups, ["d1", "d2"], "copies", "left").withColumn("vertex", F.when(F.col("n") > 0, F.col("vertex")))
    found = found.join(joined, "vertex", "left").withColumn("component", F.when(F.col("id").isNotNull(), F.least("vertex", "component", "id")))
    # A row for each id and text, to be joined with the rows of docs, whatever repeats there.
    found = found.groupBy("id", "content").agg(F.min("component").alias("component_id"), F.first("n").alias("n_shingles"))
    same = docs[id_].cast("long").eqNullSafe(found["id"]) & (F.xxhash64(docs[text]) == found["content"])
    out = docs.join(found, same, "left").drop(found["id"], found["content"])
    return out.withColumn("kept", F.col(id_).cast("long").eqNullSafe(F.col("component_id")))
