"""Temperature mixing of sources.

A source with n_i tokens gets the weight w_i proportional to n_i ** a. The exponent a in [0, 1] is bisected
until the weights meet a target entropy, or until no source is repeated more often than a limit allows.
The weights are realised as block permutations: a source whose share of the token budget is 2.3 times its
size is emitted as two whole permutations of its documents and the beginning of a third, cut where the
budget is used up.

With no budget given, it is the least with which every source is emitted whole at least once, so that no
document is lost. Null sources are one source. Null and blank texts count one token, so that they are placed
too. Rows without an id and repeated rows are emitted like others, as many of those that repeat at a source's cut as the budget takes;
texts are emitted whole, whatever their length. Other columns pass through, whatever their names; those named
n_tokens, epoch, block_slot or source_weight are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column_name, gapless_rank, written

#: Tokens of a cell, about, and bits of the hash that tell cells apart. A source is dealt into cells, so that no task
#: orders a whole source.
CELL_TOKENS, LEAST_BITS, MOST_BITS = 1 << 20, 6, 30
#: Sources up to which the plan, a row of some numbers for each, is broadcast.
FEW_SOURCES = 100_000


def weights(tokens: list[int], exponent: float) -> list[float]:
    most = max(tokens)
    raw = [(n / most) ** exponent for n in tokens]
    total = sum(raw)
    return [x / total for x in raw]


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log2(p) for p in shares if p > 0)


def passes(tokens: list[int], shares: list[float], budget: float | None) -> list[float]:
    """How often each source is emitted."""
    per = [p / n for p, n in zip(shares, tokens)]
    budget = budget if budget is not None else 1 / min(per)
    return [budget * x for x in per]


def solve_exponent(tokens: list[int], target_entropy: float | None = None, repeat_limit: float | None = None, budget: float | None = None) -> float:
    """The exponent nearest to 0 that keeps the repetition limit, or whose weights have the target entropy."""
    if not tokens or (target_entropy is None and repeat_limit is None):
        return 1.0

    def too_flat(a: float) -> bool:
        shares = weights(tokens, a)
        if repeat_limit is not None and max(passes(tokens, shares, budget)) > repeat_limit:
            return True
        return target_entropy is not None and entropy(shares) > target_entropy

    if not too_flat(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return high


def mix(docs: DataFrame, source: str = "source", text: str = "text", id_: str = "doc_id", target_entropy: float | None = None, repeat_limit: float | None = 1.5, budget: int | None = None, seed: int = 7, slots: bool = True) -> DataFrame:
    """docs, each row as often as its source's weight says, with n_tokens, epoch (from 0), block_slot and source_weight.

    Tokens are counted as words over all documents. The driver sees one number for each source. Within an
    epoch a source's rows are ordered by a hash of their id, text and the epoch; block_slot numbers them
    without gaps; without ``slots`` it is left out, and no row is moved between tasks.
    """
    docs = docs.drop("n_tokens", "epoch", "block_slot", "source_weight")
    cell, order, key, passes_, rest_, cut_ = (column_name(docs, c) for c in ("mix_cell", "mix_order", "mix_source", "mix_passes", "mix_rest", "mix_cut"))
    first_row, first_token, past_, ties_, tied_, place = (column_name(docs, c) for c in ("mix_first_row", "mix_first_token", "mix_past", "mix_ties", "mix_tied", "mix_place"))
    n_tokens = F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))).cast("long")
    rows = docs.withColumn("n_tokens", n_tokens).withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    spark = docs.sparkSession
    per_source = {r[0]: r[1] for r in written(rows.groupBy(key).agg(F.sum("n_tokens").alias("n")), "mix-sources").collect()}
    if not per_source:
        empty = rows.withColumn("epoch", F.lit(0)).withColumn("source_weight", F.lit(0.0)).drop(key)
        return empty.withColumn("block_slot", F.lit(0).cast("long")) if slots else empty
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(per_source.values()) / CELL_TOKENS))))
    names = sorted(per_source)
    tokens = [per_source[s] for s in names]
    shares = weights(tokens, solve_exponent(tokens, target_entropy, repeat_limit, budget))
    plan = []
    for s, n, p, k in zip(names, tokens, shares, passes(tokens, shares, budget)):
        whole = math.floor(k + 1e-9)
        rest = round((k - whole) * n) if k - whole > 1e-9 else 0
        plan.append((s, p, whole, rest))
    hash_ = F.xxhash64(F.col(id_), F.col(text), F.col("epoch"), F.lit(seed))

    def emitted(rows: DataFrame, plan: list[tuple], schema: str) -> DataFrame:
        """A row for each row and epoch; the plan has a row for each source."""
        table = spark.createDataFrame(plan, schema)
        out = rows.join(F.broadcast(table) if len(plan) <= FEW_SOURCES else table, key).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col(passes_))))
        out = out.filter((F.col("epoch") < F.col(passes_)) | (F.col(rest_) > 0))
        return out.withColumn(order, hash_).withColumn(cell, F.shiftrightunsigned(order, 64 - bits).cast("int"))

    def cells_of(epochs: DataFrame) -> DataFrame:
        """Where each cell of an epoch begins, in rows and in tokens."""
        before = Window.partitionBy(key, "epoch").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        cells = epochs.groupBy(key, "epoch", cell).agg(F.count("*").alias(first_row), F.sum("n_tokens").alias(first_token))
        return cells.select(key, "epoch", cell, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in (first_row, first_token)])

    schema = f"`{key}` string, source_weight double, `{passes_}` int, `{rest_}` long"
    within = Window.partitionBy(key, "epoch", cell).orderBy(order, id_, F.col("n_tokens"))
    # The last hash of each source that the cut epoch's budget reaches, from ids and counts alone.
    last = emitted(rows, plan, schema).filter(F.col("epoch") == F.col(passes_)).select(key, "epoch", cell, order, id_, "n_tokens", rest_)
    past = F.col(first_token) + F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    # Rows that repeat have one hash: how many have it, and which of them this row is.
    same = Window.partitionBy(key, "epoch", cell, order)
    last = last.join(cells_of(last), [key, "epoch", cell]).withColumn(past_, past).withColumn(ties_, F.count("*").over(same)).withColumn(tied_, F.row_number().over(same.orderBy(id_, F.col("n_tokens"))))
    # In the order of the cells, which is that of unsigned hashes.
    unsigned = F.col(order).bitwiseXOR(F.lit(-(1 << 63)))
    ends = last.filter(F.col(past_) < F.col(rest_)).groupBy(key).agg(F.max(F.struct(unsigned.alias("cut"), F.col(tied_).alias("takes"), F.col(ties_).alias("of"))).alias("end"))
    cuts = {r[0]: r[1] for r in ends.collect()}  # three numbers for each source
    out = emitted(rows, [(*p, *(cuts.get(p[0]) or (None, None, None))) for p in plan], f"{schema}, `{cut_}` long, `{tied_}` int, `{ties_}` long")
    whole, at_cut = F.col("epoch") < F.col(passes_), unsigned == F.col(cut_)
    if all(c.takes == c.of for c in cuts.values()):
        out = out.filter(whole | (unsigned <= F.col(cut_)))
    else:  # of the rows at the cut, as many as the budget takes; they are numbered by their place in what is written
        at_end = out.filter(~whole & at_cut)
        tied = written(at_end.withColumn(place, F.monotonically_increasing_id()), "mix-ties")
        tied = gapless_rank(tied, [key], [F.col(place)], ties_ + "_rank", spread=[F.col(place)]).filter(F.col(ties_ + "_rank") < F.col(tied_))
        out = out.filter(whole | (unsigned < F.col(cut_))).unionByName(tied.select(*out.columns))
    out = out.drop(tied_, ties_)
    if not slots:
        return out.drop(cell, order, key, passes_, rest_, cut_)
    out = out.join(cells_of(out), [key, "epoch", cell]).withColumn("block_slot", F.col(first_row) + F.row_number().over(within) - 1)
    return out.drop(cell, order, key, first_row, first_token, passes_, rest_, cut_)
