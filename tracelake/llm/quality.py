"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is a column expression over the text; every rule is (name, ratio, lowest, highest) and
a document is kept when no rule fails. Words are the runs matched by ``[^\\x20\\x09-\\x0D]+``.

Null, empty and blank texts have no words: all measures are 0, they fail the base rule and are not
kept. Repeated rows and ties in doc_id are judged one by one. Texts are measured whole, whatever their length. Other
columns pass through; one that is named like a measure, base_failed or kept is replaced by it. An empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column_name

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages that the rules are meant for.
STOP_WORDS = (
    "the of and to in is a that for on with as was by "
    "der die das und in zu den ist von ein mit sich "
    "le la les de des et en un une est que qui "
    "el los las del y en que es por con una se"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose numerator / denominator is below ``least`` or above ``most``."""

    name: str
    numerator: str
    denominator: str
    least: float | None = None
    most: float | None = None


#: Length, symbol, stop-word and line ratios. The limits leave wide room around ordinary prose.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", most=0.3),
    Rule("stop_word_ratio", "n_stop_words", "n_words", least=0.01),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", most=0.5),
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more in ``words``.

    Windows are compared by hash and position, sorted once; a window is repeated if a neighbour in that
    order has its hash. Each repeated window covers three words, less what the next one covers too.
    """
    n = F.size(words)
    windows = F.transform(
        F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(n, F.lit(1))).alias("b"), F.slice(words, 3, F.greatest(n, F.lit(1))).alias("c")),
        lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("h"), i.alias("i")),
    )

    def starts(s: Column) -> Column:
        same = lambda x, i, d: (i + d >= 0) & (F.get(s, i + d)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i, -1), F.lit(False)) | F.coalesce(same(x, i, 1), F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")), lambda acc, x: F.struct((acc["sum"] + F.least(F.lit(3), x - acc["last"])).alias("sum"), x.alias("last")), lambda acc: acc["sum"])

    hashes = lambda z: F.transform(z, lambda x: x["h"])
    inner = lambda z: F.when(F.size(F.array_distinct(hashes(z))) == F.size(z), F.lit(0)).otherwise(_let(_let(F.sort_array(z), starts), covered))
    return F.when(n < 4, F.lit(0)).otherwise(_let(F.slice(windows, 1, F.greatest(n - 2, F.lit(1))), inner))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    stops = list(dict.fromkeys(STOP_WORDS))  # a set of literals, which Spark hashes

    def all_of(w: Column, x: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda y: F.lower(y).isin(stops))).cast("long").alias("n_stop_words"),
        )

    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"]
    m = column_name(docs, "measures")
    found = docs.withColumn(m, _let(words, lambda w: _let(lines, lambda x: all_of(w, x))))
    return found.withColumns({n: F.col(m)[n] for n in names}).drop(m)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules as one boolean column over the measures: true where none fails."""
    ok = F.lit(True)
    for r in rules:
        ratio = F.col(r.numerator) / F.greatest(F.col(r.denominator), F.lit(1))
        if r.least is not None:
            ok = ok & (ratio >= F.lit(float(r.least)))
        if r.most is not None:
            ok = ok & (ratio <= F.lit(float(r.most)))
    return ok


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures, base_failed and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
