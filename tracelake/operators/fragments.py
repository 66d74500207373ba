"""Reassembly of texts from numbered fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reassemble(df: DataFrame, keys: list[str], number: str, total: str, text: str, most_parts: int = 1000, most_chars: int = 262144) -> DataFrame:
    """A row for each key: complete, expected_parts, observed_parts, missing_parts, reasons, script, script_sha256.

    Numbers are read strictly as integers with 1 <= number <= total <= most_parts; parts with equal text
    count once. A script is only given when nothing speaks against it.
    """
    n, m = F.expr(f"try_cast(trim(cast(`{number}` as string)) as int)"), F.expr(f"try_cast(trim(cast(`{total}` as string)) as int)")
    rows = df.withColumn("__n", n).withColumn("__m", m)
    valid = F.coalesce((F.col("__n") >= 1) & (F.col("__n") <= F.col("__m")) & (F.col("__m") <= most_parts) & F.col(text).isNotNull(), F.lit(False))
    rows = rows.withColumn("__v", valid)
    per = rows.groupBy(*keys).agg(
        F.collect_set(F.when(F.col("__v"), F.col("__m"))).alias("totals"),
        F.array_sort(F.collect_set(F.when(F.col("__v"), F.struct(F.col("__n").alias("n"), F.col(text).alias("t"))))).alias("parts"),
        F.count_if(~F.col("__v")).alias("bad"),
    )
    numbers = F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["n"])))
    per = per.withColumn("observed_parts", numbers).withColumn("expected_parts", F.when(F.size("totals") == 1, F.element_at("totals", 1)))
    missing = F.when(F.col("expected_parts").isNotNull(), F.array_except(F.sequence(F.lit(1), F.coalesce("expected_parts", F.lit(1))), "observed_parts")).otherwise(F.array().cast("array<int>"))
    per = per.withColumn("missing_parts", missing)
    # As many characters as the parts would join to, one text for each number.
    length = F.aggregate("parts", F.lit(0), lambda s, p: s + F.length(p["t"]))
    reasons = F.array_compact(
        F.array(
            F.when(F.size("parts") > F.size("observed_parts"), F.lit("conflicting fragment content")),
            F.when(F.size("totals") != 1, F.lit("inconsistent message totals")),
            F.when(F.col("bad") > 0, F.lit("invalid fragment metadata")),
            F.when(F.size("missing_parts") > 0, F.lit("missing message parts")),
            F.when(length > most_chars, F.lit("script exceeds reconstruction limit")),
        )
    )
    per = per.withColumn("reasons", reasons).withColumn("complete", F.size("reasons") == 0)
    script = F.when(F.col("complete"), F.array_join(F.transform("parts", lambda p: p["t"]), ""))
    return per.withColumn("script", script).withColumn("script_sha256", F.sha2("script", 256)).drop("totals", "parts", "bad")
