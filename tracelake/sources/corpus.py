"""A labelled corpus of scenarios: a folder of JSON files and a manifest of their hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<timestamp:string,host:string,channel:string,provider:string,event_id:bigint,record_id:bigint,event_data:map<string,string>>"
SCENARIO = f"id string, split string, expected_review boolean, variant string, rationale string, events array<{EVENT}>"
SPLITS = ("development", "holdout")


def load_scenarios(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(scenarios, problems) of folder/*.json, held against folder/manifest.jsonl (file, sha256).

    Problems: a file whose bytes have another hash, that the manifest doesn't name or that is missing; a file that is no
    scenario; an unknown split; an id that repeats. A corpus with problems shouldn't be evaluated.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"), F.decode("content", "UTF-8").alias("text"))
    listed = spark.read.schema("file string, sha256 string").json(f"{folder}/manifest.jsonl")
    both = files.join(listed, "file", "full").withColumn("s", F.from_json("text", SCENARIO))
    hash_ = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "not in the manifest").when(F.col("found") != F.col("sha256"), "other bytes")
    form = F.when(F.col("s.id").isNull() | F.col("s.events").isNull() | F.col("s.expected_review").isNull(), "no scenario").when(~F.col("s.split").isin(*SPLITS), "unknown split")
    told = both.withColumn("problem", F.coalesce(hash_, form))
    scenarios = told.filter("problem is null").select("file", "s.*")
    repeated = scenarios.groupBy("id").agg(F.count("*").alias("n"), F.min("file").alias("file")).filter("n > 1").select("file", F.lit("id repeats").alias("problem"))
    return scenarios, told.filter("problem is not null").select("file", "problem").unionByName(repeated)


def scenario_events(scenarios: DataFrame) -> DataFrame:
    """The events of all scenarios; each provider and channel of a scenario is a source of its own, lines in the order given."""
    rows = scenarios.select(F.col("id").alias("scenario"), F.posexplode("events").alias("at", "e")).select("scenario", "at", "e.*")
    source = F.sha2(F.concat_ws("|", "scenario", "provider", "channel"), 256)
    from pyspark.sql import Window

    line = F.row_number().over(Window.partitionBy("scenario", "provider", "channel").orderBy("at")).cast("long")
    rows = rows.withColumn("source_sha256", source).withColumn("source_line", line).drop("at")
    return rows.withColumn("event_uid", F.sha2(F.concat_ws(":", "source_sha256", "source_line"), 256)).withColumn("timestamp", F.to_timestamp("timestamp"))


def evaluate(scenarios: DataFrame, flagged: DataFrame, methods: list[str]) -> DataFrame:
    """Precision, recall and F1 of each split and method. flagged: scenario, method."""
    from ..operators.readiness import confusion

    rows = scenarios.select("id", "split", "expected_review", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    hits = flagged.select(F.col("scenario").alias("id"), "method").distinct().withColumn("hit", F.lit(True))
    return confusion(rows.join(hits, ["id", "method"], "left"), F.col("expected_review"), F.col("hit"), "split", "method")
