"""Review of alerts: lists, promotion to cases, the assets they concern, and fingerprints of what was reviewed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The namespace of case ids.
CASES = uuid.uuid5(uuid.NAMESPACE_URL, "tracelake:cases")
MOST_LISTED = 200


def alert_list(alerts: DataFrame, id_: str = "finding_id", state: str | None = None, most: int = 50) -> DataFrame:
    """The newest alerts, of one state if given, without their evidence but with evidence_count."""
    if not 1 <= most <= MOST_LISTED:
        raise ValueError(f"a list has 1 to {MOST_LISTED} alerts")
    rows = alerts if state is None else alerts.filter(F.col("state") == state)
    if "evidence" in rows.columns:
        rows = rows.withColumn("evidence_count", F.size("evidence").cast("long")).drop("evidence")
    return rows.orderBy(F.desc("created"), id_).limit(most)


def name_uuid(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of a name (RFC 9562): SHA-1 of the namespace's bytes and the name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)))), 1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def promote(alerts: DataFrame, cases: DataFrame, id_: str = "finding_id") -> DataFrame:
    """New cases for alerts that have none. A case's id follows from its alert's, so a repeated promotion adds nothing."""
    rows = alerts.withColumn("case_id", name_uuid(CASES, F.col(id_).cast("string")))
    return rows.join(cases.select("case_id"), "case_id", "left_anti")


def mapped_assets(events: DataFrame, aliases: DataFrame, host: str = "host") -> tuple[DataFrame, DataFrame]:
    """(events with asset_id, null where no alias fits; the hosts without one, with their events). aliases: alias, asset_id, each alias once."""
    known = aliases.select(F.lower("alias").alias("__alias"), "asset_id")
    told = events.join(known, F.lower(host) == F.col("__alias"), "left").drop("__alias")
    per = events.groupBy(F.lower(host).alias("host")).agg(F.count("*").alias("observations"))
    return told, per.join(known, F.col("host") == F.col("__alias"), "left_anti")


def alert_assets(alerts: DataFrame, events: DataFrame, id_: str = "finding_id", uid: str = "event_uid") -> DataFrame:
    """(id, assets, n_assets, unmapped): the assets of an alert's evidence, and how many of its events have none. events: uid, asset_id."""
    rows = alerts.select(id_, F.explode("evidence").alias("__uid"))
    seen = rows.join(events.select(F.col(uid).alias("__uid"), "asset_id"), "__uid", "left").groupBy(id_, "asset_id").agg(F.count("*").alias("__n"))
    out = seen.groupBy(id_).agg(F.array_sort(F.collect_list("asset_id")).alias("assets"), F.sum(F.when(F.col("asset_id").isNull(), F.col("__n")).otherwise(0)).alias("unmapped"))
    return out.select(id_, "assets", F.size("assets").cast("long").alias("n_assets"), "unmapped")


def sample_anchors(observed: DataFrame, check: str, uid: str, ts: str, most: int = 5) -> DataFrame:
    """(check, anchors): the first events of each check, in canonical order; no more than ``most`` of any leave a task."""
    rank = F.row_number().over(Window.partitionBy(check).orderBy(ts, uid))
    first = observed.select(check, uid, ts).withColumn("__n", rank).filter(F.col("__n") <= most)
    return first.groupBy(check).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", uid))), lambda x: x[uid]).alias("anchors"))


def by_criticality(assets: DataFrame, criticality: str, id_: str, ranks: dict[str, int]) -> DataFrame:
    """Assets in the order of review: the most critical first, then by id."""
    rank = F.coalesce(*[F.when(F.col(criticality) == k, F.lit(v)) for k, v in ranks.items()], F.lit(0))
    return assets.withColumn("criticality_rank", rank).orderBy(F.desc("criticality_rank"), id_)


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, sha256) of a table's rows with all repeats, whatever their order and partitions.

    Rows' SHA-256 values are added up as eight numbers of 32 bits each, so that every task adds its own part; their
    sums and the number of rows are hashed. It shows that a table changed, not who changed it.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring("__h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(8)]
    sums = df.select(row.alias("__h")).agg(F.count("*").alias("n_rows"), *words)
    parts = [F.col("n_rows").cast("string"), *[F.coalesce(f"s{i}", F.lit("0")) for i in range(8)]]
    return sums.select("n_rows", F.sha2(F.concat_ws(":", *parts), 256).alias("sha256"))
