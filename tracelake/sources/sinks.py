"""Writers: analysis bundles, case archives, metrics and delivery of log lines.

Tables go out through Spark, to any file system that it writes; only small documents (manifests, metrics, one case) are
made on the driver. A bundle or snapshot is written beside its place and moved there when complete, so a reader never
sees half of one.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_cell
from ..functions.times import utc_text
from ..operators.joins import bounded
from ..streaming.queue import QUEUED, Queue
from ..operators.review import fingerprint

TIMELINE = ("timestamp", "host", "channel", "provider", "event_id", "record_id", "source_sha256", "source_line", "event_uid")
PROCESS_FIELDS = ("Image", "CommandLine", "ParentImage", "User", "ProcessGuid", "ParentProcessGuid", "LogonGuid")
#: HTTP states after which a delivery is tried again, and how often.
RETRY_STATES, RETRIES = (429, 502, 503, 504), 3


def timeline(events: DataFrame) -> DataFrame:
    """All events for a spreadsheet, no cell of which is a formula."""
    rows = events.withColumn("timestamp", utc_text(F.col("timestamp")))
    return rows.select(*[csv_cell(F.col(c).cast("string")).alias(c) for c in TIMELINE])


def processes(events: DataFrame) -> DataFrame:
    rows = events.filter("event_id = 1 and lower(provider) = 'microsoft-windows-sysmon' and lower(channel) = 'microsoft-windows-sysmon/operational'")
    fields = [csv_cell(F.coalesce(F.col("event_data")[f], F.lit(""))).alias(f) for f in PROCESS_FIELDS]
    return rows.select(utc_text(F.col("timestamp")).alias("timestamp"), csv_cell(F.col("host")).alias("host"), "event_uid", *fields)


class Folder:
    """A folder on any file system that Spark knows, by its URI or path."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        path = self.jvm.org.apache.hadoop.fs.Path(at.rstrip("/"))
        self.files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = self.files.makeQualified(path)
        self.at = self.path.toString()

    def exists(self) -> bool:
        return self.files.exists(self.path)

    def write_text(self, name: str, text: str) -> None:
        out = self.files.create(self.jvm.org.apache.hadoop.fs.Path(self.path, name))
        out.write(bytearray(text.encode()))
        out.close()

    def read_text(self, name: str) -> str:
        return self.spark.read.text(f"{self.at}/{name}", wholetext=True).first()[0]

    def beside(self) -> Folder:
        return Folder(self.spark, f"{self.at}.{uuid.uuid4().hex}.part")

    def become(self, other: Folder) -> None:
        if other.exists() or not self.files.rename(self.path, other.path):
            raise FileExistsError(other.at)


def inventory(folder: Folder, *tables: str) -> DataFrame:
    """(file, sha256) of the data files of these tables below folder, hashed where Spark reads them."""
    files = folder.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load([f"{folder.at}/{t}" for t in tables])
    return files.select(F.substring("path", len(folder.at) + 2, 4096).alias("file"), F.sha2("content", 256).alias("sha256"))


BUNDLE = ("findings", "timeline", "processes", "sources")


def write_bundle(folder: str, events: DataFrame, findings: DataFrame, sources: DataFrame, parameters: dict) -> dict:
    """findings (JSON lines), timeline and processes (CSV), sources, the inventory of all files, and manifest.json in a new folder; returns the manifest."""
    spark = events.sparkSession
    place = Folder(spark, folder)
    if place.exists():
        raise FileExistsError(folder)
    staged = place.beside()
    began = time.time()
    findings.write.json(f"{staged.at}/findings")
    timeline(events).write.option("header", True).csv(f"{staged.at}/timeline")
    processes(events).write.option("header", True).csv(f"{staged.at}/processes")
    sources.write.json(f"{staged.at}/sources")
    listed = inventory(staged, *BUNDLE)
    listed.write.json(f"{staged.at}/inventory")
    manifest = {
        "sources": fingerprint(sources).first().asDict(),
        "events": events.count(),
        "findings_by_rule": {r.rule_id: r["count"] for r in findings.groupBy("rule_id").count().collect()},
        "findings_by_status": {r.status: r["count"] for r in findings.groupBy("status").count().collect()},
        "parameters": parameters,
        "verdict": "unassessed",
        "seconds": round(time.time() - began, 3),
        "files": fingerprint(listed).first().asDict(),
    }
    staged.write_text("manifest.json", json.dumps(manifest, ensure_ascii=False, sort_keys=True, indent=1))
    staged.become(place)
    return manifest


def anchor(spark: SparkSession, folder: str) -> str:
    """SHA-256 of a bundle's manifest, to be kept elsewhere."""
    return hashlib.sha256(Folder(spark, folder).read_text("manifest.json").encode()).hexdigest()


def verify_bundle(spark: SparkSession, folder: str, most: int = 1000, anchored: str | None = None) -> list[str]:
    """What differs from the manifest, at most so many: changed, missing or added files, another inventory, other counts.

    With ``anchored``, the manifest itself must have that hash; without one, whoever changed the files may have changed it as well.
    """
    place = Folder(spark, folder)
    manifest = json.loads(place.read_text("manifest.json"))
    if anchored is not None and anchor(spark, folder) != anchored:
        return ["other manifest than anchored"]
    told = spark.read.schema("file string, sha256 string").json(f"{place.at}/inventory")
    now = inventory(place, *BUNDLE).withColumnRenamed("sha256", "now")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "added").otherwise("changed")
    odd = told.join(now, "file", "full").filter("not (sha256 <=> now)").select(F.concat_ws(" ", state, "file").alias("problem"))
    problems = [r.problem for r in odd.orderBy("problem").limit(most).collect()]
    if fingerprint(told).first().asDict() != manifest["files"]:
        problems.append("changed inventory")
    counts = {r.rule_id: r["count"] for r in spark.read.schema("rule_id string").json(f"{place.at}/findings").groupBy("rule_id").count().collect()}
    return problems + (["other findings than counted"] if counts != manifest["findings_by_rule"] else [])


#: Logs of a live store by batch and day; its delivery queue comes with them, as the rows that it holds.
LOGS, QUEUE = ("events", "alerts", "leads"), "outbox"


def live_queue(spark: SparkSession, store: str) -> Queue:
    return Queue(spark, f"{store}/{QUEUE}", QUEUED)


def snapshot(spark: SparkSession, store: str, folder: str) -> dict:
    """A copy of a live store's logs in a new folder, with the fingerprint of each; returns the manifest."""
    place, source = Folder(spark, folder), Folder(spark, store)
    if place.exists():
        raise FileExistsError(folder)
    staged, manifest = place.beside(), {}
    for log in (*LOGS, QUEUE):
        if Folder(spark, f"{source.at}/{log}").exists():
            if log == QUEUE:
                live_queue(spark, source.at).read().write.parquet(f"{staged.at}/{log}")
            else:
                spark.read.parquet(f"{source.at}/{log}").write.partitionBy("batch", "day").parquet(f"{staged.at}/{log}")
            manifest[log] = fingerprint(spark.read.parquet(f"{staged.at}/{log}")).first().asDict()
    staged.write_text("manifest.json", json.dumps(manifest, sort_keys=True))
    staged.become(place)
    return manifest


def restore(spark: SparkSession, folder: str, store: str) -> None:
    """The store of a snapshot, in a new folder, if every log is named by the manifest and has its fingerprint."""
    place, target = Folder(spark, folder), Folder(spark, store)
    manifest = json.loads(place.read_text("manifest.json"))
    there = {log for log in (*LOGS, QUEUE) if Folder(spark, f"{place.at}/{log}").exists()}
    if target.exists() or set(manifest) != there:
        raise ValueError("the store exists, or the snapshot has other logs than its manifest")
    staged = target.beside()
    for log in sorted(there):
        rows = spark.read.parquet(f"{place.at}/{log}")
        if fingerprint(rows).first().asDict() != manifest[log]:
            raise ValueError(f"{log} is not as it was")
        if log == QUEUE:
            live_queue(spark, staged.at).add(rows, {"restored": place.at})
            continue
        rows.write.partitionBy("batch", "day").parquet(f"{staged.at}/{log}")
    staged.become(target)


def review_archive(path: str, id_: str, alerts: DataFrame, log: DataFrame, events: DataFrame, most: int = 1000) -> str:
    """A zip of one alert with all its revisions and the anchors of its evidence; returns its SHA-256. More than ``most`` of either are an error."""
    alert = alerts.filter(F.col("finding_id") == id_).limit(2).collect()
    if len(alert) != 1:
        raise ValueError(f"{len(alert)} alerts have this id")
    revisions = bounded(log.filter(F.col("finding_id") == id_), most).orderBy("revision").collect()
    if len(alert[0].evidence) > most:
        raise ValueError(f"more than {most} events of evidence")
    anchors = events.filter(F.col("event_uid").isin(list(alert[0].evidence))).select("event_uid", "source_sha256", "source_line", "host", F.col("timestamp").cast("string").alias("timestamp"))
    plain = lambda rows: json.loads(json.dumps([r.asDict(recursive=True) for r in rows], default=str))
    return case_archive(path, {"alert.json": plain(alert)[0], "audit.json": plain(revisions), "anchors.json": plain(anchors.orderBy("event_uid").collect())})


def case_archive(path: str, documents: dict[str, object]) -> str:
    """A zip of JSON documents with fixed times, so equal cases have equal bytes; returns its SHA-256. Refuses an existing file."""
    with open(path, "xb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(documents):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), json.dumps(documents[name], ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def metrics(health: DataFrame, prefix: str = "tracelake") -> str:
    """Queue health as text lines for a scraper; a row for each state."""
    lines = []
    for r in health.orderBy("state").collect():
        for c in ("n_rows", "oldest_age_s", "n_overdue"):
            lines.append(f'{prefix}_{c}{{state="{r.state}"}} {r[c] if r[c] is not None else 0}')
    return "\n".join(lines) + "\n"


def deliver(lines: DataFrame, send: Callable[[list[str]], int], batch: int = 100, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Sends rows (event_uid, line) in batches from the executors; returns (event_uid, delivered).

    send takes texts and returns an HTTP state. Delivery is at least once: a batch may be sent again after a
    failure, so receivers go by event_uid.
    """

    def go(frames: Iterator) -> Iterator:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                state = 503
                for n in range(RETRIES + 1):
                    state = send(part["line"].tolist())
                    if state not in RETRY_STATES:
                        break
                    wait(0.25 * 2**n)
                yield part[["event_uid"]].assign(delivered=200 <= state < 300)

    return lines.select("event_uid", "line").mapInPandas(go, "event_uid string, delivered boolean")
