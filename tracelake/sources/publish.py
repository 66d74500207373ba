"""Publishing a table with two-phase commit, as a data source writer.

Every task writes files of its own under new names and tells the driver their names, rows and hashes. Only when all tasks are done,
the driver creates the manifest, which names the files that count; before that nothing is published, and files of tasks that failed,
were killed or ran twice are in no manifest, whatever they left behind. Creating the manifest fails if there is one, so a second
publication to the same place is refused and the first stays as it is. When a write is given up, the files of the tasks that had
finished are deleted.

    df.write.format("published").mode("append").save(path)

Readers go by the manifest: ``read_published``; ``verify_published`` compares the files with it. Paths are of any file system that
pyarrow knows; on local ones a manifest is taken by a hard link, elsewhere by a file that is only created where none is.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT, MANIFEST = "published", "manifest.json"
#: Rows of a file.
FILE_ROWS = 1_000_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The files of one task."""

    files: list[dict]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: str, file_rows: int):
        self.path, self.schema, self.file_rows = path.rstrip("/"), schema, file_rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _place(self.path)
        store.create_dir(f"{at}/data", recursive=True)
        task, files, batches, rows = TaskContext.get(), [], [], 0

        def close() -> None:
            nonlocal batches, rows
            name = f"data/part-{task.partitionId():05}-{len(files):04}-{uuid.uuid4().hex}.parquet"
            sink = pa.BufferOutputStream()
            pq.write_table(pa.Table.from_batches(batches), sink)
            data = sink.getvalue()
            with store.open_output_stream(f"{at}/{name}") as out:
                out.write(data)
            files.append({"file": name, "rows": rows, "sha256": hashlib.sha256(data).hexdigest()})
            batches, rows = [], 0

        for batch in iterator:
            while batch.num_rows:
                part = batch.slice(0, self.file_rows - rows)
                batches.append(part)
                rows, batch = rows + part.num_rows, batch.slice(part.num_rows)
                if rows >= self.file_rows:
                    close()
        if rows:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["file"])
        manifest = json.dumps({"schema": self.schema, "rows": sum(f["rows"] for f in files), "files": files}, sort_keys=True, indent=1).encode()
        store, at = _place(self.path)
        store.create_dir(at, recursive=True)
        if isinstance(store, fs.LocalFileSystem):
            staged = f"{at}/.{uuid.uuid4().hex}"
            with open(staged, "xb") as f:
                f.write(manifest)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(staged, f"{at}/{MANIFEST}")
            except FileExistsError:
                raise FileExistsError(f"{self.path} is published already") from None
            finally:
                os.unlink(staged)
            return
        if store.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} is published already")
        with store.open_output_stream(f"{at}/{MANIFEST}") as out:
            out.write(manifest)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _place(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{at}/{f['file']}")


class PublishedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("what is published is not replaced")
        return Writer(self.options["path"], schema.json(), int(self.options.get("fileRows", FILE_ROWS)))


def publish(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> dict:
    """Writes df as a publication; returns its manifest."""
    df.sparkSession.dataSource.register(PublishedSource)
    df.write.format(FORMAT).mode("append").option("fileRows", file_rows).save(path)
    return manifest_of(path)


def manifest_of(path: str) -> dict:
    store, at = _place(path.rstrip("/"))
    with store.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files that the manifest names, and of no others. Without a manifest there is nothing to be read: an error."""
    from pyspark.sql import types as T

    manifest = manifest_of(path)
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    files = [f"{path.rstrip('/')}/{f['file']}" for f in manifest["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def verify_published(path: str) -> list[str]:
    """What differs from the manifest: files that changed or are missing. Files that it doesn't name don't count."""
    store, at = _place(path.rstrip("/"))
    problems = []
    for f in manifest_of(path)["files"]:
        if store.get_file_info(f"{at}/{f['file']}").type == fs.FileType.NotFound:
            problems.append(f"missing {f['file']}")
            continue
        with store.open_input_stream(f"{at}/{f['file']}") as data:
            if hashlib.sha256(data.read()).hexdigest() != f["sha256"]:
                problems.append(f"changed {f['file']}")
    return problems
