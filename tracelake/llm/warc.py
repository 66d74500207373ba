"""WARC archives compressed with a Zstandard dictionary.

An archive is a ``.warc.zst`` file: a leading skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary, then one frame for each record, a warcinfo record first. The dictionary is built from the archive's own first records:
at most SAMPLE_BYTES of them, whatever the archive's size. Each task writes archives of about
ARCHIVE_BYTES of records, so memory is bounded by the dictionary sample and one record. Archives are
written under a temporary name and renamed when complete; the list of archives is a Spark table, so files
of failed or repeated attempts are in no list and are never read.

Of records with equal payloads, that with the largest id is a response and the others are revisits, which
hold the HTTP headers, the payload's digest and the record id and URI of the response, but no payload.

Null pages count as empty payloads, which are grouped as any other. A row without an id is a revisit if a
record with an id has its payload; if none has, all such rows are responses. Rows that repeat the largest
id of a payload are all responses, of one record id, as nothing tells them apart; all other record ids are unique.
Null URLs are written as an empty target, and control characters are cut from URLs. Pages of any length are one record,
which a task holds in memory. An empty table gives no archives and no rows. Other columns aren't archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, written

SKIPPABLE = 0x184D2A5D
#: Records of an archive, before compression.
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
RECORD_DATE = "2024-01-01T00:00:00Z"


@dataclass
class Record:
    kind: str
    uri: str
    page_id: int | None
    digest: str
    refers_to: int | None
    payload_bytes: int
    payload: bytes | None
    refers_to_uri: str = ""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _line(x: str) -> str:
    """x as the value of a header, which is one line."""
    return "".join(c for c in x if c >= " " and c != "\x7f")


def _record(head: list[str], block: bytes) -> bytes:
    head = [*head, f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def information() -> bytes:
    """The warcinfo record that an archive begins with."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {RECORD_DATE}", "Content-Type: application/warc-fields"]
    return _record(head, b"software: tracelake\r\nformat: WARC File Format 1.1\r\n")


def encode(r: Record) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = http + (r.payload or b"")
    own = record_id(r.page_id, r.digest) if r.kind == "response" else f"<urn:uuid:{uuid.uuid4()}>"
    head = [
        f"WARC-Type: {r.kind}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Target-URI: {_line(r.uri)}",
        f"WARC-Payload-Digest: sha1:{r.digest}",
    ]
    if r.page_id is not None:
        head.append(f"X-Page-Id: {r.page_id}")
    if r.kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(r.refers_to, r.digest)}",
            f"WARC-Refers-To-Target-URI: {_line(r.refers_to_uri)}",
            f"WARC-Refers-To-Date: {RECORD_DATE}",
            f"X-Refers-To-Page-Id: {r.refers_to}",
        ]
    return _record([*head, "Content-Type: application/http; msgtype=response"], block)


def decode(data: bytes) -> Record:
    """The inverse of encode(). The block's and a response's digests are computed and held against the headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(h["content-length"])]
    if h["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"block of {h['warc-record-id']} does not match its digest")
    if h["warc-type"] == "warcinfo":
        return Record("warcinfo", "", None, "", None, 0, None)
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if h["warc-type"] == "response":
        found = sha1_base32(payload)
        if (found, len(payload)) != (digest, size):
            raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
    page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
    return Record(h["warc-type"], h.get("warc-target-uri", ""), None if page is None else int(page), digest, None if refers is None else int(refers), size, payload if h["warc-type"] == "response" else None, h.get("warc-refers-to-target-uri", ""))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class ArchiveWriter:
    """Writes encoded records to one archive; the first ones are held back until the dictionary is built."""

    def __init__(self, out):
        self.out, self.held, self.size, self.codec = out, [], 0, None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        if self.codec is None:
            self.held.append(data)
            if self.size >= SAMPLE_BYTES:
                self.start()
        else:
            self.out.write(self.codec.compress(data))

    def start(self) -> None:
        try:
            # Samples of at most 32 KB, so that one long record doesn't fill the dictionary.
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, [x[:32768] for x in self.held], k=200, d=8)
        except zstandard.ZstdError:  # too few records to learn from
            dictionary = zstandard.ZstdCompressionDict(b"".join(self.held)[:DICTIONARY_BYTES] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = dictionary.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.codec = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for x in self.held:
            self.out.write(self.codec.compress(x))
        self.held = []

    def close(self) -> None:
        if self.codec is None:
            self.start()
        self.out.close()


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, from a file object, one at a time."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    raw = stream.read(n)
    is_full = raw[:4] == struct.pack("<I", 0xEC30A437)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if is_full else zstandard.DICT_TYPE_RAWCONTENT))
    rest = b""
    frame, parts = codec.decompressobj(), []
    while data := rest or stream.read(1 << 18):
        parts.append(frame.decompress(data))
        rest = b""
        if frame.eof:
            yield b"".join(parts)
            rest = frame.unused_data
            frame, parts = codec.decompressobj(), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def write_archives(pages: DataFrame, folder: str | None = None, id_: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archives of all pages; returns the list of archives (path, records), read back from shared storage.

    Payloads of fewer than ``min_bytes`` bytes are always responses.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    # The largest id of each payload that occurs more than once; rows stay where they are unless it's theirs to change.
    groups = rows.groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).filter("n > 1").drop("n").withColumnRenamed("sha1", "same_sha1")
    joined = rows.join(groups, (rows["sha1"] == groups["same_sha1"]) & (F.octet_length("payload") >= min_bytes), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    planned = joined.select("page_id", "url", "payload", refers.alias("refers_to"), F.coalesce("first_url", F.lit("")).alias("first_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        now = path = None
        count = 0

        def close():
            now.close()
            store.move(f"{root}/{path}.part", f"{root}/{path}")
            done.append((f"{folder}/{path}", count))

        for batch in batches:
            for page_id, url_, data, refers_to, first_url in zip(*(batch.column(i) for i in range(5))):
                data, refers_to = data.as_py(), refers_to.as_py()
                kind = "response" if refers_to is None else "revisit"
                record = Record(kind, url_.as_py(), page_id.as_py(), sha1_base32(data), refers_to, len(data), data if refers_to is None else None, first_url.as_py())
                if now is None:
                    path, count = f"{uuid.uuid4().hex}.warc.zst", 0
                    now = ArchiveWriter(store.open_output_stream(f"{root}/{path}.part", compression=None))
                    now.add(information())
                now.add(encode(record))
                count += 1
                if now.size >= ARCHIVE_BYTES:
                    close()
                    now = None
        if now is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "records": [n for _, n in done]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return written(planned.mapInArrow(write, "path string, records long"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the listed archives. A task streams an archive; memory holds a few records."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def rows(found: list[Record]) -> pa.RecordBatch:
            columns = ([r.page_id for r in found], [r.uri for r in found], [r.kind for r in found], [r.digest for r in found], [r.payload_bytes for r in found], [r.refers_to for r in found], [r.payload for r in found])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(path)
                found, size, count = [], 0, 0
                with store.open_input_stream(at, compression=None) as stream:
                    for data in read_archive(stream):
                        record = decode(data)
                        if record.kind == "warcinfo":
                            continue
                        found.append(record)
                        size, count = size + len(data), count + 1
                        if size > 4 << 20:
                            yield rows(found)
                            found, size = [], 0
                if count != expected:
                    raise ValueError(f"{path} has {count} records instead of {expected}")
                if found:
                    yield rows(found)

    n = max(1, archives.count())
    spread = archives.repartition(min(n, 4096))
    return spread.mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
