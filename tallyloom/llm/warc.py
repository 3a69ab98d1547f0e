"""Write pages as WARC archives and read archives back.

A record is one gzip member, so a reader can start at any record. Records whose payload equals that
of another one are ``revisit`` records: they keep the HTTP headers, not the payload.

Null html is an empty payload, a null url is written as ``about:blank``, and a null page id is kept
as null. In a group of equal payloads the largest page id is the response, each row of it if the
id is repeated; rows without an id revisit it. Where all ids of a group are null, each is a response.
An empty table gives no records.
"""
from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.rows import arrow_schema, slices
from tallyloom.operators.staging import new_folder, stage

#: Size at which a task goes on with the next archive; a reading task holds one archive.
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary, archive string, member_start long")
#: Ids are custom (version 8) UUIDs: a mark in the high half, the page id in the low bits.
MARK, NO_ID = 0x74616C6C796C8000, 0x74616C6C796C8001


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``html`` and ``refers_to``: the page whose record holds the same
    payload, null for responses. A join on the payload's SHA-256 and size; adaptive execution
    splits the partition of a payload that many pages share."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumns({"_key": F.sha2("html", 256), "_bytes": F.octet_length("html")})
    largest = (
        rows.where(F.col("_bytes") >= min_bytes).groupBy("_key", "_bytes")
        .agg(F.max("page_id").alias("_top"), F.count("*").alias("_n"))
        .where("_n > 1 AND _top IS NOT NULL").drop("_n"))
    return rows.join(largest, ["_key", "_bytes"], "left").select(
        "page_id", "url", "html",
        F.when(F.col("page_id") == F.col("_top"), None).otherwise(F.col("_top")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    high, low = (NO_ID, 0) if page_id is None else (MARK, page_id & (1 << 64) - 1)
    # the variant bits of the low half are fixed, so its top two bits go to the high half
    high = high & ~0x0C00 | (low >> 62) << 10
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | 0x8000000000000000 | low & (1 << 62) - 1)}>"


def page_of(record: str | None) -> int | None:
    if not record:
        return None
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    high = value >> 64
    if high & ~0x0C00 == NO_ID & ~0x0C00:
        return None
    low = (high >> 10 & 3) << 62 | value & (1 << 62) - 1
    return low - (1 << 64) if low >> 63 else low


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
            ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
                date: str = DATE) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    headers = [
        ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return member("response", headers, http + payload)
    return member("revisit", [
        *headers, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)),
    ], http)


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of ``with_revisits`` below ``folder``, which all executors must share,
    and return one row per finished archive: ``archive``, ``records``, ``bytes``. Names hold
    the task's attempt: archives of an attempt that was lost are not in the result."""
    schema = "archive string, records long, bytes long"
    arrow = arrow_schema(schema)

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (
            fs.LocalFileSystem(), folder)
        store.create_dir(root)
        task = TaskContext.get()
        number, out, name, count, size = 0, None, "", 0, 0

        def finished():
            out.close()
            return pa.RecordBatch.from_pydict(
                {"archive": [posixpath.join(folder, name)], "records": [count], "bytes": [size]},
                schema=arrow)

        for part in slices(batches, 64):
            columns = [part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out = store.open_output_stream(posixpath.join(root, name), compression=None)
                    info = member("warcinfo", [
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                        ("WARC-Date", DATE), ("WARC-Filename", name),
                        ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    count, size = 0, len(info)
                data = page_record(page_id, url, html.encode(), refers_to)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    yield finished()
                    out, number = None, number + 1
        if out is not None:
            yield finished()

    return stage(records.mapInArrow(write, schema))


class Members:
    """Bytes of one gzip member at a time, decompressed piece by piece."""

    def __init__(self, data, piece: int = 64 << 10):
        self.data, self.piece, self.at = memoryview(data), piece, 0

    def open(self) -> None:
        self.start, self.unzip, self.held, self.rest = self.at, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        """Decompress on; False at the end of the member."""
        if self.unzip.eof:
            return False
        given = self.unzip.unconsumed_tail or self.data[self.at:self.at + self.piece]
        if not len(given):
            raise ValueError("the archive ends within a record")
        fresh = not self.unzip.unconsumed_tail
        self.held += self.unzip.decompress(given, self.piece)
        if fresh:
            self.at += len(given)
        if self.unzip.eof:
            self.at -= len(self.unzip.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.held:
            if not self.more():
                raise ValueError("a record's header does not end")
        head, _, self.held = self.held.partition(mark)
        return head

    def exactly(self, count: int) -> Iterator[bytes]:
        """The next ``count`` bytes, in pieces."""
        while count:
            if not self.held and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.held = self.held[:count], self.held[count:]
            count -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def records_of(archive: str, data: bytes, payloads: bool = False) -> Iterator[dict]:
    """Read one archive from its start to its end. Framing is by Content-Length, and both digests
    are verified; a fault raises ValueError with the archive and the member's place in it."""
    members = Members(data)
    while members.at < len(data):
        members.open()
        try:
            head = fields(members.until(b"\r\n\r\n"))
            left = int(head["content-length"])
            block, payload, kept, size = hashlib.sha1(), hashlib.sha1(), [], 0
            http, held = None, b""
            for piece in members.exactly(left):
                block.update(piece)
                if http is None:  # the HTTP headers of the block
                    held += piece
                    if b"\r\n\r\n" not in held:
                        continue
                    start, _, piece = held.partition(b"\r\n\r\n")
                    http = fields(start)
                payload.update(piece)
                size += len(piece)
                if payloads:
                    kept.append(piece)
            end = b"".join(members.exactly(4))
            while not members.held and members.more():
                pass
            if end != b"\r\n\r\n" or members.held:
                raise ValueError("a member holds more or less than one record")
            for name, digest in (("warc-block-digest", block), ("warc-payload-digest", payload)):
                if name == "warc-payload-digest" and head["warc-type"] != "response":
                    continue  # a revisit has the digest of the payload it does not hold
                given = head.get(name)
                if given and given != f"sha1:{base64.b32encode(digest.digest()).decode()}":
                    raise ValueError(f"{name} does not match")
        except (ValueError, KeyError, zlib.error) as error:
            raise ValueError(f"{archive}, member at byte {members.start}: {error}") from error
        if head["warc-type"] not in ("response", "revisit"):
            continue
        yield {
            "page_id": page_of(head["warc-record-id"]), "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"],
            "payload_bytes": int((http or {}).get("content-length", size)),
            "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
            "refers_to": page_of(head.get("warc-refers-to")),
            "payload": b"".join(kept) if payloads and head["warc-type"] == "response" else None,
            "archive": archive, "member_start": members.start}


def read_archives(spark: SparkSession, archives: list[str], payloads: bool = False) -> DataFrame:
    """The records of archives, one row each. Spark lists and opens the files, so they may lie in
    any store it can read; a task reads its archives one after the other."""
    arrow = arrow_schema(RECORD)
    if not archives:
        return spark.createDataFrame([], RECORD)

    def read(batches):
        for part in slices(batches, 1):
            rows, held = [], 0
            path, data = part.column("path")[0].as_py(), part.column("content")[0].as_buffer()
            for row in records_of(path, data, payloads):
                rows.append(row)
                held += len(row["payload"] or b"") + 200
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    return files.mapInArrow(read, RECORD)


def archived(pages: DataFrame, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    written = write_archives(with_revisits(pages, min_bytes), new_folder(spark))
    # one path per archive of FILE_BYTES, as in any listing of files
    names = [row.archive for row in written.select("archive").collect()]
    return read_archives(spark, names, payloads)
