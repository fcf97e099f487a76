"""A deterministic, sharded WARC writer, and the reader for its archives.

Pages are range-sorted by id; a task writes the records of its range one by one
as gzip members, starts a new file whenever the compressed size reaches the roll
size, and regenerates all headers and digests from the row. Files are written
under temporary names that hold the attempt; the rows a task returns (its
manifest) go through Spark's own commit, so an attempt that died or ran twice
leaves no entry. Only then are the files of the manifest renamed, which may be
repeated, and the manifest is stored beside them.

Equal payloads are found by digest: one row per page with id and digest is
grouped, which combines before the shuffle, and only pages that revisit another
come back as short rows, which are sorted in front of their page. So the pages
themselves are shuffled once.

File names count ranges and files; the bytes depend only on the rows and the
number of ranges. The record date is a parameter.

Defined cases: a null payload is an empty one; a null url is left out of the
header, control characters and blanks in it are percent-encoded; null ids count
as the smallest id and write `none`; a record is named by page, payload and its number
among equals, so that rows with one id have names of their own; among rows with one id and payload the first
written is the response and the others revisit that id; an empty table gives no
files and an empty manifest. Columns other than the three are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, type_of
from tidemark.session import scratch_dir

MANIFEST = "part int, number int, temporary string, name string, records long, bytes long, sha256 string"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
TASK_BYTES = 64 << 20  # of archives a task reads or renames
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str, payload_digest: str, kind: str, number: int) -> str:
    """Names a record by its page, payload and kind, and its number among the records that share these."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {number} {payload_digest} of page {page}')}>"


def record(page_id, url, payload: bytes, refers_to, revisit: bool, date: str, number: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header only."""
    payload_digest = base32_sha1(payload)
    name = "none" if page_id is None else str(page_id)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(name, payload_digest, 'revisit' if revisit else 'response', number)}",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    lines += [
        f"WARC-Page-ID: {name}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        target = "none" if refers_to is None else str(refers_to)
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(target, payload_digest, 'response', 0)}",
            f"WARC-Refers-To-Page-ID: {target}",
        ]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(root: str, date: str, roll_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, digest, path = None, None, ""
        number = size = records = 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal out, number, size, records
            if out is not None:
                out.close()
                name = f"pages-{part:06d}-{number:05d}.warc.gz"
                done.append((part, number, path, name, records, size, digest.hexdigest()))
                out, number, size, records = None, number + 1, 0, 0

        at, targets, written, numbers = None, {}, set(), Counter()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, kind, url, html, sha1, refers_to = row
                if at != (page_id,):
                    at, targets, written, numbers = (page_id,), {}, set(), Counter()
                if kind == 0:
                    targets[sha1] = refers_to
                    continue
                payload = (html or "").encode()
                sha1 = hashlib.sha1(payload).hexdigest() if targets or written else ""
                revisit = sha1 in targets or sha1 in written
                target = targets.get(sha1, page_id)
                if not targets:
                    written.add(sha1 or hashlib.sha1(payload).hexdigest())
                if out is None:
                    path = f"{base}/.temporary/{attempt}-{part:06d}-{number:05d}"
                    files.create_dir(f"{base}/.temporary", recursive=True)
                    out, digest = files.open_output_stream(path), hashlib.sha256()
                same = revisit, sha1 or hashlib.sha1(payload).hexdigest()
                data = member(record(page_id, url, payload, target, revisit, date, numbers[same]), level)
                numbers[same] += 1
                out.write(data)
                digest.update(data)
                size, records = size + len(data), records + 1
                if size >= roll_bytes:
                    close()
        close()
        columns = list(zip(*done, strict=True)) if done else [[]] * 7
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _rename(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, name in zip(batch["temporary"].to_pylist(), batch["name"].to_pylist(), strict=True):
                if files.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                    files.move(path, f"{base}/{name}")
            yield batch

    return run


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1)


def write_warc(
    pages: DataFrame,
    root: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2025-01-01T00:00:00Z",
    roll_bytes: int = 256 << 20,
    min_revisit_bytes: int = 0,
    level: int = 6,
) -> DataFrame:
    """Writes the archives below `root`, a new folder all executors reach; returns the manifest.

    Of pages with equal payloads of at least `min_revisit_bytes` the one with the
    largest id is the response, the others revisit it.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")
    )
    narrow = stored(
        rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").alias("n"))
        .where(F.col("n") >= min_revisit_bytes)
        .drop("n"),
        "warc-digests",
    )
    largest = narrow.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = (
        narrow.join(largest, "sha1").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).drop("n")
    )
    kind = type_of(rows, "page_id")
    both = rows.select(
        "page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("string").alias("sha1"),
        F.lit(None).cast(kind).alias("refers_to"),
    ).unionByName(
        stored(revisits, "warc-revisits").select(
            "page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
            F.lit(None).cast("string").alias("html"), "sha1", "refers_to",
        )
    )
    uri = _uri(root)
    # Files roll within a range, so the number of ranges is free; all rows of an id share one.
    made = (
        both.repartitionByRange("page_id")
        .sortWithinPartitions("page_id", "kind", "url", "html")
        .mapInArrow(_writer(uri, date, roll_bytes, level), MANIFEST)
    )
    manifest = stored(made, "warc-manifest")
    renamed = _file_by_file(manifest).mapInArrow(_rename(uri), MANIFEST)
    renamed.drop("temporary").write.json(f"{root}/manifest")
    return pages.sparkSession.read.schema(
        "part int, number int, name string, records long, bytes long, sha256 string"
    ).json(f"{root}/manifest")


def _file_by_file(manifest: DataFrame) -> DataFrame:
    """The files dealt to tasks: as many as files, until a task has TASK_BYTES.

    The number is given, as Spark would join so few rows in one task.
    """
    size = manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    least = 4 * manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartition(max(1, min(size.files, max(least, -(-size.bytes // TASK_BYTES)))), "name")


WARC_ROW = (
    "page_id string, record_type string, url string, date string, payload_bytes long, payload_digest string, "
    "refers_to string, payload binary"
)


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of a stream of uncompressed WARC records."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record ends early")
        yield headers, block


def read_warc(spark: SparkSession, root: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files of a manifest; digests are checked against the blocks.

    Files are streamed: one record is in memory at a time, and a few as a batch.
    """
    uri = _uri(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io

        files, base = fs.FileSystem.from_uri(uri)
        names = [x.split()[0] for x in WARC_ROW.split(", ")]
        kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_file(f"{base}/{name}") as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)
                    for headers, block in records_of(stream):
                        if headers["warc-block-digest"] != "sha1:" + base32_sha1(block):
                            raise ValueError(f"{name}: a block differs from its digest")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        page = headers["warc-page-id"]
                        target = headers.get("warc-refers-to-page-id")
                        rows.append(
                            (
                                None if page == "none" else page,
                                kind,
                                headers.get("warc-target-uri"),
                                headers["warc-date"],
                                size,
                                digest,
                                None if target == "none" else target,
                                payload if payloads and kind == "response" else None,
                            )
                        )
                        held += len(payload) if payloads else 0
                        if len(rows) == 4096 or held > 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                yield packed(rows)

    return _file_by_file(manifest).select("name").mapInArrow(run, WARC_ROW)


def new_root(spark: SparkSession) -> str:
    return scratch_dir(spark, "warc")
