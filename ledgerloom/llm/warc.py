"""WARC records as a chunked record table.

An archive is a Parquet table of chunks ``record, chunk, data, digest``: chunk 0 of a record
holds its WARC header, the others at most CHUNK bytes of its payload each. The data of a
record's chunks in order are the bytes of a WARC/1.1 record (:func:`warc_bytes` gives whole
files), and each chunk carries the payload's SHA-1 *so far*, so a writer and a reader work
through a payload of any size chunk by chunk and notice damage at the chunk it is in.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, in_small_batches, new_folder, sent, whole_text, width

CHUNK, SMALLEST_REVISITED = 1 << 16, 1000
ARCHIVE = "record string, chunk int, data binary, digest string"
INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = 256  # chunks that a writer hands on at once


def classify(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """``page_id, url, payload, sha1, record_type, refers_to`` of each page.

    Of the pages with equal payloads of at least SMALLEST_REVISITED bytes that with the
    largest id is the response. Payloads are equal when two digests and the length agree.
    Null html is the empty payload, payloads of any length are compared by digests.
    Repeated rows are all responses if they have the largest id; a null id is a response
    only if no equal payload has another id. An empty table gives an empty result.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        (F.col(url) if url in pages.columns else F.lit(None)).cast("string").alias("url"),
        whole_text(html).cast("binary").alias("payload"),
    )
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.when(F.length("payload") >= SMALLEST_REVISITED, F.sha2("payload", 256)).alias("same"))
    holders = rows.where("same is not null").groupBy("sha1", "same").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(sent(checkpointed(holders)), ["sha1", "same"], "left")  # payloads are shuffled only beside very many groups of copies
    response = F.col("holder").isNull() | F.col("page_id").eqNullSafe(F.col("holder"))
    return rows.select("page_id", "url", "payload", "sha1", F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("holder")).alias("refers_to"))


def _header(row: dict, record: str, size: int, date: str) -> bytes:
    """The header fields of one record and the empty line.

    The id is that of the record's place in the archive, so repeated pages and pages
    without id have different ones; a revisit names the page that it refers to.
    """
    revisit = row["record_type"] == "revisit"
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row['page_id']} {row['sha1']} {record}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": "".join((row["url"] or "about:blank").split()),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode(),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": 0 if revisit else size,
        "X-Payload-Length": size,
    }
    if row["page_id"] is not None:
        fields["X-Page-Id"] = row["page_id"]
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To-Date": date, "X-Refers-To-Page-Id": row["refers_to"]}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def _chunks(date: str, chunk_bytes: int):
    """Batches of classified pages to chunk rows; a payload is read through a view, never copied whole."""
    schema = pa.schema([("record", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("digest", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, out, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            payloads = batch.column("payload")
            for i, row in enumerate(batch.drop_columns(["payload"]).to_pylist()):
                payload, digest = memoryview(payloads[i].as_buffer()), hashlib.sha1()
                record, number = f"{task:06d}-{number:012d}", number + 1
                out.append((record, 0, _header(row, record, len(payload), date), digest.hexdigest()))
                stored = len(payload) if row["record_type"] == "response" else 0
                for chunk, start in enumerate(range(0, stored, chunk_bytes), 1):
                    part = bytes(payload[start : start + chunk_bytes])
                    digest.update(part)
                    out.append((record, chunk, part, digest.hexdigest()))
                    held += len(part)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return write


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = CHUNK, **columns: str) -> None:
    """Write one WARC record per page to the chunk table at ``path``."""
    in_small_batches(classify(pages, **columns)).mapInArrow(_chunks(date, chunk_bytes), ARCHIVE).write.option("compression", "zstd").parquet(path)


def _fields(header: bytes) -> dict[str, str]:
    first, *lines = header.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return dict(line.split(": ", 1) for line in lines if line)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows in order of record and chunk to one index row a record, one chunk at a time."""
    names = INDEX.split(", ")
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n.split()[0], kinds[n.split()[1]]) for n in names])
    record, fields, digest, size, out = None, {}, None, 0, []

    def close() -> None:
        if record is None:
            return
        if size != int(fields["Content-Length"]):
            raise ValueError(f"record {record} has {size} of {fields['Content-Length']} bytes")
        stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if fields["WARC-Type"] == "response" and digest.hexdigest() != stated:
            raise ValueError(f"record {record} has another digest than it states")
        number = lambda name: int(fields[name]) if name in fields else None
        out.append((number("X-Page-Id"), number("X-Payload-Length"), stated, fields["WARC-Type"], number("X-Refers-To-Page-Id")))

    for batch in batches:
        data = batch.column("data")
        for i, (name, chunk, so_far) in enumerate(zip(batch.column("record").to_pylist(), batch.column("chunk").to_pylist(), batch.column("digest").to_pylist())):
            part = data[i].as_buffer()
            if chunk == 0:
                close()
                record, fields, digest, size, expected = name, _fields(part.to_pybytes()), hashlib.sha1(), 0, 0
            else:
                digest.update(part)
                size += len(part)
            if name != record or chunk != expected or digest.hexdigest() != so_far:
                raise ValueError(f"record {name} is damaged at chunk {chunk}")
            expected += 1
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record.

    A record's chunks meet in one task in order but are held one at a time. A missing,
    changed or misplaced chunk ends the query with an error that names it.
    """
    chunks = spark.read.schema(ARCHIVE).parquet(path)
    return in_small_batches(chunks.repartition(width(chunks), "record").sortWithinPartitions("record", "chunk")).mapInArrow(_read, INDEX)


def warc_bytes(spark: SparkSession, path: str, record: str) -> Iterator[bytes]:
    """The bytes of one WARC record, chunk by chunk, as a ``.warc`` file holds them."""
    for row in spark.read.schema(ARCHIVE).parquet(path).where(F.col("record") == record).orderBy("chunk").toLocalIterator():
        yield bytes(row["data"])
    yield b"\r\n\r\n"


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write an archive to the shared folder and read it back. An empty table gives an empty result."""
    path = new_folder(pages.sparkSession, "warc")
    write_archive(pages, path, **columns)
    return read_archive(pages.sparkSession, path)
