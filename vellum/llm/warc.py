"""WARC archives, index first.

Writing: every record becomes one gzip member of an archive; its offset, length, URL and digest go to an index.
Reading: the selected index rows are dealt out by archive and byte range, sorted, and adjacent ranges are
coalesced into few reads. Archives lie in a folder that all executors share and are opened by its URI (local,
HDFS, object stores). A file's name holds a random part and the index names only files of tasks that
committed, so a task that runs again leaves at most an orphan.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the record with the largest page_id is the
response and the others revisit it. Rows that share that page_id are all responses; a null page_id is
smaller than any other, and if all are null all are responses. A group's rows are salted before the join, so
a payload that fills a third of the table does not meet in one task.

Defined results. Null html: an empty payload, a response. Null URL: ``about:blank`` in the archive, null in the
index. Repeated rows: a record each. No rows: no archives, an empty index. Extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, slices, split_join, table

MIN_REVISIT = 1000
ARCHIVE_BYTES = 256 << 20
#: Index rows are dealt out by ranges of this size; within one, gaps up to MAX_GAP are read over.
RANGE_BYTES, MAX_GAP = 8 << 20, 64 << 10
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
#: A fixed date keeps archives the same from run to run.
DATE = "2000-01-01T00:00:00Z"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to, refers_url."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    records = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("size", F.octet_length("payload"))
    key = F.when(F.col("size") >= MIN_REVISIT, F.sha2("payload", 256))
    keyed = records.withColumn("key", key)
    large = keyed.where("key is not null")
    first = large.groupBy("key").agg(F.max("page_id").alias("top"), F.max_by("url", "page_id").alias("top_url"), F.count("*").alias("n")).where("n > 1 and top is not null")
    known = split_join(large, first, "key", "n", pages.count(), "left")
    small = keyed.where("key is null").withColumns({"top": F.lit(None).cast("long"), "top_url": F.lit(None).cast("string"), "n": F.lit(None).cast("long")})
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return known.unionByName(small).select(
        "page_id", "url", "payload", F.sha1("payload").alias("digest"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("top")).alias("refers_to"), F.when(again, F.col("top_url")).alias("refers_url"))


def record_id(page_id: int | None) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One gzip member. The stored HTTP header tells the size of the full payload, in revisits too."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": clean(url), "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    }
    if kind == "revisit":
        head |= {"WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Target-URI": clean(refers_url), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head["Content-Length"] = str(len(block))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def clean(url: str | None) -> str:
    return "about:blank" if url is None else re.sub(r"[\r\n]+", " ", url)


def decode_record(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload. A response's digest is checked."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return page_of(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")), payload


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records of with_revisits() into archives; returns the index, kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        out, name, at = None, "", 0
        try:
            for part in slices(batches, 256):
                rows = []
                for page_id, url, payload, digest, kind, to, to_url in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{root}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = store.open_output_stream(name, compression=None), 0
                    data = encode_record(page_id, url, payload, digest, kind, to, to_url)
                    out.write(data)
                    rows.append((name, at, len(data), url, digest, page_id, kind))
                    at += len(data)
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return cut(records.select("page_id", "url", "payload", "digest", "record_type", "refers_to", "refers_url").mapInArrow(run, INDEX))


def read_warc(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Reads the records that the index rows select: page_id, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for."""
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)

        def fetch(name: str, wanted: list[tuple[int, int]]) -> pa.RecordBatch:
            first, last = wanted[0][0], wanted[-1][0] + wanted[-1][1]
            with store.open_input_file(name) as f:
                data = f.read_at(last - first, first)
            rows = [decode_record(data[o - first : o - first + n])[: len(kinds)] for o, n in wanted]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

        name, wanted = None, []
        for part in slices(batches, 4096):
            for f, o, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if wanted and (f != name or o - sum(wanted[-1]) > MAX_GAP or o + n - wanted[0][0] > RANGE_BYTES):
                    yield fetch(name, wanted)
                    wanted = []
                name = f
                wanted.append((o, n))
        if wanted:
            yield fetch(name, wanted)

    span = (F.col("offset") / RANGE_BYTES).cast("long")
    rows = index.select("file", "offset", "length").repartition("file", span).sortWithinPartitions("file", "offset")
    sql = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}
    return rows.mapInArrow(run, ", ".join(f"{k} {sql[k]}" for k in kinds))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_warc(write_warc(with_revisits(table(spark, sf_dir, "pages")), folder), folder)


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY sha256(html)) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < top THEN top END AS refers_to
FROM d
"""
