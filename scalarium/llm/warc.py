"""WARC archives in which a payload is stored once and its other records are revisits.

Headers only (digest and id) are counted and shuffled by payload digest to find each payload's original; records
then join it, and archives are written with fresh headers: the original as a response, the others as revisits
that refer to it.  Archives are gzip files of bounded numbers of records, written by Spark's own text writer, so
they can lie in any store that Spark writes: a record ends in a line break, which is the writer's separator.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarium.llm.tables import BATCH_BYTES, bounded, fresh_path, stored

RECORDS_PER_FILE = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit whose block has HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    lines.append(f"WARC-Block-Digest: sha1:{payload_digest(block)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Refers-To-Date: {date}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(lines: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of archives, from their lines without CR LF; lengths alone say where records end.

    No more than one record is held.
    """
    head: list[str] = []
    block: list[bytes] = []
    size, have = -1, 0
    for line in lines:
        if size < 0:
            if line:
                head.append(line.decode())
                continue
            if not head or not head[0].startswith("WARC/"):
                raise ValueError("no record where one should begin")
            headers = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in head[1:])}
            size = int(headers["content-length"])
            continue
        block += (line, b"\r\n")
        have += len(line) + 2
        if have >= size + 4:
            data = b"".join(block)
            if data[size:] != b"\r\n\r\n":
                raise ValueError("a record is longer than its header says")
            yield headers, data[:size]
            head, block, size, have = [], [], -1, 0
    if head or size >= 0:
        raise ValueError("a record is cut off")


def originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Digests (20 bytes) of payloads of at least so many bytes that several rows have, and the largest id of each."""
    headers = pages.filter(F.length("payload") >= least_bytes).select(F.unhex(F.sha1("payload")).alias("digest"), "page_id")
    return headers.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "original")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Deduplicated archives of the pages in the folder `path`.

    A null html is an empty payload.  Of records with equal payloads that with the largest id is the response, and
    so is each other row with that id; a null id is the smallest, and if all ids of a payload are null, all are
    responses.  Payloads under least_bytes are all responses.  A null url has no target header.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    found = stored(originals(rows, least_bytes), "originals")
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    joined = keyed.join(found, "digest", "left").select("page_id", "url", "payload", "original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for page_id, url, payload, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisit = original is not None and page_id != original
                made.append(record(page_id, url, payload, original, revisit)[:-2].decode())  # the writer ends it
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])

    joined.mapInArrow(run, "value string").write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives: page_id, url, record_type, payload_bytes and payload_digest (of the full payload), refers_to, payload (null for a revisit).

    A response's digest and length are those of the payload read, which must agree with its header.  Archives are read as
    lines (a gzip file by one task, its lines in order), so a task holds a record and never a file.
    """

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = re.compile(r"<urn:page:(-?\d+|none)>")
        of = lambda told: None if told is None or (m := number.fullmatch(told))[1] == "none" else int(m[1])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows, held = [], 0
        for headers, block in records(line for batch in batches for line in batch.column(0).cast(pa.binary()).to_pylist()):
            http, _, payload = block.partition(b"\r\n\r\n")
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            revisit = headers["warc-type"] == "revisit"
            if not revisit and (payload_digest(payload), len(payload)) != (digest, size):
                raise ValueError(f"the payload of {headers['warc-record-id']} isn't what its header says")
            rows.append((of(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], size, digest, of(headers.get("warc-refers-to")), None if revisit else payload))
            held += len(block) + 512
            if held > BATCH_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    lines = bounded(spark).read.option("pathGlobFilter", "*.txt.gz").option("lineSep", "\r\n").text(path)
    return lines.select("value").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages written as archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(spark, path)
