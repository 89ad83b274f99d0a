"""WARC archives: write, index, and read selected records by byte ranges.

Spark's text writer commits the archives: a row is a record and the line
separator is the empty lines that end one. The index comes first: one task per
archive hops from header to header and writes file, offset, length, URL and
digest of each record. Reading takes any selection of the index, sorts it by
place and turns neighbours into one read.

A payload that occurs more than once is stored by the page with the smallest
page_id; the others are revisit records that refer to it. Who revisits whom is
settled on digests alone, counted before the shuffle, so a payload that many
pages share costs a grouped sum, and only the short list of revisits meets the
pages again, by page_id.

Cases: a null html is an empty payload. Payloads under 100 bytes are always
responses. A null page_id is a response and is never referred to. Rows that
repeat a page_id and its payload are alike: all responses or all revisits. A
null url is left out of the record. Control characters in a url are
percent-encoded. Archives may lie wherever Spark writes and pyarrow reads: local
or shared folders, HDFS, S3 or GCS. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import width
from tidemark.session import checkpoint

REVISIT_BYTES = 100
#: A read spans gaps up to this, and grows up to that.
GAP = 64 << 10
READ = 8 << 20
_WINDOW = 1 << 20
_END = "\r\n\r\n"
_NAME = "urn:x-page:"
INDEX = "file string, offset long, length long, url string, page_id long, record_type string, payload_digest string, refers_to long"


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns(
        {"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)}
    )


def revisits(pages: DataFrame, at_least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest and ``first``, the page that stores the payload of a revisit."""
    short = checkpoint(_payloads(pages).select("page_id", "digest", "bytes").filter((F.col("bytes") >= at_least) & F.col("page_id").isNotNull()))
    shared = short.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    shared = shared.filter("first <> last").select("digest", "first")
    later = short.select("page_id", "digest").join(shared, "digest").filter("page_id <> first")
    return later.distinct()


def _record(date: str) -> Column:
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    again = F.col("first").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"\r\nWARC-Record-ID: <{_NAME}"), name, F.lit(">"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{_NAME}"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END),
        block,
    )


def write(pages: DataFrame, folder: str, at_least: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per page into archives below ``folder``."""
    again = checkpoint(revisits(pages, at_least))
    rows = _payloads(pages).join(again, ["page_id", "digest"], "left")
    rows.select(_record(date).alias("record")).write.option("lineSep", _END).text(folder)


def _open(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record starts here: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix(_NAME)
    return int(number) if number else None


def _records(file: pa.NativeFile, size: int) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, header fields) of each record; payloads are skipped."""
    at, begin, window = 0, 0, b""
    while at < size:
        end, want = (window.find(_END.encode(), at - begin) if at < begin + len(window) else -1), _WINDOW
        while end < 0:
            begin, window = at, file.read_at(min(want, size - at), at)
            end = window.find(_END.encode())
            if end < 0 and at + len(window) >= size:
                raise ValueError(f"the header of the record at {at} does not end")
            want *= 2
        fields = _fields(window[at - begin : end])
        length = end - (at - begin) + 4 + int(fields["content-length"])
        yield at, length, fields
        at += length + 4


def index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives below ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                with _open(path) as file:
                    for offset, length, f in _records(file, size):
                        rows.append((path, offset, length, f.get("warc-target-uri"), _page(f["warc-record-id"]), f["warc-type"], f["warc-payload-digest"].removeprefix("sha256:"), _page(f.get("warc-refers-to"))))
                        if len(rows) == 4_096:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), target.types)], schema=target)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), target.types)], schema=target)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.filter("length > 0").repartition(width(spark), "path").mapInArrow(run, INDEX)


def _ranges(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of index rows, sorted by place, that one read covers."""
    run: list[tuple] = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > GAP or row[1] + row[2] - run[0][1] > READ):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read(selected: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the records of an index; adds payload_bytes and, for responses, checks the digest."""
    names = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "page_id", "record_type", "refers_to", "payload_digest"))))
            path, file = None, None
            for group in _ranges(rows):
                if group[0][0] != path:
                    path, file = group[0][0], _open(group[0][0])
                begin = group[0][1]
                data = file.read_at(group[-1][1] + group[-1][2] - begin, begin)
                out = []
                for _, offset, length, page, kind, first, digest in group:
                    record = data[offset - begin : offset - begin + length]
                    http = record.partition(_END.encode())[2]
                    head, _, payload = http.partition(_END.encode())
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"the record at {offset} of {path} does not hold what its digest says")
                    out.append((page, kind, first, digest, size) + (payload,) * payloads)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)

    ordered = selected.repartitionByRange(width(selected.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    return ordered.mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Give each revisit the size and digest of the payload it refers to."""
    again = records.filter("record_type = 'revisit'")
    stored = records.filter("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("_stored")).agg(
        F.first("payload_bytes").alias("_bytes"), F.first("payload_digest").alias("_digest")
    )
    found = again.join(stored, F.col("refers_to") == F.col("_stored"), "left")
    found = found.withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest")}).select(*records.columns)
    return records.filter("record_type <> 'revisit'").unionByName(found)
