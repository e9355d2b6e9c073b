"""WARC archives: written by Spark's own text writer, indexed in one pass, read by coalesced byte ranges.

A record ends with two line breaks. With those as the line separator, the text writer's output of one record per row is a
plain WARC file, committed and retried like any other output, in any store that Spark writes to. The index pass
goes over every archive once, from header to header, and writes offset, length, URL and digest of each record;
reads then fetch only the ranges of the records that are wanted."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import map_batches, scratch_path, stage

REVISIT_BYTES = 1000  # equal payloads of at least this size are stored once
GAP = 1 << 16  # ranges nearer than this are read in one request
READ = 8 << 20  # a request for several records stays below this
DATE = "2024-01-01T00:00:00Z"
BREAK = "\r\n"


def _header(fields: list[tuple[str, Column | str]]) -> list[Column]:
    out = []
    for name, value in fields:
        text = F.lit(value) if isinstance(value, str) else value
        out.append(F.when(text.isNotNull(), F.concat(F.lit(f"{name}: "), text, F.lit(BREAK))).otherwise(""))
    return out


def write(pages: DataFrame, path: str, min_bytes: int = REVISIT_BYTES) -> None:
    """Writes one record per row to ``path``/archives, an archive per task.

    Of records with equal payloads of at least ``min_bytes``, the one with the largest page_id is the response and the
    others are revisits, without payload. Null html is an empty payload, a null url an empty one (line breaks in it are
    escaped); rows that repeat a page_id are all written, and of equal payloads under the largest page_id all are
    responses. Null page_ids are written as responses. An empty table gives no records. Other columns are ignored.

    Digests are grouped without payloads; only the groups of more than one record are joined back, so payloads
    are not shuffled where those fit a broadcast, and are otherwise joined like any skewed join."""
    payload = F.coalesce(F.col("html"), F.lit("")).alias("payload")
    held = pages.select("page_id", "url", payload)
    held = held.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")})
    ids = held.select("page_id", "digest", "payload_bytes").filter(F.col("payload_bytes") >= min_bytes)
    groups = ids.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("_kept"), F.count("*").alias("_n"))
    groups = stage(groups.filter("_n > 1").drop("_n"), "warc-repeated")
    held = held.join(groups, ["digest", "payload_bytes"], "left")
    held = held.withColumn("refers_to", F.when(F.col("page_id") < F.col("_kept"), F.col("_kept")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK * 2))
    block = F.concat(http, F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(""))
    fields = [
        ("WARC-Type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        ("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "%0A")),
        ("WARC-Date", DATE),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        ("WARC-Profile", F.when(F.col("refers_to").isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.lit(f"WARC/1.1{BREAK}"), *_header(fields), F.lit(BREAK), block)
    held.select(record.alias("value")).write.option("lineSep", BREAK * 2).text(f"{path}/archives")


def _open(name: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
    return store.open_input_file(at)


def _walk(name: str) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and header fields of each record, reading READ bytes at a time."""
    source = _open(name)
    size, at, data, start = source.size(), 0, b"", 0
    while at < size:
        end = data.find(BREAK.encode() * 2, at - start)
        while end < 0:
            more = source.read_at(READ, start + len(data))
            if not more:
                raise ValueError(f"{name} ends inside a header")
            data, start = data[at - start :] + more, at
            end = data.find(BREAK.encode() * 2)
        fields = _fields(data[at - start : end])
        length = start + end + 4 - at + int(fields["Content-Length"])
        yield at, length, fields
        at += length + 4
        if at - start > len(data):
            data, start = b"", at


def index(spark: SparkSession, path: str) -> DataFrame:
    """Writes ``path``/index: file, offset, length, url, digest, page_id, record_type, refers_to of every record of every
    archive, and returns it. Each archive is read once, from start to end."""
    files = spark.read.format("binaryFile").load(f"{path}/archives").filter("length > 0").select(F.col("path").alias("file"))
    count = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = list(_walk(name))
                for i in range(0, len(rows), 10_000):
                    some = rows[i : i + 10_000]
                    yield {
                        "file": [name] * len(some), "offset": [r[0] for r in some], "length": [r[1] for r in some],
                        "url": [r[2].get("WARC-Target-URI", "") for r in some], "digest": [r[2]["WARC-Payload-Digest"].removeprefix("sha1:") for r in some],
                        "page_id": pa.array([_number(r[2]["WARC-Record-ID"]) for r in some], pa.int64()), "record_type": [r[2]["WARC-Type"] for r in some],
                        "refers_to": pa.array([_number(r[2].get("WARC-Refers-To")) for r in some], pa.int64()),
                    }

    schema = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
    map_batches(files.repartition(count, "file"), schema, run).write.parquet(f"{path}/index")
    return spark.read.schema(schema).parquet(f"{path}/index")


def _number(name: str | None) -> int | None:
    return None if name is None or name == "<urn:page:null>" else int(name.removeprefix("<urn:page:").removesuffix(">"))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split(BREAK)
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    return dict(x.split(": ", 1) for x in lines[1:])


def _parse(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    head, _, block = record.partition(b"\r\n\r\n")
    http, _, payload = block.partition(b"\r\n\r\n")
    return _fields(head), http, payload


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Coalesces sorted (offset, length) rows: start, end, and the rows inside."""
    start = end = 0
    held: list[int] = []
    for i, (offset, length) in enumerate(rows):
        if held and (offset - end > GAP or offset + length - start > READ):
            yield start, end, held
            held = []
        if not held:
            start = end = offset
        end = max(end, offset + length)
        held.append(i)
    if held:
        yield start, end, held


def read(selected: DataFrame, payload: bool = True) -> DataFrame:
    """Reads the records of ``selected`` (rows of the index, filtered as wanted) back from the archives: page_id,
    url, record_type, refers_to, payload_digest, payload_bytes, and payload (of responses; null for revisits).

    The selected rows of an archive are sorted by offset and near ranges are read in one request. Each
    response's digest is worked out anew; one that differs from its header is an error."""
    rows = selected.select("file", "offset", "length")
    tasks = max(1, rows.select("file").distinct().count())
    rows = rows.repartition(tasks, "file").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        name, source = None, None
        for batch in batches:
            files = batch.column("file").to_pylist()
            spans = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if files[i] != name:
                    name = files[i]
                    source = _open(name)
                for start, end, held in _ranges(spans[i:j]):
                    data = source.read_at(end - start, start)
                    out = {k: [] for k in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")}
                    for r in held:
                        offset, length = spans[i + r]
                        fields, http, body = _parse(data[offset - start : offset - start + length])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = fields["WARC-Type"] == "response"
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        if response and (hashlib.sha1(body).hexdigest() != digest or len(body) != size):
                            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was written")
                        values = (_number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI", ""), fields["WARC-Type"])
                        values += (_number(fields.get("WARC-Refers-To")), digest, size, body if response and payload else None)
                        for column, value in zip(out.values(), values):
                            column.append(value)
                    out["payload"] = pa.array(out["payload"], pa.binary())
                    out["page_id"] = pa.array(out["page_id"], pa.int64())
                    out["refers_to"] = pa.array(out["refers_to"], pa.int64())
                    yield out
                i = j

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    made = map_batches(rows, schema, run)
    return made if payload else made.drop("payload")


def round_trip(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes the pages to a fresh folder of the shared scratch space and reads every record back, without payloads."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes)
    return read(index(pages.sparkSession, path), payload=False)
