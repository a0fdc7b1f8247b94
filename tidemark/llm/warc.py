"""WARC archives of individually compressed records that share a Zstandard dictionary.

An archive is one byte stream: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then a Zstandard frame
for each WARC 1.1 record, so any record can be read with the dictionary alone. The dictionary is trained on records from
all over the archive, as many as TRAIN_BYTES allow; where these are too few or too uniform to train on, their own
beginning is the dictionary.

Archives are rows (archive, content) of a table that Spark writes, so they can lie in any store that Spark reaches and
appear only when their task has committed; `export` copies one to a plain .warc.zst file.

Payloads equal to an earlier one (SHA-256 and length, from MIN_REVISIT bytes on) become revisit records of the row with
the smallest id among them. A null html is an empty payload, a null id takes no part in choosing the smallest, and every
row that repeats the smallest id is a response. A null url is archived as urn:absent. An empty table gives no archive.
Further input columns are not archived.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import stored

MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
TRAIN_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_DATE = "2024-01-01T00:00:00Z"

READ_SCHEMA = "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _record(row: dict) -> bytes:
    """A WARC record; a revisit has the HTTP head of the full payload and no body."""
    payload = row["payload"] if row["refers_to"] is None else b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {name(row['page_id'])}",
        f"WARC-Date: {ARCHIVE_DATE}",
        "WARC-Target-URI: " + ("urn:absent" if row["url"] is None else row["url"].replace("\r", "%0D").replace("\n", "%0A")),
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
    ]
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: {name(row['refers_to'])}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + head + payload + b"\r\n\r\n"


def archive_bytes(records: list[bytes]) -> bytes:
    """One archive of these records."""
    step = max(1, -(-sum(map(len, records)) // TRAIN_BYTES))
    sample = [r[:TRAIN_BYTES] for r in records[::step]]
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 8), sample)
    except (zstandard.ZstdError, ValueError):  # too few or too uniform
        trained = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = trained.as_bytes()
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw + b"".join(squeeze.compress(r) for r in records)


def records_of(content: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    magic, size = struct.unpack_from("<II", content) if len(content) >= 8 else (0, 0)
    trained, at = None, 0
    if magic == SKIPPABLE_MAGIC:
        trained, at = zstandard.ZstdCompressionDict(content[8 : 8 + size]), 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(view):
        one = opener.decompressobj()
        yield one.decompress(view[at:])
        at = len(view) - len(one.unused_data)


def parse(record: bytes) -> dict:
    """The headers and the payload of a record that `_record` laid out."""
    top, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda text: int(text) if (text := text.removeprefix("<urn:x-page:").removesuffix(">")) else None
    return {
        "page_id": number(headers["WARC-Record-ID"]),
        "url": None if headers["WARC-Target-URI"] == "urn:absent" else headers["WARC-Target-URI"],
        "record_type": headers["WARC-Type"],
        "refers_to": number(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None,
        "payload_bytes": int(inner["Content-Length"]),
        "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": payload if headers["WARC-Type"] == "response" else None,
    }


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each row.

    Equal payloads are found on ids and digests alone, and short ones aren't looked for. Payloads meet what was found by
    their own id, so a payload that a third of the rows share is spread like all others.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")
    ).select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    told = stored(rows.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "payload_digest"), "digests")
    first = told.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = first.where("n > 1 AND first_id IS NOT NULL").select("payload_digest", "first_id")
    again = told.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).distinct()
    again = again.toDF("__digest", "__id", "refers_to")
    joined = rows.join(again, rows["page_id"].eqNullSafe(again["__id"]) & (rows["payload_digest"] == again["__digest"]), "left")
    revisit = F.col("refers_to").isNotNull()
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to",
    )


def write_archives(records: DataFrame, path: str, archive_size: int = ARCHIVE_BYTES) -> None:
    """Write the rows of `plan_records` as a table of archives of about archive_size bytes of records each."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made, size
            if waiting:
                content = archive_bytes(waiting)
                yield pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{made:05d}.warc.zst"]), pa.array([content], pa.binary())], ["archive", "content"])
                made, size = made + 1, 0
                waiting.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for row in batch.slice(i, 64).to_pylist():
                    waiting.append(_record(row))
                    size += len(waiting[-1])
                    if size >= archive_size:
                        yield from out()
        yield from out()

    records.mapInArrow(packed, "archive string, content binary").write.mode("error").option("compression", "none").parquet(path)


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """A row for each record of the archives; payload is null for revisits, and for all if it isn't asked for.

    Digest and length of a response are those of the payload as read back, so a damaged archive shows.
    """
    import hashlib

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, size = [], 0
                for record in records_of(content):
                    row = parse(record) | {"archive": name}
                    if row["payload"] is not None:
                        row["payload_bytes"], row["payload_digest"] = len(row["payload"]), hashlib.sha256(row["payload"]).hexdigest()
                    size += len(record)
                    rows.append(row if payload else row | {"payload": None})
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    names = [part.split() for part in READ_SCHEMA.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in names])
    return archives.select("archive", "content").mapInArrow(read, READ_SCHEMA)


def export(archives: DataFrame, name: str, to: str) -> None:
    """Write one archive to a plain file of the driver."""
    with open(to, "wb") as file:
        for row in archives.where(F.col("archive") == name).select("content").toLocalIterator():
            file.write(row["content"])
