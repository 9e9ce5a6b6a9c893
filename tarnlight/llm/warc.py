"""WARC archives with a Zstandard dictionary in a leading skippable frame.

Each archive is a byte string: a skippable frame (magic 0x184D2A5D) that holds a
dictionary built from the archive's own records, then one Zstandard frame a record,
compressed with it, so that every record can be read by itself.  Archives are cells of a
table, written and committed by Spark, because executors share no local files;
:func:`save_archives` puts them as ``.warc.zst`` files into a folder that all mount.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest id
is a ``response``; the others are ``revisit`` records that refer to it and hold no payload.
Defined results: a null payload is empty; a null id is never the largest unless all are
null, and differs from an empty one; rows that repeat the largest id and payload are all
responses; ids and URLs of any characters fit into one header line (a URL's white space and
control characters read back as ``%XX``, a null URL as ``about:blank``); payloads of any length
are one record; extra columns are not read; an empty table gives no archives.

The dictionary is trained on pieces at even distances through an archive's records, ``TRAINING_BYTES`` in all, however
large those are; of many records, not every one gives a piece.  Where training finds nothing in common (or sees too little) the dictionary is
the pieces' raw bytes; only archives below ``8 * MIN_DICTIONARY`` bytes have none.

Scale: equal payloads meet by hash; only (hash, largest id) of hashes that occur twice is
joined back, and Spark splits a hot payload's rows in that join.  A task holds one
archive's records (``ARCHIVE_BYTES`` of payload) at a time.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlight.llm.shared import utf8

MIN_BYTES = 1_000
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
MIN_DICTIONARY = 256
#: Bound of the bytes of an archive's records that its dictionary is trained on, and of each piece of them.
TRAINING_BYTES = 1 << 20
PIECE_BYTES = 2 << 10
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
LEVEL = 3
SKIPPABLE = 0x184D2A5D
FEED = 8 << 10
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(key, url, payload, refers_to, record_type) for each row."""
    own = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    large = F.octet_length("payload") >= min_bytes
    # A small record's key is its own, so it meets nothing in the join, and small records spread evenly.
    own = own.withColumns({"large": large, "hash": F.when(large, F.sha2("payload", 256)).otherwise(F.concat(F.lit("small:"), F.xxhash64("key", "payload").cast("string")))})
    again = own.filter("large").groupBy("hash").agg(F.max("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = own.join(again, "hash", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    return found.select("key", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, "revisit").otherwise("response").alias("record_type"))


def record_id(key) -> str:
    return "<urn:x-record>" if key is None else f"<urn:x-record:{quote(str(key), safe='')}>"


def key_of(urn: str | None) -> str | None:
    """The id in a record's name; None where it has none."""
    return unquote(urn[14:-1]) if urn and urn.startswith("<urn:x-record:") else None


def target_uri(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x20\x7f-\xa0]", lambda m: quote(m.group()), url or "about:blank")


def build_record(key, url: str | None, payload: bytes, refers_to, record_type: str) -> bytes:
    """One WARC/1.1 record, as bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if record_type == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target_uri(url)}",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
    ]
    if record_type == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def training_pieces(records: list[bytes]) -> list[bytes]:
    """Pieces of at most ``PIECE_BYTES`` at even distances through the records, ``TRAINING_BYTES`` in all."""
    places = [(k, at) for k, r in enumerate(records) for at in range(0, len(r), PIECE_BYTES)]
    step = max(1.0, sum(map(len, records)) / TRAINING_BYTES)
    chosen = (places[int(i * step)] for i in range(int(len(places) / step)))
    return [records[k][at : at + PIECE_BYTES] for k, at in chosen]


def _train(records: list[bytes]) -> bytes:
    """A dictionary from the archive's own records; empty only for an archive of next to nothing."""
    import zstandard

    pieces = training_pieces(records)
    size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // 8)
    if size < MIN_DICTIONARY:
        return b""
    try:
        return zstandard.train_dictionary(size, pieces, k=64, d=8, steps=1, threads=0).as_bytes()
    except zstandard.ZstdError:  # too few pieces, or nothing in common
        each = -(-size // len(pieces))
        raw = b"".join(p[:each] for p in pieces)[:size]
        return b" " + raw if raw.startswith(DICTIONARY_MAGIC) else raw


def build_archive(records: list[bytes]) -> bytes:
    import zstandard

    words = _train(records)
    out = io.BytesIO()
    out.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    for record in records:
        out.write(packer.compress(record))
    return out.getvalue()


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    words, at = content[8 : 8 + size], 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    while at < len(content):
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            piece = content[at : at + FEED]
            if not piece:
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    """The fields of a record; the payload is None for a revisit."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"fields": fields, "payload": body if response else None, "payload_bytes": length, "digest": digest}


ARCHIVES = T.StructType([T.StructField("archive", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("content", T.BinaryType())])
_ARCHIVES = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("content", pa.binary())])


def write_archives(planned: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, n_records, content): archives of planned records, each of about ``archive_bytes`` of payload."""

    def pack(records: list[bytes]) -> pa.RecordBatch:
        content = build_archive(records)
        name = str(uuid.UUID(bytes=hashlib.md5(content).digest()))
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((name, len(records), content), _ARCHIVES)], schema=_ARCHIVES)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in source:
            keys, urls, refers, kinds = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for row in zip(keys, urls, utf8(batch.column(2)), refers, kinds):
                records.append(build_record(*row))
                size += len(row[2]) + 512
                if size >= archive_bytes:
                    yield pack(records)
                    records, size = [], 0
        if records:
            yield pack(records)

    return planned.select("key", "url", "payload", "refers_to", "record_type").mapInArrow(run, ARCHIVES)


def read_archives(archives: DataFrame, key: T.DataType | None = None) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record; payloads are checked against their digests."""
    names = ("key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = ("string", "string", "bigint", "string", "string", "string", "binary")
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    arrow = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[k]) for n, k in zip(names, kinds)])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for content in batch.column(0):
                rows = []
                for record in read_archive(content.as_py()):
                    r = parse_record(record)
                    f = r["fields"]
                    rows.append((key_of(f["WARC-Record-ID"]), f["WARC-Target-URI"], r["payload_bytes"], r["digest"], f["WARC-Type"], key_of(f.get("WARC-Refers-To")), r["payload"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    out = archives.select("content").mapInArrow(run, schema)
    if key is not None:
        out = out.withColumns({"key": F.col("key").cast(key), "refers_to": F.col("refers_to").cast(key)})
    return out


def save_archives(archives: DataFrame, folder: str) -> None:
    """Each archive as ``<folder>/<archive>.warc.zst``, for a folder that all executors mount.

    A file appears under its name only when whole; a task that runs again writes the same file.
    """

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = os.path.join(folder, f".{row['archive']}.{uuid.uuid4().hex}")
            with open(part, "wb") as out:
                out.write(row["content"])
            os.replace(part, os.path.join(folder, f"{row['archive']}.warc.zst"))

    archives.foreachPartition(run)
