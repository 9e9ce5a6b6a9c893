"""Media columns by signature sniffing.

An Aho-Corasick automaton over magic bytes finds every place where a known format might
start.  A validator for each format then confirms its structure and finds its length; what
fails is no medium.  A medium at offset 0 that ends with the cell corrects the declared
type; others, also those inside another, are embedded and can be carved out.

Texts become media losslessly: UTF-8, zero bytes up to a positive multiple of 64, stored as
the samples of an 8-bit mono WAV file.

Defined results: a null cell is an empty one; an empty cell has no medium and keeps its
declared type (``application/octet-stream`` where null); equal cells give equal values;
repeated rows each get a row; cells of any length are sniffed whole; input columns pass through
under any names, and those that the operator adds replace columns of the same names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlight.llm.shared import utf8

UNIT = 64
RATE = 8_000
UNKNOWN = "application/octet-stream"
SLICE = 8 << 20


# --- validators: (bytes, start) -> length of the medium there, or None ---------


def _riff(b: bytes, at: int, form: bytes) -> int | None:
    if len(b) < at + 12 or b[at + 8 : at + 12] != form:
        return None
    size = struct.unpack_from("<I", b, at + 4)[0]
    stop = at + 8 + size
    if size < 4 or stop > len(b):
        return None
    p, seen = at + 12, []
    while p + 8 <= stop:
        name, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > stop:
            return None
        seen.append(name)
        p += 8 + n + (n & 1)
    if form == b"WAVE" and not (b"fmt " in seen and b"data" in seen):
        return None
    return stop - at if p >= stop and seen else None


def wav(b: bytes, at: int) -> int | None:
    return _riff(b, at, b"WAVE")


def webp(b: bytes, at: int) -> int | None:
    return _riff(b, at, b"WEBP")


def avi(b: bytes, at: int) -> int | None:
    return _riff(b, at, b"AVI ")


def png(b: bytes, at: int) -> int | None:
    """Chunks from IHDR to IEND, each with a right checksum."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (kind == b"IHDR") != first:
            return None
        if zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return None


def gif(b: bytes, at: int) -> int | None:
    """Blocks up to the trailer."""
    if len(b) < at + 14:
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(q: int) -> int | None:
        while q < len(b):
            if not b[q]:
                return q + 1
            q += 1 + b[q]
        return None

    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21 and p + 2 <= len(b):
            q = blocks(p + 2)
        elif kind == 0x2C and p + 10 < len(b):
            own = b[p + 9]
            q = blocks(p + 11 + (3 << (own & 7) + 1 if own & 0x80 else 0))
        else:
            return None
        if q is None:
            return None
        p = q
    return None


def jpeg(b: bytes, at: int) -> int | None:
    """Marker segments, then scan data up to the end marker."""
    p, scanned = at + 2, False
    while p + 4 <= len(b) or (p + 2 <= len(b) and b[p + 1] == 0xD9):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at if scanned else None
        if kind == 0xFF:
            p += 1
            continue
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            p += 2
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return None
        p += 2 + n
        if kind == 0xDA:
            scanned = True
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
    return None


def bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 30:
        return None
    size, reserved, start, head = struct.unpack_from("<IIII", b, at + 2)
    if reserved or head not in (40, 52, 56, 108, 124) or not 14 + head <= start <= size or at + size > len(b):
        return None
    wide, high, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or wide <= 0 or not high:
        return None
    return size if size >= start + (wide * bits + 31) // 32 * 4 * abs(high) or struct.unpack_from("<I", b, at + 30)[0] else None


def _ogg_checksums() -> tuple[int, ...]:
    """The CRC-32 of each byte at the head of a word, by the polynomial of Ogg pages, most significant bit first."""
    table = []
    for byte in range(256):
        r = byte << 24
        for _ in range(8):
            r = (r << 1 ^ (0x04C11DB7 if r & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(r)
    return tuple(table)


OGG_CRC = _ogg_checksums()


def ogg(b: bytes, at: int) -> int | None:
    """The pages of one stream: one serial number, numbered in order, each with its checksum, from the first page's flag to the last page's.

    A page inside a stream has no first flag, so it begins nothing: each page is walked for one stream only.
    """
    p, first, number = at, True, 0
    serial = b[at + 14 : at + 18]
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0:
        flags, count = b[p + 5], b[p + 26]
        stop = p + 27 + count + sum(b[p + 27 : p + 27 + count])
        if bool(flags & 2) != first or b[p + 14 : p + 18] != serial or p + 27 + count > len(b) or stop > len(b):
            return None
        if struct.unpack_from("<I", b, p + 18)[0] != number or _ogg_sum(b[p : p + 22] + bytes(4) + b[p + 26 : stop]) != struct.unpack_from("<I", b, p + 22)[0]:
            return None
        if flags & 4:
            return stop - at
        p, first, number = stop, False, number + 1
    return None


def _ogg_sum(page: bytes) -> int:
    r = 0
    for x in page:
        r = (r << 8 & 0xFFFFFFFF) ^ OGG_CRC[r >> 24 ^ x]
    return r


def gzip(b: bytes, at: int) -> int | None:
    """A whole deflate stream with a right trailer; output is read in slices."""
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    reader, p = zlib.decompressobj(31), at
    try:
        while not reader.eof:
            piece = reader.unconsumed_tail or b[p : p + 65536]
            if not piece:
                return None
            if not reader.unconsumed_tail:
                p += len(piece)
            reader.decompress(piece, 1 << 20)
    except zlib.error:
        return None
    return p - len(reader.unused_data) - at


def pdf(b: bytes, at: int) -> int | None:
    """From the header to the last end mark before another header."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    limit = b.find(b"%PDF-", at + 5)
    stop = b.rfind(b"%%EOF", at, limit if limit >= 0 else len(b))
    if stop < 0 or b.rfind(b"startxref", at, stop) < 0:
        return None
    stop += 5
    while b[stop : stop + 1] in (b"\r", b"\n") and stop < len(b):
        stop += 1
    return stop - at


#: Fixed magic bytes: (bytes, media type, validator).
SIGNATURES: tuple[tuple[bytes, str, Callable[[bytes, int], int | None]], ...] = (
    (b"RIFF", "audio/wav", wav),
    (b"RIFF", "image/webp", webp),
    (b"RIFF", "video/x-msvideo", avi),
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"BM", "image/bmp", bmp),
    (b"OggS", "audio/ogg", ogg),
    (b"\x1f\x8b\x08", "application/gzip", gzip),
    (b"%PDF-", "application/pdf", pdf),
)

_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic in dict.fromkeys(m for m, _, _ in SIGNATURES):
            a.add_word(magic.decode("latin-1"), (len(magic), [(t, v) for m, t, v in SIGNATURES if m == magic]))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def find_media(content: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid media by offset; media inside another medium are listed too."""
    found = []
    for last, (length, kinds) in _automaton().iter(content.decode("latin-1")):
        at = last - length + 1
        for kind, valid in kinds:
            size = valid(content, at)
            if size is not None:
                found.append((kind, at, size))
                break
    return sorted(found, key=lambda x: x[1])


# --- the lossless form of texts ------------------------------------------------


def payload_of(text: bytes) -> bytes:
    """A text's bytes, padded by zeros to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono WAV file whose samples are the payload."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wav(content: bytes) -> bytes:
    """The samples of an 8-bit mono WAV file, by its chunks."""
    if wav(content, 0) is None:
        raise ValueError("not a WAV file")
    p = 12
    while True:
        name, n = struct.unpack_from("<4sI", content, p)
        if name == b"fmt " and struct.unpack_from("<HHIIHH", content, p + 8)[5] != 8:
            raise ValueError("not 8-bit samples")
        if name == b"data":
            return content[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media, declared, n_bytes): each text as a WAV cell, declared without knowledge of its type."""
    kind = docs.schema[key].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at, cells in _slices(utf8(batch.column(1))):
                media = [to_wav(payload_of(c or b"")) for c in cells]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(cells)), pa.array(media, pa.binary()), pa.array([UNKNOWN] * len(cells)), pa.array([len(c or b"") for c in cells], pa.int64())], names=["key", "media", "declared", "n_bytes"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, media binary, declared string, n_bytes bigint").withColumnRenamed("key", key)


def _slices(cells: list[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    start, weight = 0, 0
    for i, c in enumerate(cells):
        weight += len(c or b"")
        if weight >= SLICE or i == len(cells) - 1:
            yield start, cells[start : i + 1]
            start, weight = i + 1, 0


MEDIUM = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))
_MEDIUM = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def sniff(media: DataFrame, content: str = "media", declared: str = "declared") -> DataFrame:
    """``media`` with ``_type``, the corrected type, and ``_embedded``, the media that are only a part of the cell, at any depth.

    A medium is the cell if it starts it and leaves nothing over but zero bytes.  Columns of the input with these names are replaced.
    """
    names = [c for c in media.columns if c not in ("_type", "_embedded")]
    own = media.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*own.schema, T.StructField("_type", T.StringType()), T.StructField("_embedded", MEDIUM)])
    at_content, at_declared = names.index(content), names.index(declared)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            types, inner = [], []
            for cell, said in zip(utf8(batch.column(at_content)), batch.column(at_declared).to_pylist()):
                kind, parts = _judge(cell or b"", said)
                types.append(kind)
                inner.append(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(inner, _MEDIUM)], names=[*names, "_type", "_embedded"])

    return own.mapInArrow(run, schema)


def _judge(cell: bytes, declared: str | None) -> tuple[str, list[dict]]:
    found = find_media(cell)
    whole = next((x for x in found if x[1] == 0 and not cell[x[2] :].strip(b"\0")), None)
    parts = [{"type": t, "offset": o, "length": n} for t, o, n in found if (t, o, n) != whole]
    return (whole[0] if whole else declared or UNKNOWN), parts


def carve(sniffed: DataFrame, content: str = "media") -> DataFrame:
    """A row for each embedded medium: the input's columns but the content, with ``type``, ``offset``, ``carved``."""
    rest = [c for c in sniffed.columns if c not in (content, "_type", "_embedded", "type", "offset", "carved")]
    one = sniffed.select(*[F.col(f"`{c}`") for c in rest], F.col(content).alias("_cell"), F.explode("_embedded").alias("_m"))
    return one.select(*rest, F.col("_m.type").alias("type"), F.col("_m.offset").alias("offset"), F.substring("_cell", F.col("_m.offset").cast("int") + 1, F.col("_m.length").cast("int")).alias("carved"))


DIGEST = "key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def features(media: DataFrame, key: str = "doc_id", content: str = "media", declared: str = "declared") -> DataFrame:
    """Reads stored cells back and sums each up: sizes, digests and what sniffing the cell and the bytes read back finds.

    Columns: n_bytes (of the text), payload_bytes, payload_sha256, tail_crc32 (of the last 64
    bytes), media_bytes, media_sha256, feature (type, mean and peak of the samples, zero
    crossings, number of embedded media, and each medium carved from the payload as
    type@offset+length#crc32).
    """
    import numpy as np

    kind = media.schema[key].dataType.simpleString()
    names = ("key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    arrow = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for cell, said, n in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found, parts = _judge(cell, said)
                payload = from_wav(cell)
                held = ",".join(f"{t}@{o}+{k}#{zlib.crc32(memoryview(payload)[o : o + k]):08x}" for t, o, k in find_media(payload))
                samples = np.frombuffer(payload, np.uint8)
                above = samples >= 128
                feature = f"type={found};mean={samples.mean():.4f};peak={samples.max()};crossings={int((above[1:] != above[:-1]).sum())};embedded={len(parts)};holds={held}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(cell), hashlib.sha256(cell).hexdigest(), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), arrow)]], names=list(names))

    own = media.select(F.col(key).alias("key"), F.col(content).alias("media"), F.col(declared).alias("declared"), F.col("n_bytes"))
    return own.mapInArrow(run, DIGEST.format(kind=kind)).withColumnRenamed("key", key)
