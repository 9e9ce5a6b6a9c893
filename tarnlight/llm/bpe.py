"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``INNER[0]`` characters is cut into overlapping chunks; a shorter one is a single chunk, which needs no stitch.  Each chunk is
pre-tokenised on its own, from a start that need not be a pre-token boundary.  In the
overlap of two neighbours, the boundaries that both see show where the two runs
resynchronise; the text is stitched there and each piece between two stitches is
encoded as an independent row.  Decoding concatenates the raw bytes of the ids.

A text of at most ``CHUNK`` characters is cut, stitched and encoded in the task that has read it, so it is never
shuffled; the chunks of a longer one, which are longer too, are rows that spread over the cluster.

Where an overlap holds no common boundary (a word longer than it), only the chunks on its two
sides become one chunk, which is pre-tokenised again and stitched to its neighbours; this repeats
until all stitches hold.  Such a chunk is cut at its own boundaries before it is encoded, so
only a single pre-token longer than a chunk stays whole, as its encoding must.

Defined results: null and empty texts have no ids; repeated rows each get a row; texts of any
length are encoded whole; only the key and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlight.llm.shared import StepTables, batches, utf8

INNER = (8_192, 256)  #: chunk and overlap within a task
CHUNK, OVERLAP = 65_536, 1_024  #: of texts whose chunks are rows


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _text(cell: bytes | None) -> str:
    return (cell or b"").decode("utf-8", "replace")


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of pre-tokens after which a text may be cut: behind a letter or digit before anything else, or a non-space before a space.

    Pre-tokens look ahead of their end only behind white space, so a cut there changes no match.
    """
    import regex

    ends = (m.end() for m in regex.finditer(pattern, text))
    return [e for e in ends if e < len(text) and not text[e - 1].isspace() and (text[e].isspace() or text[e - 1].isalnum())]


def _encode(cells: list[bytes | None], path: str, pattern: str) -> list[list[int]]:
    encode = _encoding(path, pattern).encode_ordinary
    return [encode(_text(c)) for c in cells]


def _encode_cut(cells: list[bytes | None], path: str, pattern: str, chunk: int, overlap: int) -> list[list[int]]:
    """As :func:`_encode`, of texts longer than ``chunk`` by their :func:`pieces`."""
    encode, out = _encoding(path, pattern).encode_ordinary, []
    for cell in cells:
        text = _text(cell)
        out.append(encode(text) if len(text) <= chunk else [i for piece in pieces(text, pattern, chunk, overlap) for i in encode(piece)])
    return out


def pieces(text: str, pattern: str, chunk: int, overlap: int) -> list[str]:
    """A text cut where the pre-tokens of neighbouring chunks resynchronise; chunks without a common boundary become one."""
    spans = [(first, min(first + chunk + overlap, len(text))) for first in range(0, max(len(text) - overlap, 1), chunk)]
    seen = {span: [span[0] + e for e in boundaries(text[slice(*span)], pattern)] for span in spans}
    starts, k = [0], 1
    while k < len(spans):
        before, own = spans[k - 1], spans[k]
        common = {e for e in seen[before] if e >= own[0]}.intersection(seen[own])
        if common:
            starts.append(min(common))
            k += 1
            continue
        whole = (before[0], own[1])
        seen[whole] = [whole[0] + e for e in boundaries(text[slice(*whole)], pattern)]
        spans[k - 1 : k + 1] = [whole]
        if k > 1:  # its stitch to the chunk before is looked for again
            k -= 1
            starts.pop()
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def decode_ids(ids, path: str) -> bytes:
    """The raw bytes of ids, concatenated."""
    return b"".join(map(_token_bytes(path).__getitem__, ids))


def _chunks(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, first, text, head, tail, cuts) of each chunk of long texts.

    ``first`` is the place of the chunk's first character in its text, ``head`` and ``tail`` are the
    boundaries in the overlaps with the chunks before and after, as places in the text.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in source:
                for row, cell in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                    text = _text(cell)
                    for first in range(0, max(len(text) - overlap, 1), chunk):  # the last chunk holds more than its overlap
                        yield row, first, text[first : first + chunk + overlap].encode()

        yield from batches(rows(), pa.schema(list(_CHUNKS)[:3]))

    cut = texts.select("row", "text").mapInArrow(run, "row string, first bigint, text binary").repartition("row", "first")
    return cut.mapInArrow(_seen(pattern, chunk, overlap), CHUNKS)


CHUNKS = "row string, first bigint, text binary, head array<bigint>, tail array<bigint>, cuts array<bigint>"
_CHUNKS = pa.schema([("row", pa.string()), ("first", pa.int64()), ("text", pa.binary()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())), ("cuts", pa.list_(pa.int64()))])


def _seen(pattern: str, chunk: int, overlap: int):
    """A mapInArrow function over (row, first, text): pre-tokenises each chunk."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in source:
                for row, first, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                    text = _text(cell)
                    found = [first + e for e in boundaries(text, pattern)]
                    after = first + max(len(text) - overlap, 0)  # where the next chunk begins
                    cuts = [next(iter(found[i : i + 1]), None) for i in np.searchsorted(found, range(first + chunk, after, chunk))]
                    yield row, first, cell, [e for e in found if e < first + overlap], [e for e in found if e >= after], sorted({c for c in cuts if c is not None})

        yield from batches(rows(), _CHUNKS)

    return run


def _stitched(chunks: DataFrame, tables: StepTables, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, first, start, stop) and the chunk's columns: chunks whose stitches all hold."""
    order = Window.partitionBy("row").orderBy("first")
    chunks, path = tables.write(chunks)
    while True:
        met = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
        narrow = chunks.select("row", "first", "head", "tail").withColumn("start", F.when(F.col("first") == 0, F.lit(0).cast("bigint")).otherwise(met))
        if narrow.filter("start IS NULL").isEmpty():
            stops = narrow.select("row", "first", "start", F.lead("start").over(order).alias("stop"))
            return chunks.select("row", "first", "text", "cuts").join(stops, ["row", "first"])
        # Chunks on both sides of a failed stitch become one; all others stay as they are.
        grouped = narrow.withColumn("group", F.count("start").over(order))
        grouped = grouped.withColumn("members", F.count("*").over(Window.partitionBy("row", "group"))).select("row", "first", "group", "members", (F.lead("first").over(order) - F.col("first")).alias("own"))
        both = chunks.join(grouped, ["row", "first"])
        parts = F.sort_array(F.collect_list(F.struct("first", "own", "text")))
        joined = both.filter("members > 1").groupBy("row", "group").agg(F.min("first").alias("first"), parts.alias("parts")).select("row", "first", "parts").mapInArrow(_joined, "row string, first bigint, text binary").mapInArrow(_seen(pattern, chunk, overlap), CHUNKS)
        before = path
        chunks, path = tables.write(both.filter("members = 1").select(*chunks.columns).unionByName(joined))
        tables.drop(before)


def _joined(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of neighbouring chunks: each without its overlap but for the last."""
    for batch in source:
        for row, first, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            texts = [_text(p["text"]) if k == len(parts) - 1 else _text(p["text"])[: p["own"]] for k, p in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([first], pa.int64()), pa.array(["".join(texts).encode()], pa.binary())], names=["row", "first", "text"])


def _pieces(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, place, text): what lies between two stitches, cut again where the chunk is a joined one."""
    schema = pa.schema([("row", pa.string()), ("place", pa.int64()), ("text", pa.binary())])

    def rows():
        for batch in source:
            for row, first, cell, cuts, start, stop in zip(*[utf8(batch.column(i)) if i == 2 else batch.column(i).to_pylist() for i in range(6)]):
                text = _text(cell)
                end = first + len(text) if stop is None else stop
                places = [start, *[c for c in cuts if start < c < end], end]
                for a, b in zip(places, places[1:]):
                    yield row, a, text[a - first : b - first].encode()

    yield from batches(rows(), schema)


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, inner: tuple[int, int] = INNER) -> DataFrame:
    """(key, ids): the ids of each text, one row per input row.

    ``ranks`` is a file of ``base64-token rank`` lines; it must be readable on executors.  Texts longer than ``chunk`` characters
    are cut into rows with ``overlap``; others, where longer than ``inner[0]``, in their task with the overlap ``inner[1]``.
    """
    return _coded(docs, ranks, pattern, key, text, chunk, overlap, inner, digest=False)


def encode_digest(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, inner: tuple[int, int] = INNER) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids, and keeps only digests.

    The ids of a text of at most ``chunk`` characters never leave the worker that made them.
    """
    return _coded(docs, ranks, pattern, key, text, chunk, overlap, inner, digest=True)


def _digest(ids: list[int], ranks: str) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decode_ids(ids, ranks)).hexdigest())


def _coded(docs: DataFrame, ranks: str, pattern: str, key: str, text: str, chunk: int, overlap: int, inner: tuple[int, int], digest: bool) -> DataFrame:
    if not (0 < overlap <= chunk and 0 < inner[1] <= inner[0]):
        raise ValueError("overlap must be positive and at most chunk")
    kind = docs.schema[key].dataType
    key_out = T.StructField("key", kind)
    outs = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    out_arrow = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digest else [("ids", pa.list_(pa.int32()))]

    def result(ids: list[int]) -> tuple:
        return _digest(ids, ranks) if digest else (ids,)

    def short(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys, cells = batch.column(0), utf8(batch.column(1))
            for at in range(0, len(cells), 512):
                made = [result(ids) for ids in _encode_cut(cells[at : at + 512], ranks, pattern, *inner)]
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*made), out_arrow)]
                yield pa.RecordBatch.from_arrays([keys.slice(at, 512), *columns], names=["key", *[n for n, _ in out_arrow]])

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    long_text = F.coalesce(F.length("text") > chunk, F.lit(False))
    of_short = source.filter(~long_text).mapInArrow(short, T.StructType([key_out, *outs]))

    # Repeated rows stay apart: they are one named row with a number of copies.
    tables = StepTables(docs, "bpe")
    named = source.filter(long_text).withColumn("row", F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), F.sha2("text", 256)))
    counted = tables.keep(named.groupBy("row").agg(F.first("key").alias("key"), F.first("text").alias("text"), F.count("*").alias("copies")))
    pieces = _stitched(_chunks(counted, pattern, chunk, overlap), tables, pattern, chunk, overlap)
    pieces = pieces.select("row", "first", "text", "cuts", "start", "stop").mapInArrow(_pieces, "row string, place bigint, text binary").repartition("row", "place")
    piece_ids = T.StructType([T.StructField("row", T.StringType()), T.StructField("place", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    piece_arrow = pa.schema([("row", pa.string()), ("place", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def by_piece(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in source:
                ids = _encode(utf8(batch.column(2)), ranks, pattern)
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids)

        yield from batches(rows(), piece_arrow, size=16)

    joined = pieces.mapInArrow(by_piece, piece_ids).groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "ids"))), lambda x: x.ids)).alias("ids"))
    with_key = counted.select("row", "key", "copies").join(joined, "row").select("key", "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")

    def finish(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys, lists = batch.column(0), batch.column(1)
            for at in range(len(lists)):
                made = result(np.asarray(lists[at].values).tolist())
                yield pa.RecordBatch.from_arrays([keys.slice(at, 1), *[pa.array([v], t) for v, (_, t) in zip(made, out_arrow)]], names=["key", *[n for n, _ in out_arrow]])

    of_long = with_key.mapInArrow(finish, T.StructType([key_out, *outs])) if digest else with_key
    return of_short.unionByName(of_long).withColumnRenamed("key", key)


def decode(coded: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes): the bytes of each list of ids; a null list gives no bytes."""
    schema = T.StructType([T.StructField(key, coded.schema[key].dataType), T.StructField("bytes", T.BinaryType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_ids(x or (), ranks) for x in lists], pa.binary())], names=[key, "bytes"])

    return coded.select(F.col(key), F.col(ids)).mapInArrow(run, schema)
