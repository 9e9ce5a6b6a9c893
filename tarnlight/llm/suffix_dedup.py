"""Suffix-array dedup by distributed prefix doubling.

Removes each byte that a string of ``LENGTH`` bytes covers which also starts in a document
with a smaller number.  Suffix positions are compared by the ranks of their prefixes, at
growing offsets: 8 bytes, pairs at offset 8 (16 bytes), at 8 (24 bytes, the seeds), at 16
(32 bytes), and at 18 (50 bytes, past the threshold).  A rank is the 64-bit name of a pair of ranks instead of its
place in the sorted order, so pairing needs no shuffle and only reranking does: Spark
sorts (rank, document) rows and keeps the positions whose rank is not unique.

Two reranks suffice because positions are taken in groups.  Each start of 50 bytes belongs
to the 24-byte prefix of least rank among those inside the 50 bytes, so equal strings
belong to equal prefixes wherever they stand, and the starts of one prefix are one row:

* Rerank 1 sorts (24-byte rank, rank of the whole stretch of its starts, document).  A
  stretch that also stands in a smaller document is decided: all its starts are repeats.
  A prefix that stands in one document only, or in one kind of stretch only, is unique or
  decided, and is dropped.
* Rerank 2 sorts the 50-byte ranks (as a pair of names: 128 bits) of the starts that are left.

Within a batch, documents of a stretch are found by its 64-bit rank alone.  The stretches of one 24-byte prefix meet in one
task in rerank 1, as a row for each batch of texts and different surrounding: a prefix in very many surroundings is a hot key.

Defined results: null and empty texts have no bytes; a document shorter than ``LENGTH``
loses nothing; rows that repeat a number are one document in the comparison and get a row
each; rows without a number lose nothing and are compared with nothing; other columns are
not read.  Very long texts are read in pieces of ``PIECE`` bytes that overlap by one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm.repeats import LATER, by_document, closed_key, covered, int_docs, later, later_rows, map_batches, member, names_of
from tarnlight.llm.shared import StepTables, file_count, pair_name, utf8

LENGTH = 50
PIECE = 256 << 10
SEED = 24


def _bytes8(text: bytes) -> np.ndarray:
    """The 8 bytes at each position, as a number."""
    out = np.empty(len(text) - 7, np.uint64)
    for j in range(8):
        count = (len(text) - j) // 8
        out[j::8] = np.frombuffer(text, "<u8", count, j)
    return out


def ranks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the 24-byte and 32-byte prefixes at each position that has them."""
    r8 = _bytes8(text)
    r16 = pair_name(r8[:-8], r8[8:])
    return pair_name(r16[:-8], r16[8:]), pair_name(r16[:-16], r16[16:])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def stretches(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, seed rank, stretch rank, r32, r32 at offset 18): stretches of starts with one least seed.

    A stretch holds ``LENGTH`` starts at most, so its first and last 50 bytes cover all its bytes.
    """
    r24, r32 = ranks(text)
    starts = len(text) - LENGTH + 1
    left, right = r32[:starts], r32[LENGTH - 32 : LENGTH - 32 + starts]
    seed = _least(r24, LENGTH - SEED + 1)
    new = np.r_[True, seed[1:] != seed[:-1]]
    begin = np.flatnonzero(new)
    if len(begin) < starts:
        into = np.arange(starts) - begin[np.cumsum(new) - 1]
        begin = np.flatnonzero(into % LENGTH == 0)
    last = np.r_[begin[1:], starts] - 1
    whole = pair_name(left[begin], right[begin]), pair_name(left[last], right[last])
    rank = pair_name(pair_name(*whole), (last - begin).astype(np.uint64) ^ seed[begin])
    return begin, last, seed[begin], rank, left, right


def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a text's pieces; each start of ``LENGTH`` bytes lies in exactly one."""
    if len(text) <= PIECE:
        if len(text) >= LENGTH:
            yield 0, text
        return
    step = PIECE - LENGTH + 1
    for at in range(0, len(text) - LENGTH + 1, step):
        yield at, text[at : at + PIECE]


STRETCHES = "key bigint, stretch bigint, doc bigint, known boolean"


def _stretch_rows(docs: np.ndarray, texts: list[bytes], _) -> Iterator[pa.RecordBatch]:
    doc, seed, rank = [], [], []
    for d, text in zip(docs, texts):
        for _, piece in pieces(text):
            _, _, s, r, _, _ = stretches(piece)
            doc.append(np.full(len(s), d, np.int64))
            seed.append(s)
            rank.append(r)
    if not doc:
        return
    doc, seed, rank = map(np.concatenate, (doc, seed, rank))
    # Of a stretch's documents in this batch, the smallest goes on; the others are decided.
    order = np.lexsort((doc, rank))
    doc, seed, rank = doc[order], seed[order], rank[order]
    new = np.r_[True, rank[1:] != rank[:-1]]
    once = new | np.r_[True, doc[1:] != doc[:-1]]
    doc, seed, rank, new = doc[once], seed[once], rank[once], new[once]
    key = np.where(new, seed, closed_key(rank, doc))
    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rank.view(np.int64)), pa.array(doc), pa.array(~new)], names=["key", "stretch", "doc", "known"])


def rerank_stretches(rows: DataFrame) -> DataFrame:
    """(doc, stretch, decided): stretches that repeat, or may hold repeats."""
    same, seed = Window.partitionBy("key", "stretch"), Window.partitionBy("key")
    out = rows.withColumn("low", F.min("doc").over(same))
    out = out.withColumns({"d0": F.min("doc").over(seed), "d1": F.max("doc").over(seed), "s0": F.min("stretch").over(seed), "s1": F.max("stretch").over(seed)})
    decided = F.col("known") | (F.col("low") < F.col("doc"))
    return out.filter(decided | ((F.col("d0") < F.col("d1")) & (F.col("s0") < F.col("s1")))).select("doc", "stretch", decided.alias("decided"))


def _start_rows(docs: np.ndarray, texts: list[bytes], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """50-byte ranks of the starts in a document's open stretches."""
    ids, names, checks = [], [], []
    for k, (d, text) in enumerate(zip(docs, texts)):
        wanted = names_of(batch.column(2)[k])
        left, right = [], []
        for _, piece in pieces(text):
            begin, last, _, rank, r32, r32b = stretches(piece)
            mine = np.repeat(member(rank, wanted), last - begin + 1)
            left.append(r32[mine])
            right.append(r32b[mine])
        if left:
            pair = np.stack([np.concatenate(left), np.concatenate(right)], axis=1)
            name = pair_name(pair[:, 0], pair[:, 1])
            name, at = np.unique(name, return_index=True)
            ids.append(int(d))
            names.append(name)
            checks.append(pair[at, 0])
    if ids:
        yield later_rows(ids, names, checks)


def repeat_marks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, stretches, starts): each document's decided stretches and repeated 50-byte ranks."""
    tables = StepTables(docs, "suffix-dedup")
    own = int_docs(docs, key, text)
    ranked = rerank_stretches(own.mapInArrow(map_batches(_stretch_rows), STRETCHES))
    ranked = tables.keep(ranked)
    open_docs = by_document(ranked.filter("NOT decided"), "stretch")
    starts = tables.keep(later(own.join(open_docs, "doc").select("doc", "text", "names").mapInArrow(map_batches(_start_rows), LATER)))
    decided = ranked.filter("decided").select("doc", F.col("stretch").alias("name"), F.lit(True).alias("whole"))
    both = decided.unionByName(starts.select("doc", "name", F.lit(False).alias("whole")))
    return both.groupBy("doc").agg(F.collect_list(F.when(F.col("whole"), F.col("name"))).alias("stretches"), F.collect_list(F.when(~F.col("whole"), F.col("name"))).alias("starts"))


def removed_bytes(text: bytes, decided: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Which bytes of a text go."""
    found = []
    for at, piece in pieces(text):
        begin, last, _, rank, left, right = stretches(piece)
        gone = np.repeat(member(rank, decided), last - begin + 1)
        if len(repeated):
            gone |= member(pair_name(left, right), repeated)
        found.append(np.flatnonzero(gone) + at)
    return covered(np.concatenate(found), LENGTH, len(text)) if found else np.zeros(len(text), bool)


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): a row for each row of ``docs``; with ``digest``, ``kept_sha256`` instead of the bytes."""
    kind = docs.schema[key].dataType.simpleString()
    marks = repeat_marks(docs, key, text)
    own = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"), F.col(key).cast("long").alias("doc"))
    joined = own.join(marks, "doc", "left").select("id", "text", "stretches", "starts")
    last = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for k, cell in enumerate(utf8(batch.column(1))):
                cell = cell or b""
                decided, repeated = names_of(batch.column(2)[k]), names_of(batch.column(3)[k])
                if len(decided) or len(repeated):
                    gone = removed_bytes(cell, decided, repeated)
                    kept = np.frombuffer(cell, np.uint8)[~gone].tobytes()
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                else:
                    kept, spans = cell, 0
                rows.append((len(cell), len(cell) - len(kept), spans, hashlib.sha256(kept).hexdigest() if digest else kept))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), last[1]))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_bytes", "n_removed", "n_spans", last[0]])

    out = joined.coalesce(file_count(docs)).mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {last[0]} {'string' if digest else 'binary'}")
    return out.withColumnRenamed("id", key)


def brute_force(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The digest of a small table from all its strings; for tests."""
    strings: dict[bytes, int] = {}
    for d, text in docs:
        b = ("" if text is None else text).encode()
        for i in range(len(b) - length + 1 if d is not None else 0):
            s = b[i : i + length]
            strings[s] = min(strings.get(s, d), d)
    out = []
    for d, text in docs:
        b = ("" if text is None else text).encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1 if d is not None else 0):
            if strings[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
