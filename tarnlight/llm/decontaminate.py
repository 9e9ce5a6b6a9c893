"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of ASCII letters (A-Z lower-cased), digits and bytes above 0x7F.  A
pattern is a window of ``window`` consecutive words of a benchmark text, or the whole of
a text with fewer (but not no) words.  Patterns of one length make one search table:

* the *shift table* gives, for the block of words that ends at a position, how far the
  search may jump; a block in no pattern jumps past all positions it could spoil, and a
  word in no pattern past all windows that hold it.  A block has about log_c(2 m L) words
  for m patterns of L words and c equally likely words;
* at shift zero, the *suffix bucket* of the block is searched for the hash of the first
  words of the window;
* *direct comparison* of all words confirms each occurrence.

Every occurrence marks its words as hit.  Defined results: null and empty texts have no
words; benchmark rows without an id are left out; rows that repeat an id add up to one
item; documents are rows, so repeated rows each get a result; texts of any length are
searched whole; columns may have any names, and one that is called ``_marks`` is replaced.

Scale: the benchmark's texts are cut into distinct pieces of at most ``PIECE_WORDS`` words that
overlap by ``window - 1``, and pieces gather into blocks of at most ``block_bytes``, whatever
their ids (a single piece of giant words may be larger).  The driver holds one block and one
partition of pieces of about half its size at a time.  A block's search tables are arrays; a
Python worker holds those of one block, and 4 MiB of text took it 230 MB at most to build them.  With one block, documents never shuffle.  With more, each
is a pass of its own over the documents, from which only the marks of distinct texts with
hits go on; those join the documents by a digest of the text.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlight.llm.shared import StepTables, utf8

WINDOW = 10
BLOCK_BYTES = 4 << 20
PIECE_WORDS = 2_048

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text."""
    return (text or b"").translate(_WORD_BYTES).split()


def block_length(patterns: int, length: int, counts: np.ndarray) -> int:
    """log_c(2 m L) words, where c is how many equally likely words would be as hard to guess; within 2 and L."""
    share = counts / counts.sum()
    bits = float(-(share * np.log2(share)).sum())
    return min(length, max(2, math.ceil(math.log2(2 * patterns * length) / max(bits, 0.5))))


def _runs_hash(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` neighbouring numbers, as :func:`_hash` makes it."""
    count = len(ids) - width + 1
    out = np.zeros(max(count, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = (out ^ ids[j : j + count].astype(np.uint64)) * np.uint64(_MIX)
            out ^= out >> np.uint64(29)
    return out


def _hash(ids) -> int:
    out = 0
    for x in ids:
        out = (out ^ x) * _MIX & _MASK
        out ^= out >> 29
    return out


class WuManber:
    """Search tables for all windows of ``length`` words of some sequences of word numbers."""

    def __init__(self, sequences: list[np.ndarray], owners: list[int], length: int):
        self.length = length
        text = np.concatenate(sequences).astype(np.int32)
        sizes = np.array([len(s) for s in sequences])
        begin = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        start = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner = np.repeat(np.asarray(owners, np.int32), count)
        self.block = block = block_length(len(start), length, np.bincount(text)[1:][np.bincount(text)[1:] > 0])
        self.default = length - block + 1
        whole, blocks = _runs_hash(text, length), _runs_hash(text, block)

        # Shift: the least distance from a block to its pattern's end; blocks with one slot share the least.
        self.bits = max(8, min(24, (8 * len(text)).bit_length()))
        down = np.uint64(64 - self.bits)
        shift = np.full(1 << self.bits, min(self.default, 255), np.uint8)
        for end in range(block, length + 1):  # in falling order, so the least stays
            shift[(blocks[start + end - block] >> down).astype(np.int64)] = min(length - end, 255)
        self.shift = shift.tobytes()

        # Buckets: patterns in the order of (suffix slot, hash of the prefix); equal patterns stand together.
        suffix = (blocks[start + length - block] >> down).astype(np.int64)
        prefix = blocks[start]
        order = np.lexsort((owner, whole[start], prefix, suffix))
        start, owner, suffix, prefix = start[order], owner[order], suffix[order], prefix[order]
        new = np.ones(len(start), bool)
        new[1:] = suffix[1:] != suffix[:-1]
        for j in range(length):
            new[1:] |= text[start[1:] + j] != text[start[:-1] + j]
        first = np.flatnonzero(new)
        self.bucket = array("i", np.searchsorted(suffix[first], np.arange((1 << self.bits) + 1)).astype(np.int32).tobytes())
        self.prefix = array("Q", prefix[first].tobytes())
        self.start = array("i", start[first].astype(np.int32).tobytes())
        self.owners, self.owner_at = array("i", owner.tobytes()), array("i", np.r_[first, len(start)].astype(np.int32).tobytes())
        self.text = array("i", text.tobytes())

    @property
    def nbytes(self) -> int:
        return len(self.shift) + sum(len(a) * a.itemsize for a in (self.bucket, self.prefix, self.start, self.owners, self.owner_at, self.text))

    def find(self, words: list[bytes], number: dict[bytes, int]) -> Iterator[tuple[int, set[int]]]:
        """(start, owners) of every occurrence in ``words``; ``number`` gives the words of patterns."""
        length, block, shift, bucket, prefix, down = self.length, self.block, self.shift, self.bucket, self.prefix, 64 - self.bits
        end, n, get = length, len(words), number.get
        while end <= n:
            value = 0
            for k in range(end - block, end):
                x = get(words[k])
                if x is None:  # no window with this word occurs
                    end = k + 1 + length
                    break
                value = (value ^ x) * _MIX & _MASK
                value ^= value >> 29
            else:
                slot = value >> down
                jump = shift[slot]
                if jump:
                    end += jump
                    continue
                found = [get(w) for w in words[end - length : end]]
                if None not in found:
                    head = _hash(found[:block])
                    at, stop = bucket[slot], bucket[slot + 1]
                    at = bisect_left(prefix, head, at, stop)
                    while at < stop and prefix[at] == head:
                        s = self.start[at]
                        if self.text[s : s + length].tolist() == found:
                            yield end - length, set(self.owners[self.owner_at[at] : self.owner_at[at + 1]])
                        at += 1
                end += 1


class SearchTables:
    """A search table for each pattern length in the pieces of a block."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in pieces})
        place = {item: k for k, item in enumerate(self.items)}
        by_length: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for item, text in pieces:
            words = words_of(text)
            if words:
                ids = np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words), np.int32, len(words))
                sequences, owners = by_length[min(window, len(words))]
                sequences.append(ids)
                owners.append(place[item])
        self.tables = [WuManber(s, o, length) for length, (s, o) in sorted(by_length.items())]

    def mark(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs [start, stop) of hit words, and the items that occur."""
        runs, items = [], set()
        for table in self.tables:
            for start, owners in table.find(words, self.number):
                runs.append((start, start + table.length))
                items |= owners
        return merge(runs), {self.items[k] for k in items}


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


# --- the benchmark in blocks of bounded size -------------------------------------


def cut(words: list[bytes], window: int, size: int = PIECE_WORDS) -> list[bytes]:
    """Pieces of at most ``size`` words (never fewer than a window, where there are that many) that together hold each window."""
    step = max(size - window + 1, 1)
    return [b" ".join(words[at : at + step + window - 1]) for at in range(0, max(len(words) - window + 1, 1), step)] if words else []


def _pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """The distinct (item, piece) of the benchmark."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name, cell in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                found = cut(words_of(cell), window)
                for at in range(0, len(found), 256):
                    some = found[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.binary())], names=["item", "piece"])

    own = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    return own.mapInArrow(run, "item string, piece binary").distinct()


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's pieces in blocks of at most ``block_bytes``, one at a time; none is empty."""
    weight = F.octet_length("piece") + F.octet_length("item") + 64
    pieces = StepTables(benchmark, "decontaminate").keep(_pieces(benchmark, item, text, window))
    total = pieces.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    # Pieces are distinct and small, so their hashes spread them evenly; the cut below bounds a block in any case.
    spread = pieces.repartition(max(1, -(-2 * total // block_bytes)), F.xxhash64("item", "piece"))
    held, size = [], 0
    for row in spread.select("item", "piece", weight.alias("w")).toLocalIterator():
        if held and size + row["w"] > block_bytes:
            yield held
            held, size = [], 0
        held.append((row["item"], bytes(row["piece"])))
        size += row["w"]
    if held:
        yield held


# --- documents --------------------------------------------------------------------

MARKS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])
_MARKS = [("n_words", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]
_TABLES: dict[str, SearchTables] = {}


def _search(held, at: int, window: int, hits_only: bool):
    """A mapInArrow function: batches with a column of marks, or (digest, marks) of texts with hits."""
    block = uuid.uuid4().hex

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The tables are built once for each worker and block, not for each task.
        if block not in _TABLES:
            _TABLES.clear()
            _TABLES[block] = SearchTables(held.value if held else [], window)
        tables = _TABLES[block]
        for batch in source:
            counts, runs, items, which = [], [], [], []
            for k, cell in enumerate(utf8(batch.column(at))):
                words = words_of(cell)
                found, names = tables.mark(words)
                if found or not hits_only:
                    which.append(k)
                    counts.append(len(words))
                    runs.append(found)
                    items.append(sorted(names))
            marks = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip((counts, runs, items), _MARKS)], names=[n for n, _ in _MARKS])
            if not hits_only:
                yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*batch.schema.names, "_marks"])
            elif which:
                yield pa.RecordBatch.from_arrays([batch.column(1 - at).take(pa.array(which)), marks], names=["digest", "_marks"])

    return run


def _merged(runs):
    """Sorted runs put together where they meet, as :func:`merge` does."""

    def add(held, run):
        last = F.element_at(held, -1)
        joined = F.array(F.get(last, 0), F.greatest(F.get(last, 1), F.get(run, 1)))
        meets = (F.size(held) > 0) & (F.get(run, 0) <= F.coalesce(F.get(F.try_element_at(held, F.lit(-1)), 1), F.lit(-1)))
        return F.when(meets, F.concat(F.slice(held, 1, F.size(held) - 1), F.array(joined))).otherwise(F.concat(held, F.array(run)))

    return F.aggregate(F.array_sort(runs), F.expr("cast(array() as array<array<bigint>>)"), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``_marks``: ``n_words``, ``runs`` of hit words as [start, stop), ``items`` (sorted as strings)."""
    context = docs.sparkSession.sparkContext
    names = [c for c in docs.columns if c != "_marks"]
    own = docs.select(*[F.col(f"`{c}`") for c in names])
    blocks = _blocks(benchmark, item, item_text, window, block_bytes)
    first = next(blocks, None)
    out = own.mapInArrow(_search(first and context.broadcast(first), names.index(text), window, False), T.StructType([*own.schema, T.StructField("_marks", MARKS)]))
    digest = F.sha2(F.col(f"`{text}`").cast("binary"), 256)
    texts = docs.select(digest.alias("digest"), F.col(f"`{text}`").alias("text"))
    more = None
    for block in blocks:
        hits = texts.mapInArrow(_search(context.broadcast(block), 1, window, True), T.StructType([T.StructField("digest", T.StringType()), T.StructField("_marks", MARKS)]))
        # Equal texts have equal marks: one row of each goes on, summed up before it shuffles.
        hits = hits.groupBy("digest").agg(F.first("_marks").alias("m"))
        more = hits if more is None else more.unionByName(hits)
    if more is None:
        return out
    more = more.groupBy("digest").agg(F.flatten(F.collect_list("m.runs")).alias("runs"), F.flatten(F.collect_list("m.items")).alias("items"))
    more = StepTables(docs, "decontaminate").keep(more)
    page = F.struct(*[F.col(f"`{c}`") for c in names])
    joined = out.select(page.alias("_page"), "_marks", digest.alias("digest")).join(more, "digest", "left")
    both = F.struct(F.col("_marks.n_words").alias("n_words"), _merged(F.concat("_marks.runs", "runs")).alias("runs"), F.array_sort(F.array_union("_marks.items", "items")).alias("items"))
    marks = F.when(F.col("runs").isNull(), F.col("_marks")).otherwise(both)
    return joined.select(*[F.col("_page").getField(c).alias(c) for c in names], marks.alias("_marks"))


def digest(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of marked documents."""
    hit = F.aggregate("_marks.runs", F.lit(0).cast("long"), lambda a, r: a + F.get(r, 1) - F.get(r, 0))
    return marked.select(
        F.col(key),
        F.col("_marks.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_marks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_marks.items", ","), 256).alias("items_sha256"),
        (F.size("_marks.runs") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The digest of small tables by comparing every window with every position; for tests."""
    patterns = defaultdict(set)
    for item, text in items:
        words = words_of(None if text is None else text.encode())
        size = min(window, len(words))
        if item is not None and words:
            for i in range(len(words) - size + 1):
                patterns[tuple(words[i : i + size])].add(str(item))
    out = []
    for doc, text in docs:
        words, hit, which = words_of(None if text is None else text.encode()), set(), set()
        for pattern, owners in patterns.items():
            for i in range(len(words) - len(pattern) + 1):
                if tuple(words[i : i + len(pattern)]) == pattern:
                    hit |= set(range(i, i + len(pattern)))
                    which |= owners
        out.append((doc, len(words), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit)))
    return out
