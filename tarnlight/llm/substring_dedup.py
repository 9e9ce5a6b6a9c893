"""Substring dedup by difference-cover anchors.

Removes each word that a window of ``WINDOW`` consecutive words covers whose words also
start in a document with a smaller number.

``COVER`` is a difference cover modulo ``PERIOD``: every difference of two residues is a
difference of two members.  Two equal windows at positions i and j therefore hold, at some
offset below ``PERIOD``, positions i + o and j + o that are both in the cover.  Documents
hash ``SPAN = WINDOW - PERIOD + 1`` words only at cover positions, and any long match
shares such an aligned anchor.  Anchors in one document only are dropped; around the others
the match is extended: every window that holds a shared anchor is compared by its whole
word sequence (a pair of 64-bit names) with those of smaller documents.

Defined results: words are divided by ASCII white space and kept unchanged; null, empty
and blank texts have no words; texts with fewer words than the window lose nothing; rows
that repeat a number are one document in the comparison and get a row each; rows without
a number lose nothing and are compared with nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.jaccard import word_names
from tarnlight.llm.repeats import LATER, SHARED, by_document, covered, in_several, int_docs, later, later_rows, map_batches, member, names_of, shared_rows
from tarnlight.llm.shared import StepTables, file_count, pair_name, utf8

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
SPAN = WINDOW - PERIOD + 1


def sequence_names(names: np.ndarray, length: int) -> np.ndarray:
    """Names of the sequences of ``length`` words at each position, by doubling."""
    span, out = 1, names
    while span * 2 <= length:
        out = pair_name(out[:-span], out[span:]) if len(out) > span else out[:0]
        span *= 2
    rest = length - span
    if rest:
        out = pair_name(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out


_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def anchors(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the cover, names of the ``SPAN`` words there)."""
    spans = sequence_names(names, SPAN)
    at = np.flatnonzero(_IN_COVER[np.arange(len(spans)) % PERIOD])
    return at, spans[at]


def candidates(names: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a shared anchor."""
    count = len(names) - WINDOW + 1
    if count <= 0 or not len(shared):
        return np.empty(0, np.int64)
    at, spans = anchors(names)
    hit = np.zeros(len(names), bool)
    hit[at[member(spans, shared)]] = True
    near = np.cumsum(np.r_[0, hit])
    starts = np.arange(count)
    return starts[near[starts + PERIOD] > near[starts]]


def window_names(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name and check name of the windows at ``starts``."""
    half = sequence_names(names, 32)
    left, right = half[starts], half[starts + WINDOW - 32]
    return pair_name(left, right), left


def _anchor_rows(docs: np.ndarray, texts: list[bytes], _) -> Iterator[pa.RecordBatch]:
    ids, found = [], []
    for d, text in zip(docs, texts):
        words = text.split()
        if len(words) >= WINDOW:
            ids.append(int(d))
            found.append(np.unique(anchors(word_names(words))[1]))
    if ids:
        yield shared_rows(ids, found)


def _window_rows(docs: np.ndarray, texts: list[bytes], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids, found, checks = [], [], []
    for k, (d, text) in enumerate(zip(docs, texts)):
        names = word_names(text.split())
        starts = candidates(names, names_of(batch.column(2)[k]))
        if len(starts):
            name, check = window_names(names, starts)
            name, at = np.unique(name, return_index=True)
            ids.append(int(d))
            found.append(name)
            checks.append(check[at])
    if ids:
        yield later_rows(ids, found, checks)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept): a row for each row of ``docs``; ``kept`` joins the words by one space; with ``digest``, ``kept_sha256`` instead."""
    tables = StepTables(docs, "substring-dedup")
    own = int_docs(docs, key, text)
    shared = tables.keep(by_document(in_several(own.mapInArrow(map_batches(_anchor_rows), SHARED))))
    repeated = tables.keep(by_document(later(own.join(shared, "doc").select("doc", "text", "names").mapInArrow(map_batches(_window_rows), LATER))))
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"), F.col(key).cast("long").alias("doc"))
    joined = source.join(repeated, "doc", "left").select("id", "text", "names")
    last = ("kept_sha256", pa.string()) if digest else ("kept", pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, cell in enumerate(utf8(batch.column(1))):
                words = (cell or b"").split()
                gone, total = names_of(batch.column(2)[k]), len(words)
                if len(gone):
                    names = word_names(words)
                    all_names = window_names(names, np.arange(total - WINDOW + 1))[0]
                    out = covered(np.flatnonzero(member(all_names, gone)), WINDOW, total)
                    words = [w for w, g in zip(words, out.tolist()) if not g]
                kept = b" ".join(words)
                rows.append((total, total - len(words), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace")))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_removed", last[0]])

    out = joined.coalesce(file_count(docs)).mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, {last[0]} string")
    return out.withColumnRenamed("id", key)


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The digest of a small table from all its windows; for tests."""
    seen: dict[tuple, int] = {}
    split = [(d, ("" if t is None else t).encode().split()) for d, t in docs]
    for d, words in split:
        for i in range(len(words) - window + 1 if d is not None else 0):
            w = tuple(words[i : i + window])
            seen[w] = min(seen.get(w, d), d)
    out = []
    for d, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1 if d is not None else 0):
            if seen[tuple(words[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
