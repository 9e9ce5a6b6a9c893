"""Which names of a document also stand in another document: the global step of the repeat removers.

Names are 64-bit (or pairs of them, where equality decides the result).  Rows are made by
:func:`first_of_batch`, which sums up each batch first: of the documents of a batch with one
name only the smallest goes on to meet other batches, so a name that a third of all
documents share is one row a batch, not one a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm.shared import pair_name, utf8


def first_of_batch(doc: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, many): rows sorted by name and document; which are the first of their name; whether the name has several documents here."""
    order = np.lexsort((doc, name))
    d, n = doc[order], name[order]
    first = np.r_[True, n[1:] != n[:-1]] if len(n) else np.empty(0, bool)
    group = np.cumsum(first) - 1
    stops = np.r_[np.flatnonzero(first)[1:], len(n)] - 1
    many = (d[stops] != d[np.flatnonzero(first)])[group] if len(n) else first
    return order, first, many


def closed_key(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A key that spreads rows which need no other rows."""
    return pair_name(pair_name(name, doc.astype(np.int64).view(np.uint64)), np.uint64(0x51ED))


def int_docs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, text) of the rows with a document number, which the comparison needs."""
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")


def map_batches(kernel: Callable[[np.ndarray, list[bytes], pa.RecordBatch], Iterator[pa.RecordBatch]], cells: int = 24 << 20):
    """A mapInArrow function over (doc, text, ...): slices of about ``cells`` bytes of text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = utf8(batch.column(1))
            start, weight = 0, 0
            for i, t in enumerate(texts):
                weight += len(t or b"")
                if weight >= cells or i == len(texts) - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield from kernel(part.column(0).to_numpy(zero_copy_only=False), texts[start : i + 1], part)
                    start, weight = i + 1, 0

    return run


SHARED = "key bigint, name bigint, doc bigint, known boolean"


def shared_rows(docs: list[int], names: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of :data:`SHARED` for each document's distinct names; ``known``: shared within this batch already."""
    doc = np.repeat(np.asarray(docs, np.int64), [len(n) for n in names])
    name = np.concatenate(names) if names else np.empty(0, np.uint64)
    order, first, many = first_of_batch(doc, name)
    doc, name = doc[order], name[order]
    keep = first | many
    doc, name, first, many = doc[keep], name[keep], first[keep], many[keep]
    key = np.where(first, name, closed_key(name, doc))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(name.view(np.int64)), pa.array(doc), pa.array(many)], names=["key", "name", "doc", "known"])


def in_several(rows: DataFrame) -> DataFrame:
    """(doc, name) of names that stand in at least two documents."""
    same = Window.partitionBy("key")
    return rows.withColumns({"low": F.min("doc").over(same), "high": F.max("doc").over(same)}).filter("known OR low <> high").select("doc", "name")


LATER = "key bigint, check bigint, name bigint, doc bigint, known boolean"


def later_rows(docs: list[int], names: list[np.ndarray], checks: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of :data:`LATER`; a name and its check are one name of 128 bits. ``known``: a smaller document of this batch has it."""
    doc = np.repeat(np.asarray(docs, np.int64), [len(n) for n in names])
    name = np.concatenate(names) if names else np.empty(0, np.uint64)
    check = np.concatenate(checks) if checks else np.empty(0, np.uint64)
    order = np.lexsort((doc, check, name))
    doc, name, check = doc[order], name[order], check[order]
    first = np.r_[True, (name[1:] != name[:-1]) | (check[1:] != check[:-1])] if len(name) else np.empty(0, bool)
    low = doc[np.flatnonzero(first)][np.cumsum(first) - 1] if len(name) else doc
    known = doc > low
    keep = first | known
    doc, name, check, first, known = doc[keep], name[keep], check[keep], first[keep], known[keep]
    key = np.where(first, name, closed_key(name, doc))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), pa.array(name.view(np.int64)), pa.array(doc), pa.array(known)], names=["key", "check", "name", "doc", "known"])


def later(rows: DataFrame) -> DataFrame:
    """(doc, name) of names that also stand in a document with a smaller number."""
    same = Window.partitionBy("key", "check")
    return rows.withColumn("low", F.min("doc").over(same)).filter("known OR low < doc").select("doc", "name")


def by_document(rows: DataFrame, name: str = "name") -> DataFrame:
    """(doc, names): each document's names, of which it holds no more than it has positions."""
    return rows.groupBy("doc").agg(F.collect_list(name).alias("names"))


def names_of(cell) -> np.ndarray:
    """An Arrow list cell of names as sorted unsigned numbers."""
    values = getattr(cell, "values", None)
    if values is None:
        return np.empty(0, np.uint64)
    return np.sort(values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def member(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which values are among sorted names."""
    if not len(names):
        return np.zeros(len(values), bool)
    at = np.searchsorted(names, values)
    at[at == len(names)] = 0
    return names[at] == values


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a window of ``length`` at one of ``starts``."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0
