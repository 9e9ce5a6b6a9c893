"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Words are runs of ASCII letters and digits of the lower-cased text; shingles are five
words.  A template with fewer words than that is one shingle of all its words.

Retrieval.  A text's shingles are cut into blocks of ``BLOCK``; each pair of neighbouring
blocks is a window, so windows overlap by half.  A window's signature is its minimum
under ``len(MASKS)`` permutations (a hash XOR a fixed mask), and every permutation is a
band of one row.  The masks differ in their two top bits, so the four minima come from four
different quarters of the hashes and never favour the same shingle: windows of Jaccard
similarity J meet in some band with probability 1 - (1 - J)^4 or more (0.9375 at J = 0.5; a test
measures it).  Templates are windowed at every offset, so a
verbatim copy holds a window equal to a template's (J = 1: certain retrieval), and a copy
of n shingles offers about n / BLOCK windows.  Templates shorter than ``SHORT`` shingles
use windows of one shingle, whose signature is the shingle itself: certain retrieval of
any text that shares one.

Verification.  A retrieved template matches if at least ``containment`` of its distinct
shingles, compared as strings, occur in the text.

Everything is one projection a row: no shuffle, no join.  The templates are parameters,
held as literals (a few hundred short texts at most; ``MAX_TEMPLATES`` is checked).
Defined results: null and empty texts match nothing; repeated rows each give their matches;
texts of any length are scanned whole, each in its own row; only ``key`` and ``text`` are read,
so other columns may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.shared import once

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK = 4
SHORT = 12
MAX_TEMPLATES = 512
#: Masks of the permutations as signed longs, one for each value of the two top bits.
MASKS = tuple((top << 62 | low) - (top >> 1 << 64) for top, low in ((0, 0), (1, 0x1A827999B504F333), (2, 0x2545F4914F6CDD1D), (3, 0x3FEDCBA987654321)))

#: Notices by licence; fixed texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
}


def template_shingles(text: str, shingle: int = SHINGLE) -> list[str]:
    """The shingles of a template in order, by the same rules as a text's."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return [" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, min(len(words), 1)))]


def _shingles(words: Column, shingle: int) -> Column:
    starts = F.when(F.size(words) >= shingle, F.sequence(F.lit(0), F.size(words) - shingle)).otherwise(F.expr("array()").cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(shingle)]))


def _minima(names: Column, mask: int) -> Column:
    """Minimum of each block of names under one permutation."""
    starts = F.when(F.size(names) > 0, F.sequence(F.lit(0), F.size(names) - 1, F.lit(BLOCK))).otherwise(F.expr("array()").cast("array<int>"))

    def least(i: Column) -> Column:
        cells = [F.get(names, i + j).bitwiseXOR(F.lit(mask)) for j in range(BLOCK)]
        return F.least(*cells)  # skips the nulls beyond the end

    return F.transform(starts, least)


def _bands(minima: Column) -> Column:
    """Band keys of all windows: the minimum over each block and its right neighbour, by permutation."""

    def windows(row: Column, number: Column) -> Column:
        return F.zip_with(row, F.slice(row, 2, 1 << 30), lambda a, b: F.xxhash64(F.least(a, b), number))

    return F.flatten(F.transform(minima, windows))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT, shingle: int = SHINGLE) -> DataFrame:
    """(key, license_id, n_shingles, n_found, containment): a row for each text and matching template."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    parts = {name: template_shingles(t, shingle) for name, t in templates.items()}
    parts = {name: s for name, s in parts.items() if s}
    out = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = once(out, "words", F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")).drop("text")
    if not parts:
        return out.select(F.col("key").alias(key), F.lit("").alias("license_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_found"), F.lit(0.0).alias("containment")).limit(0)
    keys = _template_bands(docs, parts)
    short = {name for name, s in parts.items() if len(s) < SHORT}
    tiny = [name for name, s in parts.items() if len(s[0].split(" ")) < shingle]
    out = once(out, "names", F.transform(_shingles(F.col("words"), shingle), lambda s: F.xxhash64(s)))
    out = once(out, "minima", F.array(*[_minima(F.col("names"), m) for m in MASKS]))
    out = once(out, "bands", _bands(F.col("minima"))).drop("minima")
    all_short = F.lit(sorted({k for n in short for k in keys[n]})).cast("array<bigint>")
    all_long = F.lit(sorted({k for n in parts if n not in short for k in keys[n]})).cast("array<bigint>")
    met = F.arrays_overlap("names", all_short) | F.arrays_overlap("bands", all_long)
    for name in tiny:  # shorter than one shingle: retrieved by their words
        met = met | F.array_contains("words", parts[name][0].split(" ")[0])
    out = once(out.filter(met), "shingles", _shingles(F.col("words"), shingle))
    found = []
    for name, shingles in parts.items():
        distinct = sorted(set(shingles))
        mine = F.lit([int(k) for k in keys[name]]).cast("array<bigint>")
        if name in tiny:
            size = len(shingles[0].split(" "))
            hits = F.array_contains(_shingles(F.col("words"), size), shingles[0]).cast("int")
        else:
            retrieved = F.arrays_overlap("names" if name in short else "bands", mine)
            hits = F.when(retrieved, F.size(F.array_intersect("shingles", F.lit(distinct)))).otherwise(0)
        found.append(F.struct(F.lit(name).alias("license_id"), F.lit(len(distinct)).cast("long").alias("n_shingles"), hits.cast("long").alias("n_found")))
    rows = out.select("key", F.explode(F.array(*found)).alias("m")).select(F.col("key").alias(key), "m.*")
    rows = rows.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    return rows.filter(F.col("n_found") >= F.lit(containment) * F.col("n_shingles"))


def _template_bands(docs: DataFrame, parts: dict[str, list[str]]) -> dict[str, list[int]]:
    """Retrieval keys of each template, hashed by Spark as the texts' are; a few thousand longs."""
    rows = [(name, shingles) for name, shingles in parts.items()]
    table = docs.sparkSession.createDataFrame(rows, "name string, shingles array<string>")
    names = table.select("name", F.transform("shingles", lambda s: F.xxhash64(s)).alias("h"))
    # Windows of two blocks at every offset.
    width = 2 * BLOCK
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - width, F.lit(0)))

    def signature(mask: int, number: int) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(F.least(*[F.get("h", i + j).bitwiseXOR(F.lit(mask)) for j in range(width)]), F.lit(number)))

    bands = F.flatten(F.array(*[signature(m, n) for n, m in enumerate(MASKS)]))
    return {r["name"]: (r["h"] if len(r["h"]) < SHORT else sorted(set(r["b"]))) for r in names.select("name", "h", bands.alias("b")).collect()}


def oracle() -> str:
    """DuckDB SQL: every text against every template by exact containment."""
    values = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in TEMPLATES.items())
    grams = "list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])"
    return f"""
WITH t AS (SELECT name, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM (VALUES {values}) v(name, body)),
ts AS (SELECT name, {grams} AS s FROM t),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
ds AS (SELECT doc_id, {grams} AS s FROM d),
m AS (SELECT doc_id, name AS license_id, CAST(len(ts.s) AS BIGINT) AS n_shingles, CAST(len(list_intersect(ts.s, ds.s)) AS BIGINT) AS n_found FROM ds, ts)
SELECT doc_id, license_id, n_shingles, n_found, n_found / n_shingles AS containment FROM m WHERE n_found >= {CONTAINMENT} * n_shingles
"""
