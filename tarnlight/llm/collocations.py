"""Phrase collocations: exact n-gram counts of each language, scored at their weakest cut.

Texts are split into pieces at punctuation and line ends, pieces into words at blanks and
tabs.  The 1..max_n-grams of the pieces are counted in stretches of some MB of text, by arrays;
the distinct ones of a stretch become rows, which Spark sums up by language and phrase.  A candidate is a phrase of two words or more with at least ``least``
occurrences; each cut into a first part and a rest scores ``SCALE * a * a / (l * r)``,
rounded down, in decimal arithmetic, and the lowest cut counts.  A candidate inside a longer one that keeps
at least ``share`` of its occurrences is dropped; as counts never grow with length, it is enough to
look at extensions by one word.  Each language's best ``top`` phrases are ranked.

Defined results: a null or empty text has no words; a null language is ``und`` and counts
together with a language of that name; repeated rows count each time; only A-Z are lower-cased;
ties in the score go to the more frequent phrase, then to the first in UTF-8 byte
order, so ranks are unique; a language without candidates has no rows, and an empty table gives none.
Only ``text`` and ``lang`` are read, so no other column can clash.

Scale: one round for words and pairs and one for each further length, so the shuffle files of a round are gone before the next
begins; each round is one pass over the texts and one exchange, in which a hot phrase or language
is a row a stretch.  A piece is never cut, so it is what a task must hold.  Phrases below ``least`` are never
written after their round but for the number of words: both parts of a candidate occur at least as often as it does.
The joins are between frequent phrases only; Spark splits the rows of a word that begins many of them.
The rank filter limits each task's rows of a language before they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm.shared import StepTables

SCALE = 1_000_000
LEAST, SHARE, TOP, MAX_N = 10, 0.5, 2000, 3
UNKNOWN = "und"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What a byte is: part of a word, a blank between words, or the end of a piece; A-Z in lower case.
WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Ends the phrase of a key; no word holds it, as it ends pieces.
MARK = b"\n"
STRETCH, ROWS = 8 << 20, 1 << 16


def stretches(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Places of about ``size`` bytes of the texts in ``data``, cut between texts or, in long ones, between pieces."""
    start, stop = 0, size
    while start < len(data):
        cut = len(data)
        if stop < len(data):
            cut = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
            if cut <= start:
                breaks = np.flatnonzero(KIND[data[start:stop]] == BREAK)
                cut = start + int(breaks[-1]) + 1 if len(breaks) else start
        if cut > start:
            yield start, cut
            start, stop = cut, cut + size
        else:  # a piece is never cut
            stop += stop - start


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts that lie one after the other, the number of each word's text, and whether the next word is in its piece."""
    kind = KIND[data]
    inside = kind == WORD
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[offsets < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    ends = np.cumsum(np.r_[0, np.flatnonzero(last) + 1 - starts])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(LOWER[data[inside]])])
    before = np.searchsorted(starts, offsets)
    cut = np.zeros(len(starts) + 1, bool)
    cut[before] = True
    cut[np.searchsorted(starts, np.flatnonzero(kind == BREAK))] = True
    return words, np.repeat(np.arange(len(offsets) - 1), np.diff(before)), ~cut[1:-1]


def _dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place among the distinct ones, and these."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


def _joined(*parts: pa.Array, by: bytes) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar(by, pa.large_binary()))


def gram_rows(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, names: pa.Array, lengths: tuple[int, ...]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrase, MARK, language) as bytes and its occurrences, for the distinct phrases of ``lengths``; the empty phrase occurs at each word."""
    words, text, joined = words_of(data, offsets)
    if not len(words):
        return
    coded = words.dictionary_encode()
    lang = langs[text]
    code, found = _dense(lang * len(coded.dictionary) + coded.indices.to_numpy())
    plain = coded.dictionary.take(pa.array(found % len(coded.dictionary)))
    last = _joined(plain, names.take(pa.array(found // len(coded.dictionary))), by=MARK)
    if 0 in lengths:
        some = np.unique(lang)
        yield _joined(pa.array([b""] * len(some), pa.large_binary()), names.take(pa.array(some)), by=MARK), np.bincount(lang)[some]
    base, columns = len(found), [np.arange(len(found))]
    at, here, span, tails = np.arange(len(code)), code, base, 0
    for n in range(1, max(lengths) + 1):
        if n > 1:
            room = np.searchsorted(at, len(code) - n + 1)
            follows = joined[at[:room] + n - 2]
            at, here = at[:room][follows], here[:room][follows]
            here, span, tails = here * base + code[at + n - 1], span * base, tails + 1
            if n in lengths or span > 2**62 // base:  # numbers of phrases again, before their words outgrow 64 bits
                here, rest = _dense(here)
                ends = []
                for _ in range(tails):
                    rest, end = np.divmod(rest, base)
                    ends.append(end)
                columns = [c[rest] for c in columns] + ends[::-1]
                span, tails = max(len(rest), 1), 0
        if n in lengths:
            count = np.bincount(here, minlength=len(columns[0]))
            for i in range(0, len(count), ROWS):
                *head, tail = [pa.array(c[i : i + ROWS]) for c in columns]
                yield _joined(*[plain.take(c) for c in head], last.take(tail), by=b" "), count[i : i + ROWS]


def _gathered(source: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Two columns of bytes, of short batches together."""
    held = []
    for batch in source:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield tuple(pa.concat_arrays([b.column(i).cast(pa.large_binary()) for b in held]) for i in (0, 1))
            held = []
    if held:
        yield tuple(pa.concat_arrays([b.column(i).cast(pa.large_binary()) for b in held]) for i in (0, 1))


def phrases(docs: DataFrame, lengths: tuple[int, ...], size: int = STRETCH) -> DataFrame:
    """(_key, _f): occurrences of each phrase in stretches of about ``size`` bytes of text, one row a stretch. ``docs``: (_lang, _text) without nulls."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _gathered(source, size):
            names = lang.dictionary_encode()
            langs = names.indices.to_numpy().astype(np.int64)
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            for start, stop in stretches(data, offsets, size):
                a, b = np.searchsorted(offsets, start, side="right") - 1, np.searchsorted(offsets, stop)
                own = np.clip(offsets[a : b + 1] - start, 0, stop - start)
                for key, f in gram_rows(data[start:stop], own, langs[a:b], names.dictionary, lengths):
                    yield pa.RecordBatch.from_arrays([key.cast(pa.binary()), pa.array(f, pa.int64())], names=["_key", "_f"])

    return docs.select("_lang", "_text").mapInArrow(run, "_key binary, _f bigint")


def counts(docs: DataFrame, lengths: tuple[int, ...], least: int) -> DataFrame:
    """(_lang, _phrase, _f): phrases of some ``lengths`` with ``least`` occurrences or more; the empty one (length 0) has the number of words, whatever it is."""
    # Stretches have few phrases in common: to sum them up once more before the exchange would cost more than it saves.
    summed = phrases(docs, lengths).repartition("_key").groupBy("_key").agg(F.sum("_f").alias("_f"))
    kept = summed.filter((F.col("_f") >= least) | F.col("_key").startswith(F.lit(MARK)))
    parts = F.split(F.col("_key").cast("string"), MARK.decode(), 2)
    return kept.select(parts.alias("_parts"), "_f").select(F.get("_parts", F.lit(1)).alias("_lang"), F.get("_parts", F.lit(0)).alias("_phrase"), "_f")


def score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (l * r)), exact for counts below 10^16."""
    wide = "CAST({} AS DECIMAL(19, 0))".format
    return F.expr(f"({wide(a)} * {wide(a)} * CAST({SCALE} AS DECIMAL(7, 0))) div ({wide(left)} * {wide(right)})")


def _part(first: Column, last: Column) -> Column:
    """Words ``first`` to ``last`` (from 1) of a phrase."""
    return F.array_join(F.slice(F.split("_phrase", " "), first, last - first + 1), " ")


def scored(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """``candidates`` (_lang, _phrase, _n, _a) with _l, _r and _score of their weakest cut; ties go to the earliest."""
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)).alias("_k"))
    cut = cut.select("*", _part(F.lit(1), F.col("_k")).alias("_first"), _part(F.col("_k") + 1, F.col("_n")).alias("_rest"))
    left = frequent.select("_lang", F.col("_phrase").alias("_first"), F.col("_f").alias("_l"))
    right = frequent.select("_lang", F.col("_phrase").alias("_rest"), F.col("_f").alias("_r"))
    found = cut.join(left, ["_lang", "_first"]).join(right, ["_lang", "_rest"])
    least = found.groupBy("_lang", "_phrase", "_n", "_a").agg(F.min(F.struct(score("_a", "_l", "_r").alias("_score"), "_k", "_l", "_r")).alias("_cut"))
    return least.select("_lang", "_phrase", "_n", "_a", "_cut._l", "_cut._r", "_cut._score")


def extensions(candidates: DataFrame) -> DataFrame:
    """(_lang, _phrase, _most): of each phrase, the occurrences of its most frequent extension by one word."""
    longer = candidates.filter(F.col("_n") > 2)
    inner = F.explode(F.array(_part(F.lit(1), F.col("_n") - 1), _part(F.lit(2), F.col("_n")))).alias("_phrase")
    return longer.select("_lang", inner, "_a").groupBy("_lang", "_phrase").agg(F.max("_a").alias("_most"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = LEAST, share: float = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to ``max_n`` words."""
    tables = StepTables(docs, "collocations")
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("_lang"), F.col(text).alias("_text")).filter(F.col("_text") != "")
    first = tables.keep(counts(texts, (0, 1, 2)[: max_n + 1], least))
    longer = [tables.keep(counts(texts, (n,), least)) for n in range(3, max_n + 1)]
    totals = first.filter(F.col("_phrase") == "").select("_lang", F.col("_f").alias("_total"))
    frequent = reduce(DataFrame.unionAll, [first.filter(F.col("_phrase") != ""), *longer])
    single = ~F.contains(F.col("_phrase"), F.lit(" "))
    candidates = frequent.filter(~single).select("_lang", "_phrase", F.size(F.split("_phrase", " ")).alias("_n"), F.col("_f").alias("_a"))
    part = F.lit(f"{share:g}").cast("decimal(10,6)")
    covered = extensions(candidates).alias("e")
    own = scored(candidates, frequent).alias("c")
    same = (F.col("c._lang") == F.col("e._lang")) & (F.col("c._phrase") == F.col("e._phrase"))
    kept = own.join(covered, same & (F.col("e._most") >= part * F.col("c._a")), "left_anti")
    order = Window.partitionBy("_lang").orderBy(F.desc("_score"), F.desc("_a"), "_phrase")
    best = kept.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top)
    named = {"lang": "_lang", "rank": "_rank", "phrase": "_phrase", "a": "_a", "l": "_l", "r": "_r", "n": "_total", "score": "_score"}
    return best.join(totals, "_lang").select(*[(F.col(c) if k in ("lang", "phrase") else F.col(c).cast("long")).alias(k) for k, c in named.items()])


#: DuckDB SQL for :func:`collocations` with the default parameters.
ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM spots, range(1, {MAX_N + 1}) AS t(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= {LEAST}),
cuts AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM c),
parts AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, ({SCALE} * a * a) // (x.f * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:c.m], ' ')),
weakest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT c.lang, array_to_string(d.w[s:s + c.m - 1], ' ') AS phrase FROM c d, range(1, {MAX_N}) AS t(s), c WHERE c.lang = d.lang AND c.m < d.m AND s + c.m - 1 <= d.m AND c.phrase = array_to_string(d.w[s:s + c.m - 1], ' ') AND 100 * d.a >= {int(100 * SHARE)} * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest ANTI JOIN gone USING (lang, phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
