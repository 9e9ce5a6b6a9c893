"""Language identification by cross-parsing entropy.

For each language, labelled text makes a suffix automaton.  A text is parsed into phrases,
each the longest match from where it stands; the language that needs fewest phrases wins.
``phrases * log2(length of the labelled text) / characters`` estimates the cross entropy in bits a character.

Fitting is bounded and documented: at most ``DOCS`` distinct labelled texts of a language are drawn (those
whose hash is least within a share of them that is drawn by hash), a window of ``CHARS_EACH``
characters at a hashed place of each (more where the texts are few). The windows are put together in
that order and the first ``CHARS`` characters are learned from, so of many texts about ``CHARS / CHARS_EACH``;
every character in them is a symbol of its own.  Prediction parses
every whole text.  Long texts are parsed in segments of ``SEGMENT`` characters at once, each from
``WARM`` characters before it; where the parse so begun does not stand in the state in which the
segment before has ended, the segment is parsed again from that state.  So the phrases are
those of one parse from the text's start, whatever the segments.
All languages and the segments of many texts are parsed in step, as array operations.

Defined results: a null text and one without a letter are ``und`` with score 0; without any
labelled text all are ``und``; equal counts go to the alphabetically first language; the
score is ``1 - fewest / second fewest`` (1 where there is one language only); each row is
predicted by its text alone, repeated rows alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlight.llm.shared import utf8

DOCS = 160
CHARS_EACH = 400
CHARS = 40_000
SEGMENT = 4_096
WARM = 512
UNDETERMINED = "und"


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


@dataclass
class Model:
    languages: list[str]
    chars: np.ndarray  #: code points seen in training; class k + 1, all others are class 0
    owner: np.ndarray  #: [state + class] -> the state whose transition it is, or -1
    target: np.ndarray  #: [state + class] -> that transition's next state
    first: np.ndarray  #: [language, class] -> the state that a phrase of this character alone leads to
    roots: np.ndarray  #: each language's root state
    sizes: np.ndarray  #: characters of each language's labelled text

    @property
    def classes(self) -> int:
        return len(self.chars) + 1


def _pack(moves: list[dict[int, int]], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, target, places): sparse transitions laid over one another, each state at a place of its own.

    Class 0 has no transitions.  The transition of a state at place p by class c is in cell p + c.
    """
    span = 3 * sum(map(len, moves)) + len(moves) + 1
    used, taken = bytearray(span), bytearray(span + classes)
    places = [0] * len(moves)
    draw = 0
    for state in sorted(range(len(moves)), key=lambda k: -len(moves[k])):
        own = moves[state]
        for _ in range(64):
            draw = (draw + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            at = (draw >> 16) % span
            if not used[at] and not any(taken[at + c] for c in own):
                break
        else:  # no place found: one behind all others
            at = len(taken)
            used.extend(bytes(at + 1 - len(used)))
            taken.extend(bytes(classes))
        used[at] = 1
        for c in own:
            taken[at + c] = 1
        places[state] = at
    owner, target = np.full(len(taken), -1, np.int32), np.zeros(len(taken), np.int32)
    for state, own in enumerate(moves):
        at = places[state]
        for c, to in own.items():
            owner[at + c], target[at + c] = at, places[to]
    return owner, target, np.array(places, np.int64)


def train(texts: dict[str, list[str]], chars: int = CHARS) -> Model:
    """A model of the labelled texts of each language."""
    joined = {lang: "\n".join(parts).lower()[:chars] for lang, parts in sorted(texts.items()) if any(parts)}
    points = np.array(sorted({ord(c) for t in joined.values() for c in t}), np.int64)
    place = {int(p): k + 1 for k, p in enumerate(points)}
    classes = len(points) + 1
    owners, targets, roots, base = [], [], [], 0
    first = np.empty((len(joined), classes), np.int32)
    for k, text in enumerate(joined.values()):
        moves = suffix_automaton([place[ord(c)] for c in text])
        owner, target, places = _pack(moves, classes)
        if base + len(owner) >= 1 << 31:
            raise ValueError("the model is too large; lower chars or the number of languages")
        owners.append(np.where(owner >= 0, owner + base, -1).astype(np.int32))
        targets.append((target + base).astype(np.int32))
        roots.append(base + places[0])
        first[k] = roots[-1]  # a character the language lacks is a phrase of its own
        first[k, list(moves[0])] = base + places[list(moves[0].values())]
        base += len(owner)
    empty = [np.empty(0, np.int32)]
    return Model(list(joined), points, np.concatenate(owners or empty), np.concatenate(targets or empty), first, np.array(roots, np.int64), np.array([len(t) for t in joined.values()], np.int64))


def _parse(model: Model, segments: list[np.ndarray], begin: np.ndarray, warm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, first, last), each [language, segment]: phrases ended after the segment's first ``warm`` symbols, the state there and at the end.

    ``begin`` holds the states that the segments start from.
    """
    count, first, last = np.zeros(begin.shape, np.int64), begin.copy(), begin.copy()
    roots = model.roots[:, None].astype(np.int32)
    lengths = np.array([len(s) for s in segments], np.int64)
    order = np.argsort(-lengths, kind="stable")
    # Segments of like length go together, longest first, so that few cells are padding.
    for at in range(0, len(order), 1024):
        part = order[at : at + 1024]
        size = lengths[part]
        grid = np.zeros((int(size[0]), len(part)), segments[part[0]].dtype)
        for k, i in enumerate(part):
            grid[: size[k], k] = segments[i]
        active = np.searchsorted(-size, -np.arange(len(grid)), side="left")
        state, seen = begin[:, part], np.zeros((len(begin), len(part)), np.int32)
        for t in range(len(grid)):
            if t == WARM:
                late = np.flatnonzero(warm[part])
                first[:, part[late]] = state[:, late]
                seen[:, late] = 0
            m = active[t]
            held, symbol = state[:, :m], grid[t, :m]
            cell = held + symbol
            ends, alone = model.owner[cell] != held, model.first[:, symbol]
            # A character the language lacks closes the phrase before it, if one is open, and is one more.
            seen[:, :m] += ends
            seen[:, :m] += (alone == roots) & (held != roots)
            state[:, :m] = np.where(ends, alone, model.target[cell])
        count[:, part], last[:, part] = seen, state
    return count, first, last


def phrase_counts(model: Model, texts: list[str]) -> np.ndarray:
    """[text, language]: how many phrases each text parses into."""
    kind = np.int16 if model.classes < 1 << 15 else np.int32
    lookup = np.zeros(0x110000 if len(model.chars) and model.chars[-1] > 0xFFFF else 0x10000, kind)
    lookup[model.chars] = np.arange(1, len(model.chars) + 1)
    symbols = []
    for t in texts:
        c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols.append(lookup[np.where(c < len(lookup), c, 0)])
    places = [(k, at) for k, c in enumerate(symbols) for at in range(0, len(c), SEGMENT)]
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    if not places:
        return out
    owner, inner = np.array([k for k, _ in places]), np.array([at > 0 for _, at in places])
    roots = np.repeat(model.roots[:, None].astype(np.int32), len(places), axis=1)
    count, first, last = _parse(model, [symbols[k][max(at - WARM, 0) : at + SEGMENT] for k, at in places], roots, inner)
    # Each round mends at least the first segment of a text that began in a wrong state.
    while len(wrong := np.flatnonzero(np.r_[False, (first[:, 1:] != last[:, :-1]).any(axis=0)] & inner)):
        begin = last[:, wrong - 1]
        again, _, end = _parse(model, [symbols[k][at : at + SEGMENT] for k, at in (places[i] for i in wrong)], begin, np.zeros(len(wrong), bool))
        count[:, wrong], first[:, wrong], last[:, wrong] = again, begin, end
    closing = np.r_[owner[1:] != owner[:-1], True]
    np.add.at(out, owner, (count + ((last != roots) & closing)).T)  # and the phrase that the text's end closes
    return out


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
    """(language, score, bits a character) of each text."""
    known = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
    out: list[tuple[str, float, float | None]] = [(UNDETERMINED, 0.0, None)] * len(texts)
    if known:
        counts = phrase_counts(model, [texts[i] for i in known])
        for i, row in zip(known, counts):
            # "Normalised": by the bits that name a place in the language's labelled text.
            cost = row * np.log2(model.sizes + 1)
            best = int(cost.argmin())
            second = np.delete(cost, best)
            score = 1.0 - cost[best] / second.min() if len(second) else 1.0
            out[i] = (model.languages[best], float(min(max(score, 0.0), 1.0)), float(cost[best] / len(texts[i])))
    return out


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", n_docs: int = DOCS, chars_each: int = CHARS_EACH, chars: int = CHARS) -> Model:
    """A model from a bounded sample of the distinct texts of ``docs`` where ``usable`` holds."""
    own = docs.filter(usable & F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text), F.lit("fit")).alias("h"))
    totals = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}
    if not totals:
        return train({})

    def of_lang(value) -> Column:
        return F.element_at(F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(value(n)))]), F.col("lang"))

    # The hash draws about twice the texts wanted of each language; the least of those are taken.
    drawn = own.filter((F.col("h") / F.lit(float(1 << 63)) + 1) / 2 <= of_lang(lambda n: min(1.0, 2.0 * n_docs / n)))
    # Where texts are few, each gives more, so that the same number of characters is learned from.
    size = of_lang(lambda n: max(chars_each, -(-chars // min(n, n_docs))))
    start = F.pmod(F.xxhash64(F.col("text"), F.lit("place")), F.greatest(F.length("text") - size + 1, F.lit(1))).cast("int")
    rows = drawn.select("lang", "h", F.substring("text", start + 1, size).alias("part")).distinct().collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["part"])):
        texts.setdefault(r["lang"], []).append(r["part"])
    return train({k: list(dict.fromkeys(v))[:n_docs] for k, v in texts.items()}, chars=chars)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``_lang``, ``_score``, ``_bits``: what :func:`predict` says of each row's whole text.

    Input columns pass through; columns of the input with these three names are replaced.
    """
    names = [c for c in docs.columns if c not in ("_lang", "_score", "_bits")]
    own = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*own.schema, T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_bits", T.DoubleType())])
    held, at = docs.sparkSession.sparkContext.broadcast(model), names.index(text)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            cells = [None if c is None else c.decode("utf-8", "replace") for c in utf8(batch.column(at))]
            made: list[tuple] = []
            start, weight = 0, 0
            for i, c in enumerate(cells):  # texts of about 4 million characters at a time
                weight += len(c or "")
                if weight > 4 << 20 or i == len(cells) - 1:
                    made += predict(held.value, cells[start : i + 1])
                    start, weight = i + 1, 0
            langs, scores, bits = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=[*names, "_lang", "_score", "_bits"])

    return own.mapInArrow(run, schema)
