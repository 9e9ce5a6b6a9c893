"""A training-corpus pipeline: each stage applies one corpus operator to what the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes as
Parquet in the shared folder and reads again as the next stage's documents.  All stages but
the last return the columns of ``documents``, whatever others the table has beside
``doc_id``, ``text``, ``lang`` and ``source``; columns named like an operator's own keep their values.

Defined results, stage by stage: *language* drops null and empty texts and those without a
letter (and all, where nothing is labelled); *lines* treats equal texts of a source as one page, a null source
as a source of its own, and keeps a document whose lines are all dropped, with an empty text;
*near_copies* keeps the rows of the least ``doc_id`` of each group, so rows that repeat an id stay or
go together, and keeps every row with a null id or an empty text; *decontamination*
keeps documents without words; *tokens* returns a row for each row.  Equal rows are treated alike
by every stage, texts of any length are taken whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm import bpe, decontaminate, jaccard, language, line_dedup
from tarnlight.llm.queries import held_out, table, tokenizer
from tarnlight.llm.shared import StepTables


def _held(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and all others as one struct ``rest``, where no name clashes."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in columns]
    return docs.select(*columns, (F.struct(*others) if others else F.lit(None)).alias("rest"))


def _back(docs: DataFrame, held: tuple[str, ...], changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns of ``docs`` from what :func:`_held` made, in their order."""
    changed = changed or {}
    return [changed[c].alias(c) if c in changed else F.col(c) if c in held else F.col("rest").getField(c).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told (no text, or no letter in it)."""
    model = language.fit(docs, ~held_out())
    kept = language.identify(_held(docs, "text"), model).filter(F.col("_lang") != language.UNDETERMINED)
    return kept.select(*_back(docs, ("text",)))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines above the boilerplate ratio of their source; ``n_chars``, where there is one, follows the text."""
    out = line_dedup.line_dedup(_held(docs, "source", "text"), host="source")
    size = {"n_chars": F.when(F.col("_dropped") > 0, F.length("text")).otherwise(F.col("rest").getField("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*_back(docs, ("source", "text"), size))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest number of each group of near copies (five words, similarity 0.8)."""
    found = jaccard.jaccard_components(docs, shingle=5, num=8, den=10)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark text."""
    marked = decontaminate.decontaminate(_held(docs, "text"), table(spark, sf_dir, "benchmark"))
    return marked.filter(F.size("_marks.runs") == 0).select(*_back(docs, ("text",)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again: counts and digests."""
    return bpe.encode_digest(docs, *tokenizer())


STAGES = [
    ("language", identify_language),
    ("lines", drop_boilerplate),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("tokens", encode),
]

#: The stages' iterative and learned parts have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tables = StepTables(docs, "pipeline")
    before = None
    for _, stage in STAGES:
        docs, path = tables.write(stage(spark, docs, sf_dir))
        if before:
            tables.drop(before)
        before = path
    return docs
