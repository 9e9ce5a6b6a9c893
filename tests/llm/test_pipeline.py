"""The corpus pipeline against a plain version of all its stages."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnlight.llm import bpe, decontaminate, jaccard, line_dedup, queries
from tarnlight.llm.shared import StepTables

WORDS = ["alpha", "beta", "gamma", "delta", "kilo", "lima", "oscar", "papa", "tango", "zulu", "echo", "golf"]


def plain(rows, items):
    """(doc_id, n_tokens, ids_sha256) of what the pipeline keeps."""
    docs = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    total, seen = {}, {}
    for source, text in {(r[3], r[1]) for r in docs}:
        total[source] = total.get(source, 0) + 1
        for line in {x.strip(line_dedup.BLANKS) for x in text.split("\n")} - {""}:
            seen[source, line] = seen.get((source, line), 0) + 1
    bad = {k for k, n in seen.items() if n >= line_dedup.LEAST and n > line_dedup.RATIO * total[k[0]]}
    docs = [(d, "\n".join(x for x in t.split("\n") if (s, x.strip(line_dedup.BLANKS)) not in bad)) for d, t, _, s, _ in docs]
    label = {d: c for d, _, c in jaccard.brute_force(docs, 5, 8, 10)}
    docs = [(d, t) for d, t in docs if label[d] == d]
    hit = {r[0] for r in decontaminate.brute_force(docs, items) if r[5]}
    ranks, pattern = queries.tokenizer()
    out = []
    for d, t in docs:
        if d not in hit:
            ids = bpe._encoding(ranks, pattern).encode_ordinary(t)
            out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_pipeline_equals_the_plain_version(spark, tmp_path):
    rng = random.Random(2)
    items = [(1, " ".join(rng.choice(WORDS) for _ in range(14)))]
    rows = []
    for i in range(110):
        text = "\n".join([" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(6)] + ["Follow us for more"] * (i % 4 == 0))
        if i % 20 == 1:
            text = rows[0][1].replace("alpha", "beta", 1)
        if i % 25 == 2:
            text = f"{text} {items[0][1]} end"
        rows.append((i, None if i == 50 else "12 34 !" if i == 51 else text, "aa", f"s{i % 3}", len(text)))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == plain(rows, items)
    assert 60 < len(plain(rows, items)) < 108


def test_stages_keep_the_columns(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


CLASHES = ("_lang", "_score", "_marks", "_lines", "_dropped", "_host", "_bad", "rest", "row", "sid", "component_id", "digest", "n_tokens")


def test_stages_on_hard_tables(spark, sf_dir):
    """Nulls in every column, repeated rows and ids, ties, empty and very long texts, clashing and missing columns."""
    rng = random.Random(41)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(120_000))
    prose = " ".join(rng.choice(WORDS) for _ in range(40))
    rows = [(1, long, "aa", "s"), (2, long + " end", "aa", None), (3, prose, None, "s"), (3, prose, None, "s"), (None, prose, "bb", "s"), (4, None, "bb", None), (5, "", None, "s"), (None, None, None, None), (6, "head\n" + prose[5:], "bb", "s"), (7, "head\nother words entirely", "bb", "s"), (8, prose, "bb", "s"), (9, "一" * 70_000, "cc", "s")]
    plain_docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs = plain_docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0))) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, plain_docs.filter("false").withColumn("n_chars", F.lit(1))):
            out = stage(spark, frame, sf_dir)
            assert out.columns == frame.columns, name
            found = out.collect()
            assert all(r[c] == f"{c}{r['doc_id'] or 0}" for r in found for c in CLASHES if frame is docs), name
        docs = StepTables(docs, "test").keep(stage(spark, docs, sf_dir))
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1, 3, 3, 7, 9]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[1] == long and texts[7] == "other words entirely"
    tokens = corpus_pipeline.encode(spark, docs, sf_dir)
    assert tokens.count() == 6 and tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = {hashlib.sha256(t.encode()).hexdigest() for t in texts.values()}
    assert {r["decoded_sha256"] for r in tokens.collect()} == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_run(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    assert out.count() > 0
