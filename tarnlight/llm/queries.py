"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm import bpe, collocations, decontaminate, jaccard, language, license_scan, line_dedup, media, substring_dedup, suffix_dedup, url_filter, warc, whitening
from tarnlight.llm.shared import StepTables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """(rank file, pattern) of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), *tokenizer())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = StepTables(pages, "warc").keep(warc.write_archives(warc.plan_records(pages)))
    read = warc.read_archives(archives, pages.schema["page_id"].dataType)
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~held_out())
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), digest=True)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store_texts(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), digest=True)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_line_dedup, op3_license_scan, op4_decontaminate, op5_warc, op6_jaccard, op7_language, op8_suffix_dedup, op9_media, op10_substring_dedup, op11_url_filter, op12_whitening, op13_collocations, pipeline)}

ORACLE_OP4 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
it AS (SELECT item, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
ip AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM it),
pat AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM ip),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM it)),
dg AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM dp),
hits AS (SELECT doc_id, n, p, item FROM dg JOIN pat USING (n, s)),
pos AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""

ORACLE_OP5 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS m FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""

ORACLE_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS q, len(w) AS n FROM w),
grams AS (SELECT doc_id, n, string_agg(word, ' ') OVER s AS g, count(*) OVER s AS k FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
sets AS (SELECT DISTINCT doc_id, g FROM grams WHERE k = least(n, 3)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""
ORACLE_OP8 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(CAST(len(h) / 2 - 49 AS BIGINT))) AS i FROM d WHERE len(h) >= 100),
s AS (SELECT p.doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS x FROM p JOIN d USING (doc_id)),
m AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT s.doc_id, unnest(range(i, i + 50)) AS q FROM s JOIN m ON s.x = m.x AND m.first < s.doc_id),
bytes AS (SELECT doc_id, substr(h, CAST(2 * q + 1 AS BIGINT), 2) AS b, q FROM (SELECT doc_id, h, unnest(range(CAST(len(h) / 2 AS BIGINT))) AS q FROM d)),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY q) AS k FROM bytes ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE new) AS n_spans FROM (SELECT doc_id, q - lag(q) OVER (PARTITION BY doc_id ORDER BY q) IS DISTINCT FROM 1 AS new FROM gone) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
ORACLE_OP10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS q FROM w),
wins AS (SELECT doc_id, q, md5(string_agg(word, ' ') OVER s) AS x, count(*) OVER s AS k FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT x, min(doc_id) AS first FROM wins WHERE k = 50 GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT wins.doc_id, unnest(range(q, q + 50)) AS q FROM wins JOIN m ON wins.x = m.x AND m.first < wins.doc_id WHERE k = 50),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS k FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.ORACLE.format(ratio=line_dedup.RATIO, least=line_dedup.LEAST),
    "op3_license_scan": license_scan.oracle(),
    "op4_decontaminate": ORACLE_OP4,
    "op5_warc": ORACLE_OP5,
    "op6_jaccard": ORACLE_OP6,
    "op8_suffix_dedup": ORACLE_OP8,
    "op10_substring_dedup": ORACLE_OP10,
    "op13_collocations": collocations.ORACLE,
}
