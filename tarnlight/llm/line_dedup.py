"""Line dedup by site-relative frequency, in DataFrame functions only.

For each host, the pages that hold a line are divided by the host's pages; lines above
``ratio`` that are on at least ``least`` pages are boilerplate and are dropped from every
page of that host, however small it is.

Defined results: a line is what stands between line feeds, compared without white space
at its ends; blank lines are never counted and never dropped; a line counts once a page.
A null text has no lines and stays null; a null host is a host of its own.  Equal texts of
a host are one page, in both counts, so that copies don't make their own content boilerplate;
the lines of every row are dropped alike, texts of any length whole.  Other columns pass through,
whatever their names, but for ``_lines`` and ``_dropped``, which are replaced.  Lines are told
apart by 64-bit names, only within one host: among 10^9 distinct lines of a host a false match
with one of its boilerplate lines has a probability of about 10^-9.

Scale: the 64-bit line names of each distinct page and the counts of (host, line name) are
shuffled, both reduced on the map side first, so copies and a common line of a hot host are
one row a task.  A host's boilerplate holds fewer than
(mean lines a page) / ratio names, whatever the size of the corpus; it joins the pages as
one small array a host: by broadcast if the written table is below Spark's threshold, else by a
shuffle in which Spark splits a hot host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.shared import StepTables, once

RATIO = 0.1
LEAST = 2  #: a line on one page is no repetition
BLANKS = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without port and a leading ``www.``; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def _name(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _names(text: Column) -> Column:
    """Names of the distinct lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), _name))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, line name, pages with it, pages of the host) of the lines above ``ratio`` on ``least`` pages or more."""
    own = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col(host).isNull().alias("_none"), F.col(text).alias("_text"))
    distinct = own.groupBy("_host", "_none", F.xxhash64("_text", F.col("_text").isNull()).alias("_page")).agg(F.any_value(_names(F.col("_text"))).alias("_names"))
    totals = distinct.groupBy("_host", "_none").agg(F.count("*").alias("_total"))
    counts = distinct.select("_host", "_none", F.explode("_names").alias("_line")).groupBy("_host", "_none", "_line").agg(F.count("*").alias("_pages"))
    # Most lines are on one page and go before the join.
    frequent = counts.filter(F.col("_pages") >= least)
    return frequent.join(totals, ["_host", "_none"]).filter(F.col("_pages") > ratio * F.col("_total"))


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``pages`` with the boilerplate lines gone from ``text``, and ``_lines``, ``_dropped``: lines before, lines dropped."""
    bad = boilerplate(pages, host, text, ratio, least).groupBy("_host", "_none").agg(F.collect_list("_line").alias("_bad"))
    # As a written table its size is known, so Spark broadcasts it below its threshold and shuffles pages only above.
    bad = StepTables(pages, "line-dedup").keep(bad)
    # The page is one struct, so that no name of its columns can clash with one of the operator's.
    names = [c for c in pages.columns if c not in ("_lines", "_dropped")]
    rest = [F.col(f"`{c}`") for c in names if c != text]
    keyed = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col(host).isNull().alias("_none"), F.col(text).alias("_text"), (F.struct(*rest) if rest else F.lit(0)).alias("_page"))
    found = keyed.join(bad, ["_host", "_none"], "left")
    found = once(found, "_mine", F.when(F.col("_bad").isNotNull(), F.array_intersect(_names(F.col("_text")), F.col("_bad"))))
    lines = _lines(F.col("_text"))
    kept = F.filter(lines, lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | ~F.array_contains(F.col("_mine"), _name(x)))
    some = F.coalesce(F.size("_mine") > 0, F.lit(False))
    done = found.withColumn("_kept", F.when(some, kept)).withColumns({
        "_lines": F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "_dropped": F.when(some, F.size(lines) - F.size("_kept")).otherwise(0).cast("long"),
        "_text": F.when(some, F.array_join("_kept", "\n")).otherwise(F.col("_text")),
    })
    return done.select(*[F.col("_text").alias(c) if c == text else F.col("_page").getField(c).alias(c) for c in names], "_lines", "_dropped")


#: DuckDB SQL for the digest query; {ratio} and {least} are filled in.
ORACLE = r"""
WITH pages AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
one AS (SELECT source, text, row_number() OVER () AS i FROM (SELECT DISTINCT source, text FROM documents)),
totals AS (SELECT source, count(*) AS total FROM one GROUP BY source),
freq AS (SELECT source, t, count(DISTINCT i) AS df FROM (SELECT source, i, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM one) WHERE t <> '' GROUP BY source, t),
bad AS (SELECT f.source, f.t FROM freq f JOIN totals o ON f.source IS NOT DISTINCT FROM o.source WHERE f.df >= {least} AND f.df > {ratio} * o.total),
lines AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM pages),
trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM lines),
marked AS (SELECT l.r, l.n, l.line, b.t IS NOT NULL AS gone FROM trimmed l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.t = b.t),
back AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY r)
SELECT p.doc_id, CAST(coalesce(b.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(b.n_dropped, 0) AS BIGINT) AS n_dropped,
       CASE WHEN p.text IS NULL THEN NULL ELSE sha256(coalesce(b.kept, '')) END AS text_sha256
FROM pages p LEFT JOIN back b USING (r)
"""
