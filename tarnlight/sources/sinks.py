"""Sinks (SNK-01 to SNK-06)."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A frame as CSV (with a header) or Parquet (SNK-01)."""
    (df.write.mode(mode).option("header", True) if fmt == "csv" else df.write.mode(mode)).format(fmt).save(path)


def append_journal(journal: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows added to a journal; either may have columns that the other lacks (SNK-02)."""
    return journal.unionByName(rows, allowMissingColumns=True)


def upsert(journal: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The journal without what ``rows`` replace, and ``rows`` (SNK-03)."""
    kept = journal.join(rows.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each data file of a written table: the digest is of the file's content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(df: DataFrame, table: str, path: str, **facts) -> dict:
    """Row count, columns and the SHA-256 of each file of ``table``, from which ``df`` is read, written as JSON to ``path`` (SNK-04).

    The manifest is small, written by the driver; the digests are made in tasks.
    """
    files = [r.asDict() for r in file_digests(df.sparkSession, table).orderBy("file").collect()]
    out = {**facts, "rows": df.count(), "columns": df.columns, "files": files}
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")
    return out


def markdown(df: DataFrame, limit: int = 200, digits: int = 3) -> str:
    """A small report table as Markdown (SNK-05); ``limit`` is the feature: reports are short."""

    def cell(x) -> str:
        return "—" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)

    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows]) + "\n"


def resume(df: DataFrame, folder: str, code: str) -> DataFrame:
    """A partial result under a name that depends on code and configuration: computed once, then read (SNK-06)."""
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{hashlib.sha256(code.encode()).hexdigest()[:16]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
