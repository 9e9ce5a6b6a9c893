"""File and network sources (SRC-01 to SRC-10).

Files are read by Spark's readers with explicit schemas.  Network fetches are pluggable
callables, so nothing here depends on an HTTP library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.request import urlopen

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tarnlight.functions.scalar import reciprocal
from tarnlight.operators.validate import require, require_columns, validate_external
from tarnlight.sources.panel import CONTEXT, EXTERNAL, RATES


RECORD = "_Date string, _Id string, Nominal string, Value string"


def _rate_rows(raw: DataFrame, currency: Column, cbr_id: Column) -> DataFrame:
    """Rate rows of raw records; a malformed one is an error."""

    def number(column: str) -> Column:
        return F.expr(f"try_cast(replace(replace(`{column}`, ' ', ''), ',', '.') as double)")

    nominal, value = number("Nominal"), number("Value")
    out = raw.select(F.expr("try_to_date(_Date, 'dd.MM.yyyy')").alias("effective_date"), currency.alias("currency"), cbr_id.alias("cbr_id"), nominal.cast("int").alias("nominal"), value.alias("value_rub"))
    bad = F.col("effective_date").isNull() | F.col("nominal").isNull() | (F.col("nominal") <= 0) | F.col("value_rub").isNull()
    out = out.withColumn("value_rub", F.when(bad, F.raise_error(F.lit("malformed rate record")).cast("double")).otherwise(F.col("value_rub")))
    price = F.col("value_rub") / F.col("nominal")
    return out.select("effective_date", F.col("effective_date").alias("available_at"), "currency", "cbr_id", "nominal", "value_rub", price.alias("rub_per_unit"), reciprocal(price).alias("recipient_per_rub"), F.lit(True).alias("is_fresh"))


def parse_rate_xml(spark: SparkSession, path: str, currency: str, cbr_id: str) -> DataFrame:
    """``Record`` elements as rate rows: decimal commas, ``dd.MM.yyyy`` dates, prices per one unit (SRC-01).

    A malformed record or a file without records is an error.
    """
    raw = spark.read.format("xml").option("rowTag", "Record").schema(RECORD).load(path)
    require(not raw.isEmpty(), f"no records in {path}")
    return _rate_rows(raw, F.lit(currency), F.lit(cbr_id))


def fetch_rates(spark: SparkSession, fetch: Callable[[str], str], series: dict[str, str]) -> DataFrame:
    """Rate rows of each series' XML, fetched in tasks, one series each; a text without records is an error."""
    require(bool(series), "no series to fetch")
    names = spark.createDataFrame(sorted(series.items()), "currency string, cbr_id string").repartition(len(series), "currency")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for currency, cbr_id in zip(*[c.to_pylist() for c in batch.columns]):
                yield pa.RecordBatch.from_arrays([pa.array([currency]), pa.array([cbr_id]), pa.array([fetch(cbr_id)])], names=["currency", "cbr_id", "text"])

    texts = names.mapInArrow(run, "currency string, cbr_id string, text string")
    records = F.from_xml("text", f"Record array<struct<{RECORD.replace(' string', ': string')}>>").getField("Record")
    some = F.when(F.coalesce(F.size(records), F.lit(0)) > 0, records).otherwise(F.raise_error(F.concat(F.lit("no records of "), "currency")).cast(f"array<struct<{RECORD.replace(' string', ': string')}>>"))
    rows = texts.select("currency", "cbr_id", F.explode(some).alias("r"))
    return _rate_rows(rows.select("currency", "cbr_id", "r.*"), F.col("currency"), F.col("cbr_id"))


def fetch_snapshot(spark: SparkSession, fetch: Callable[[str], str], series: dict[str, str], target: str, force: bool = False) -> DataFrame:
    """All series' rates, fetched once and written as a table; a present table is kept unless forced (SRC-02)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(target)
    present = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    if not present or force:
        fetch_rates(spark, fetch, series).withColumns({"source": F.lit("fetched"), "fetched_at": F.current_timestamp()}).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def load_rates(spark: SparkSession, path: str) -> DataFrame:
    """A rate CSV with the canonical schema, columns by name (SRC-03); malformed rows fail when they are read."""
    try:
        found = spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"rates not found at {path}: fetch them first") from error
        raise
    kinds = {f.name: f for f in RATES}
    schema = T.StructType([kinds.get(c, T.StructField(c, T.StringType())) for c in found])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def public_context_csv(spark: SparkSession, path: str, date: str, value: str, name: str, source: str, lag_days: int = 0) -> DataFrame:
    """A dated CSV column as public context; rows that don't parse are dropped (SRC-04)."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, (date, value))
    day = F.expr(f"try_to_date(`{date}`)")
    out = raw.select(day.alias("effective_date"), F.date_add(day, lag_days).alias("available_at"), F.lit(name).alias("name"), F.expr(f"try_cast(`{value}` as double)").alias("value"), F.lit(source).alias("source"))
    return out.na.drop(subset=["effective_date", "value"])


class PagedJson(DataSource):
    """``spark.read.format("paged_json").option("base", ..)``: JSON pages read until an empty one (SRC-05).

    ``base`` is an HTTP address, asked with ``?start=<n>``, or a folder that all executors mount, of
    files ``<n>.json``; n grows by ``page``.  A page is a list of objects with ``date`` and ``value``.
    Each of ``readers`` tasks reads every such page in turn, until it meets an empty one.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "date string, value double"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PagedStream(self.options)


class _Pages:
    def __init__(self, options):
        self.base, self.page, self.readers = options["base"].rstrip("/"), int(options.get("page", "100")), int(options.get("readers", "1"))

    def _rows(self, start: int) -> list[dict]:
        if self.base.startswith(("http://", "https://")):
            with urlopen(f"{self.base}?start={start}", timeout=60) as answer:
                return json.load(answer)
        file = Path(self.base, f"{start}.json")
        return json.loads(file.read_text(encoding="utf-8")) if file.exists() else []


class _PagedReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.readers)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start = partition.value * self.page
        while rows := self._rows(start):
            for r in rows:
                yield r["date"], float(r["value"])
            start += self.readers * self.page


class _PagedStream(_Pages, DataSourceStreamReader):
    """``spark.readStream``: an offset is how many rows have been seen, so a last page that fills up later loses and repeats none.

    The driver asks for new pages only to count their rows; tasks read them, a page each.
    """

    seen = 0

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        start = self.seen - self.seen % self.page
        while rows := self._rows(start):
            self.seen = max(self.seen, start + len(rows))
            if len(rows) < self.page:
                break
            start += self.page
        return {"rows": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["rows"], end["rows"]
        pages = range(first - first % self.page, last, self.page)
        return [InputPartition((p, max(first - p, 0), min(last - p, self.page))) for p in pages]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, first, last = partition.value
        for r in self._rows(page)[first:last]:
            yield r["date"], float(r["value"])

    def commit(self, end: dict) -> None:
        self.seen = max(self.seen, end["rows"])


def load_public_context(spark: SparkSession, path: str) -> DataFrame:
    """A public-context CSV; nothing may be available before its date (SRC-06)."""
    out = spark.read.schema(CONTEXT).option("header", True).option("enforceSchema", False).csv(path)
    require(out.filter("available_at < effective_date").isEmpty(), "context is available before its date")
    return out


def load_external(spark: SparkSession, path: str) -> DataFrame:
    """An external-series CSV that keeps its contract (SRC-07)."""
    return validate_external(spark.read.schema(EXTERNAL).option("header", True).option("enforceSchema", False).csv(path))


def from_public_context(context: DataFrame, source: str) -> DataFrame:
    """Public context in the external-series shape (SRC-08)."""
    return context.select(F.col("effective_date").alias("event_date"), "available_at", F.lit(source).alias("source"), F.col("name").alias("series_id"), "value")


def load_yaml(path: str) -> dict:
    """A configuration file (SRC-09)."""
    import yaml

    with open(path, encoding="utf-8") as lines:
        return yaml.safe_load(lines) or {}


PLACEHOLDERS = {"currency", "effect_pct"}
SPEEDS = {"fast", "slow"}


def text_library(spark: SparkSession, scenarios: list[dict], forbidden: list[str] = (), required: set[str] = frozenset()) -> DataFrame:
    """Message templates as a dimension table, checked (SRC-10, TXT-02): one a signal, none missing, known placeholders and speeds, no forbidden phrase."""
    names = [s["signal"] for s in scenarios]
    require(len(set(names)) == len(names), "a signal has two templates")
    missing = sorted(set(required) - set(names))
    require(not missing, f"signals without a template: {missing}")
    for s in scenarios:
        text = f"{s['push_title']} {s['push_body']}"
        unknown = set(re.findall(r"\{([^{}]*)\}", text)) - PLACEHOLDERS
        require(not unknown, f"unknown placeholders in {s['signal']}: {sorted(unknown)}")
        require(s["speed"] in SPEEDS, f"unknown speed {s['speed']!r}")
        found = [p for p in forbidden if p.lower() in text.lower()]
        require(not found, f"forbidden phrases in {s['signal']}: {found}")
    fields = ("signal", "scenario", "direction", "speed", "push_title", "push_body")
    return spark.createDataFrame([tuple(s[f] for f in fields) for s in scenarios], ", ".join(f"{f} string" for f in fields))
