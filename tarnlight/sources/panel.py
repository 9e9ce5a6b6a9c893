"""Canonical schemas, and the adapter that reads the star-schema tables as panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATES = T.StructType([
    T.StructField("effective_date", T.DateType()), T.StructField("available_at", T.DateType()), T.StructField("currency", T.StringType()),
    T.StructField("cbr_id", T.StringType()), T.StructField("nominal", T.IntegerType()), T.StructField("value_rub", T.DoubleType()),
    T.StructField("rub_per_unit", T.DoubleType()), T.StructField("recipient_per_rub", T.DoubleType()), T.StructField("is_fresh", T.BooleanType()),
    T.StructField("source", T.StringType()), T.StructField("fetched_at", T.TimestampType()),
])
EXTERNAL = T.StructType([T.StructField("event_date", T.DateType()), T.StructField("available_at", T.DateType()), T.StructField("source", T.StringType()), T.StructField("series_id", T.StringType()), T.StructField("value", T.DoubleType())])
CONTEXT = T.StructType([T.StructField("effective_date", T.DateType()), T.StructField("available_at", T.DateType()), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("source", T.StringType())])

#: Regions stand for corridors, return flags for context currencies; fixed mapping.
CONTEXT_BY_FLAG = {"A": "USD", "N": "EUR", "R": "CNY"}
COUNTRY_BY_CORRIDOR = {"AFRICA": "ZA", "AMERICA": "US", "ASIA": "JP", "EUROPE": "FR", "MIDDLE EAST": "AE"}
#: Fixed month and day of each country's holidays.
HOLIDAYS = {"ZA": ((1, 1), (4, 27), (9, 24), (12, 16), (12, 25)), "US": ((1, 1), (7, 4), (11, 11), (12, 25)), "JP": ((1, 1), (2, 11), (5, 3), (11, 3)), "FR": ((1, 1), (5, 1), (7, 14), (11, 1), (12, 25)), "AE": ((1, 1), (12, 2), (12, 3))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate panel: one price a region and order date, the mean order in whole cents.

    The daily sums are taken by customer first, so the fact table shuffles on its own key
    once and only (region, day) sums cross the network after the small joins.
    """
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    home = customer.select("c_custkey", "c_nationkey").join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_regionkey", "r_name")
    daily = orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("effective_date"), _cents("o_totalprice").alias("c"))
    panel = daily.join(home, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("r_name").alias("currency"), "r_regionkey", "effective_date").agg(F.expr("sum(c) div count(*)").alias("cents"))
    nominal = F.pow(F.lit(10), F.col("r_regionkey") % 3).cast("int")
    price = F.col("cents") / F.lit(100.0)
    return panel.select(
        "effective_date", F.col("effective_date").alias("available_at"), "currency", F.concat(F.lit("R"), F.lpad(F.col("r_regionkey").cast("string"), 5, "0")).alias("cbr_id"),
        nominal.alias("nominal"), (F.col("cents") * nominal / F.lit(100.0)).alias("value_rub"), price.alias("rub_per_unit"), F.try_divide(F.lit(1.0), price).alias("recipient_per_rub"),
        F.lit(True).alias("is_fresh"), F.lit("orders").alias("source"), "cents",
    )


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context panel: (effective_date, currency, cents, rub_per_unit) from line items by return flag."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag"), F.col("l_shipdate").cast("date").alias("effective_date"), _cents("l_extendedprice").alias("c"), F.col("l_quantity").cast("long").alias("q"))
    names = F.create_map(*[F.lit(x) for kv in CONTEXT_BY_FLAG.items() for x in kv])
    out = lines.groupBy("l_returnflag", "effective_date").agg(F.expr("sum(c) div sum(q)").alias("cents"))
    return out.select("effective_date", F.col("effective_date").alias("available_at"), names[F.col("l_returnflag")].alias("currency"), "cents", (F.col("cents") / F.lit(100.0)).alias("rub_per_unit"))


def external(spark: SparkSession, sf_dir: str, delay_days: int = 2) -> DataFrame:
    """External series by order priority, each value available some days after its date."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("event_date"), _cents("o_totalprice").alias("c"))
    out = orders.groupBy("series_id", "event_date").agg(F.expr("sum(c) div count(*)").alias("cents"))
    return out.select("event_date", F.date_add("event_date", delay_days).alias("available_at"), F.lit("orders").alias("source"), "series_id", (F.col("cents") / F.lit(100.0)).alias("value"))


def public_context(external_series: DataFrame) -> DataFrame:
    """External series in the public-context shape, named for columns."""
    from tarnlight.functions.scalar import series_name

    return external_series.select(F.col("event_date").alias("effective_date"), "available_at", F.concat(F.lit("ctx_"), series_name(F.col("series_id"))).alias("name"), "value", "source")


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(country, holiday) by the fixed rules; a few rows a year."""
    import datetime as dt

    rows = [(c, dt.date(y, m, d)) for c, days in HOLIDAYS.items() for y in range(first_year, last_year + 1) for m, d in days]
    return spark.createDataFrame(rows, "country string, holiday date")


def country_of(currency: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in COUNTRY_BY_CORRIDOR.items() for x in kv])[currency]
