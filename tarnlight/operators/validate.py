"""Checks of inputs: columns and parameters on the driver, data by one aggregate query."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.functions.scalar import series_name


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")


def require(condition: bool, what: str) -> None:
    if not condition:
        raise ValueError(what)


def external_violations(df: DataFrame) -> DataFrame:
    """One row of counts for the external-series contract (VAL-01): each must be zero."""
    require_columns(df, ("event_date", "available_at", "source", "series_id", "value"))
    counts = df.agg(
        F.count_if(F.col("event_date").isNull() | F.col("available_at").isNull()).alias("missing_dates"),
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("missing_values"),
        F.count_if(F.col("available_at") < F.col("event_date")).alias("available_early"),
    )
    repeated = df.groupBy("source", "series_id", "event_date", "available_at").count().filter("count > 1").agg(F.count("*").alias("repeated_keys"))
    names = df.select("series_id").distinct().groupBy(series_name(F.col("series_id"))).count().filter("count > 1").agg(F.count("*").alias("colliding_names"))
    return counts.join(repeated).join(names)  # three single rows


def validate_external(df: DataFrame) -> DataFrame:
    """The frame itself; an error if it breaks the contract."""
    bad = {k: v for k, v in external_violations(df).first().asDict().items() if v}
    require(not bad, f"external series break their contract: {bad}")
    return df


def frame_violations(df: DataFrame, key: str = "currency", date: str = "effective_date") -> DataFrame:
    """Missing keys and repeated (key, date) pairs of a panel (VAL-02)."""
    require_columns(df, (key, date))
    rows = df.groupBy(key, date).count()
    return rows.agg(F.count_if(F.col(key).isNull()).alias("missing_keys"), F.count_if(F.col(date).isNull()).alias("missing_dates"), F.count_if(F.col("count") > 1).alias("repeated_keys"))


def validate_panel(df: DataFrame, columns: Iterable[str] = (), key: str = "currency", date: str = "effective_date") -> DataFrame:
    require_columns(df, columns)
    bad = {k: v for k, v in frame_violations(df, key, date).first().asDict().items() if v}
    require(not bad, f"the panel breaks its contract: {bad}")
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on ``keys``; an error, when it runs, if a key that is met has two rows on the right (JOIN-06)."""
    require_columns(left, keys)
    require_columns(right, keys)
    rest = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest) if rest else F.lit(0)).alias("_row"))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("a key of the right side has several rows")))
    joined = left.join(one, keys).withColumn("_row", checked)
    return joined.select(*left.columns, *[F.col("_row").getField(c).alias(c) for c in rest])
