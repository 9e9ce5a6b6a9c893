"""Walk-forward folds, split masks and purging (MDL-01, MDL-02, FLT-04 to FLT-06, VAL-03, JOIN-07)."""

from __future__ import annotations

import datetime as dt
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.functions.frames import DATE, KEY
from tarnlight.operators.validate import require


@dataclass(frozen=True)
class Fold:
    name: str
    split: str
    train_end: dt.date
    val_start: dt.date
    val_end: dt.date
    test_start: dt.date
    test_end: dt.date


def add_months(day: dt.date, months: int) -> dt.date:
    m = day.month - 1 + months
    year, month = day.year + m // 12, m % 12 + 1
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)).day
    return dt.date(year, month, min(day.day, last))


def walk_forward_folds(first: dt.date, last: dt.date, first_test_year: int = 2022, oot_start: dt.date = dt.date(2025, 9, 1), oot_train_end: dt.date = dt.date(2024, 9, 1)) -> list[Fold]:
    """Yearly folds, each validated on the year before its test, then a final fold never touched before.

    Folds with less than half a year of training are skipped.  The test year 2022 is a split
    of its own.  ``oot_train_end`` is a fixed date, whatever ``oot_start`` is.
    """
    folds, year = [], first_test_year
    while dt.date(year, 1, 1) < oot_start:
        test_start, val_start = dt.date(year, 1, 1), dt.date(year - 1, 1, 1)
        if val_start > add_months(first, 6):
            folds.append(Fold(f"wf_{year}", "y2022" if year == 2022 else "wf_oos", val_start, val_start, test_start, test_start, min(dt.date(year + 1, 1, 1), oot_start)))
        year += 1
    end = last + dt.timedelta(1)
    if end > oot_start:
        folds.append(Fold("oot", "oot", oot_train_end, oot_train_end, oot_start, oot_start, end))
    return folds


def snapshot_fold(as_of: dt.date, validation_days: int = 365, replay_days: int = 10) -> Fold:
    """The fold of a point-in-time decision: a replay window ends on the cutoff day (MDL-02)."""
    test_start = as_of - dt.timedelta(replay_days)
    val_start = test_start - dt.timedelta(validation_days)
    return Fold("snapshot", "snapshot", val_start, val_start, test_start, test_start, as_of + dt.timedelta(1))


def check_folds(folds: list[Fold]) -> None:
    """Test windows must not overlap, and each fold's parts must follow each other."""
    require(bool(folds), "there are no folds")
    for f in folds:
        require(f.train_end <= f.val_start < f.val_end <= f.test_start < f.test_end, f"fold {f.name} is out of order")
    ordered = sorted(folds, key=lambda f: f.test_start)
    for a, b in zip(ordered, ordered[1:]):
        require(a.test_end <= b.test_start, f"the tests of {a.name} and {b.name} overlap")


def fold_table(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    return spark.createDataFrame([astuple(f) for f in folds], "fold string, split string, train_end date, val_start date, val_end date, test_start date, test_end date")


def in_range(start: dt.date, end: dt.date, date: str = DATE) -> Column:
    """``start <= date < end``."""
    return (F.col(date) >= F.lit(start)) & (F.col(date) < F.lit(end))


def purge_tail(frame: DataFrame, horizon: int, key: str = KEY, date: str = DATE) -> DataFrame:
    """Without each series' last ``horizon`` rows, whose labels look beyond the frame."""
    if horizon <= 0:
        return frame
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))
    return frame.withColumn("_back", back).filter(F.col("_back") > horizon).drop("_back")


def train_rows(frame: DataFrame, fold: Fold, horizon: int) -> DataFrame:
    return purge_tail(frame.filter(F.col(DATE) < F.lit(fold.train_end)), horizon)


def validation_rows(frame: DataFrame, fold: Fold, horizon: int) -> DataFrame:
    return purge_tail(frame.filter(in_range(fold.val_start, fold.val_end)), horizon)


def test_rows(frame: DataFrame, fold: Fold) -> DataFrame:
    return frame.filter(in_range(fold.test_start, fold.test_end))


def assign_folds(frame: DataFrame, folds: list[Fold], date: str = DATE) -> DataFrame:
    """Each row with the fold that tests it; rows of none are dropped (JOIN-07).

    There are a few folds and their windows don't overlap, so this is a case distinction
    that the scan can filter by, not a join.
    """
    check_folds(folds)
    name, split, some = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for f in folds:
        inside = in_range(f.test_start, f.test_end, date)
        name, split, some = F.when(inside, f.name).otherwise(name), F.when(inside, f.split).otherwise(split), some | inside
    return frame.filter(some).withColumns({"fold": name, "split": split})


def split_sizes(frame: DataFrame, folds: list[Fold], horizon: int) -> DataFrame:
    """(fold, part, currency, n, first, last): how each fold divides the panel, and that parts don't overlap (VAL-03)."""
    out = None
    for f in folds:
        for part, rows in (("train", train_rows(frame, f, horizon)), ("validation", validation_rows(frame, f, horizon)), ("test", test_rows(frame, f))):
            one = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.min(DATE).alias("first"), F.max(DATE).alias("last")).select(F.lit(f.name).alias("fold"), F.lit(part).alias("part"), KEY, "n", "first", "last")
            out = one if out is None else out.unionByName(one)
    return out
