"""Event-time streams against the batch policy."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import days
from tarnlight.operators import policy
from tarnlight.streaming.event_time import event_time_policy, run_available, weekly_sends

SCHEMA = "currency string, effective_date date, candidate boolean"
LAST = ("~end", dt.date(2100, 1, 1), False)


def rows_of(n=120):
    rng = random.Random(4)
    return [(k, d, rng.choice([True, True, False, None])) for k in ("AAA", "BBB") for d in days(n) if rng.random() < 0.8]


def written(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def got(df):
    return sorted((r["currency"], r["effective_date"], r["policy_signal"]) for r in df.collect() if r["currency"] != "~end")


def test_shuffled_arrivals_give_what_the_batch_policy_gives(spark, tmp_path):
    rows = rows_of()
    rng = random.Random(5)
    arrive = sorted(rows, key=lambda r: r[1].toordinal() + rng.randrange(0, 6))  # never more than six days late
    written(spark, tmp_path / "in", [arrive[i : i + 40] for i in range(0, len(arrive), 40)] + [[LAST]])
    out = run_available(spark, lambda: event_time_policy(source(spark, tmp_path / "in"), 3, 2), "policy", str(tmp_path / "out"))
    want = policy.calendar_policy(spark.createDataFrame(rows, SCHEMA), "candidate", 3, 2)
    assert got(out) == got(want) and len(got(out)) == len(rows)


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    rows = sorted(rows_of(60), key=lambda r: r[1])
    written(spark, tmp_path / "in", [rows[:50]])
    stream = lambda: event_time_policy(source(spark, tmp_path / "in"), 3, 2)
    first = run_available(spark, stream, "policy", str(tmp_path / "out")).count()
    spark.createDataFrame([*rows[50:]], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/100")
    run_available(spark, stream, "policy", str(tmp_path / "out"))
    spark.createDataFrame([LAST], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/200")
    out = run_available(spark, stream, "policy", str(tmp_path / "out"))
    assert 0 < first < len(rows)
    assert got(out) == got(policy.calendar_policy(spark.createDataFrame(rows, SCHEMA), "candidate", 3, 2))


def test_late_repeated_and_undated_rows(spark, tmp_path):
    start = dt.date(2024, 1, 1)
    on = lambda n: start + dt.timedelta(n)
    written(spark, tmp_path / "in", [[("AAA", on(0), True), ("AAA", None, True), ("AAA", on(40), True)], [("AAA", on(1), True), ("AAA", on(45), True)], [("AAA", on(45), False), ("AAA", on(46), None)], [LAST]])
    out = run_available(spark, lambda: event_time_policy(source(spark, tmp_path / "in"), 3, 2), "policy", str(tmp_path / "out"))
    assert got(out) == [("AAA", on(0), True), ("AAA", on(40), True), ("AAA", on(45), False), ("AAA", on(46), False)]


def test_weekly_sends_by_event_time(spark, tmp_path):
    rows = sorted(rows_of(50), key=lambda r: r[1])
    written(spark, tmp_path / "in", [rows[:30], rows[30:], [LAST]])
    out = run_available(spark, lambda: weekly_sends(source(spark, tmp_path / "in"), "candidate"), "weeks", str(tmp_path / "out"))
    want = spark.createDataFrame(rows, SCHEMA).groupBy("currency", F.date_trunc("week", "effective_date").cast("date").alias("week")).agg(F.count_if(F.coalesce("candidate", F.lit(False))).alias("pushes"))
    assert sorted(map(tuple, out.filter("currency <> '~end'").collect())) == sorted(map(tuple, want.collect()))
