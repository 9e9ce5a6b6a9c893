import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import column, days, panel
from tarnlight.operators import metrics, targets


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def labelled(spark, target, signal):
    rows = [("AAA", d, t, s) for d, t, s in zip(days(len(target)), target, signal)]
    return frame(spark, rows, "currency string, effective_date date, t boolean, s boolean")


def test_lift(spark):
    r = metrics.lift_by_indicator(labelled(spark, [True, False, True, False], [True, False, True, False]), "t", ["s"], ["currency"]).first()
    assert (r["signal_hit_rate"], r["random_hit_rate"], r["lift"]) == (1.0, 0.5, 2.0)


def test_only_eligible_rows_count(spark):
    r = metrics.lift_by_indicator(labelled(spark, [True, False, True, None], [True] * 4), "t", ["s"], ["currency"]).first()
    assert r["signal_hit_rate"] == pytest.approx(2 / 3) and r["lift"] == pytest.approx(1)


def test_tail_mean(spark):
    df = frame(spark, [("A", float(i)) for i in range(1, 101)], "currency string, x double")
    assert metrics.worst_share(df, "x", ["currency"]).first()["cvar"] == 98
    with pytest.raises(Exception, match="negative"):
        metrics.worst_share(frame(spark, [("A", -1.0)], "currency string, x double"), "x", ["currency"]).collect()


def weeks(spark):
    rows = [("A", d, t, True) for d, t in ((dt.date(2025, 1, 6), True), (dt.date(2025, 1, 7), False), (dt.date(2025, 1, 20), True))]
    return frame(spark, rows, "currency string, effective_date date, t boolean, s boolean")


def test_empty_weeks_count(spark):
    assert column(metrics.weekly_counts(weeks(spark), "s", ["currency"]), "pushes", ("week",)) == [2, 0, 1]


def test_frequency_summary(spark):
    r = metrics.frequency_summary(weeks(spark), "s", ["currency"], 1, 2).first()
    assert (r["pushes_per_week"], r["pushes_p50_per_week"]) == (1, 1) and r["pushes_p90_per_week"] == pytest.approx(1.8)
    assert r["zero_push_week_rate"] == r["over_budget_week_rate"] == r["cluster_rate"] == pytest.approx(1 / 3)
    assert metrics.useful_signals(weeks(spark), "t", "s", ["currency"]).first()["useful_signals_per_week"] == pytest.approx(2 / 3)


def test_stability(spark):
    df = frame(spark, [(1.5, 10.0), (1.2, 30.0), (1.3, 20.0)], "lift double, regret double")
    got = {r["metric"]: r for r in metrics.stability(df, ["lift", "regret"], ("regret",)).collect()}
    assert (got["lift"]["worst"], got["lift"]["median"]) == (1.2, 1.3) and (got["regret"]["worst"], got["regret"]["best"]) == (30, 10)


def test_draws_match_each_week_and_repeat(spark):
    df = panel(spark, range(1, 41)).selectExpr("*", "rub_per_unit % 3 = 0 AS s")
    picked = metrics.matched_draws(df, "s", ["currency"], 4)
    per = picked.withColumn("w", metrics.week()).groupBy("draw", "w").count().collect()
    sent = {r["w"]: r["count"] for r in df.filter("s").withColumn("w", metrics.week()).groupBy("w").count().collect()}
    assert len(per) == 4 * len(sent) and all(r["count"] == sent[r["w"]] for r in per)
    assert sorted(picked.collect()) == sorted(metrics.matched_draws(df, "s", ["currency"], 4).collect())


def test_sending_everything_is_neutral(spark):
    df = targets.add_path_outcomes(targets.add_targets(panel(spark, [10, 11, 9, 10, 12, 8, 9, 10, 11, 10]), 2), 2).selectExpr("*", "true AS s")
    r = metrics.path_lift_at_risk(df, "target_stay_not_worse_h2", "s", ["currency"], 3).first()
    assert r["lift"] == pytest.approx(1) and r["lift_at_risk"] == pytest.approx(1) and r["excluded_signal_count"] == 2


def test_scale_of_the_composite_score(spark):
    from pyspark.sql import functions as F

    from tarnlight.functions.scalar import lift_at_risk

    assert spark.range(1).select(lift_at_risk(F.lit(1.0), F.lit(100.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("x")).first()["x"] == pytest.approx(1.3)


def masked(spark, drawn):
    """Ten days of one corridor, of which the first two were sent and the last can't be judged, and masks by draw."""

    rows = [("AAA", d, None if i == 9 else i % 2 == 0, float(i), 1.0, i < 2) for i, d in enumerate(days(10))]
    own = spark.createDataFrame(rows, "currency string, effective_date date, t boolean, path_value_bps double, path_regret_bps double, s boolean")
    masks = [(k, "AAA", d, i in picked) for k, picked in enumerate(drawn) for i, d in enumerate(days(10))]
    return own, spark.createDataFrame(masks, "draw int, currency string, effective_date date, drawn boolean")


def test_given_draws_are_judged(spark):
    own, masks = masked(spark, [{4, 5}, {2, 3}])
    row = metrics.path_lift_at_risk(own, "t", "s", ["currency"], masks=masks).first()
    assert (row["signal_count"], row["signal_value_bps"], row["random_value_bps"], row["random_hit_rate"]) == (2, 0.5, 3.5, 0.5)


@pytest.mark.parametrize("what,drawn,change", [
    ("other_count", [{4}], None), ("ineligible", [{4, 9}], None), ("other_length", [{4, 5}], "effective_date <> date'2024-01-03'"), ("outside", [{4, 5}], "later"),
])
def test_given_draws_that_don_t_fit_are_refused(spark, what, drawn, change):
    own, masks = masked(spark, drawn)
    if change == "later":
        masks = masks.withColumn("effective_date", F.date_add("effective_date", 100))
    elif change:
        masks = masks.filter(change)
    with pytest.raises(ValueError, match=what):
        metrics.given_draws(own, masks, F.col("t").isNotNull(), "s", ["currency"])


def test_given_draws_must_exist(spark):
    own, masks = masked(spark, [])
    with pytest.raises(ValueError, match="at least one draw"):
        metrics.given_draws(own, masks, F.col("t").isNotNull(), "s", ["currency"])
