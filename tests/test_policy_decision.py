import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import days
from tarnlight.operators import decision, policy
from tarnlight.operators.signals import SIGNALS, effect_column


def candidates(spark, dates, wanted=None):
    return spark.createDataFrame([("AAA", d, True if wanted is None else w) for d, w in zip(dates, wanted or dates)], "currency string, effective_date date, c boolean")


def sent(df):
    return [r["policy_signal"] for r in df.orderBy("effective_date").collect()]


def test_calendar_policy(spark):
    dates = [dt.date(2026, 8, d) for d in (3, 4, 7, 8, 10)]
    assert sent(policy.calendar_policy(candidates(spark, dates), "c", 2, 2)) == [True, False, True, False, True]


def test_publication_policy(spark):
    dates = days(10, business=True)
    got = [d for d, s in zip(dates, sent(policy.publication_policy(candidates(spark, dates), "c", 1, 2))) if s]
    assert got[:2] == [dt.date(2024, 1, 1), dt.date(2024, 1, 3)] and got[2] >= dt.date(2024, 1, 8)


def test_limits_must_not_be_negative(spark):
    with pytest.raises(ValueError):
        policy.calendar_policy(candidates(spark, days(2)), "c", -1)


def decide(spark, score=0.9, threshold=0.8, fresh=True, allowed=None, **effects):
    """``effects`` by signal without prefix; a value None is an active signal without an effect."""
    columns = [F.lit(score).cast("double").alias("market_score"), F.lit(fresh).cast("boolean").alias("fresh")]
    for s in SIGNALS:
        short = s.removeprefix("signal_")
        columns += [F.lit(short in effects).alias(s), F.lit(effects.get(short)).cast("double").alias(effect_column(s))]
    return decision.add_decisions(spark.range(1).select(*columns), threshold=threshold, freshness="fresh", allowed=allowed).first()


def test_largest_clear_effect_wins(spark):
    r = decide(spark, better_than_30_day_average=0.02, better_than_one_year_ago=0.05, most_recent_changes_favourable=0.03)
    assert r["meta_selected_signal"] == "signal_better_than_one_year_ago" and r["meta_selection_score"] == pytest.approx(0.05 * 0.95)
    assert len(r["meta_signal_scores"]) == 3


def test_clarity_counts(spark):
    assert decide(spark, better_than_30_day_average=0.01, better_than_one_year_ago=0.0104)["meta_selected_signal"] == "signal_better_than_30_day_average"


def test_seasonality_goes_first(spark):
    r = decide(spark, seasonality=None, better_than_30_day_average=0.2, better_range_held=0.1)
    assert (r["meta_reason"], r["meta_selected_effect"], r["meta_selection_score"]) == ("selected_seasonality_priority", None, None)


def test_missing_effect(spark):
    r = decide(spark, better_than_30_day_average=None, better_range_held=0.1)
    assert not r["meta_should_send"] and r["meta_reason"] == "invalid_signal_effect"
    assert decide(spark, better_than_30_day_average=None)["meta_reason"] == "selected_single_signal"


@pytest.mark.parametrize("kwargs, reason", [
    ({"fresh": None}, "stale_market_data"), ({"fresh": False}, "stale_market_data"), ({"score": None}, "invalid_market_score"), ({"score": float("nan")}, "invalid_market_score"),
    ({"score": float("inf")}, "invalid_market_score"), ({"score": 0.79}, "below_market_threshold"), ({"score": 0.8}, "no_active_signal"),
])
def test_gates(spark, kwargs, reason):
    assert decide(spark, **kwargs)["meta_reason"] == reason


def test_only_allowed_signals_are_named(spark):
    assert decide(spark, allowed=("signal_level",), momentum=0.1)["meta_reason"] == "no_allowed_signal"


def test_bad_clarity():
    with pytest.raises(ValueError):
        decision.clarity_weights({"signal_level": 1.5})


def test_explanation(spark):
    df = spark.range(1).selectExpr("true AS ml_signal", "true AS signal_level", "true AS signal_momentum", "false AS signal_seasonality", "false AS signal_reversal", "0.05D AS price_percentile", "3D AS down_streak", "null AS days_to_holiday", "null AS rebound_pct")
    r = decision.add_explanations(df).first()
    assert (r["chosen_indicator"], r["speed"], r["scenario"], r["direction"]) == ("level", "slow", "now_cheap", "down")


def plain_calendar(dates, cooldown, limit):
    last, used, out = None, {}, []
    for d in sorted(dates):
        week = d - dt.timedelta(d.weekday())
        if (last is None or (d - last).days > cooldown) and used.get(week, 0) < limit:
            last, used[week] = d, used.get(week, 0) + 1
            out.append(d)
    return out


def plain_publication(places, cooldown, limit):
    """places: (place, date) of candidates."""
    out = []
    for p, d in places:
        if (not out or p - out[-1][0] > cooldown) and sum((d - s).days < 7 for _, s in out) < limit:
            out.append((p, d))
    return [d for _, d in out]


@pytest.mark.parametrize("share,cooldown,limit", [(0.05, 3, 2), (0.3, 0, 2), (0.6, 2, 1), (0.9, 9, 3), (0.5, 1, 0)])
def test_pieces_of_a_series_are_folded_like_the_whole(spark, share, cooldown, limit):
    import random

    rng = random.Random(int(100 * share))
    dates = [d for d in days(300) if rng.random() < 0.8]
    wanted = [rng.random() < share and not 90 < i < 120 for i in range(len(dates))]
    df = candidates(spark, dates, wanted)
    got = [d for d, s in zip(dates, sent(policy.calendar_policy(df, "c", cooldown, limit))) if s]
    assert got == plain_calendar([d for d, w in zip(dates, wanted) if w], cooldown, limit)
    got = [d for d, s in zip(dates, sent(policy.publication_policy(df, "c", cooldown, limit))) if s]
    assert got == plain_publication([(i, d) for i, (d, w) in enumerate(zip(dates, wanted)) if w], cooldown, limit)
