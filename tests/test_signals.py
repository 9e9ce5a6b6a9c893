import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import column, days, panel
from tarnlight.operators import features, signals
from tarnlight.operators.signals import Thresholds, effect_column


def from_units(spark, units, dates=None):
    return panel(spark, [1 / u for u in units], dates=dates)


def test_baseline_rules_and_effects(spark):
    df = signals.add_baseline(panel(spark, [5.0] * 7 + [4, 3, 2, 1, 1.5]), level_window=4, reversal_window=4)
    assert [i for i, x in enumerate(column(df, "signal_momentum")) if x] == [9, 10]
    assert column(df, "signal_level")[10] and column(df, "signal_level")[0] is None
    assert [i for i, x in enumerate(column(df, "signal_reversal")) if x] == [11]
    assert column(df, effect_column("signal_momentum"))[10] == pytest.approx(3.0)
    assert column(df, effect_column("signal_level"))[10] == pytest.approx(0.3)
    assert column(df, effect_column("signal_reversal"))[11] == pytest.approx(-1 / 3)
    assert set(column(df, effect_column("signal_seasonality"))) == {None}


def test_seasonality_looks_ahead(spark):
    holidays = spark.createDataFrame([("XX", dt.date(2024, 1, 10))], "country string, holiday date")
    df = signals.add_baseline(panel(spark, [1.0] * 12), holidays, F.lit("XX"))
    assert column(df, "signal_seasonality") == [False, False] + [True] * 8 + [False, False]


@pytest.mark.parametrize("last, gain, loss", [(1.1, True, False), (0.9, False, True)])
def test_annual_comparison(spark, last, gain, loss):
    dates = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2025, 1, 1), dt.date(2025, 1, 2)]
    df = signals.add_research(from_units(spark, [1, 1, 1, last], dates), Thresholds(year_gain=0.05, year_loss=0.05))
    assert column(df, "signal_better_than_one_year_ago")[3] is gain and column(df, "signal_less_than_one_year_ago")[3] is loss
    assert column(df, effect_column("signal_better_than_one_year_ago"))[3] == pytest.approx(last - 1)


def test_range_held(spark):
    df = signals.add_research(from_units(spark, [1.0] * 7 + [1.1] * 3))
    assert column(df, "signal_better_range_held")[9] and column(df, effect_column("signal_better_range_held"))[9] == pytest.approx(0.1)


def test_unusual_move(spark):
    units = [1.001**i for i in range(11)]
    df = signals.add_research(from_units(spark, units + [units[-1] * 1.05]))
    assert column(df, "signal_larger_than_usual_latest_improvement")[-1]


def test_thirty_day_average(spark):
    df = signals.add_research(from_units(spark, [1.0] * 30 + [1.2]))
    assert column(df, "signal_better_than_30_day_average")[-1]


def test_recent_changes(spark):
    up, down = [1, 1.02, 1.04, 1.03, 1.05, 1.07], [1, 0.98, 0.96, 0.97, 0.95, 0.93]
    assert column(signals.add_research(from_units(spark, up)), "signal_most_recent_changes_favourable")[-1]
    df = signals.add_research(from_units(spark, down))
    assert column(df, "signal_most_recent_changes_unfavourable")[-1]
    assert column(df, effect_column("signal_most_recent_changes_unfavourable"))[-1] == pytest.approx(-0.07)


def test_signals_do_not_see_the_future(spark):
    units = [1 + 0.002 * (i % 17) for i in range(430)]
    whole = signals.add_research(from_units(spark, units + [5.0] * 20)).filter(F.col("effective_date") < days(431)[-1])
    part = signals.add_research(from_units(spark, units))
    for s in signals.RESEARCH:
        assert column(whole, s) == column(part, s)


def test_features_do_not_see_the_future(spark):
    prices = [20 - 0.1 * i for i in range(40)]
    whole = features.add_series_features(panel(spark, prices), 10, 5).filter(F.col("effective_date") < days(31)[-1])
    part = features.add_series_features(panel(spark, prices[:30]), 10, 5)
    for c in ("down_streak", "price_percentile", "days_since_min", "rebound_pct", "ret_5", "vol_20"):
        assert column(whole, c) == column(part, c)


def test_feature_values(spark):
    df = features.add_series_features(panel(spark, [3, 2, 1, 2, 1.5]), 3, 3)
    assert column(df, "down_streak") == [0, 1, 2, 0, 1]
    assert column(df, "days_since_min") == [None, None, 0, 1, 2]
    assert column(df, "price_percentile")[2:] == pytest.approx([1 / 3, 1.0, 2 / 3])


def test_bad_thresholds():
    with pytest.raises(ValueError):
        Thresholds(year_gain=-1)
    with pytest.raises(ValueError):
        Thresholds(unusual_multiplier=0)


def test_empty_panel_keeps_its_columns(spark):
    out = signals.add_research(panel(spark, []))
    assert set(signals.RESEARCH) <= set(out.columns) and out.count() == 0
