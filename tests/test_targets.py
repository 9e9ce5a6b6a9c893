import math

import pytest

from helpers import column, panel
from tarnlight.operators import targets


def test_local_min_needs_a_whole_window(spark):
    df = panel(spark, [3, 2, 1, 2, 3]).unionByName(panel(spark, [4, 1, 4], "BBB"))
    got = column(targets.add_targets(df, 1), "target_local_min_h1")
    assert got == [None, False, True, False, None, None, True, None]


def test_stay_not_worse(spark):
    assert column(targets.add_targets(panel(spark, [2, 2, 1.5, 1.6, 1.7]), 2), "target_stay_not_worse_h2") == [False, False, True, None, None]


def test_window_closing(spark):
    assert column(targets.add_targets(panel(spark, [1, 1, 1.2, 1.1]), 2), "target_window_closing_h2") == [True, True, None, None]


def test_customer_outcomes(spark):
    df = targets.add_customer_outcomes(panel(spark, [3, 2, 1, 2, 3], "TJS").unionByName(panel(spark, [100, 50, 100], "KZT")), 1)
    mean, regret = column(df, "surrounding_mean_h1"), column(df, "customer_regret_bps_h1")
    assert mean[1] == pytest.approx(250 / 3) and mean[5] == pytest.approx(5 / 3)
    assert regret[0] == pytest.approx(10_000) and regret[2] is None and regret[4] == pytest.approx(10_000) and regret[5] == 0


def test_path_outcomes_fixed_and_discounted(spark):
    df = panel(spark, [10, 11, 9, 10])
    fixed = targets.add_path_outcomes(df, 2)
    assert column(fixed, "path_value_bps")[0] == pytest.approx(0) and column(fixed, "path_regret_bps")[0] == pytest.approx(10_000 / 9)
    assert column(fixed, "path_value_bps")[2:] == [None, None]
    discounted = targets.add_path_outcomes(df, 2, 1.0)
    assert column(discounted, "path_value_bps")[0] == pytest.approx((1000 - 1000 / math.e) / (1 + 1 / math.e))
    assert column(discounted, "path_regret_bps")[0] == pytest.approx(10_000 / 9 / math.e)


def test_one_step_paths_agree(spark):
    df = panel(spark, [10, 11, 9, 10])
    assert column(targets.add_path_outcomes(df, 1), "path_value_bps") == column(targets.add_path_outcomes(df, 1, 3.0), "path_value_bps")


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        targets.target_column("other", 3)
    with pytest.raises(ValueError):
        targets.add_path_outcomes(panel(spark, [1]), 0)


def test_negative_prices_are_an_error(spark):
    with pytest.raises(Exception, match="positive"):
        targets.add_customer_outcomes(panel(spark, [1, -1, 1]), 1).collect()
