import datetime as dt
import json
import math

import pytest

from helpers import days, panel
from tarnlight.operators import models, rules
from tarnlight.plans import jobs


def validation(spark, scores, prices, forward, target=None):
    rows = [("AAA", d, float(p), float(f), s, True if target is None else t, True) for d, p, f, s, t in zip(days(len(scores)), prices, forward, scores, target or scores)]
    return spark.createDataFrame(rows, "currency string, effective_date date, rub_per_unit double, forward_mean_h5 double, score double, t boolean, has_fact boolean")


def test_more_signals_win_until_one_a_week(spark):
    scores = [0.95 if i % 35 == 0 else 0.55 if i % 7 == 0 else 0.1 for i in range(70)]
    df = validation(spark, scores, [10.0] * 70, [11.0] * 70)
    assert models.select_threshold(df, "t", 5, [0.9, 0.5], []) == 0.5


def test_the_cap_on_frequency(spark):
    scores = [0.95 if i % 7 == 0 else 0.55 for i in range(70)]
    df = validation(spark, scores, [10.0] * 70, [11.0] * 70)
    assert models.select_threshold(df, "t", 5, [0.9, 0.5], []) == 0.9


def test_no_value_falls_back(spark):
    df = validation(spark, [0.9] * 20, [10.0] * 20, [9.0] * 20)
    assert models.select_threshold(df, "t", 5, [0.5], []) == models.FALLBACK_THRESHOLD


@pytest.mark.parametrize("kind", ["logreg", "gbt"])
def test_scorers_learn_and_fill_gaps(spark, kind):
    rows = [(("AAA", "BBB")[i % 2], d, float(i % 10) if i % 17 else None, i % 10 > 5) for i, d in enumerate(days(200))]
    df = spark.createDataFrame(rows, "currency string, effective_date date, x double, t boolean")
    scorer = models.fit_scorer(df, ["x"], "t", kind, df, iterations=8)
    got = models.score(df, scorer).selectExpr("avg(CASE WHEN t THEN score END) AS a", "avg(CASE WHEN NOT t THEN score END) AS b", "min(score) AS lo", "max(score) AS hi").first()
    assert got["a"] > got["b"] + 0.3 and 0 <= got["lo"] <= got["hi"] <= 1
    with pytest.raises(ValueError):
        models.fit_scorer(df.filter("t"), ["x"], "t", kind)


def test_the_catalog_has_every_rule_and_is_causal(spark):
    prices = [10 - 0.001 * i + 0.01 * math.sin(i) for i in range(300)]
    whole, catalog = rules.add_rules(panel(spark, prices + [1.0] * 10))
    part, _ = rules.add_rules(panel(spark, prices))
    assert len(catalog) == 116 and len({r.rule_id for r in catalog}) == 116
    names = [r.rule_id for r in catalog]
    last = part.orderBy("effective_date").select("effective_date", *names).tail(40)
    again = {r["effective_date"]: r for r in whole.select("effective_date", *names).collect()}
    assert all(again[r["effective_date"]] == r for r in last)


@pytest.fixture(scope="module")
def config(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("job")
    rows = [(c, d, d, 8.0 + k + math.sin(i / 9 + k), True) for k, c in enumerate(("AAA", "BBB")) for i, d in enumerate(days(900, dt.date(2021, 1, 1), True))]
    spark.createDataFrame(rows, "currency string, effective_date date, available_at date, rub_per_unit double, is_fresh boolean").write.parquet(str(folder / "rates"))
    return {"rates": str(folder / "rates"), "output": str(folder / "out"), "horizon": 5, "first_test_year": 2023, "oot_start": "2024-01-01", "oot_train_end": "2023-01-01", "draws": 3, "iterations": 5}


def test_jobs_write_reports(spark, config, tmp_path):
    own = {**config, "output": str(tmp_path / "a"), "horizons": [5]}
    assert "lift" in jobs.run_baseline(spark, own)
    own = {**config, "output": str(tmp_path / "b"), "methods": [{"method": "random"}, {"method": "signal_momentum"}, {"name": "m", "method": "logreg", "feature_groups": ["B", "C"]}]}
    assert "signal_momentum" in jobs.run_summary(spark, own)
    own = {**config, "output": str(tmp_path / "c"), "experiments": [{"name": "base", "method": "signal_momentum"}, {"name": "low", "method": "signal_level"}]}
    assert "adopt" in jobs.run_research(spark, own)


def test_signals_do_not_see_beyond_the_cutoff(spark, config, tmp_path):
    text = {"scenario": "s", "direction": "d", "speed": "fast", "push_title": "{currency}", "push_body": "{effect_pct}"}
    own = {**config, "as_of": "2024-05-15", "feature_groups": ["B", "C"], "thresholds": [0.1], "scenarios": [{**text, "signal": s} for s in jobs.SIGNALS]}
    jobs.run_signals(spark, {**own, "output": str(tmp_path / "x")})
    later = spark.read.parquet(config["rates"]).selectExpr("currency", "effective_date", "available_at", "CASE WHEN effective_date > '2024-05-15' THEN rub_per_unit * 100 ELSE rub_per_unit END AS rub_per_unit", "is_fresh")
    later.write.parquet(str(tmp_path / "later"))
    jobs.run_signals(spark, {**own, "rates": str(tmp_path / "later"), "output": str(tmp_path / "y")})
    a, b = ((tmp_path / f / "REPORT.md").read_text() for f in "xy")
    assert a == b and "push_title" in a
    assert json.dumps(a)
