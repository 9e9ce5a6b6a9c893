"""Series cut into chunks and as-of joins cut into spans give what whole ones give."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import START, days, panel
from tarnlight.functions.chunks import Pieces, placed
from tarnlight.operators import asof, features, rules, search, signals, targets
from tarnlight.plans import queries

ID = ["currency", "effective_date"]


def walk(seed, n, step=0.02):
    rng, p, out = random.Random(seed), 100.0, []
    for _ in range(n):
        p *= 1 + rng.gauss(0, step)
        out.append(round(p, 2))
    return out


@pytest.fixture(scope="module")
def long(spark):
    """One series of 460 rows and three short ones, with falls and rises longer than a chunk."""
    prices = walk(1, 330) + [200 - i for i in range(70)] + walk(2, 60)
    df = panel(spark, prices, "AAA", business=True)
    for k, n in (("BBB", 1), ("CCC", 23), ("DDD", 40)):
        df = df.unionByName(panel(spark, walk(n, n), k))
    return df.repartition(3).cache()


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def same(whole, cut):
    assert whole.columns == cut.columns
    w, c = (sorted(map(tuple, df.select(*ID, *[x for x in df.columns if x not in ID]).collect()), key=lambda r: r[:2]) for df in (whole, cut))
    assert len(w) == len(c)
    for a, b in zip(w, c):
        assert all(map(close, a, b)), (a, b)


OPERATORS = {
    "labels": lambda df, rows: targets.add_targets(df, 5, rows=rows),
    "outcomes": lambda df, rows: targets.add_customer_outcomes(df, 3, rows=rows),
    "paths": lambda df, rows: targets.add_path_outcomes(df, 5, 2.0, rows=rows),
    "features": lambda df, rows: features.add_series_features(df, rows=rows),
    "baseline": lambda df, rows: signals.add_baseline(df, rows=rows),
    "research": lambda df, rows: signals.add_research(df, rows=rows),
    "means": lambda df, rows: rules.with_ema(df, (1, 2, 10, 60), rows=rows),
    "rules": lambda df, rows: rules.add_rules(df, rows=rows)[0],
}


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_give_what_whole_series_give(long, name):
    same(OPERATORS[name](long, None), OPERATORS[name](long, 23))


@pytest.mark.parametrize("rows", [1, 460, 10_000])
def test_chunks_of_any_size(long, rows):
    same(OPERATORS["labels"](long, None), OPERATORS["labels"](long, rows))


def test_context_features_in_chunks(spark, long):
    rng = random.Random(7)
    found = [(c, d, 50 + rng.random()) for c in ("USD", "EUR", "CNY") for i, d in enumerate(days(700)) if rng.random() < 0.3 and not 100 < i < 260]
    context = spark.createDataFrame(found, "currency string, effective_date date, rub_per_unit double")
    own = features.add_series_features(long)
    same(features.add_context(own, context), features.add_context(own, context, rows=31))


def test_a_chunk_holds_its_rows_and_its_halo_only(spark, long):
    pieces = Pieces(long, 23, back=40, ahead=5)
    counts = pieces.table.groupBy("currency", "_chunk").count().collect()
    assert max(r["count"] for r in counts) == 23 + 45 and sum(r["currency"] == "AAA" for r in counts) >= 20
    assert pieces.run(lambda x: x).count() == long.count()


@pytest.mark.parametrize("span", [1, 30, 5000])
def test_places_count_rows_whatever_the_span(spark, long, span):
    got = placed(long, span).orderBy(*ID).collect()
    for k in ("AAA", "BBB", "CCC", "DDD"):
        own = [r["_place"] for r in got if r["currency"] == k]
        assert own == list(range(len(own)))


def test_means_match_the_recursion(spark, long):
    got = rules.with_ema(long.filter("currency = 'AAA'"), (2, 10, 60)).orderBy("effective_date").collect()
    for n in (2, 10, 60):
        y, a = None, 2 / (n + 1)
        for i, r in enumerate(got):
            p = r["rub_per_unit"]
            y = p if y is None else a * p + (1 - a) * y
            assert (r[f"ema_{n}"] is None) == (i < n - 1) and (i < n - 1 or math.isclose(r[f"ema_{n}"], y, rel_tol=1e-12))


@pytest.mark.parametrize("rows", [None, 4])
def test_means_with_gaps_match_pandas(spark, rows):
    import pandas as pd

    prices = [None, None, 3.0, 4.0, None, None, None, None, None, 5.0, 2.0, None, 7.0, 7.5, None]
    got = rules.with_ema(panel(spark, prices), (1, 3, 5), rows).orderBy("effective_date").toPandas()
    for n in (1, 3, 5):
        want = pd.Series(prices, dtype=float).ewm(span=n, min_periods=n, adjust=False).mean()
        assert all(math.isclose(a, b) or (math.isnan(a) and math.isnan(b)) for a, b in zip(got[f"ema_{n}"].astype(float), want))


def test_the_catalog_needs_no_python(spark, long):
    plan = rules.add_rules(long)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "percentile(" not in plan


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("days_", [1, 7, 1000])
def test_spans_give_what_whole_keys_give(spark, direction, days_):
    rng = random.Random(days_)
    date = lambda: None if rng.random() < 0.03 else START + dt.timedelta(rng.randrange(0, 400))
    probes = spark.createDataFrame([(i, rng.choice(["hot", "hot", "hot", "a", None]), date()) for i in range(400)], "id int, k string, at date")
    facts = spark.createDataFrame([(rng.choice(["hot", "hot", "b", None]), date(), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(60)], "k string, since date, v double")
    whole, cut = (asof.asof(probes, facts, ["k"], "at", "since", ["v"], direction, days=d) for d in (None, days_))
    rows = [sorted(map(tuple, df.collect())) for df in (whole.fillna({"v": -1.0, "k": ""}).na.fill("x", ["k"]).select("id", "v"), cut.fillna({"v": -1.0}).select("id", "v"))]
    assert rows[0] == rows[1] and len(rows[0]) == 400
    found = {r["id"]: r["v"] for r in cut.collect()}
    known = [tuple(r) for r in facts.collect() if r["since"]]
    for r in probes.collect():
        fits = [(s, v) for k, s, v in known if k == r["k"] and r["at"] and (s <= r["at"] if direction == "backward" else s >= r["at"])]
        if not fits:
            assert found[r["id"]] is None
        else:
            at = max(s for s, _ in fits) if direction == "backward" else min(s for s, _ in fits)
            assert found[r["id"]] == max((v for s, v in fits if s == at), key=lambda v: -1 if v is None else v)


def test_ranks_don_t_depend_on_the_layout(spark):
    names = ["level__b", "level__a", "level__c", "momentum__x"]
    value = 251696.16116133946
    made = [(n, n.split("__")[0], 100, 5, 1.5, value * (1 + k * 1e-15), 1.0, True) for k, n in enumerate(names)]
    table = spark.createDataFrame(made, "rule_id string, family string, signal_count int, corridors_with_signals int, median_lift double, mean_bps double, mean_signals_per_week double, passed boolean")
    for parts in (1, 3, 5):
        got = search.shortlist(table.repartition(parts), names).orderBy("place").collect()
        assert [r["rule_id"] for r in got] == names


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_the_shortlist_is_the_same_in_every_layout(spark, sf_dir, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        found = set()
        for parts in (1, 5, 17):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            found.add(tuple(sorted((r["place"], r["rule_id"]) for r in queries.rule_shortlist(spark, sf_dir).collect())))
        assert len(found) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_all_features_in_chunks_and_spans(spark, long):
    rng = random.Random(9)
    found = [(c, d, 50 + rng.random()) for c in ("USD", "EUR", "CNY") for d in days(700) if rng.random() < 0.6]
    context = spark.createDataFrame(found, "currency string, effective_date date, rub_per_unit double")
    holidays = spark.createDataFrame([("XX", START + dt.timedelta(n)) for n in (3, 100, 400)], "country string, holiday date")
    facts = [(d, d + dt.timedelta(2), "s", "oil", 10 + rng.random()) for d in days(500) if rng.random() < 0.5]
    external = spark.createDataFrame(facts, "event_date date, available_at date, source string, series_id string, value double")
    whole, cut = (features.add_features(long, context, external, holidays, F.lit("XX"), rows=r, days=d) for r, d in ((None, None), (150, 60)))
    same(whole, cut)
