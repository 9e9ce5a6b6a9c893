"""Registered queries over the adapted tables; each takes (spark, sf_dir)."""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Callable
from functools import reduce
from operator import add
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.functions.frames import DATE, KEY, PRICE, full, last_rows, rank_share
from tarnlight.functions.scalar import LAR_SCALE_BPS, corridor, cross_rate, method_label, series_name
from tarnlight.operators import asof, backtest, decision, features, metrics, models, policy, research, rules, search, signals, splits, targets, validate
from tarnlight.operators.signals import SIGNALS, effect_column
from tarnlight.session import scratch_folder, written
from tarnlight.sources import panel, sinks
from tarnlight.sources.readers import PagedJson, fetch_snapshot, from_public_context, load_external, load_public_context, load_rates, parse_rate_xml, public_context_csv, text_library
from tarnlight.streaming.event_time import event_time_policy, run_available, weekly_sends

Query = Callable[[SparkSession, str], DataFrame]
ID = [KEY, DATE]
#: Explicit folds over the span of the orders table.
FOLDS = [splits.Fold(f"wf_{y}", "wf_oos", dt.date(y - 1, 1, 1), dt.date(y - 1, 1, 1), dt.date(y, 1, 1), dt.date(y, 1, 1), min(dt.date(y + 1, 1, 1), dt.date(2000, 9, 1))) for y in (1997, 1998, 1999, 2000)]
FOLDS.append(splits.Fold("oot", "oot", dt.date(1999, 9, 1), dt.date(1999, 9, 1), dt.date(2000, 9, 1), dt.date(2000, 9, 1), dt.date(2001, 9, 1)))
FIRST_YEAR, LAST_YEAR = 1994, 2003


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that two engines' sums compare."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.rates(spark, sf_dir)


def with_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.add_baseline(rates(spark, sf_dir), panel.holidays(spark, FIRST_YEAR, LAST_YEAR), panel.country_of(F.col(KEY)))


def with_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.add_research(with_baseline(spark, sf_dir))


# --- sources ---------------------------------------------------------------------


def rates_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir).select("currency", "effective_date", "cents", "nominal", "value_rub", "rub_per_unit", F.round("recipient_per_rub", 10).alias("recipient_per_rub"))


def context_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.context(spark, sf_dir).select("currency", "effective_date", "cents", "rub_per_unit")


def external_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.external(spark, sf_dir).select("series_id", "event_date", "available_at", "value")


def external_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.external_violations(panel.external(spark, sf_dir))


def panel_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.frame_violations(rates(spark, sf_dir))


def data_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rates(spark, sf_dir).select(F.lit("target").alias("kind"), F.col(KEY).alias("series_id"), F.col(DATE).alias("d"), "available_at")
    ctx = panel.context(spark, sf_dir).select(F.lit("context").alias("kind"), F.col(KEY).alias("series_id"), F.col(DATE).alias("d"), "available_at")
    ext = panel.external(spark, sf_dir).select(F.lit("external").alias("kind"), "series_id", F.col("event_date").alias("d"), "available_at")
    return rounded(research.data_audit(own.unionByName(ctx).unionByName(ext), ["kind", "series_id"], "d"))


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.quality_profile(targets.add_targets(rates(spark, sf_dir), 3), "target_local_min_h3"))


# --- labels ----------------------------------------------------------------------


def _columns(make: Callable[[SparkSession, str], DataFrame], *columns: str, digits: int = 8) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(make(spark, sf_dir).select(*ID, *columns), digits)

    return run


def _targets(h: int) -> Query:
    return lambda spark, sf_dir: targets.add_targets(rates(spark, sf_dir), h)


def customer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = targets.add_customer_outcomes(rates(spark, sf_dir), 3)
    return rounded(out.select(*ID, "surrounding_mean_h3", "future_best_h3", "moment_advantage_bps_h3", "customer_regret_bps_h3"), 6)


def path_outcomes(mean_gap_days: float | None) -> Query:
    return lambda spark, sf_dir: rounded(targets.add_path_outcomes(rates(spark, sf_dir), 5, mean_gap_days).select(*ID, "path_value_bps", "path_regret_bps"), 6)


def future_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rates(spark, sf_dir).withColumn("path", targets.future_prices(3))
    return out.select(*ID, *[F.get("path", i).alias(f"lead_{i + 1}") for i in range(3)])


# --- signals and features ----------------------------------------------------------


def signal_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        make = with_baseline if name in signals.BASELINE else with_signals
        return rounded(make(spark, sf_dir).select(*ID, F.col(name).alias("signal"), F.col(effect_column(name)).alias("effect")))

    return run


def has_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.add_has_fact(with_signals(spark, sf_dir)).select(*ID, "has_fact")


def _series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_series_features(rates(spark, sf_dir))


def days_to_holiday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.next_holiday(rates(spark, sf_dir), panel.holidays(spark, FIRST_YEAR, LAST_YEAR), panel.country_of(F.col(KEY))).select(*ID, "days_to_holiday")


def annual_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(asof.annual_reference(rates(spark, sf_dir), F.col("rub_per_unit")).select(*ID, "annual_reference"))


def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.context_features(rates(spark, sf_dir), panel.context(spark, sf_dir)))


def synthetic_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.add_context(features.add_series_features(rates(spark, sf_dir)), panel.context(spark, sf_dir))
    return rounded(out.select(*ID, "residual_usd_1", *[f"local_per_{c}_{s}" for c in ("usd", "cny") for s in ("ret_1", "ret_5", "vol_20")]))


def external_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.external_features(rates(spark, sf_dir), panel.external(spark, sf_dir)))


def causal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.causal_context(rates(spark, sf_dir).select(*ID), panel.public_context(panel.external(spark, sf_dir)))


def cross_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = panel.context(spark, sf_dir)
    usd, eur = (ctx.filter(F.col(KEY) == c).select(DATE, F.col(PRICE).alias(c.lower())) for c in ("USD", "EUR"))
    return rounded(usd.join(eur, DATE).select(DATE, cross_rate(F.col("usd"), F.col("eur")).alias("usd_per_eur")))


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = panel.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    return orders.select("o_orderpriority", "o_orderstatus", series_name(F.col("o_orderpriority")).alias("series"), corridor(F.col("o_orderstatus")).alias("corridor"), method_label(series_name(F.col("o_orderpriority")), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))).alias("label"))


# --- metrics -----------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str, h: int = 5) -> DataFrame:
    return targets.add_customer_outcomes(targets.add_targets(with_baseline(spark, sf_dir), h), h)


def momentum_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: hit rate, prevalence and lift of the momentum rule in each corridor."""
    own = targets.add_targets(signals.add_baseline(rates(spark, sf_dir)), 5)
    return rounded(metrics.lift_by_indicator(own, "target_stay_not_worse_h5", ["signal_momentum"], [KEY]))


def lift_by_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = targets.add_targets(with_baseline(spark, sf_dir), 3)
    return rounded(metrics.lift_by_indicator(own, "target_local_min_h3", list(signals.BASELINE), [KEY]))


def tail_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.worst_share(_labelled(spark, sf_dir), "customer_regret_bps_h5", [KEY]), 6)


def customer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.customer_outcomes(_labelled(spark, sf_dir), "signal_level", 5, [KEY]), 6)


def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weekly_counts(with_baseline(spark, sf_dir), "signal_momentum", [KEY])


def frequency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.frequency_summary(with_baseline(spark, sf_dir), "signal_momentum", [KEY]))


def cluster_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = with_baseline(spark, sf_dir)
    return rounded(metrics.cluster_rate(own, "signal_level", [KEY]).join(metrics.cluster_share(own, "signal_level", [KEY]), KEY))


def useful_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.useful_signals(_labelled(spark, sf_dir), "target_stay_not_worse_h5", "signal_momentum", [KEY]))


def random_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.random_signal(rates(spark, sf_dir).select(*ID))


def matched_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.matched_hit_rate(_labelled(spark, sf_dir), "target_stay_not_worse_h5", "signal_momentum", [KEY], draws=50))


def matched_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.matched_draws(with_baseline(spark, sf_dir).select(*ID, "signal_momentum"), "signal_momentum", [KEY], draws=50).select(*ID, "draw")


def lift_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = targets.add_path_outcomes(targets.add_targets(with_baseline(spark, sf_dir), 5), 5)
    return rounded(metrics.path_lift_at_risk(own, "target_stay_not_worse_h5", "signal_momentum", [KEY], draws=200, scale=SCALE), 7)


def method_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = targets.add_path_outcomes(_labelled(spark, sf_dir), 5)
    return rounded(metrics.evaluate_method(own, "target_stay_not_worse_h5", "signal_momentum", 5, [KEY], draws=200, scale=SCALE), 6)


def baseline_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.baseline(with_baseline(spark, sf_dir), (1, 3, 5)))


#: Prices of the test tables jump by a factor of hundreds from day to day, so that scores of the usual scale leave
#: the range of doubles; reports over them use a scale that is 10,000 times as long.
SCALE = LAR_SCALE_BPS * 10_000
REPORTED = ("signal_momentum", "signal_level")


def lift_at_risk_discounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = targets.add_path_outcomes(targets.add_targets(with_baseline(spark, sf_dir), 5), 5, 2.0)
    return rounded(metrics.path_lift_at_risk(own, "target_stay_not_worse_h5", "signal_momentum", [KEY], draws=200, scale=SCALE), 7)


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled rows with paths, and twenty masks over all of them: of each corridor, as many judged rows as were sent, whatever their weeks."""
    own = written(targets.add_path_outcomes(targets.add_targets(with_baseline(spark, sf_dir), 5), 5).select(*ID, "target_stay_not_worse_h5", "path_value_bps", "path_regret_bps", "signal_momentum"), "given")
    known = own.filter("target_stay_not_worse_h5 IS NOT NULL AND path_value_bps IS NOT NULL")
    sent = F.count_if(F.coalesce("signal_momentum", F.lit(False))).over(Window.partitionBy(KEY))
    drawn = metrics.uniform_draws(known, sent, [KEY], 20, "given").select("draw", *ID, F.lit(True).alias("drawn"))
    return own, metrics.with_draws(own.select(*ID), 20).join(drawn, ["draw", *ID], "left")


def lift_at_risk_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift-at-risk against given draws."""
    own, masks = _given(spark, sf_dir)
    return rounded(metrics.path_lift_at_risk(own, "target_stay_not_worse_h5", "signal_momentum", [KEY], scale=SCALE, masks=masks), 7)


def given_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the given draws once dates of 1996 are taken out of the frame and one draw lacks a year."""
    own, masks = _given(spark, sf_dir)
    known = F.col("target_stay_not_worse_h5").isNotNull() & F.col("path_value_bps").isNotNull() & (F.year(DATE) != 1998)
    return metrics.mask_violations(own.filter(F.year(DATE) != 1996), masks.filter((F.col("draw") != 3) | (F.year(DATE) != 1997)), known, "signal_momentum", [KEY])


def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of two rules by fold, corridor and horizon: input of the report queries."""
    frame = backtest.prepare(with_baseline(spark, sf_dir), (1, 5, 10))
    out = backtest.evaluate_rules(frame, FOLDS, (1, 5, 10), signals=REPORTED, draws=50, control=False, scale=SCALE)
    return out.select("method", "split", "fold", KEY, "horizon", "lift", "moment_advantage_bps", "customer_regret_bps_mean", "signal_count", "signals_per_week", "cluster_rate", "lift_at_risk")


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(slice_metrics(spark, sf_dir), 6)


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.stability(slice_metrics(spark, sf_dir), ["lift", "lift_at_risk", "moment_advantage_bps", "customer_regret_bps_mean"], ("customer_regret_bps_mean",)), 6)


def oot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.oot_summary(slice_metrics(spark, sf_dir)), 6)


def oot_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = backtest.prepare(with_signals(spark, sf_dir), (5, 10))
    found = backtest.evaluate_rules(own, FOLDS[-1:], (5, 10), draws=50, scale=SCALE)
    return research.oot_ranking(research.oot_summary(found, (5, 10))).select("place", "method", "corridors_with_lar_h5", "corridors_with_lar_h10")


def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.method_summary(slice_metrics(spark, sf_dir)), 6)


def with_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = slice_metrics(spark, sf_dir).select("method", "fold", KEY, "horizon", "lift", "signal_count")
    diagnostics = own.filter("signal_count > 20").select("method", "fold", KEY, "horizon", (F.col("signal_count") * 2).alias("signal_count"), (F.col("lift") > 1).alias("better"))
    return rounded(research.with_diagnostics(own, diagnostics, ["method", "fold", KEY, "horizon"]), 6)


def gate_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.gate_shares(slice_metrics(spark, sf_dir), ["method", "split"]), 6)


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.heatmap(slice_metrics(spark, sf_dir), KEY, "horizon", [1, 5, 10], "lift")
    return rounded(out.select(KEY, *[F.col(f"`{h}`").alias(f"lift_h{h}") for h in (1, 5, 10)]), 6)


def median_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = slice_metrics(spark, sf_dir).withColumn("slice", F.concat_ws("|", "method", KEY))
    return rounded(research.median_ranking(own, "slice", "lift", 5), 6)


def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.experiment_summary(slice_metrics(spark, sf_dir), ["method", "horizon"])


def market_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.market_components(rates(spark, sf_dir), panel.context(spark, sf_dir)), 6)


def paired_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _labelled(spark, sf_dir)
    base = own.withColumn("sent", F.col("signal_momentum"))
    new = own.select(*ID, F.coalesce("signal_level", F.lit(False)).alias("sent"))
    return rounded(research.paired_effect(new, base, "target_stay_not_worse_h5", "forward_mean_h5", [KEY]), 6)


def research_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = slice_metrics(spark, sf_dir).filter("horizon = 5")
    base = own.filter("method = 'signal_momentum'").select("fold", KEY, F.col("lift").alias("l0"), F.col("moment_advantage_bps").alias("v0"))
    new = own.filter("method = 'signal_level'").join(base, ["fold", KEY])
    new = new.withColumns({"delta_lift": F.col("lift") - F.col("l0"), "delta_bps": F.col("moment_advantage_bps") - F.col("v0")})
    return research.decision_counts(new.withColumn("decision", research.research_decision(0.5)), "fold")


# --- rules, search, policy -----------------------------------------------------------


def _held_rows(frame: DataFrame, names: list[str]) -> DataFrame:
    """(key, date, n_rules, rules_md5): how many rules hold on each row, and a digest of which."""
    return frame.select(*ID, reduce(add, [F.col(n).cast("int") for n in names]).alias("n_rules"), F.md5(F.concat(*[F.col(n).cast("int").cast("string") for n in names])).alias("rules_md5"))


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all price rules hold, row by row."""
    frame, catalog = rules.add_rules(rates(spark, sf_dir).select(*ID, PRICE))
    return _held_rows(frame, [r.rule_id for r in catalog])


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule of the price catalog holds in each corridor."""
    frame, catalog = rules.add_rules(rates(spark, sf_dir).select(*ID, PRICE))
    return frame.select(KEY, *[r.rule_id for r in catalog]).groupBy(KEY).agg(*[F.count_if(r.rule_id).alias(r.rule_id) for r in catalog]).unpivot([KEY], [r.rule_id for r in catalog], "rule_id", "n")


def _context_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    own = features.add_context(features.add_series_features(rates(spark, sf_dir)), panel.context(spark, sf_dir))
    own = asof.causal_context(own, panel.public_context(panel.external(spark, sf_dir)))
    ctx = [c for c in own.columns if c.startswith("ctx_")]
    frame, catalog = rules.add_rules(own.select(*ID, PRICE, "ret_1", "usd_ret_1", "eur_ret_1", "cny_ret_1", "residual_usd_1", *ctx), ("relative", "context"))
    return frame, [r.rule_id for r in catalog]


def context_rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_rows(*_context_rules(spark, sf_dir))


def context_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, names = _context_rules(spark, sf_dir)
    return frame.groupBy(KEY).agg(*[F.count_if(n).alias(n) for n in names]).unpivot([KEY], names, "rule_id", "n")


def _screening(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    frame, catalog = rules.add_rules(targets.add_targets(rates(spark, sf_dir).select(*ID, PRICE), 5))
    return search.screen(frame, catalog, "target_stay_not_worse_h5", 5), [r.rule_id for r in catalog]


def rule_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_screening(spark, sf_dir)[0], 6)


def rule_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.shortlist(*_screening(spark, sf_dir))


#: One rule of each family and a second level rule: every kind of ensemble is made of them.
SHORTLIST = ("level__pct_w20_p10", "momentum__down_streak_2", "oversold__rsi_w5_p30", "level__near_min_w60_bp50", "confirmation__stabilize_h3", "regime__cheap_normal")


def ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, catalog = rules.add_rules(rates(spark, sf_dir).select(*ID, PRICE))
    names = list(SHORTLIST)
    out, candidates = rules.combine(frame, names, {r.rule_id: r.family for r in catalog}, rules.correlations(frame, names))
    made = [n for n in candidates if n not in names]
    return out.groupBy(KEY).agg(*[F.count_if(n).alias(n) for n in made]).unpivot([KEY], made, "candidate", "n")


def discovery_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _labelled(spark, sf_dir).filter("target_stay_not_worse_h5 IS NOT NULL")
    bps = (F.col("forward_mean_h5") / F.col(PRICE) - 1) * 10_000
    return rounded(search.discovery_effect(own.select(*ID, F.col("target_stay_not_worse_h5").alias("target"), bps.alias("bps"), F.coalesce("signal_momentum", F.lit(False)).alias("sent"))), 6)


def policy_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = signals.add_baseline(rates(spark, sf_dir).select(*ID, PRICE), momentum_days=1)
    return policy.calendar_policy(own, "signal_momentum", 3, 2).select(*ID, "policy_signal")


def policy_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = signals.add_baseline(rates(spark, sf_dir).select(*ID, PRICE), momentum_days=1)
    return policy.publication_policy(own, "signal_momentum", 1, 2).select(*ID, "policy_signal")


def indicator_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen stream of every fold, on its test rows."""
    own = targets.add_targets(rates(spark, sf_dir).select(*ID, PRICE), 5)
    found = search.indicator_search(own, FOLDS, "target_stay_not_worse_h5", 5)
    return reduce(DataFrame.unionByName, [f.test.withColumns({"rule_id": F.lit(f.rule_id)}) for f in found])


# --- decisions ---------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score without a model: how low the price stands among the last 20."""
    return with_signals(spark, sf_dir).withColumn("market_score", 1 - rank_share(F.col(PRICE), 20))


def meta_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decision.add_decisions(_scored(spark, sf_dir), threshold=0.5)
    return rounded(out.select(*ID, "meta_should_send", "meta_selected_signal", "meta_reason", "meta_selected_effect", "meta_selection_score", F.concat_ws(",", "meta_active_signals").alias("active"), F.size("meta_signal_scores").cast("long").alias("n_scores")))


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features.add_series_features(with_baseline(spark, sf_dir))
    out = decision.add_explanations(own.withColumn("ml_signal", F.col("price_percentile") <= 0.3))
    return rounded(out.select(*ID, "chosen_indicator", "direction", "strength", "speed", "scenario"))


TEMPLATES = [{"signal": s, "scenario": "now_cheap", "direction": "down", "speed": "slow", "push_title": "{currency}: a good day", "push_body": "{currency} moved by {effect_pct}%: " + s.removeprefix("signal_").replace("_", " ")} for s in SIGNALS]


def push_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlight.functions.scalar import message

    sent = decision.add_decisions(_scored(spark, sf_dir), threshold=0.5).filter("meta_should_send")
    texts = text_library(spark, TEMPLATES, ["guaranteed"], set(SIGNALS)).withColumnRenamed("signal", "meta_selected_signal")
    out = sent.join(F.broadcast(texts), "meta_selected_signal")  # one row a signal
    return out.select(*ID, message(F.col("push_title"), F.col(KEY), F.col("meta_selected_effect")).alias("title"), message(F.col("push_body"), F.col(KEY), F.col("meta_selected_effect")).alias("body"))


# --- splits, models ----------------------------------------------------------------


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_sizes(rates(spark, sf_dir), FOLDS, 5)


def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_folds(rates(spark, sf_dir), FOLDS).groupBy("fold", "split", KEY).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def fold_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly folds over the span of the panel, by rule."""
    first, last = rates(spark, sf_dir).agg(F.min(DATE), F.max(DATE)).first()
    return splits.fold_table(spark, splits.walk_forward_folds(first, last, 1996, dt.date(2000, 9, 1), dt.date(1999, 9, 1)))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.add_has_fact(targets.add_targets(_scored(spark, sf_dir), 5)).withColumn("score", F.col("market_score")).filter("target_stay_not_worse_h5 IS NOT NULL AND score IS NOT NULL")


THRESHOLDS, QUANTILES = [0.2, 0.5, 0.75, 0.9], [0.10, 0.15, 0.20]


def threshold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _judged(spark, sf_dir)
    return rounded(models.score_thresholds(own, models.threshold_candidates(own, THRESHOLDS, QUANTILES), "target_stay_not_worse_h5", 5), 6)


def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _judged(spark, sf_dir)
    return models.best_threshold(models.score_thresholds(own, models.threshold_candidates(own, THRESHOLDS, QUANTILES), "target_stay_not_worse_h5", 5))


def threshold_macro_lar(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = targets.add_path_outcomes(_judged(spark, sf_dir), 5)
    return rounded(models.score_thresholds(own, THRESHOLDS, "target_stay_not_worse_h5", 5, metric="lar", draws=50, scale=SCALE), 6)


def _model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = targets.add_targets(features.add_series_features(with_signals(spark, sf_dir)), 5)
    return signals.add_has_fact(own)


MODEL_COLUMNS = ["price_percentile", "days_since_min", "rebound_pct", "ret_1", "ret_5", "vol_20"]


def _predictions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    out, _ = backtest.walk_forward_predictions(_model_frame(spark, sf_dir), FOLDS, MODEL_COLUMNS, "target_stay_not_worse_h5", 5, kind)
    return out


def logreg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir, "logreg").select(*ID, "fold", "score", "threshold", "model_signal")


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir, "gbt").select(*ID, "fold", "score", "threshold", "model_signal")


def policy_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.meta_policy(_predictions(spark, sf_dir, "logreg")).select(*ID, "fold", "score", "meta_reason", "policy_signal")


def model_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst, median and best slice of the logistic model's final stream, over all folds and corridors."""
    frame = signals.add_has_fact(backtest.prepare(features.add_series_features(with_signals(spark, sf_dir)), (5,)))
    found = backtest.evaluate_models(frame, FOLDS, MODEL_COLUMNS, 5, draws=50, scale=SCALE)
    return metrics.stability(found, ["lift", "lift_at_risk", "moment_advantage_bps", "signals_per_week"])


def _rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score without a model, with its threshold and signal."""
    own = signals.add_has_fact(_scored(spark, sf_dir)).withColumns({"score": F.col("market_score"), "threshold": F.lit(0.5)})
    return own.withColumn("model_signal", (F.col("score") >= F.col("threshold")) & F.col("has_fact"))


def rule_policy_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final stream of a score without a model."""
    return backtest.meta_policy(_rule_scores(spark, sf_dir)).select(*ID, "meta_reason", "policy_signal")


#: Cutoff days of the snapshot queries.
CUTOFFS = [dt.date(2000, 3, 1) + dt.timedelta(60 * k) for k in range(3)]


def rule_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be sent on each of some cutoff days, by a score without a model."""
    texts = text_library(spark, TEMPLATES, required=set(SIGNALS))
    scored, parts = written(_rule_scores(spark, sf_dir), "scored"), []
    for day in CUTOFFS:
        # Sends depend on those before them, so each cutoff's stream is made of what was known then.
        stream = backtest.meta_policy(scored.filter(F.col("available_at") <= F.lit(day)))
        parts.append(backtest.snapshot_output(stream, texts, day))
    out = reduce(DataFrame.unionByName, parts)
    return rounded(out.select("as_of", "effective_date", "corridor", "indicator", "direction", "strength", "speed", "recommended_scenario", "push_title", "push_body", "market_score", "market_threshold", "selected_effect", "selection_score", "decision_reason"))


def snapshot_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = text_library(spark, TEMPLATES, required=set(SIGNALS))
    choice = backtest.ThresholdChoice(grid=(0.3, 0.4, 0.5))
    return backtest.signal_snapshot(_model_frame(spark, sf_dir), texts, SNAPSHOT_DAY, MODEL_COLUMNS, "target_stay_not_worse_h5", 5, allowed=SIGNALS, choice=choice)


#: A cutoff day on which something is sent in the test tables.
SNAPSHOT_DAY = dt.date(2000, 7, 10)


def rule_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of every rule and the random control, by fold and corridor."""
    frame = backtest.prepare(with_signals(spark, sf_dir), (5,))
    return rounded(backtest.evaluate_rules(frame, FOLDS, (5,), draws=50, scale=SCALE), 6)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of methods, and on how many rows of the panel each may send: a rule where it holds, a model where any rule does."""
    registry = spark.createDataFrame([(m.method_id, m.kind, "".join(m.groups), m.signal or m.kind) for m in backtest.methods((("A", "B"), ("A", "B", "C")))], "method string, kind string, groups string, sends string")
    own = metrics.random_signal(signals.add_has_fact(with_signals(spark, sf_dir)))
    counts = own.agg(*[F.count_if(s).alias(s) for s in SIGNALS], F.count_if("random_signal").alias("random"), F.count_if("has_fact").alias("model")).unpivot([], [*SIGNALS, "random", "model"], "sends", "n")
    return registry.join(counts, "sends").select("method", "kind", "groups", "n")


# --- sources and sinks -----------------------------------------------------------------


def compact_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.compact_outcomes(rates(spark, sf_dir), 5), 6)


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups A, B, C, E and F of the assembled frame, by the names that their selection gives."""
    own = rates(spark, sf_dir).select(*ID, PRICE, "recipient_per_rub", "available_at")
    frame = features.add_features(own, None, panel.external(spark, sf_dir), panel.holidays(spark, FIRST_YEAR, LAST_YEAR), panel.country_of(F.col(KEY)))
    out = frame.select(*ID, *features.columns_for_groups(["A", "B", "C", "E", "F", "A"], frame))
    return rounded(rounded(out.withColumn("slope_20", F.round("slope_20", 3)), 6), 6)


def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = panel.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    customers = panel.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return validate.many_to_one(orders, customers, ["custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def xml_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written as rate records in XML, by corridor, and parsed again."""
    own, folder = rates(spark, sf_dir), scratch_folder(spark, "xml")
    value = F.replace(F.col("value_rub").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(","))
    records = own.select(F.replace(F.col(KEY), F.lit(" "), F.lit("_")).alias("name"), F.date_format(DATE, "dd.MM.yyyy").alias("_Date"), F.lit("R1").alias("_Id"), F.col("nominal").alias("Nominal"), value.alias("Value"))
    records.write.partitionBy("name").format("xml").option("rootTag", "ValCurs").option("rowTag", "Record").save(folder)
    parts = [parse_rate_xml(spark, f"{folder}/name={c.replace(' ', '_')}", c, "R1") for c in sorted(panel.COUNTRY_BY_CORRIDOR)]
    return reduce(DataFrame.unionByName, parts).select(*ID, "nominal", "value_rub", F.round("rub_per_unit", 6).alias("rub_per_unit"))


def fetched_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot fetched series by series in tasks; the answers, which a network would give, are the panel's series as XML in a folder that all executors mount."""
    folder = scratch_folder(spark, "answers").removeprefix("file:")
    own = written(rates(spark, sf_dir).select(*ID, "cbr_id", "nominal", "value_rub"), "answers-rows")

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        cells = sorted(zip(*[rows.column(c).to_pylist() for c in (DATE, "nominal", "value_rub")]))
        records = (f'<Record Date="{d:%d.%m.%Y}" Id="{key[0].as_py()}"><Nominal>{n}</Nominal><Value>{f"{v:.2f}".replace(".", ",")}</Value></Record>' for d, n, v in cells)
        os.makedirs(folder, exist_ok=True)
        Path(folder, f"{key[0].as_py()}.xml").write_text(f"<ValCurs>{''.join(records)}</ValCurs>", encoding="utf-8")
        return pa.table({"n": pa.array([len(cells)], pa.int64())})

    own.groupBy("cbr_id").applyInArrow(write, "n bigint").count()
    names = {r[KEY]: r["cbr_id"] for r in own.select(KEY, "cbr_id").distinct().collect()}
    out = fetch_snapshot(spark, lambda cbr_id: Path(folder, f"{cbr_id}.xml").read_text(encoding="utf-8"), names, scratch_folder(spark, "rates"))
    return out.select(*ID, "cbr_id", "nominal", F.round("value_rub", 2).alias("value_rub"), F.round("rub_per_unit", 6).alias("rub_per_unit"))


PAGE = 100


def _pages(rows: DataFrame, folder: str) -> None:
    """Rows (date, value, place) as the pages that a paged service would answer with: files in a folder that all executors mount."""
    target = folder.removeprefix("file:")

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        start = key[0].as_py() * PAGE
        cells = sorted(zip(rows.column("place").to_pylist(), rows.column("date").to_pylist(), rows.column("value").to_pylist()))
        os.makedirs(target, exist_ok=True)
        Path(target, f"{start}.json").write_text(json.dumps([{"date": d, "value": v} for _, d, v in cells]), encoding="utf-8")
        return pa.table({"start": pa.array([start], pa.int64())})

    rows.groupBy(F.floor(F.col("place") / PAGE).alias("page")).applyInArrow(write, "start bigint").count()


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = panel.context(spark, sf_dir).filter("currency = 'USD'")
    return own.select(F.col(DATE).cast("string").alias("date"), F.col(PRICE).alias("value"), (F.row_number().over(Window.orderBy(DATE)) - 1).alias("place"))  # one series


def paged_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paged source read by several tasks."""
    folder = scratch_folder(spark, "pages")
    _pages(_paged(spark, sf_dir), folder)
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").options(base=folder.removeprefix("file:"), page=PAGE, readers=4).load()


def paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paged source read as a stream that is stopped in the middle of a page and goes on once more has come."""
    folder, out = scratch_folder(spark, "pages"), scratch_folder(spark, "paged")
    own = written(_paged(spark, sf_dir), "paged-rows")
    spark.dataSource.register(PagedJson)
    stream = lambda: spark.readStream.format("paged_json").options(base=folder.removeprefix("file:"), page=PAGE).load()
    _pages(own.filter(F.col("place") < 7 * PAGE + PAGE // 2), folder)
    run_available(spark, stream, "paged", out)
    _pages(own.filter(F.col("place") >= 7 * PAGE), folder)
    return run_available(spark, stream, "paged", out)


def csv_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "csv")
    sinks.write_table(rates(spark, sf_dir).select(*ID, "available_at", "nominal", "value_rub", "rub_per_unit", "is_fresh"), folder, "csv")
    return load_rates(spark, folder).select(*ID, "available_at", "nominal", "value_rub", "rub_per_unit", "is_fresh")


def public_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated CSV with cells that don't parse, as public context, written and loaded again, and as external series."""
    folder, again = scratch_folder(spark, "public"), scratch_folder(spark, "context")
    bad = F.when(F.col("cents") % 7 == 0, "n/a").otherwise(F.col("cents").cast("string"))
    sinks.write_table(panel.context(spark, sf_dir).filter("currency = 'USD'").select(F.col(DATE).cast("string").alias("day"), bad.alias("level")), folder, "csv")
    sinks.write_table(public_context_csv(spark, folder, "day", "level", "usd", "lineitem", 3), again, "csv")
    return from_public_context(load_public_context(spark, again), "public").select("event_date", "available_at", "source", "series_id", "value")


def csv_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "external")
    sinks.write_table(panel.external(spark, sf_dir), folder, "csv")
    return load_external(spark, folder).select("series_id", "event_date", "available_at", "value")


def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of a written file, as a manifest lists them."""
    folder = scratch_folder(spark, "regions")
    sinks.write_table(panel.table(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1).sortWithinPartitions("r_regionkey"), folder, "csv")
    return sinks.file_digests(spark, folder).filter("file LIKE 'part-%'").select("bytes", "sha256")


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report table."""
    own = rates(spark, sf_dir).groupBy(KEY).agg(F.count("*").alias("n"), F.max("value_rub").alias("high")).orderBy(KEY)
    lines = sinks.markdown(own.withColumn("low", F.lit(None).cast("double"))).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial result that is computed once and then read."""
    folder = scratch_folder(spark, "resume")
    sinks.resume(rates(spark, sf_dir).select(*ID, "cents"), folder, "panel, version 1")
    return sinks.resume(rates(spark, sf_dir).select(*ID, F.lit(None).cast("long").alias("cents")), folder, "panel, version 1")


def upsert_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = panel.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    journal, rows = orders.filter("y < 2000"), orders.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    return sinks.upsert(journal, rows, ["o_orderkey"])


def append_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = panel.table(spark, sf_dir, "orders")
    return sinks.append_journal(orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus"), orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority"))


def new_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context dates without a price in any corridor (SET-02, SET-03, JOIN-13)."""
    return panel.context(spark, sf_dir).select(DATE).distinct().exceptAll(rates(spark, sf_dir).select(DATE).distinct())


def rolling_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlight.functions.frames import quantile

    return rounded(rates(spark, sf_dir).select(*ID, full(quantile(0.1), F.col(PRICE), last_rows(90), 90).alias("q10")))


def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.with_ema(rates(spark, sf_dir).select(*ID, PRICE), (10, 60)).drop(PRICE), 4)


# --- event-time streams ------------------------------------------------------------


def _candidate_stream(spark: SparkSession, sf_dir: str, name: str) -> Callable[[], DataFrame]:
    """The panel's one-fall candidates as files that arrive one by one: three parts by date, each with a few days of the next, then an end mark."""
    own = signals.add_baseline(rates(spark, sf_dir).select(*ID, PRICE), momentum_days=1)
    own = written(own.select(*ID, F.col("signal_momentum").alias("candidate")), name)
    folder = scratch_folder(spark, f"{name}-arrivals")
    first, last = own.agg(F.min(DATE), F.max(DATE)).first()
    third = (last - first) / 3
    # A row's place depends on its date and, up to six days around a border, on its series.
    part = reduce(add, [(F.date_add(F.col(DATE), F.pmod(F.hash(KEY), F.lit(6)).cast("int")) > F.lit(first + k * third)).cast("int") for k in (1, 2)])
    for k in range(3):
        own.filter(part == k).coalesce(1).write.parquet(f"{folder}/{k}")
    spark.createDataFrame([("~end", dt.date(2200, 1, 1), False)], own.schema).coalesce(1).write.parquet(f"{folder}/3")
    return lambda: spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def stream_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar policy as a stream with a watermark, over all that has arrived."""
    stream = _candidate_stream(spark, sf_dir, "stream-calendar")
    return run_available(spark, lambda: event_time_policy(stream()), "stream-calendar").filter(F.col(KEY) != "~end")


def stream_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by week of event time, as a stream with a watermark."""
    stream = _candidate_stream(spark, sf_dir, "stream-weeks")
    return run_available(spark, lambda: weekly_sends(stream(), "candidate"), "stream-weeks").filter(F.col(KEY) != "~end")


# --- long series in chunks, as-of joins in spans: the same rows by the other plan ----------

#: Rows of a chunk, so that a series of the orders table is cut into about 20, and days of a span.
CHUNK_ROWS, SPAN_DAYS = 120, 120


def cut_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of horizon 5, and the outcomes around and after each row, of series in chunks."""
    own = written(rates(spark, sf_dir).select(*ID, PRICE), "panel")
    out = targets.add_path_outcomes(targets.add_customer_outcomes(targets.add_targets(own, 5, CHUNK_ROWS), 5, CHUNK_ROWS), 5, 2.0, rows=CHUNK_ROWS)
    return rounded(out.drop(PRICE), 6)


def cut_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price features of series in chunks."""
    own = features.add_series_features(rates(spark, sf_dir).select(*ID, PRICE), rows=CHUNK_ROWS)
    return rounded(own.drop(PRICE), 4)


def cut_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals of series in chunks, with holidays found in spans of time."""
    own = signals.add_baseline(rates(spark, sf_dir).select(*ID, PRICE), panel.holidays(spark, FIRST_YEAR, LAST_YEAR), panel.country_of(F.col(KEY)), rows=CHUNK_ROWS, days=SPAN_DAYS)
    out = signals.add_research(own, rows=CHUNK_ROWS)
    return rounded(out.select(*ID, *SIGNALS, *[effect_column(x) for x in SIGNALS]))


def cut_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context features of context series in chunks."""
    return rounded(features.context_features(rates(spark, sf_dir), panel.context(spark, sf_dir), CHUNK_ROWS))


def cut_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External features: an as-of join in spans of time, then windows over chunks."""
    return rounded(features.external_features(rates(spark, sf_dir), panel.external(spark, sf_dir), CHUNK_ROWS, SPAN_DAYS))


def cut_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which price rules hold, row by row, of series in chunks."""
    frame, catalog = rules.add_rules(rates(spark, sf_dir).select(*ID, PRICE), rows=CHUNK_ROWS)
    return _held_rows(frame, [r.rule_id for r in catalog])


def span_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of a year before, and context as last available, by as-of joins in spans of time."""
    own = asof.annual_reference(rates(spark, sf_dir).select(*ID, PRICE), F.col(PRICE), days=SPAN_DAYS)
    return rounded(asof.causal_context(own.select(*ID, "annual_reference"), panel.public_context(panel.external(spark, sf_dir)), days=SPAN_DAYS))


SIGNAL_QUERIES = {
    "sig_momentum": "signal_momentum", "sig_level": "signal_level", "sig_reversal": "signal_reversal", "sig_seasonality": "signal_seasonality",
    "sig_year_up": "signal_better_than_one_year_ago", "sig_year_down": "signal_less_than_one_year_ago", "sig_range_held": "signal_better_range_held",
    "sig_unusual_move": "signal_larger_than_usual_latest_improvement", "sig_avg30": "signal_better_than_30_day_average",
    "sig_recent_up": "signal_most_recent_changes_favourable", "sig_recent_down": "signal_most_recent_changes_unfavourable",
}

QUERIES: dict[str, Query] = {
    **{f.__name__: f for f in (momentum_lift, rates_panel, context_panel, external_long, external_validation, panel_validation, data_audit, quality_profile)},
    "target_local_min": _columns(_targets(3), "target_local_min_h3"),
    "target_stay_not_worse": _columns(_targets(5), "target_stay_not_worse_h5"),
    "target_window_closing": _columns(_targets(5), "target_window_closing_h5"),
    "forward_mean": _columns(_targets(5), "forward_mean_h5"),
    "customer_outcomes": customer_outcomes, "lar_path_fixed": path_outcomes(None), "lar_path_discounted": path_outcomes(2.0), "future_prices": future_prices,
    **{name: signal_query(s) for name, s in SIGNAL_QUERIES.items()}, "has_fact": has_fact,
    "down_streak": _columns(_series_features, "down_streak"), "price_percentile": _columns(_series_features, "price_percentile"), "days_since_min": _columns(_series_features, "days_since_min"),
    "rebound": _columns(_series_features, "rebound_pct"), "returns": _columns(_series_features, "ret_1", "ret_3", "ret_5", "ret_10", "ret_20"), "vol20": _columns(_series_features, "vol_20", digits=6),
    "slope20": _columns(_series_features, "slope_20", digits=4), "calendar": _columns(_series_features, "month", "weekday"),
    **{f.__name__: f for f in (
        days_to_holiday, annual_reference, context_features, synthetic_cross, external_features, causal_context, cross_rates, text_scalars, rolling_quantile, ema,
        lift_by_indicator, tail_regret, customer_metrics, weekly_counts, frequency_summary, cluster_rate, useful_signals, random_signal, matched_hit_rate, matched_draws, lift_at_risk, method_metrics, baseline_lift,
        slices, stability, oot_summary, method_summary, gate_shares, heatmap, median_ranking, experiment_summary, market_components, paired_effect, research_decisions,
        lift_at_risk_discounted, oot_ranking, with_diagnostics, compact_outcomes, feature_frame, fold_calendar, threshold_macro_lar, candidates, merged_segments, discovery_effect,
        xml_rates, fetched_rates, csv_rates, public_csv, csv_external, file_digest, report_table, resumed,
        rule_rows, rule_counts, context_rule_rows, context_rule_counts, rule_screen, rule_shortlist, ensembles, policy_calendar, policy_prints, indicator_search,
        meta_decisions, explanations, push_messages, split_sizes, fold_assignment, threshold_scores, threshold_choice, logreg_scores, gbt_scores, policy_stream, rule_policy_stream, model_stability, snapshot_signals, rule_snapshots, rule_backtest,
        upsert_journal, append_journal, new_dates,
        paged_context, paged_stream, stream_calendar, stream_weeks, lift_at_risk_given, given_violations, cut_labels, cut_features, cut_signals, cut_context, cut_external, cut_rules, span_asof,
    )},
}
