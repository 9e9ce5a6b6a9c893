"""From model scores and signals to explained decisions (DEC-01 to DEC-04, EXP-01)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.functions.scalar import finite, flag
from tarnlight.operators.signals import SIGNALS, effect_column
from tarnlight.operators.validate import require, require_columns

SEASONALITY = "signal_seasonality"
#: Fixed weights of how clear each signal is to a reader.
CLARITY = {
    "signal_seasonality": 1.00, "signal_better_than_30_day_average": 1.00, "signal_better_than_one_year_ago": 0.95,
    "signal_less_than_one_year_ago": 0.95, "signal_better_range_held": 0.80, "signal_level": 0.75,
    "signal_larger_than_usual_latest_improvement": 0.70, "signal_reversal": 0.70, "signal_momentum": 0.65,
    "signal_most_recent_changes_favourable": 0.65, "signal_most_recent_changes_unfavourable": 0.65,
}


def clarity_weights(given: Mapping[str, float] | None) -> dict[str, float]:
    for name, value in (given or {}).items():
        require(name in SIGNALS, f"unknown signal {name!r}")
        require(0 < value <= 1, f"the clarity of {name!r} must be in (0, 1]")
    return {**CLARITY, **(given or {})}


def add_decisions(frame: DataFrame, score: str = "market_score", threshold: float | str = 0.8, freshness: str | None = None, allowed: tuple[str, ...] | None = None, clarity: Mapping[str, float] | None = None) -> DataFrame:
    """``frame`` with ``meta_*`` columns: whether to send, which signal to name, and why.

    Gates are tried in order: fresh data, a finite score, the threshold (equality passes), an
    active signal, an allowed one.  Then one candidate is named as it is; seasonality goes
    before others; else the candidate with the largest ``abs(effect) * clarity`` is named,
    ties going to clarity, then effect, then the order of the signals.
    """
    require(allowed is None or set(allowed) <= set(SIGNALS), "unknown signals are allowed")
    names = [s for s in SIGNALS if allowed is None or s in allowed]
    require_columns(frame, (score, *SIGNALS, *[effect_column(s) for s in names]))
    weights = clarity_weights(clarity)
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    fresh = F.lit(True) if freshness is None else flag(F.col(freshness))

    def entry(signal: str) -> Column:
        effect = finite(F.col(effect_column(signal)).cast("double"))
        return F.when(flag(F.col(signal)), F.struct(
            F.lit(signal).alias("signal"), effect.alias("effect"), F.lit(weights[signal]).alias("clarity"), (F.abs(effect) * weights[signal]).alias("score"), F.lit(-SIGNALS.index(signal)).alias("place"),
        ))

    out = frame.withColumns({
        "_active": F.array_compact(F.array(*[F.when(flag(F.col(s)), F.lit(s)) for s in SIGNALS])),
        "_all": F.array_compact(F.array(*[entry(s) for s in names])),
        "_score": finite(F.col(score).cast("double")),
    })
    found, one = F.size("_all"), F.get("_all", 0)
    scored = F.filter("_all", lambda x: x.effect.isNotNull() | (x.signal == SEASONALITY))
    seasonal = F.exists("_all", lambda x: x.signal == SEASONALITY)
    best = F.array_max(F.transform("_all", lambda x: F.struct(x.score.alias("score"), x.clarity.alias("clarity"), F.abs(x.effect).alias("size"), x.place.alias("place"), x.signal.alias("signal"), x.effect.alias("effect"))))
    reason = (
        F.when(~fresh, "stale_market_data").when(F.col("_score").isNull(), "invalid_market_score").when(F.col("_score") < limit, "below_market_threshold")
        .when(F.size("_active") == 0, "no_active_signal").when(found == 0, "no_allowed_signal").when(found == 1, "selected_single_signal")
        .when(seasonal, "selected_seasonality_priority").when(F.exists("_all", lambda x: x.score.isNull()), "invalid_signal_effect").otherwise("selected_by_effect")
    )
    gated = F.col("meta_reason").isin("stale_market_data", "invalid_market_score", "below_market_threshold", "no_active_signal", "no_allowed_signal")
    out = out.withColumns({"meta_reason": reason, "_best": best})

    def pick(single: Column, seasonal_value: Column, effect_value: Column) -> Column:
        r = F.col("meta_reason")
        return F.when(r == "selected_single_signal", single).when(r == "selected_seasonality_priority", seasonal_value).when(r == "selected_by_effect", effect_value)

    none = F.lit(None).cast("double")
    out = out.withColumns({
        "meta_should_send": F.col("meta_reason").startswith("selected"),
        "meta_selected_signal": pick(one.signal, F.lit(SEASONALITY), F.col("_best.signal")),
        "meta_selected_effect": pick(one.effect, none, F.col("_best.effect")),
        "meta_selection_score": pick(one.score, none, F.col("_best.score")),
        "meta_active_signals": F.col("_active"),
        "meta_signal_scores": F.when(gated, F.filter("_all", lambda x: F.lit(False))).otherwise(scored),
    })
    scores = F.transform("meta_signal_scores", lambda x: F.struct(x.signal.alias("signal"), x.effect.alias("effect"), x.clarity.alias("clarity"), x.score.alias("score")))
    return out.withColumn("meta_signal_scores", scores).drop("_active", "_all", "_score", "_best")


#: What may be said for each target, fixed: facts that fit it, its scenario, and ranks of facts.
FACTS = {"stay_not_worse": ("level", "momentum", "seasonality"), "local_min": ("level", "momentum", "seasonality"), "window_closing": ("reversal",)}
SCENARIO = {"stay_not_worse": "now_cheap", "local_min": "now_cheap", "window_closing": "window_closing"}
RANK = {"level": 3, "momentum": 2, "seasonality": 1, "reversal": 3}
FAST = ("momentum",)


def add_explanations(frame: DataFrame, signal: str = "ml_signal", target: str = "stay_not_worse", rank: Mapping[str, int] | None = None) -> DataFrame:
    """The fact to name for each sent row, with direction, strength, speed and scenario (EXP-01)."""
    require(target in FACTS, f"unknown target {target!r}")
    ranks = rank or RANK
    strength = {
        "level": F.coalesce(1 - F.col("price_percentile"), F.lit(0.0)),
        "momentum": F.coalesce(F.col("down_streak"), F.lit(0.0)),
        "seasonality": F.coalesce(-F.col("days_to_holiday"), F.lit(float("-inf"))),
        "reversal": F.coalesce(F.col("rebound_pct"), F.lit(0.0)),
    }
    facts = [F.when(flag(F.col(f"signal_{f}")), F.struct(F.lit(ranks.get(f, 0)).alias("rank"), strength[f].alias("strength"), F.lit(-i).alias("place"), F.lit(f).alias("fact"))) for i, f in enumerate(FACTS[target])]
    out = frame.withColumn("_fact", F.when(flag(F.col(signal)), F.array_max(F.array_compact(F.array(*facts)))))
    fact = F.col("_fact.fact")
    return out.withColumns({
        "chosen_indicator": fact,
        "direction": F.when(fact == "reversal", "up").when(fact.isNotNull(), "down"),
        "strength": F.col("_fact.strength"),
        "speed": F.when(fact.isin(*FAST), "fast").when(fact.isNotNull(), "slow"),
        "scenario": F.when(fact.isNotNull(), SCENARIO[target]),
    }).drop("_fact")
