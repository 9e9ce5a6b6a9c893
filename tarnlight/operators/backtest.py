"""Walk-forward backtests, the method matrix, and point-in-time snapshots (MDL-07 to MDL-10, POL-03, CTL-01 to CTL-04, CTL-07)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.frames import DATE, KEY, PRICE
from tarnlight.functions.scalar import LAR_SCALE_BPS, corridor, flag, message
from tarnlight.operators.decision import add_decisions
from tarnlight.operators.metrics import evaluate_method, lift_by_indicator, random_signal
from tarnlight.operators.models import FALLBACK_THRESHOLD, fit_scorer, score, select_threshold
from tarnlight.operators.policy import calendar_policy
from tarnlight.operators.signals import RESEARCH, SIGNALS
from tarnlight.operators.splits import Fold, assign_folds, check_folds, snapshot_fold, test_rows, train_rows, validation_rows
from tarnlight.operators.targets import add_customer_outcomes, add_path_outcomes, add_targets, target_column
from tarnlight.operators.validate import require
from tarnlight.session import written


@dataclass(frozen=True)
class ThresholdChoice:
    grid: tuple[float, ...] = (0.6, 0.7, 0.8, 0.9)
    quantiles: tuple[float, ...] = (0.10, 0.15, 0.20)
    max_per_week: float = 2.5
    default: float = FALLBACK_THRESHOLD
    metric: str = "lift"


def walk_forward_predictions(frame: DataFrame, folds: list[Fold], columns: list[str], target: str, horizon: int, kind: str = "logreg", choice: ThresholdChoice = ThresholdChoice(), iterations: int | None = None) -> tuple[DataFrame, list[dict]]:
    """Test rows of all folds with ``score``, ``threshold``, ``model_signal``, ``fold``, ``split``; and an audit row for each fold.

    Models are fitted fold by fold by the driver (each fit is a distributed job) on the written
    frame; scoring stays lazy and the folds' scored rows are one union.
    """
    check_folds(folds)
    frame = written(frame, "frame")
    parts, audit = [], []
    for fold in folds:
        train, validation = train_rows(frame, fold, horizon), validation_rows(frame, fold, horizon)
        scorer = fit_scorer(train, columns, target, kind, validation, iterations)
        scored = score(validation, scorer)
        some = not validation.filter(F.col(target).isNotNull()).isEmpty()
        limit = select_threshold(scored, target, horizon, list(choice.grid), list(choice.quantiles), choice.max_per_week, choice.metric) if some else choice.default
        out = score(test_rows(frame, fold), scorer).withColumns({"fold": F.lit(fold.name), "split": F.lit(fold.split), "threshold": F.lit(limit)})
        parts.append(out.withColumn("model_signal", (F.col("score") >= F.col("threshold")) & flag(F.col("has_fact"))))
        audit.append({"fold": fold.name, "split": fold.split, "threshold": limit, "calibrated": scorer.calibrator is not None})
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole, audit


def meta_policy(predictions: DataFrame, allowed: tuple[str, ...] = SIGNALS, cooldown_days: int = 3, weekly_limit: int = 2, freshness: str | None = None) -> DataFrame:
    """The final stream: model signal and decision, thinned by the calendar policy over all predicted rows of a corridor (POL-03)."""
    out = add_decisions(predictions.withColumns({"market_score": F.col("score"), "market_threshold": F.col("threshold")}), threshold="market_threshold", freshness=freshness, allowed=allowed)
    out = out.withColumn("candidate_signal", F.col("model_signal") & F.col("meta_should_send"))
    return calendar_policy(out, "candidate_signal", cooldown_days, weekly_limit)


def prepare(frame: DataFrame, horizons: tuple[int, ...], rows: int | None = None) -> DataFrame:
    """Labels and outcomes of every horizon on the full history, before any split."""
    out = frame
    for h in horizons:
        out = add_customer_outcomes(add_targets(out, h, rows), h, rows)
    return out


@dataclass(frozen=True)
class Method:
    method_id: str
    kind: str  #: rule, random or model
    signal: str | None = None
    groups: tuple[str, ...] = field(default_factory=tuple)


def methods(model_groups: tuple[tuple[str, ...], ...] = ()) -> list[Method]:
    """A random control, each rule, and models by feature groups; ids are unique (CTL-01)."""
    out = [Method("random", "random"), *[Method(s, "rule", s) for s in SIGNALS], *[Method(f"logreg_{''.join(g)}", "model", None, g) for g in model_groups]]
    require(len({m.method_id for m in out}) == len(out), "method ids must be unique")
    return out


def by_horizon(frame: DataFrame, horizons: tuple[int, ...], target_kind: str, keep: list[str]) -> DataFrame:
    """``keep``, and for each horizon a row with ``horizon``, ``target`` and the outcomes; rows without a target are left out."""
    names = ("moment_advantage_bps", "customer_regret_bps", "forward_mean")
    cells = [F.struct(F.lit(h).alias("horizon"), F.col(target_column(target_kind, h)).alias("target"), *[F.col(f"{n}_h{h}").alias(n) for n in names]) for h in horizons]
    return frame.select(*keep, F.explode(F.array(*cells)).alias("_o")).select(*keep, "_o.*").filter("target IS NOT NULL")


def evaluate_rules(frame: DataFrame, folds: list[Fold], horizons: tuple[int, ...] = (5,), target_kind: str = "stay_not_worse", signals: tuple[str, ...] = SIGNALS, draws: int = 50, control: bool = True, scale: float = LAR_SCALE_BPS) -> DataFrame:
    """Metrics of every rule (and a random ``control``) in every fold, corridor and horizon, in one query (CTL-02, MDL-08).

    Methods and horizons become columns, so that all slices are parallel and the panel is made once.
    Path outcomes are taken within a fold's slice, as evaluation sees no later rows.
    """
    own = assign_folds(frame, folds)
    own = random_signal(own, by=("fold", KEY)) if control else own
    names = [*signals, "random_signal"] if control else list(signals)
    long = by_horizon(own, horizons, target_kind, [KEY, DATE, PRICE, "fold", "split", *names])
    long = add_path_outcomes(long, max(horizons), by=["fold", KEY, "horizon"], own_horizon="horizon")
    # Metrics are a dozen aggregations of the same rows: as a table, they are made once.
    long = written(long.unpivot([c for c in long.columns if c not in names], names, "method", "sent"), "slices")
    return evaluate_method(long, "target", "sent", None, ["method", "split", "fold", KEY, "horizon"], draws=draws, scale=scale).withColumn("corridor", corridor(F.col(KEY)))


def evaluate_models(frame: DataFrame, folds: list[Fold], columns: list[str], horizon: int, kind: str = "logreg", target_kind: str = "stay_not_worse", choice: ThresholdChoice = ThresholdChoice(), iterations: int | None = None, draws: int = 50, scale: float = LAR_SCALE_BPS) -> DataFrame:
    """Metrics of a model's stream, after decision and send policy, in every fold and corridor (MDL-08); :func:`metrics.stability` sums them up."""
    stream, _ = walk_forward_predictions(frame, folds, columns, target_column(target_kind, horizon), horizon, kind, choice, iterations)
    long = by_horizon(meta_policy(stream), (horizon,), target_kind, [KEY, DATE, PRICE, "fold", "split", "policy_signal"])
    long = written(add_path_outcomes(long, horizon, by=["fold", KEY]).withColumn("method", F.lit(kind)), "slices")
    return evaluate_method(long, "target", "policy_signal", None, ["method", "split", "fold", KEY, "horizon"], draws=draws, scale=scale)


def baseline(frame: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10, 20), signals: tuple[str, ...] = SIGNALS[:4]) -> DataFrame:
    """In-sample lift of the baseline rules against local minima, by horizon (CTL-07)."""
    out = None
    for h in horizons:
        one = lift_by_indicator(add_targets(frame, h), target_column("local_min", h), list(signals), [KEY]).withColumn("horizon", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out


#: Fixed names and order of the output columns.
SNAPSHOT = ("as_of", "effective_date", "corridor", "indicator", "direction", "strength", "speed", "recommended_scenario", "push_title", "push_body", "market_score", "market_threshold", "selected_effect", "selection_score", "decision_reason")


def snapshot_output(stream: DataFrame, templates: DataFrame, as_of: dt.date, max_staleness_days: int = 3) -> DataFrame:
    """The latest row of each corridor if it is fresh and sent, with its message (TOP-04, FLT-03, JOIN-12); fixed columns, even when empty."""
    last = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(DATE)))
    latest = stream.withColumn("_last", last).filter("_last = 1").filter(F.col("policy_signal") & (F.datediff(F.lit(as_of), F.col("available_at")) <= max_staleness_days))
    texts = templates.select(F.col("signal").alias("meta_selected_signal"), "scenario", "direction", "speed", "push_title", "push_body")
    out = latest.drop("scenario", "direction", "speed").join(texts, "meta_selected_signal")
    effect = F.col("meta_selected_effect")
    return out.select(
        F.lit(as_of.isoformat()).alias("as_of"), F.col(DATE).cast("string").alias("effective_date"), corridor(F.col(KEY)).alias("corridor"), F.col("meta_selected_signal").alias("indicator"), "direction",
        F.abs(effect).alias("strength"), "speed", F.col("scenario").alias("recommended_scenario"), message(F.col("push_title"), F.col(KEY), effect).alias("push_title"), message(F.col("push_body"), F.col(KEY), effect).alias("push_body"),
        "market_score", "market_threshold", effect.alias("selected_effect"), F.col("meta_selection_score").alias("selection_score"), F.col("meta_reason").alias("decision_reason"),
    )


def signal_snapshot(frame: DataFrame, templates: DataFrame, as_of: dt.date, columns: list[str], target: str, horizon: int, kind: str = "logreg", allowed: tuple[str, ...] = RESEARCH, choice: ThresholdChoice = ThresholdChoice(), iterations: int | None = None) -> DataFrame:
    """Point-in-time decisions: what was available at ``as_of`` goes in, messages come out (CTL-03, FLT-01)."""
    known = frame.filter(F.col("available_at") <= F.lit(as_of))
    predictions, _ = walk_forward_predictions(known, [snapshot_fold(as_of)], columns, target, horizon, kind, choice, iterations)
    return snapshot_output(meta_policy(predictions, allowed), templates, as_of)
