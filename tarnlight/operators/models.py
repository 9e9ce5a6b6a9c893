"""Scorers, calibration and threshold choice (MDL-03 to MDL-06, AGG-30)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.functions.frames import KEY, PRICE
from tarnlight.functions.scalar import LAR_SCALE_BPS, advantage_bps, flag, significant
from tarnlight.operators.metrics import path_lift_at_risk, week
from tarnlight.operators.validate import require

FALLBACK_THRESHOLD = 0.8


@dataclass
class Scorer:
    """A fitted model: columns, their medians and scales, the pipeline, and a calibrator."""

    kind: str
    columns: list[str]
    medians: dict[str, float]
    scales: dict[str, tuple[float, float]]
    model: PipelineModel
    calibrator: IsotonicRegressionModel | None = None


def _numeric(column: str) -> Column:
    return F.col(column).cast("double")


def _prepared(frame: DataFrame, columns: list[str], medians: dict[str, float], scales: dict[str, tuple[float, float]], kind: str) -> DataFrame:
    made: dict[str, Column] = {}
    for c in columns:
        value = F.coalesce(_numeric(c), F.lit(medians[c]))
        mean, scale = scales[c]
        made[f"_x_{c}"] = (value - mean) / (scale or 1.0) if kind == "logreg" else value
        if kind == "gbt":
            made[f"_m_{c}"] = _numeric(c).isNull().cast("double")
    return frame.withColumns(made)


def fit_scorer(train: DataFrame, columns: list[str], target: str, kind: str = "logreg", validation: DataFrame | None = None, iterations: int | None = None) -> Scorer:
    """A scorer of ``target`` from ``columns`` and the corridor.

    ``logreg``: medians for gaps, population standardisation, one-hot corridors, L2 with C = 1
    and balanced weights.  ``gbt``: gradient-boosted trees of depth 3 with missing flags and
    square-root balanced weights, which stop early where ``validation`` has both classes and its
    error no longer falls; it is not numerically equal to any other tree library.
    """
    require(kind in ("logreg", "gbt"), f"unknown model {kind!r}")
    own = train.filter(F.col(target).isNotNull())
    wanted = [*[F.percentile(_numeric(c), F.lit(0.5)).alias(f"m_{c}") for c in columns], F.count("*").alias("n"), F.sum(F.col(target).cast("int")).alias("ones")]
    row = own.agg(*wanted).first()
    require(row["n"] > 0 and 0 < row["ones"] < row["n"], "training needs rows of both classes")
    medians = {c: row[f"m_{c}"] if row[f"m_{c}"] is not None else 0.0 for c in columns}
    filled = own.select(*[F.coalesce(_numeric(c), F.lit(medians[c])).alias(c) for c in columns])
    moments = filled.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("a", F.avg), ("s", F.stddev_pop))]).first() if columns else None
    scales = {c: (moments[f"a_{c}"], moments[f"s_{c}"]) for c in columns}
    ones, zeros = row["ones"], row["n"] - row["ones"]
    weights = (row["n"] / (2 * ones), row["n"] / (2 * zeros)) if kind == "logreg" else (max(1.0, (zeros / ones) ** 0.5), max(1.0, (ones / zeros) ** 0.5))
    data = _prepared(own, columns, medians, scales, kind).withColumns({"_label": F.col(target).cast("double"), "_weight": F.when(F.col(target), weights[0]).otherwise(weights[1])})
    seen = None if validation is None else validation.filter(F.col(target).isNotNull())
    judged = seen is not None and seen.select(target).distinct().count() == 2
    if kind == "gbt":
        data = data.withColumn("_held", F.lit(False))
        if judged:
            shared = [c for c in own.columns if c in seen.columns]
            rest = _prepared(seen.select(*shared), columns, medians, scales, kind).withColumns({"_label": F.col(target).cast("double"), "_weight": F.lit(1.0), "_held": F.lit(True)})
            data = data.unionByName(rest, allowMissingColumns=True)
    index = StringIndexer(inputCol=KEY, outputCol="_key", handleInvalid="keep", stringOrderType="alphabetAsc")
    names = [f"_x_{c}" for c in columns] + ([f"_m_{c}" for c in columns] if kind == "gbt" else [])
    if kind == "logreg":
        stages = [index, OneHotEncoder(inputCol="_key", outputCol="_hot", dropLast=False, handleInvalid="keep"), VectorAssembler(inputCols=[*names, "_hot"], outputCol="_features")]
        total = weights[0] * ones + weights[1] * zeros
        stages.append(LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", regParam=1.0 / total, standardization=False, maxIter=iterations or 200))
    else:
        stages = [index, VectorAssembler(inputCols=[*names, "_key"], outputCol="_features"), GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", maxDepth=3, maxIter=iterations or 200, stepSize=0.05, seed=0, **({"validationIndicatorCol": "_held"} if judged else {}))]
    scorer = Scorer(kind, columns, medians, scales, Pipeline(stages=stages).fit(data))
    if judged:
        scorer.calibrator = IsotonicRegression(featuresCol="score", labelCol="_label").fit(score(seen, scorer).withColumn("_label", F.col(target).cast("double")))
    return scorer


def score(frame: DataFrame, scorer: Scorer) -> DataFrame:
    """``frame`` with ``score`` between 0 and 1."""
    made = scorer.model.transform(_prepared(frame, scorer.columns, scorer.medians, scorer.scales, scorer.kind))
    out = made.select(*frame.columns, vector_to_array("probability")[1].alias("score"))
    if scorer.calibrator is not None:
        out = scorer.calibrator.setPredictionCol("_calibrated").transform(out).withColumn("score", F.least(F.greatest("_calibrated", F.lit(0.0)), F.lit(1.0))).select(*frame.columns, "score")
    return out


def threshold_candidates(validation: DataFrame, grid: list[float], quantiles: list[float]) -> list[float]:
    """The grid, and the scores that a share of the rows with a fact exceed."""
    facts = validation.filter(flag(F.col("has_fact")))
    row = facts.agg(F.percentile("score", F.array(*[F.lit(1 - q) for q in quantiles])).alias("q")).first() if quantiles else None
    return sorted({*grid, *([x for x in row["q"] if x is not None] if row and row["q"] else [])})


def score_thresholds(validation: DataFrame, candidates: list[float], target: str, horizon: int, metric: str = "lift", draws: int = 50, scale: float = LAR_SCALE_BPS) -> DataFrame:
    """(threshold, weekly, metric, mean_bps) of each candidate that sends anything; all in one query.

    ``lar`` needs ``path_value_bps`` and ``path_regret_bps``; it is the mean over corridors.
    """
    require(metric in ("lift", "lar"), "metric must be lift or lar")
    bps = advantage_bps(F.col(PRICE), F.col(f"forward_mean_h{horizon}"))
    own = validation.withColumn("_bps", bps).withColumn("threshold", F.explode(F.array(*[F.lit(float(c)) for c in candidates])))
    own = own.withColumn("_sent", (F.col("score") >= F.col("threshold")) & flag(F.col("has_fact")))
    t, s = F.col(target).cast("int"), F.col("_sent")
    weeks = F.datediff(F.max(week()), F.min(week())) / 7 + 1
    out = own.groupBy("threshold").agg((F.count_if(s) / weeks).alias("weekly"), F.coalesce(F.try_divide(F.avg(F.when(s, t)), F.avg(t)), F.lit(0.0)).alias("metric"), F.avg(F.when(s, F.col("_bps"))).alias("mean_bps"), F.count_if(s).alias("_n")).filter("_n > 0").drop("_n")
    if metric == "lar":
        lar = path_lift_at_risk(own, target, "_sent", ["threshold", KEY], draws, scale=scale).filter("lift_at_risk IS NOT NULL").groupBy("threshold").agg(F.avg("lift_at_risk").alias("metric"))
        out = out.drop("metric").join(lar, "threshold").select("threshold", "weekly", "metric", "mean_bps")
    return out


def best_threshold(scored: DataFrame, max_per_week: float = 2.5, saturation: float = 1.0) -> DataFrame:
    """One row at most: the best candidate (MDL-06).

    Only positive value counts; candidates above ``max_per_week`` only if none is below.
    The metric is worth less under ``saturation`` signals a week; ties, to nine digits, go to value,
    then to the lowest threshold.
    """
    share = F.lit(1.0) if saturation <= 0 else F.least(F.col("weekly") / saturation, F.lit(1.0))
    key = F.struct((F.col("weekly") <= max_per_week).cast("int").alias("capped"), significant(F.col("metric") * share).alias("worth"), significant(F.col("mean_bps")).alias("bps"), (-F.col("threshold")).alias("low"))
    return scored.filter("mean_bps > 0").agg(F.max_by("threshold", key).alias("threshold"))


def select_threshold(validation: DataFrame, target: str, horizon: int, grid: list[float], quantiles: list[float], max_per_week: float = 2.5, metric: str = "lift", saturation: float = 1.0) -> float:
    """The chosen threshold, or 0.8 where no candidate has positive value."""
    own = validation.filter(F.col(target).isNotNull())
    scored = score_thresholds(own, threshold_candidates(own, grid, quantiles), target, horizon, metric)
    found = best_threshold(scored, max_per_week, saturation).first()["threshold"]
    return FALLBACK_THRESHOLD if found is None else found
