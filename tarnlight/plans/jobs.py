"""End-to-end jobs from a configuration: each reads panels, composes operators, and writes tables and a short report.

A configuration is a dictionary (of a YAML file): ``rates``, ``context``, ``external`` and
``public_context`` are paths of CSV or Parquet panels, ``output`` is a folder.
"""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions.frames import DATE, KEY
from tarnlight.operators import asof, backtest, features, metrics, research, search, splits, targets
from tarnlight.operators.backtest import ThresholdChoice
from tarnlight.operators.signals import SIGNALS, add_has_fact
from tarnlight.operators.validate import require, validate_panel
from tarnlight.sources import readers, sinks


def _load(spark: SparkSession, path: str, csv) -> DataFrame:
    return csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def build_frame(spark: SparkSession, config: dict) -> DataFrame:
    """The enriched panel: signals, features, labels and outcomes of the configured horizons (CTL-04)."""
    panel = validate_panel(_load(spark, config["rates"], readers.load_rates), (KEY, DATE, "rub_per_unit"))
    if config.get("corridors"):
        panel = panel.filter(F.col(KEY).isin(list(config["corridors"])))
    if config.get("as_of"):
        panel = panel.filter(F.col("available_at") <= F.lit(str(config["as_of"])).cast("date"))
    context = _load(spark, config["context"], readers.load_rates) if config.get("context") else None
    external = _load(spark, config["external"], readers.load_external) if config.get("external") else None
    holidays = spark.read.option("header", True).schema("country string, holiday date").csv(config["holidays"]) if config.get("holidays") else None
    country = F.create_map(*[F.lit(x) for kv in config["countries"].items() for x in kv])[F.col(KEY)] if config.get("countries") else None
    out = features.add_features(panel, context, external, holidays, country, rows=config.get("series_rows"), days=config.get("span_days"))
    if config.get("public_context"):
        out = asof.causal_context(out, _load(spark, config["public_context"], readers.load_public_context))
    return add_has_fact(backtest.prepare(out, tuple(config.get("horizons", (config.get("horizon", 5),))), config.get("series_rows")))


def folds_of(frame: DataFrame, config: dict) -> list[splits.Fold]:
    first, last = frame.agg(F.min(DATE), F.max(DATE)).first()
    oot = dt.date.fromisoformat(str(config.get("oot_start", "2025-09-01")))
    train_end = dt.date.fromisoformat(str(config.get("oot_train_end", "2024-09-01")))
    return splits.walk_forward_folds(first, last, int(config.get("first_test_year", 2022)), oot, train_end)


def _choice(config: dict) -> ThresholdChoice:
    return ThresholdChoice(tuple(config.get("thresholds", (0.6, 0.7, 0.8, 0.9))), tuple(config.get("quantile_rates", (0.1, 0.15, 0.2))), float(config.get("max_signals_per_week", 2.5)), float(config.get("default_threshold", 0.8)), str(config.get("ranking_metric", "lift")))


def method_stream(frame: DataFrame, folds: list[splits.Fold], config: dict, method: str, groups: list[str]) -> DataFrame:
    """Rows tested by a fold with ``sent``: of a rule, the random control, or a model (MDL-09)."""
    if method == "random":
        return metrics.random_signal(splits.assign_folds(frame, folds), by=("fold", KEY)).withColumnRenamed("random_signal", "sent")
    if method in SIGNALS:
        return splits.assign_folds(frame, folds).withColumn("sent", F.coalesce(F.col(method), F.lit(False)))
    columns = [c for c in features.columns_for_groups(groups, frame)]
    require(bool(columns), "the feature groups have no columns in this frame")
    horizon = int(config.get("horizon", 5))
    out, _ = backtest.walk_forward_predictions(frame, folds, columns, targets.target_column(config.get("target", "stay_not_worse"), horizon), horizon, method, _choice(config), config.get("iterations"))
    return out.withColumnRenamed("model_signal", "sent")


def evaluate_stream(stream: DataFrame, config: dict, name: str) -> DataFrame:
    """All metrics of one stream by fold and corridor (MDL-10)."""
    horizon = int(config.get("horizon", 5))
    target = targets.target_column(config.get("target", "stay_not_worse"), horizon)
    known = stream.filter(F.col(target).isNotNull())
    # A path must not run beyond its fold's slice, so fold and corridor make the series.
    path = targets.add_path_outcomes(known.withColumns({"_c": F.col(KEY), KEY: F.concat_ws("|", "fold", KEY)}), horizon).withColumn(KEY, F.col("_c")).drop("_c")
    return metrics.evaluate_method(path, target, "sent", horizon, ["split", "fold", KEY], draws=int(config.get("draws", 200))).withColumn("method", F.lit(name))


def _write(df: DataFrame, config: dict, name: str) -> DataFrame:
    path = f"{config['output']}/{name}"
    sinks.write_table(df, path)
    return df.sparkSession.read.parquet(path)


def _report(config: dict, title: str, **parts: DataFrame) -> str:
    text = f"# {title}\n\n" + "\n".join(f"## {name.replace('_', ' ')}\n\n{sinks.markdown(df)}" for name, df in parts.items())
    Path(config["output"]).mkdir(parents=True, exist_ok=True)
    Path(config["output"], "REPORT.md").write_text(text, encoding="utf-8")
    return text


def run_baseline(spark: SparkSession, config: dict) -> str:
    table = _write(backtest.baseline(build_frame(spark, config), tuple(config.get("horizons", (1, 3, 5, 10, 20)))), config, "baseline")
    return _report(config, "Baseline rules", lift=table.orderBy("horizon", "indicator", KEY))


def run_summary(spark: SparkSession, config: dict) -> str:
    """Every configured method over the folds (also ``train``, with one method)."""
    frame = build_frame(spark, config)
    folds, out = folds_of(frame, config), None
    for m in config.get("methods", [{"method": s} for s in SIGNALS]):
        name = m.get("name", m["method"])
        one = evaluate_stream(method_stream(frame, folds, config, m["method"], m.get("feature_groups", [])), config, name)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    table = _write(out, config, "metrics")
    return _report(config, "Methods", summary=research.method_summary(table, int(config.get("horizon", 5))).orderBy("status", F.desc_nulls_last("oos_lar_mean")), final=research.experiment_summary(table, ["method"]))


def run_search(spark: SparkSession, config: dict) -> str:
    frame = build_frame(spark, config)
    horizon = int(config.get("horizon", 5))
    target = targets.target_column(config.get("target", "stay_not_worse"), horizon)
    found = search.indicator_search(frame, folds_of(frame, config), target, horizon, search.Screening(**config.get("screening", {})), tuple(config.get("cooldown_prints", (1, 2, 3, 5))), config.get("series_rows"))
    screening = tests = None
    for f in found:
        screening = f.screening if screening is None else screening.unionByName(f.screening)
        tests = f.test if tests is None else tests.unionByName(f.test)
    screening, tests = _write(screening, config, "screening"), _write(tests, config, "streams")
    chosen = spark.createDataFrame([(f.fold, f.rule_id, f.cooldown) for f in found], "fold string, rule_id string, cooldown int")
    discovery = tests.filter(F.col("fold") != found[-1].fold) if len(found) > 1 else tests
    return _report(config, "Rule search", chosen=chosen, discovery=search.discovery_effect(discovery), screening=screening.filter("passed").groupBy("fold", "family").count())


def run_research(spark: SparkSession, config: dict) -> str:
    """Experiments against a baseline experiment, row by row (CTL-06)."""
    frame = build_frame(spark, config)
    folds, horizon = folds_of(frame, config), int(config.get("horizon", 5))
    target, forward = targets.target_column(config.get("target", "stay_not_worse"), horizon), f"forward_mean_h{horizon}"
    streams = {e["name"]: method_stream(frame, folds, config, e["method"], e.get("feature_groups", [])) for e in config["experiments"]}
    base_name = config.get("baseline_experiment", config["experiments"][0]["name"])
    require(base_name in streams, f"unknown baseline experiment {base_name!r}")
    base, out = streams[base_name], None
    for name, stream in streams.items():
        if name == base_name:
            continue
        effect = research.paired_effect(stream, base, target, forward, ["split", KEY])
        span = F.greatest(F.datediff(F.max(DATE), F.min(DATE)) / 7.0, F.lit(1.0))
        counts = stream.filter(F.col(target).isNotNull()).groupBy("split", KEY).agg(F.count_if("sent").alias("signal_count"), (F.count_if("sent") / span).alias("signals_per_week"))
        one = counts.join(effect, ["split", KEY]).withColumns({"experiment": F.lit(name), "baseline": F.lit(base_name), "horizon": F.lit(horizon)})
        out = one if out is None else out.unionByName(one)
    require(out is not None, "research needs at least two experiments")
    table = _write(out.withColumn("decision", research.research_decision(float(config.get("decision_min_signals_per_week", 0.8)))), config, "paired")
    audit = research.data_audit(frame, [KEY], DATE)
    return _report(config, "Research", data=audit, decisions=research.decision_counts(table, "experiment"))


def run_signals(spark: SparkSession, config: dict) -> str:
    """Messages of a cutoff day (``as_of``)."""
    as_of = dt.date.fromisoformat(str(config["as_of"]))
    frame = build_frame(spark, config)
    horizon = int(config.get("horizon", 5))
    allowed = tuple(config.get("allowed_signals", SIGNALS))
    texts = readers.text_library(spark, config["scenarios"], config.get("forbidden", []), set(allowed))
    columns = features.columns_for_groups(list(config.get("feature_groups", ["A", "B"])), frame)
    out = backtest.signal_snapshot(frame, texts, as_of, columns, targets.target_column(config.get("target", "stay_not_worse"), horizon), horizon, config.get("model", "logreg"), allowed, _choice(config), config.get("iterations"))
    sinks.write_table(out.coalesce(1), f"{config['output']}/signals", "csv")
    return _report(config, f"Signals of {as_of}", signals=out)


JOBS = {"baseline": run_baseline, "train": run_summary, "summary": run_summary, "backtest-report": run_summary, "indicator-search": run_search, "indicator-report": run_search, "research": run_research, "signals": run_signals}
