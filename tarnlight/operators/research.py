"""Audits, market structure, paired comparisons and report tables (AGG-16 to AGG-31, JOIN-09 to JOIN-11, FLT-08, FLT-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.frames import DATE, KEY, PRICE, change
from tarnlight.functions.scalar import advantage_bps, corridor, flag


def business_days(first: Column, last: Column) -> Column:
    """Mondays to Fridays from ``first`` to ``last``, by arithmetic on days."""

    def before(day: Column) -> Column:
        n = F.datediff(day, F.lit("1970-01-05").cast("date"))  # a Monday
        return F.floor(n / F.lit(7)) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return before(F.date_add(last, 1)) - before(first)


def data_audit(series: DataFrame, ids: list[str], date: str, available: str = "available_at") -> DataFrame:
    """Span, count, business-day coverage and publication lag of each series (AGG-22)."""
    lag = F.datediff(available, date).cast("double")
    out = series.groupBy(*ids).agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count("*").alias("observations"), F.percentile(lag, F.lit(0.5)).alias("median_publication_lag_days"))
    return out.withColumn("business_day_coverage", F.try_divide(F.col("observations").cast("double"), business_days(F.col("start"), F.col("end"))))


def quality_profile(panel: DataFrame, target: str | None = None) -> DataFrame:
    """First and last date, rows, gaps, range, and the target's counts (AGG-27)."""
    aggs = [F.min(DATE).alias("first"), F.max(DATE).alias("last"), F.count("*").alias("n"), F.count_if(F.col(PRICE).isNull()).alias("missing"), F.min(PRICE).alias("low"), F.max(PRICE).alias("high")]
    if target:
        aggs += [F.count(target).alias("target_n"), F.count_if(F.col(target)).alias("target_sum"), F.avg(F.col(target).cast("int")).alias("target_mean")]
    return panel.groupBy(KEY).agg(*aggs)


def market_components(panel: DataFrame, context: DataFrame) -> DataFrame:
    """How much of each corridor's returns each driver explains (AGG-23, JOIN-10).

    Corridors meet drivers by date; moments are aggregated, and the residual variance follows
    from them: ``var(y) - beta^2 var(x)``.  A driver that never moves is left out.
    """
    ys = panel.select(DATE, KEY, change(F.col(PRICE)).alias("y")).filter("y IS NOT NULL")
    xs = context.select(DATE, F.col(KEY).alias("driver"), change(F.col(PRICE)).alias("x")).filter("x IS NOT NULL")
    pairs = ys.join(xs, DATE)
    m = pairs.groupBy(KEY, "driver").agg(F.count("*").alias("observations"), F.corr("y", "x").alias("correlation"), F.covar_samp("y", "x").alias("_c"), F.var_samp("x").alias("_vx"), F.var_samp("y").alias("_vy")).filter("_vx > 0")
    beta = F.col("_c") / F.col("_vx")
    residual = F.greatest(F.col("_vy") - beta * beta * F.col("_vx"), F.lit(0.0))
    return m.select(corridor(F.col(KEY)).alias("corridor"), F.concat("driver", F.lit("/RUB")).alias("driver"), "observations", "correlation", beta.alias("beta"), (1 - F.try_divide(residual, F.col("_vy"))).alias("variance_explained_r2"), F.sqrt(residual).alias("residual_volatility"))


def paired_effect(candidate: DataFrame, base: DataFrame, target: str, forward: str, by: list[str]) -> DataFrame:
    """Difference in lift and value of two streams on the same rows; null if either is silent (AGG-29, JOIN-09).

    Both frames have the row key and ``sent``; ``base`` also has the target and prices.
    """
    rows = base.join(candidate.select(KEY, DATE, F.col("sent").alias("_new")), [KEY, DATE]).filter(F.col(target).isNotNull())
    t, bps = F.col(target).cast("int"), advantage_bps(F.col(PRICE), F.col(forward))
    new, old = flag(F.col("_new")), flag(F.col("sent"))
    lift = F.try_divide(F.avg(F.when(new, t)), F.avg(t)) - F.try_divide(F.avg(F.when(old, t)), F.avg(t))
    value = F.avg(F.when(new, bps)) - F.avg(F.when(old, bps))
    known = (F.count_if(new) > 0) & (F.count_if(old) > 0)
    return rows.groupBy(*by).agg(F.when(known, lift).alias("delta_lift"), F.when(known & lift.isNotNull(), value).alias("delta_bps"))


def research_decision(min_per_week: float) -> Column:
    """unusable, insufficient_frequency, adopt or reject (FLT-10)."""
    return (
        F.when(F.coalesce("signal_count", F.lit(0)) == 0, "unusable").when(F.coalesce("signals_per_week", F.lit(0.0)) < min_per_week, "insufficient_frequency")
        .when(F.coalesce((F.col("delta_lift") > 0) & (F.col("delta_bps") >= 0), F.lit(False)), "adopt").otherwise("reject")
    )


def oot_summary(metrics: DataFrame, horizons: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row for each method of the final split, horizons as columns (AGG-18)."""

    def at(h: int, c: str) -> Column:
        return F.when(F.col("horizon") == h, F.col(c))

    aggs = [a for h in horizons for a in (F.avg(at(h, "lift")).alias(f"lift_h{h}"), F.avg(at(h, "lift_at_risk")).alias(f"lar_h{h}"), F.count(at(h, "lift_at_risk")).alias(f"corridors_with_lar_h{h}"))]
    aggs += [F.avg(at(5, "signals_per_week")).alias("signals_per_week"), F.avg(at(5, "cluster_rate")).alias("cluster_rate")]
    return metrics.filter("split = 'oot'").groupBy("method").agg(*aggs)


def oot_order() -> list[Column]:
    return [F.desc_nulls_last(c) for c in ("corridors_with_lar_h5", "lift_h5", "corridors_with_lar_h10", "lift_h10")]


def oot_ranking(summary: DataFrame) -> DataFrame:
    """``summary`` with ``place``, by :func:`oot_order`; equal methods go by name (SRT-02).  One row a method."""
    return summary.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*oot_order(), "method")))


def method_summary(metrics: DataFrame, horizon: int = 5) -> DataFrame:
    """Each method over the splits before the final one, and in it, with PASS or REVIEW (AGG-19, FLT-08)."""
    work = metrics.filter(F.col("horizon") == horizon)
    valid = F.col("lift").isNotNull()

    def ok(c: str) -> Column:
        return F.when(valid, F.col(c))

    oos = work.filter("split <> 'oot'").groupBy("method").agg(
        F.avg("lift").alias("oos_lift_mean"), F.min("lift").alias("oos_lift_worst"), F.avg((F.col("lift") >= 1.3).cast("int")).alias("oos_lift_13_share"), F.avg(ok("lift_at_risk")).alias("oos_lar_mean"),
        F.avg(ok("moment_advantage_bps")).alias("_value"), F.avg("signals_per_week").alias("signals_per_week"), F.avg("cluster_rate").alias("cluster_rate"), F.count("lift").alias("valid_slices"),
    )
    final = work.filter("split = 'oot'").groupBy("method").agg(F.avg("lift").alias("oot_lift"), F.avg("lift_at_risk").alias("oot_lar"))
    passed = F.coalesce((F.col("oos_lift_mean") >= 1.3) & (F.col("_value") > 0) & F.col("signals_per_week").between(1, 2), F.lit(False))
    return oos.join(final, "method", "left").withColumn("status", F.when(passed, "PASS").otherwise("REVIEW")).drop("_value")


def gate_shares(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Percentage of slices that meet each requirement; null fails (AGG-24)."""

    def share(held: Column) -> Column:
        return F.avg(F.coalesce(held, F.lit(False)).cast("int")) * 100

    return metrics.groupBy(*by).agg(share(F.col("lift") >= 1.3).alias("lift_ok"), share(F.col("moment_advantage_bps") > 0).alias("value_ok"), share(F.col("signals_per_week").between(1, 2)).alias("frequency_ok"))


def heatmap(metrics: DataFrame, rows: str, columns: str, values: list, value: str) -> DataFrame:
    """Means pivoted for a heat map (AGG-25)."""
    return metrics.groupBy(rows).pivot(columns, values).agg(F.avg(value))


def median_ranking(metrics: DataFrame, by: str, value: str, n: int = 5) -> DataFrame:
    """The ``n`` best medians (AGG-26)."""
    return metrics.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("median")).filter("median IS NOT NULL").orderBy(F.desc("median"), by).limit(n)


def decision_counts(decided: DataFrame, by: str, decisions: tuple[str, ...] = ("unusable", "insufficient_frequency", "adopt", "reject")) -> DataFrame:
    """How often each experiment got each decision (AGG-28)."""
    return decided.groupBy(by).pivot("decision", list(decisions)).count().fillna(0)


def experiment_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Totals of the final split (AGG-28, AGG-31)."""
    return metrics.filter("split = 'oot'").groupBy(*by).agg(F.sum("signal_count").alias("signals"), F.count_if(F.col("signal_count") > 0).alias("corridors"), F.round(F.avg("lift"), 3).alias("mean_lift"), F.round(F.avg("moment_advantage_bps"), 3).alias("mean_bps"), F.round(F.avg("signals_per_week"), 3).alias("mean_per_week"))


def with_diagnostics(metrics: DataFrame, diagnostics: DataFrame, keys: list[str], suffix: str = "_diag") -> DataFrame:
    """Metrics with diagnostic columns, suffixed where names clash (JOIN-11)."""
    renamed = diagnostics.select(*keys, *[F.col(c).alias(c + suffix if c in metrics.columns else c) for c in diagnostics.columns if c not in keys])
    return metrics.join(renamed, keys, "left")
