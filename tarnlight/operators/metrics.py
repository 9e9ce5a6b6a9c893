"""Evaluation metrics by group (AGG-01 to AGG-17, RND-01 to RND-04, WIN-14, WIN-15).

Every metric takes ``by``, the columns that make one slice (corridor, method, split, horizon),
so that one query evaluates all slices in parallel.  ``target`` and ``signal`` are boolean
columns; a null target is not eligible, a null signal is not sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.frames import DATE, KEY, PRICE
from tarnlight.functions.scalar import LAR_RHO, LAR_SCALE_BPS, advantage_bps, flag, lift_at_risk
from tarnlight.operators.validate import require
from tarnlight.session import written


def week(date: str = DATE) -> Column:
    """The Monday of a date's week."""
    return F.date_trunc("week", F.col(date)).cast("date")


def hit_rate(target: Column, signal: Column) -> Column:
    """Mean target of sent, eligible rows."""
    return F.avg(F.when(flag(signal), target.cast("int")))


def lift(target: Column, signal: Column) -> Column:
    """Hit rate over prevalence; null where either is unknown or prevalence is zero."""
    return F.try_divide(hit_rate(target, signal), F.avg(target.cast("int")))


def unpivot(frame: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Long form of boolean columns."""
    return frame.unpivot(ids, columns, name, value)


def lift_by_indicator(frame: DataFrame, target: str, indicators: list[str], by: list[str]) -> DataFrame:
    """One row for each slice and indicator (AGG-03); weeks are those with eligible rows, empty ones between included."""
    eligible = frame.filter(F.col(target).isNotNull())
    long = unpivot(eligible, [*by, DATE, target], indicators, "indicator", "sent")
    t, s = F.col(target), F.col("sent")
    weeks = F.datediff(F.max(week()), F.min(week())) / 7 + 1
    return long.groupBy(*by, "indicator").agg(
        F.count("*").alias("eligible_days"), F.count_if(flag(s)).alias("signal_count"), F.count_if(t).alias("target_positives"),
        hit_rate(t, s).alias("signal_hit_rate"), F.avg(t.cast("int")).alias("random_hit_rate"), lift(t, s).alias("lift"), (F.count_if(flag(s)) / weeks).alias("signals_per_week"),
    )


def worst_share(losses: DataFrame, loss: str, by: list[str], confidence: float = 0.95, name: str = "cvar") -> DataFrame:
    """Mean of the worst ``max(1, ceil((1 - confidence) * n - 1e-12))`` losses of each slice (AGG-08).

    Ranks run within a slice; ties share the same mean whichever of them is taken.
    """
    require(0 < confidence < 1, "confidence must be between 0 and 1")
    own = losses.filter(F.col(loss).isNotNull())
    own = own.withColumn(loss, F.when(F.col(loss) >= 0, F.col(loss)).otherwise(F.raise_error(F.lit("losses must not be negative")).cast("double")))
    ranked = own.withColumns({"_n": F.count("*").over(Window.partitionBy(*by)), "_k": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(loss)))})
    worst = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(1 - confidence) - 1e-12))
    return ranked.filter(F.col("_k") <= worst).groupBy(*by).agg(F.avg(loss).alias(name))


def outcome(name: str, horizon: int | None) -> str:
    """The column of an outcome; without a horizon, that of a frame in which the horizon is a column too."""
    return name if horizon is None else f"{name}_h{horizon}"


def customer_outcomes(frame: DataFrame, signal: str, horizon: int | None, by: list[str]) -> DataFrame:
    """Value and regret of what was sent (AGG-07); the outcome columns must exist."""
    value, regret = outcome("moment_advantage_bps", horizon), outcome("customer_regret_bps", horizon)
    sent = frame.filter(flag(F.col(signal)))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(regret)))
    sums = sent.withColumn("_k", place).groupBy(*by).agg(
        F.count(value).alias("value_observations"), F.avg(value).alias("moment_advantage_bps"), F.count(regret).alias("regret_observations"),
        F.avg(regret).alias("customer_regret_bps_mean"), F.max(regret).alias("customer_regret_bps_max"),
        F.avg(F.when(F.col("_k") <= 5, F.col(regret))).alias("customer_regret_worst_five_mean_bps"),
    )
    return sums.join(worst_share(sent, regret, by, name="customer_regret_cvar_95_bps"), by, "left")


def weekly_counts(frame: DataFrame, signal: str, by: list[str]) -> DataFrame:
    """(by, week, pushes) for every week from a slice's first to its last, empty ones included (AGG-09)."""
    sums = frame.groupBy(*by, week().alias("week")).agg(F.count_if(flag(F.col(signal))).alias("n"))
    span = sums.groupBy(*by).agg(F.min("week").alias("a"), F.max("week").alias("b"))
    grid = span.select(*by, F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week"))
    return grid.join(sums, [*by, "week"], "left").select(*by, "week", F.coalesce("n", F.lit(0)).alias("pushes"))


def cluster_rate(frame: DataFrame, signal: str, by: list[str], cooldown_days: int = 3) -> DataFrame:
    """Share of sent rows at most ``cooldown_days`` after the one before (WIN-15)."""
    sent = frame.filter(flag(F.col(signal)))
    gap = F.datediff(DATE, F.lag(DATE).over(Window.partitionBy(*by).orderBy(DATE)))
    return sent.withColumn("_gap", gap).groupBy(*by).agg((F.count_if(F.col("_gap") <= cooldown_days) / F.count("*")).alias("cluster_rate"))


def cluster_share(frame: DataFrame, signal: str, by: list[str]) -> DataFrame:
    """Share of sent rows whose previous row was sent too (WIN-14)."""
    s = flag(F.col(signal))
    before = F.lag(s, 1, False).over(Window.partitionBy(*by).orderBy(DATE))
    return frame.select(*by, s.alias("_s"), (s & before).alias("_b")).groupBy(*by).agg(F.try_divide(F.count_if("_b").cast("double"), F.count_if("_s")).alias("cluster_share"))


def frequency_summary(frame: DataFrame, signal: str, by: list[str], weekly_limit: int = 2, cooldown_days: int = 3) -> DataFrame:
    """Push load by week (AGG-10, AGG-11)."""
    require(weekly_limit >= 0 and cooldown_days >= 0, "limits must not be negative")
    c = F.col("pushes")
    weeks = weekly_counts(frame, signal, by).groupBy(*by).agg(
        F.sum(c).alias("signal_count"), F.count("*").alias("eligible_weeks"), F.avg(c).alias("pushes_per_week"),
        F.percentile(c, F.lit(0.5)).alias("pushes_p50_per_week"), F.percentile(c, F.lit(0.9)).alias("pushes_p90_per_week"),
        F.avg((c == 0).cast("int")).alias("zero_push_week_rate"), F.avg((c > weekly_limit).cast("int")).alias("over_budget_week_rate"),
    )
    return weeks.join(cluster_rate(frame, signal, by, cooldown_days), by, "left")


def useful_signals(frame: DataFrame, target: str, signal: str, by: list[str]) -> DataFrame:
    """Right pushes per eligible week and per 100 of them (AGG-12)."""
    eligible = frame.filter(F.col(target).isNotNull()).withColumn("_useful", F.col(target) & flag(F.col(signal)))
    rate = F.sum("pushes") / F.count("*")
    return weekly_counts(eligible, "_useful", by).groupBy(*by).agg(rate.alias("useful_signals_per_week"), (rate * 100).alias("useful_signals_per_100_weeks"))


def draw_rank(seed: str, keys: list[str]) -> Column:
    """A random order that any engine can repeat: the MD5 of seed, draw and keys (RND-04)."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"), *[F.col(k).cast("string") for k in keys]))


def with_draws(frame: DataFrame, draws: int) -> DataFrame:
    """Each row once for each draw."""
    return frame.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))


def matched_draws(frame: DataFrame, signal: str, by: list[str], draws: int, seed: str = "lar") -> DataFrame:
    """Rows picked at random, for each draw as many in each slice and week as were sent (RND-01).

    A slice's weeks are dealt out by themselves, and draws multiply rows only where they already are; weeks in which nothing was sent stay behind.
    """
    require(draws >= 1, "draws must be at least 1")
    own = frame.withColumn("_week", week())
    own = own.withColumn("_sent", F.count_if(flag(F.col(signal))).over(Window.partitionBy(*by, "_week"))).filter("_sent > 0")
    place = F.row_number().over(Window.partitionBy(*by, "draw", "_week").orderBy(draw_rank(seed, [*by, DATE])))
    return with_draws(own, draws).withColumn("_place", place).filter("_place <= _sent").drop("_place", "_sent", "_week")


def mask_violations(frame: DataFrame, masks: DataFrame, eligible: Column, signal: str, by: list[str], rows: list[str] = [KEY, DATE]) -> DataFrame:  # noqa: B006
    """One row of counts, each of which must be zero, for given draws: ``masks`` (draw, rows.., drawn), a null as not drawn (RND-01).

    ``other_length``: draws that don't have one row for each row of the frame; ``outside``: drawn rows that the frame hasn't; ``ineligible``: drawn
    rows that can't be judged; ``other_count``: draws of a slice of another size than what was sent of it.
    """
    names = list(dict.fromkeys([*by, *rows]))
    own = frame.select(*names, F.coalesce(eligible, F.lit(False)).alias("_eligible"), flag(F.col(signal)).alias("_sent"))
    drawn = masks.select("draw", *rows, flag(F.col("drawn")).alias("_drawn"))
    met = drawn.join(own.withColumn("_in", F.lit(True)), rows, "left")
    known = F.coalesce(F.col("_in"), F.lit(False))
    single = met.agg(F.count_if(F.col("_drawn") & ~known).alias("outside"), F.count_if(F.col("_drawn") & known & ~F.col("_eligible")).alias("ineligible"))
    size = own.agg(F.count("*").alias("_rows"))
    lengths = met.groupBy("draw").agg(F.count("*").alias("_n"), F.count_distinct(*[F.when(known, F.col(c)) for c in rows]).alias("_d")).crossJoin(F.broadcast(size))  # a row a draw, and one row
    lengths = lengths.agg(F.count_if((F.col("_n") != F.col("_rows")) | (F.col("_d") != F.col("_rows"))).alias("other_length"))
    sent = own.groupBy(*by).agg(F.count_if(F.col("_sent") & F.col("_eligible")).alias("_want"))
    had = met.filter(known).groupBy(*by, "draw").agg(F.count_if(F.col("_drawn") & F.col("_eligible")).alias("_had"))
    counts = had.join(sent, by).agg(F.count_if(F.col("_had") != F.col("_want")).alias("other_count"))
    return lengths.crossJoin(single).crossJoin(counts)  # three single rows


def given_draws(frame: DataFrame, masks: DataFrame, eligible: Column, signal: str, by: list[str], rows: list[str] = [KEY, DATE]) -> DataFrame:  # noqa: B006
    """The drawn rows of each given draw; an error if there is none, or if the draws break :func:`mask_violations`."""
    require(masks.limit(1).count() > 0, "there must be at least one draw")
    bad = {k: v for k, v in mask_violations(frame, masks, eligible, signal, by, rows).first().asDict().items() if v}
    require(not bad, f"the given draws don't fit the frame: {bad}")
    return frame.join(masks.filter(flag(F.col("drawn"))).select("draw", *rows), rows)


def uniform_draws(frame: DataFrame, count: Column, by: list[str], draws: int, seed: str = "uniform") -> DataFrame:
    """Rows picked at random: ``count`` of each slice, for each draw (RND-02)."""
    place = F.row_number().over(Window.partitionBy(*by, "draw").orderBy(draw_rank(seed, [*by, DATE])))
    return with_draws(frame.withColumn("_count", count), draws).withColumn("_place", place).filter("_place <= _count").drop("_place", "_count")


def random_signal(frame: DataFrame, per_week: float = 1.5, by: tuple[str, ...] = ("currency",), seed: str = "random") -> DataFrame:
    """``frame`` with ``random_signal``: about ``per_week`` rows a week of each slice (RND-03)."""
    slice_ = Window.partitionBy(*by)
    weeks = F.greatest(F.datediff(F.max(DATE).over(slice_), F.min(DATE).over(slice_)) / 7.0, F.lit(1.0))
    count = F.least(F.bround(F.lit(per_week) * weeks), F.count("*").over(slice_).cast("double"))
    ranked = frame.withColumn("draw", F.lit(1)).withColumn("_count", count)
    place = F.row_number().over(slice_.orderBy(draw_rank(seed, [*by, DATE])))
    return ranked.withColumn("random_signal", place <= F.col("_count")).drop("draw", "_count")


def matched_hit_rate(frame: DataFrame, target: str, signal: str, by: list[str], draws: int = 50, seed: str = "hit") -> DataFrame:
    """Mean hit rate of random picks of the same size (AGG-04); its expectation is the prevalence."""
    eligible = frame.filter(F.col(target).isNotNull())
    sent = F.count_if(flag(F.col(signal))).over(Window.partitionBy(*by))
    picked = uniform_draws(eligible, sent, by, draws, seed)
    return picked.groupBy(*by, "draw").agg(F.avg(F.col(target).cast("int")).alias("h")).groupBy(*by).agg(F.avg("h").alias("freq_matched_hit_rate"))


def path_lift_at_risk(frame: DataFrame, target: str, signal: str, by: list[str], draws: int = 200, confidence: float = 0.95, seed: str = "lar", rho: float = LAR_RHO, scale: float = LAR_SCALE_BPS, masks: DataFrame | None = None) -> DataFrame:
    """Lift-at-risk of each slice against random sends (AGG-14, AGG-15); ``path_value_bps`` and ``path_regret_bps`` must exist.

    The sends are ``draws`` random ones of as many rows a week, or those of the given ``masks``.
    What is looked at is written once, as its five columns are read for counts, for what was sent and for the draws.
    """
    named = list(dict.fromkeys([*by, *([KEY] if KEY in frame.columns else []), DATE]))
    frame = written(frame.select(*named, target, signal, "path_value_bps", "path_regret_bps"), "paths")
    known = F.col(target).isNotNull() & F.col("path_value_bps").isNotNull() & F.col("path_regret_bps").isNotNull()
    counts = frame.groupBy(*by).agg(F.count_if(known).alias("eligible_count"), F.count_if(known & flag(F.col(signal))).alias("signal_count"), F.count_if(~known & flag(F.col(signal))).alias("excluded_signal_count"))
    eligible = frame.filter(known)
    own = judged(eligible.filter(flag(F.col(signal))), target, by, confidence, ("signal_hit_rate", "signal_value_bps", "signal_tail_regret_bps"))
    picked = matched_draws(eligible, signal, by, draws, seed) if masks is None else given_draws(frame, masks, known, signal, by)
    each = judged(picked, target, [*by, "draw"], confidence, ("h", "v", "r"))
    rand = each.groupBy(*by).agg(F.avg("h").alias("random_hit_rate"), F.avg("v").alias("random_value_bps"), F.avg("r").alias("random_tail_regret_bps"))
    out = counts.join(own, by, "left").join(rand, by, "left").withColumn("lift", F.try_divide("signal_hit_rate", "random_hit_rate"))
    delta = (F.col("signal_value_bps") - F.col("random_value_bps")) - rho * (F.col("signal_tail_regret_bps") - F.col("random_tail_regret_bps"))
    score = lift_at_risk(F.col("lift"), F.col("signal_value_bps"), F.col("random_value_bps"), F.col("signal_tail_regret_bps"), F.col("random_tail_regret_bps"), rho, scale)
    return out.withColumns({"delta_utility_bps": delta, "lift_at_risk": score})


def judged(sent: DataFrame, target: str, by: list[str], confidence: float, names: tuple[str, str, str]) -> DataFrame:
    """Mean hit, mean value and mean worst regret of what was sent in each slice, in one pass; regrets are known and not negative."""
    require(0 < confidence < 1, "confidence must be between 0 and 1")
    loss = F.col("path_regret_bps")
    loss = F.when(loss >= 0, loss).otherwise(F.raise_error(F.lit("losses must not be negative")).cast("double"))
    slice_ = Window.partitionBy(*by)
    ranked = sent.select(*by, F.col(target).cast("int").alias("_h"), F.col("path_value_bps").alias("_v"), loss.alias("_r"))
    ranked = ranked.withColumns({"_n": F.count("*").over(slice_), "_k": F.row_number().over(slice_.orderBy(F.desc("_r")))})
    worst = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(1 - confidence) - 1e-12))
    return ranked.groupBy(*by).agg(F.avg("_h").alias(names[0]), F.avg("_v").alias(names[1]), F.avg(F.when(F.col("_k") <= worst, F.col("_r"))).alias(names[2]))


def evaluate_method(frame: DataFrame, target: str, signal: str, horizon: int | None, by: list[str], draws: int = 200, weekly_limit: int = 2, cooldown_days: int = 3, seed: str = "lar", scale: float = LAR_SCALE_BPS) -> DataFrame:
    """One row for each slice with all metrics (AGG-05, AGG-06); outcome, path and forward-mean columns must exist.

    Without ``horizon``, it is one of the columns ``by``.
    """
    own = frame.filter(F.col(target).isNotNull() & F.col(PRICE).isNotNull())
    t, s = F.col(target), F.col(signal)
    bps = advantage_bps(F.col(PRICE), F.col(outcome("forward_mean", horizon)))
    base = own.groupBy(*by).agg(F.count("*").alias("eligible_days"), F.count_if(t).alias("target_positives"), hit_rate(t, s).alias("signal_hit_rate"), F.avg(t.cast("int")).alias("random_hit_rate"), lift(t, s).alias("lift"), F.avg(F.when(flag(s), bps)).alias("bps_forward"))
    lar = path_lift_at_risk(own, target, signal, by, draws, seed=seed, scale=scale)
    lar = lar.select(*by, "lift_at_risk", *[F.col(c).alias(f"lar_{c}") for c in lar.columns if c not in (*by, "lift_at_risk")])
    parts = [customer_outcomes(own, signal, horizon, by), useful_signals(own, target, signal, by), frequency_summary(own, signal, by, weekly_limit, cooldown_days), cluster_share(own, signal, by), matched_hit_rate(own, target, signal, by), lar]
    for part in parts:
        base = base.join(part, by, "left")
    out = base.withColumns({"lift_freq_matched": F.when(F.col("signal_count") > 0, F.try_divide("signal_hit_rate", "freq_matched_hit_rate")), "signals_per_week": F.col("pushes_per_week")})
    return out if horizon is None else out.withColumn("horizon", F.lit(horizon))


def stability(metrics: DataFrame, columns: list[str], lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """(metric, slice_count, worst, median, best) over slices, never pooled (AGG-16)."""
    require(set(lower_is_better) <= set(columns), "lower_is_better names an unknown metric")
    own = metrics.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = own.unpivot([], columns, "metric", "value")
    lower = F.first(F.col("metric").isin(*lower_is_better)) if lower_is_better else F.lit(False)
    sums = long.groupBy("metric").agg(F.count("value").alias("slice_count"), F.min("value").alias("low"), F.max("value").alias("high"), F.percentile("value", F.lit(0.5)).alias("median"), lower.alias("_l"))
    return sums.select("metric", "slice_count", F.when(F.col("_l"), F.col("high")).otherwise(F.col("low")).alias("worst"), "median", F.when(F.col("_l"), F.col("low")).otherwise(F.col("high")).alias("best"))
