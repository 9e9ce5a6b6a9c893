"""Numeric features by group (WIN-01 to WIN-13, JOIN-01): A signals, B shape, C returns, D context, E calendar, F external."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.chunks import CHUNK, PLACE, Pieces
from tarnlight.functions.frames import DATE, KEY, PRICE, carried_in, change, full, last_rows, rank_share, rows_since_minimum, run_length, running_sum, series
from tarnlight.operators.asof import external_asof, next_holiday
from tarnlight.operators.signals import BASELINE, add_baseline, add_has_fact, add_research, falling
from tarnlight.operators.validate import require

# Fixed column names of the groups.
GROUP_A = BASELINE
GROUP_B = ("down_streak", "price_percentile", "days_since_min", "rebound_pct", "days_to_holiday")
GROUP_C = ("ret_1", "ret_3", "ret_5", "ret_10", "ret_20", "vol_20", "slope_20")
GROUP_E = ("month", "weekday")
CONTEXT = ("USD", "EUR", "CNY")
SUFFIXES = ("ret_1", "ret_5", "percentile", "vol_20")


def carry_runs(pieces: Pieces, fall: Column) -> None:
    """Gives the chunks of a price series ``_in_run``: for how many rows ``fall`` has held when the chunk begins."""
    seen = pieces.run(lambda x: x.withColumn("_fall", fall), whole=True)
    broken = seen.groupBy(KEY, CHUNK).agg(F.max(F.when(~F.col("_fall"), F.col(PLACE))).alias("_broken"))
    pieces.carry(broken, _in_run=lambda before: F.col(CHUNK) * pieces.rows - 1 - F.coalesce(F.max("_broken").over(before), F.lit(-1)))


def add_series_features(panel: DataFrame, level_window: int = 90, low_window: int = 20, rows: int | None = None) -> DataFrame:
    """Groups B (without holidays), C and E: one exchange and one sort, of series or of their chunks of ``rows`` rows."""
    if rows:
        pieces = Pieces(panel, rows, max(level_window, low_window, 20))
        carry_runs(pieces, falling())
        return pieces.run(lambda x: add_series_features(x, level_window, low_window))
    p, w = F.col(PRICE), last_rows(low_window)
    out = panel.withColumns({"_fall": falling(), "ret_1": change(p)})
    low = full(F.min, p, w, low_window)
    out = out.withColumns({
        "price_percentile": rank_share(p, level_window),
        "days_since_min": rows_since_minimum(p, low_window),
        "rebound_pct": F.when(low > 0, p / low - 1),
        **{f"ret_{n}": change(p, n) for n in (3, 5, 10, 20)},
        "vol_20": full(F.stddev_samp, F.col("ret_1"), last_rows(20), 20),
        "_row": F.row_number().over(series()).cast("double"),
        "month": F.month(DATE).cast("double"),
        "weekday": F.weekday(DATE).cast("double"),
    })
    out = out.withColumns({
        "slope_20": F.when(F.count(p).over(last_rows(20)) == 20, F.regr_slope(p, F.col("_row")).over(last_rows(20))),
        "down_streak": run_length(F.col("_fall"), carried_in(panel, "run")).cast("double"),
    })
    return out.drop("_fall", "_row")


def _shape(value: Column, prefix: str, key: str, date: str) -> dict[str, Column]:
    """Returns, percentile and volatility of one date-level series; ``prefix_ret_1`` must exist for the volatility."""
    return {
        f"{prefix}_ret_5": change(value, 5, key, date),
        f"{prefix}_percentile": rank_share(value, 90, key, date),
        f"{prefix}_vol_20": full(F.stddev_samp, F.col(f"{prefix}_ret_1"), last_rows(20, key, date), 20),
    }


def _filled(long: DataFrame) -> DataFrame:
    """``long`` (ctx, date, v) with the last known ``v`` of each context series."""
    known = F.last("v", ignorenulls=True).over(series("ctx").rowsBetween(Window.unboundedPreceding, 0))
    return long.withColumn("v", F.coalesce(known, F.col("_in_v")) if "_in_v" in long.columns else known)


def _context_shape(long: DataFrame) -> DataFrame:
    return long.withColumn("x_ret_1", change(F.col("v"), 1, "ctx")).withColumns(_shape(F.col("v"), "x", "ctx", DATE))


def context_features(panel: DataFrame, context: DataFrame, rows: int | None = None) -> DataFrame:
    """(date, <ctx>_ret_1, ..): context currencies on the panel's dates, carried forward (JOIN-01, WIN-10).

    Dates and the few context currencies make a small table; it is keyed by currency so that
    each context series is a window partition of its own, and pivoted last.
    """
    dates = panel.select(DATE).distinct()
    grid = dates.withColumn("ctx", F.explode(F.array(*[F.lit(c) for c in CONTEXT])))
    known = context.filter(F.col("currency").isin(*CONTEXT)).groupBy(DATE, F.col("currency").alias("ctx")).agg(F.min(PRICE).alias("v"))
    long = grid.join(known, [DATE, "ctx"], "left")
    if rows:
        pieces = Pieces(long, rows, 0, key="ctx")
        pieces.carry(pieces.summary(_v=F.max_by("v", F.when(F.col("v").isNotNull(), F.col(PLACE)))), _in_v=lambda before: F.last("_v", ignorenulls=True).over(before))
        long = Pieces(pieces.run(_filled), rows, 91, key="ctx").run(_context_shape)
    else:
        long = _context_shape(_filled(long))
    wide = long.groupBy(DATE).pivot("ctx", list(CONTEXT)).agg(*[F.first(f"x_{s}").alias(s) for s in SUFFIXES])
    return wide.select(DATE, *[F.col(f"{c}_{s}").alias(f"{c.lower()}_{s}") for c in CONTEXT for s in SUFFIXES])


def _crosses(panel: DataFrame) -> DataFrame:
    out = panel
    for ctx in ("usd", "cny"):
        name = f"local_per_{ctx}"
        level = F.exp(running_sum(F.log1p(F.coalesce(F.col(f"{name}_ret_1"), F.lit(0.0))), carried_in(panel, name)))
        out = out.withColumn("_level", level)
        out = out.withColumns({f"{name}_percentile": rank_share(F.col("_level"), 90), f"{name}_vol_20": full(F.stddev_samp, F.col(f"{name}_ret_1"), last_rows(20), 20)}).drop("_level")
    return out


def add_context(panel: DataFrame, context: DataFrame, rows: int | None = None) -> DataFrame:
    """Group D: context columns, the residual and synthetic crosses (PRJ-05, PRJ-06, WIN-12); needs ``ret_1`` and ``ret_5``."""
    out = panel.join(context_features(panel, context, rows), DATE, "left")
    out = out.withColumn("residual_usd_1", F.col("ret_1") - F.col("usd_ret_1"))
    crosses = [f"local_per_{ctx}" for ctx in ("usd", "cny")]
    out = out.withColumns({f"{name}_ret_{n}": F.col(f"{name[-3:]}_ret_{n}") - F.col(f"ret_{n}") for name in crosses for n in (1, 5)})
    if not rows:
        return _crosses(out)
    pieces = Pieces(out, rows, 90)
    sums = pieces.summary(**{f"_{name}": F.sum(F.log1p(F.coalesce(F.col(f"{name}_ret_1"), F.lit(0.0)))) for name in crosses})
    pieces.carry(sums, **{f"_in_{name}": lambda before, name=name: F.sum(f"_{name}").over(before) for name in crosses})
    return pieces.run(_crosses)


def external_features(panel: DataFrame, external: DataFrame, rows: int | None = None, days: int | None = None) -> DataFrame:
    """(date, series, value, ret_1, ret_5, percentile, vol_20, staleness_days): group F in long form (WIN-11)."""
    long = external_asof(panel, external, days=days)
    v = F.col("value")

    def shaped(own: DataFrame) -> DataFrame:
        # Before a series' first value there is nothing; a change from it is null too.
        return own.withColumn("x_ret_1", change(v, 1, "series")).withColumns(_shape(v, "x", "series", DATE))

    long = Pieces(long, rows, 91, key="series").run(shaped) if rows else shaped(long)
    return long.select(DATE, "series", "value", *[F.col(f"x_{s}").alias(s) for s in SUFFIXES], "staleness_days")


def add_external(panel: DataFrame, external: DataFrame, rows: int | None = None, days: int | None = None) -> DataFrame:
    """Group F as columns ``ext_<series>_<suffix>``."""
    long = external_features(panel, external, rows, days)
    names = sorted(r[0] for r in long.select("series").distinct().collect())
    suffixes = (*SUFFIXES, "staleness_days")
    wide = long.groupBy(DATE).pivot("series", names).agg(*[F.first(s).alias(s) for s in suffixes])
    wide = wide.select(DATE, *[F.col(f"`{n}_{s}`").alias(f"ext_{n}_{s}") for n in names for s in suffixes])
    return panel.join(wide, DATE, "left")


def add_features(panel: DataFrame, context: DataFrame | None = None, external: DataFrame | None = None, holidays: DataFrame | None = None, country: Column | None = None, level_window: int = 90, low_window: int = 20, rows: int | None = None, days: int | None = None) -> DataFrame:
    """Signals and all feature groups that the inputs allow (WIN-13).

    ``rows`` cuts long series into chunks, ``days`` the series of as-of joins into spans of time.
    """
    out = panel if BASELINE[0] in panel.columns else add_baseline(panel, holidays, country, level_window=level_window, reversal_window=low_window, rows=rows, days=days)
    if "signal_better_range_held" not in out.columns:
        out = add_research(out, rows=rows)
    out = add_series_features(out, level_window, low_window, rows)
    if "days_to_holiday" not in out.columns:
        out = out.withColumn("days_to_holiday", F.lit(None).cast("double")) if holidays is None else next_holiday(out, holidays, country, days=days)
    if context is not None:
        out = add_context(out, context, rows)
    if external is not None:
        out = add_external(out, external, rows, days)
    return add_has_fact(out)


def columns_for_groups(groups: list[str], frame: DataFrame) -> list[str]:
    """The frame's columns of some groups, each once, in order (PRJ-08)."""
    have = frame.columns
    d = [f"{p}_{s}" for p in ("usd", "eur", "cny") for s in SUFFIXES] + ["residual_usd_1"] + [f"local_per_{c}_{s}" for c in ("usd", "cny") for s in SUFFIXES]
    f = [c for c in have if c.startswith("ext_") and c.endswith((*SUFFIXES, "staleness_days"))]
    known = {"A": GROUP_A, "B": GROUP_B, "C": GROUP_C, "D": d, "E": GROUP_E, "F": f}
    for g in groups:
        require(g in known, f"unknown feature group {g!r}")
    return list(dict.fromkeys(c for g in groups for c in known[g] if c in have))
