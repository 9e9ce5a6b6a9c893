"""Boolean rule signals and their effects (SIG-01 to SIG-15).

An effect is the relative change in units received that a signal speaks of; positive is
better.  Research signals are null while their window is incomplete; momentum and
seasonality are false instead.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.chunks import Pieces
from tarnlight.functions.frames import DATE, KEY, PRICE, change, crossing, full, lagged, last_rows, quantile, rising_edge, series
from tarnlight.functions.scalar import reciprocal
from tarnlight.operators.asof import annual_reference, next_holiday
from tarnlight.operators.validate import require, require_columns

#: Fixed names of the signals.
BASELINE = ("signal_momentum", "signal_level", "signal_reversal", "signal_seasonality")
RESEARCH = (
    "signal_better_than_one_year_ago",
    "signal_better_range_held",
    "signal_larger_than_usual_latest_improvement",
    "signal_better_than_30_day_average",
    "signal_most_recent_changes_favourable",
    "signal_less_than_one_year_ago",
    "signal_most_recent_changes_unfavourable",
)
#: In this order, which breaks ties.
SIGNALS = BASELINE + RESEARCH


def effect_column(signal: str) -> str:
    return f"{signal}_effect"


@dataclass(frozen=True)
class Thresholds:
    """Of the research signals, as decimal fractions; zero shows the bare direction."""

    year_gain: float = 0.0
    range_gain: float = 0.0
    unusual_floor: float = 0.0
    average_30_day_gain: float = 0.0
    recent_gain: float = 0.0
    year_loss: float = 0.0
    recent_loss: float = 0.0
    unusual_multiplier: float = 2.0
    unusual_epsilon: float = 1e-12
    annual_max_gap_days: int = 7

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            require(value > 0 if f.name in ("unusual_multiplier", "unusual_epsilon") else value >= 0, f"{f.name} is out of range")


def falling() -> Column:
    """Whether the price is below the one before; false on the first row."""
    return F.coalesce(F.col(PRICE) < lagged(F.col(PRICE)), F.lit(False))


def momentum(days: int) -> Column:
    """``days`` falls in a row."""
    return F.coalesce(F.sum("_fall").over(last_rows(days)) == days, F.lit(False))


def _baseline(panel: DataFrame, momentum_days: int, level_window: int, level_quantile: float, reversal_window: int) -> DataFrame:
    """Momentum, level and reversal of each series."""
    p, recipient = F.col(PRICE), F.col("_recipient")
    before = Window.partitionBy(KEY).orderBy(DATE).rowsBetween(-reversal_window, -1)
    out = panel.withColumns({"_recipient": reciprocal(p), "_fall": falling().cast("int"), "_level": full(quantile(level_quantile), p, last_rows(level_window), level_window), "_low": full(F.min, p, before, reversal_window)})
    return out.withColumns({
        "signal_momentum": momentum(momentum_days),
        effect_column("signal_momentum"): change(recipient, momentum_days),
        "signal_level": p <= F.col("_level"),
        effect_column("signal_level"): F.when(p > 0, F.try_divide(F.col("_level"), p) - 1),
        "signal_reversal": F.when(F.col("_low").isNotNull(), (lagged(p) == F.col("_low")) & (p > lagged(p))),
        effect_column("signal_reversal"): change(recipient),
    }).drop("_recipient", "_fall", "_level", "_low")


def add_baseline(panel: DataFrame, holidays: DataFrame | None = None, country: Column | None = None, momentum_days: int = 3, level_window: int = 90, level_quantile: float = 0.1, reversal_window: int = 20, holiday_days: int = 7, rows: int | None = None, days: int | None = None) -> DataFrame:
    """The four baseline signals and their effects (seasonality has none).

    Without a holiday table the seasonality signal is false.  ``rows`` cuts long series into chunks, ``days`` a country's dates into spans.
    """
    require_columns(panel, (KEY, DATE, PRICE))
    made = lambda x: _baseline(x, momentum_days, level_window, level_quantile, reversal_window)
    out = Pieces(panel, rows, max(momentum_days, level_window, reversal_window)).run(made) if rows else made(panel)
    if holidays is None:
        out = out.withColumn("signal_seasonality", F.lit(False))
    else:
        out = next_holiday(out.drop("days_to_holiday"), holidays, F.lit(None).cast("string") if country is None else country, days=days)
        out = out.withColumn("signal_seasonality", F.coalesce(F.col("days_to_holiday") <= holiday_days, F.lit(False)))
    return out.withColumn(effect_column("signal_seasonality"), F.lit(None).cast("double"))


def add_research(panel: DataFrame, thresholds: Thresholds = Thresholds(), rows: int | None = None) -> DataFrame:
    """The seven research signals and their effects; ``rows`` cuts long series into chunks, whose halo holds a year and more."""
    require_columns(panel, (KEY, DATE, PRICE))
    if rows:
        return Pieces(panel, rows, 366 + thresholds.annual_max_gap_days + 2).run(lambda x: add_research(x, thresholds))
    t, r = thresholds, F.col("_r")
    own = panel.withColumn("_r", reciprocal(F.col(PRICE)))
    own = annual_reference(own, r, t.annual_max_gap_days)
    rows = series()
    thirty = Window.partitionBy(KEY).orderBy("_day").rangeBetween(-29, 0)
    own = own.withColumn("_day", F.datediff(DATE, F.lit("1970-01-01").cast("date")))
    own = own.withColumns({
        "_year": F.try_divide(r, F.col("annual_reference")) - 1,
        "_year_loss": 1 - F.try_divide(r, F.col("annual_reference")),
        "_range": F.try_divide(full(F.min, r, rows.rowsBetween(-2, 0), 3), full(F.max, r, rows.rowsBetween(-9, -3), 7)) - 1,
        "_move": change(r),
        "_step": r - lagged(r),
        "_mean30": F.avg("_r").over(thirty), "_n30": F.count("_r").over(thirty), "_old30": F.min("_day").over(thirty),
        "_gain5": change(r, 5),
        "_loss5": 1 - F.try_divide(r, lagged(r, 5)),
    })
    own = own.withColumns({
        "_usual": full(quantile(0.5), F.abs("_move"), rows.rowsBetween(-10, -1), 10),
        "_avg30": F.when((F.col("_n30") >= 15) & (F.col("_day") - F.col("_old30") >= 25), F.try_divide(r, F.col("_mean30")) - 1),
        "_ups": full(F.sum, (F.col("_step") > 0).cast("int"), last_rows(5), 5),
        "_downs": full(F.sum, (F.col("_step") < 0).cast("int"), last_rows(5), 5),
    })
    unusual = (F.col("_move") > t.unusual_floor) & (F.col("_move") >= t.unusual_multiplier * F.greatest("_usual", F.lit(t.unusual_epsilon)))
    own = own.withColumns({
        "_c_range": F.col("_range") > t.range_gain,
        "_c_unusual": F.when(F.col("_move").isNotNull() & F.col("_usual").isNotNull(), unusual),
        "_c_up": F.when(F.col("_ups").isNotNull() & F.col("_gain5").isNotNull(), (F.col("_ups") >= 4) & (F.col("_gain5") > t.recent_gain)),
        "_c_down": F.when(F.col("_downs").isNotNull() & F.col("_loss5").isNotNull(), (F.col("_downs") >= 4) & (F.col("_loss5") > t.recent_loss)),
    })
    out = own.withColumns({
        "signal_better_than_one_year_ago": crossing(F.col("_year"), t.year_gain),
        "signal_less_than_one_year_ago": crossing(F.col("_year_loss"), t.year_loss),
        "signal_better_range_held": rising_edge(F.col("_c_range")),
        "signal_larger_than_usual_latest_improvement": rising_edge(F.col("_c_unusual")),
        "signal_better_than_30_day_average": crossing(F.col("_avg30"), t.average_30_day_gain),
        "signal_most_recent_changes_favourable": rising_edge(F.col("_c_up")),
        "signal_most_recent_changes_unfavourable": rising_edge(F.col("_c_down")),
        effect_column("signal_better_than_one_year_ago"): F.col("_year"),
        effect_column("signal_less_than_one_year_ago"): F.col("_year"),
        effect_column("signal_better_range_held"): F.col("_range"),
        effect_column("signal_larger_than_usual_latest_improvement"): F.col("_move"),
        effect_column("signal_better_than_30_day_average"): F.col("_avg30"),
        effect_column("signal_most_recent_changes_favourable"): F.col("_gain5"),
        effect_column("signal_most_recent_changes_unfavourable"): F.col("_gain5"),
    })
    return out.drop("annual_reference", *[c for c in out.columns if c.startswith("_") and c not in panel.columns])


def add_has_fact(frame: DataFrame, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Whether any signal holds, null as false (PRJ-07)."""
    some = F.lit(False)
    for s in signals:
        some = some | F.coalesce(F.col(s), F.lit(False))
    return frame.withColumn("has_fact", some)
