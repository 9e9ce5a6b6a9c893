"""Forward-looking labels (TGT-01 to TGT-09).  Lower prices are better; incomplete windows give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.functions.chunks import Pieces
from tarnlight.functions.frames import DATE, KEY, PRICE, around, full, next_rows, series
from tarnlight.functions.scalar import advantage_bps, regret_bps
from tarnlight.operators.validate import require

KINDS = ("local_min", "stay_not_worse", "window_closing")


def target_column(kind: str, horizon: int) -> str:
    """The name of a label column (PRJ-09)."""
    require(kind in KINDS, f"unknown target {kind!r}")
    return f"target_{kind}_h{horizon}"


def local_min(horizon: int) -> Column:
    p = F.col(PRICE)
    return p == full(F.min, p, around(horizon), 2 * horizon + 1)


def stay_not_worse(horizon: int) -> Column:
    p = F.col(PRICE)
    return full(F.min, p, next_rows(horizon), horizon) >= p


def forward_mean(horizon: int) -> Column:
    return full(F.avg, F.col(PRICE), next_rows(horizon), horizon)


def window_closing(horizon: int) -> Column:
    return F.lead(PRICE, horizon).over(series()) > F.col(PRICE)


def add_targets(panel: DataFrame, horizon: int, rows: int | None = None) -> DataFrame:
    """All labels of one horizon: one sort of each series, or of each chunk of ``rows`` rows."""
    require(horizon >= 1, "horizon must be at least 1")
    if rows:
        return Pieces(panel, rows, horizon, horizon).run(lambda x: add_targets(x, horizon))
    return panel.withColumns({
        target_column("local_min", horizon): local_min(horizon),
        target_column("stay_not_worse", horizon): stay_not_worse(horizon),
        f"forward_mean_h{horizon}": forward_mean(horizon),
        target_column("window_closing", horizon): window_closing(horizon),
    })


def future_prices(horizon: int) -> Column:
    """The next prices in order, as an array; null unless all exist (TGT-06)."""
    cells = F.collect_list(PRICE).over(next_rows(horizon))
    return F.when(F.size(cells) == horizon, cells)


def add_customer_outcomes(panel: DataFrame, horizon: int, rows: int | None = None) -> DataFrame:
    """Mean price around a moment, best price after it, and what they say of it in basis points (TGT-07)."""
    require(horizon >= 1, "horizon must be at least 1")
    if rows:
        return Pieces(panel, rows, horizon, horizon).run(lambda x: add_customer_outcomes(x, horizon))
    p = F.col(PRICE)
    mean, best = f"surrounding_mean_h{horizon}", f"future_best_h{horizon}"
    out = panel.withColumns({mean: full(F.avg, p, around(horizon), 2 * horizon + 1), best: full(F.min, p, next_rows(horizon), horizon)})
    return out.withColumns({f"moment_advantage_bps_h{horizon}": advantage_bps(p, F.col(mean)), f"customer_regret_bps_h{horizon}": regret_bps(p, F.col(best))})


def compact_outcomes(panel: DataFrame, horizon: int) -> DataFrame:
    """(key, date, y, v, r, m): the four labels of one horizon, ``y`` as 0 or 1 (TGT-08)."""
    own = add_customer_outcomes(add_targets(panel, horizon), horizon)
    value = (F.try_divide(F.col(f"forward_mean_h{horizon}"), F.col(PRICE)) - 1) * 10_000
    return own.select(KEY, DATE, F.col(target_column("stay_not_worse", horizon)).cast("int").cast("double").alias("y"), value.alias("v"), F.col(f"customer_regret_bps_h{horizon}").alias("r"), F.col(f"moment_advantage_bps_h{horizon}").alias("m"))


def add_path_outcomes(panel: DataFrame, horizon: int, mean_gap_days: float | None = None, by: str | list[str] = KEY, own_horizon: str | None = None, rows: int | None = None) -> DataFrame:
    """``path_value_bps`` and ``path_regret_bps`` over the next prices of a series ``by`` (TGT-09).

    Later prices weigh ``exp(-days since the first of them / mean_gap_days)``, or alike where
    ``mean_gap_days`` is None.  ``own_horizon`` names a column of horizons up to ``horizon``.
    """
    require(horizon >= 1, "horizon must be at least 1")
    require(mean_gap_days is None or 0 < mean_gap_days < float("inf"), "mean_gap_days must be positive and finite")
    if rows:
        require(by == KEY, "only series by key are cut into chunks")
        return Pieces(panel, rows, 0, horizon).run(lambda x: add_path_outcomes(x, horizon, mean_gap_days, by, own_horizon))
    p, n = F.col(PRICE), F.lit(horizon) if own_horizon is None else F.col(own_horizon)
    cells = F.slice(F.collect_list(F.struct(F.col(DATE).alias("d"), p.alias("p"))).over(next_rows(horizon, by)), F.lit(1), n)
    known = p.isNotNull() & (F.size(cells) == n) & ~F.exists(cells, lambda x: x.p.isNull())
    out = panel.withColumn("_path", F.when(known, cells))

    def weight(x: Column) -> Column:
        if mean_gap_days is None:
            return F.lit(1.0)
        return F.exp(-F.datediff(x.d, F.get("_path", 0).d) / F.lit(float(mean_gap_days)))

    def total(f) -> Column:
        return F.aggregate("_path", F.lit(0.0), lambda a, x: a + f(x))

    value = total(lambda x: (x.p / p - 1) * 10_000 * weight(x)) / total(weight)
    regret = F.array_max(F.transform("_path", lambda x: F.greatest((p / x.p - 1) * 10_000, F.lit(0.0)) * weight(x)))
    return out.withColumns({"path_value_bps": value, "path_regret_bps": regret}).drop("_path")
