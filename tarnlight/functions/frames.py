"""Window frames over one series, gated so that an incomplete frame gives null.

A series is the rows of one key in date order.  Frames count rows (publications), not
days, unless said otherwise.  All frames of one series share partitioning and order, so a
chain of them needs one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, DATE, PRICE = "currency", "effective_date", "rub_per_unit"


def series(key: str = KEY, date: str = DATE) -> WindowSpec:
    return Window.partitionBy(key).orderBy(date)


def last_rows(n: int, key: str = KEY, date: str = DATE) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return series(key, date).rowsBetween(-(n - 1), 0)


def next_rows(n: int, key: str = KEY, date: str = DATE) -> WindowSpec:
    """The n rows after the current one."""
    return series(key, date).rowsBetween(1, n)


def around(n: int, key: str = KEY, date: str = DATE) -> WindowSpec:
    """n rows before, the current row, n rows after."""
    return series(key, date).rowsBetween(-n, n)


def full(agg: Callable[[Column], Column], value: Column, frame: WindowSpec, n: int) -> Column:
    """An aggregate over a frame that holds n non-null values, else null."""
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def quantile(q: float) -> Callable[[Column], Column]:
    """A linearly interpolated quantile, for :func:`full`."""
    return lambda value: F.percentile(value, F.lit(q))


def lagged(value: Column, n: int = 1, key: str = KEY, date: str = DATE) -> Column:
    return F.lag(value, n).over(series(key, date))


def change(value: Column, n: int = 1, key: str = KEY, date: str = DATE) -> Column:
    """Relative change over n rows."""
    return F.try_divide(value, lagged(value, n, key, date)) - 1


def rank_share(value: Column, n: int, key: str = KEY, date: str = DATE) -> Column:
    """Share of the last n values that are at most the current one."""
    cells = F.collect_list(value).over(last_rows(n, key, date))
    return F.when(F.size(cells) == n, F.size(F.filter(cells, lambda x: x <= value)) / F.lit(float(n)))


def rows_since_minimum(value: Column, n: int, key: str = KEY, date: str = DATE) -> Column:
    """Rows since the first minimum of the last n values."""
    cells = F.collect_list(value).over(last_rows(n, key, date))
    return F.when(F.size(cells) == n, F.lit(n) - F.array_position(cells, F.array_min(cells))).cast("double")


def rising_edge(condition: Column, key: str = KEY, date: str = DATE) -> Column:
    """True where a condition holds and did not before (null counts as not); null where it is null."""
    held = F.coalesce(condition, F.lit(False))
    return F.when(condition.isNotNull(), held & ~F.lag(held, 1, False).over(series(key, date)))


def crossing(value: Column, threshold: float, key: str = KEY, date: str = DATE) -> Column:
    """True where a value passes a threshold upwards; null unless this and the previous value are known."""
    before = lagged(value, 1, key, date)
    return F.when(value.isNotNull() & before.isNotNull(), (value > threshold) & (before <= threshold))


def run_length(flag: Column, carried: Column | None = None, key: str = KEY, date: str = DATE) -> Column:
    """Rows up to a row, itself included, on which a flag without nulls has held without a break.

    In a chunk of a series, ``carried`` is the length of the run that ends before the chunk's own rows.
    """
    place = F.row_number().over(series(key, date))
    broken = F.max(F.when(~flag, place)).over(series(key, date).rowsBetween(Window.unboundedPreceding, 0))
    unbroken = place if carried is None else F.col("_place") - F.col("_start") + 1 + carried
    return F.when(broken.isNotNull(), place - broken).otherwise(unbroken)


def running_sum(value: Column, carried: Column | None = None, key: str = KEY, date: str = DATE) -> Column:
    """The sum of a series up to a row; in a chunk, ``carried`` is the sum before the chunk's own rows."""
    total = F.sum(value).over(series(key, date).rowsBetween(Window.unboundedPreceding, 0))
    if carried is None:
        return total
    halo = F.coalesce(F.sum(F.when(F.col("_place") < F.col("_start"), value)).over(Window.partitionBy(key)), F.lit(0.0))
    return total - halo + carried


def carried_in(df, name: str) -> Column | None:
    """The boundary state ``_in_<name>`` of a chunk, null as 0; None where ``df`` isn't cut into chunks."""
    return F.coalesce(F.col(f"_in_{name}"), F.lit(0)) if f"_in_{name}" in df.columns else None
