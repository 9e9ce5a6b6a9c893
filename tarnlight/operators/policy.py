"""Send policies: a greedy pass over each series' candidates in date order (POL-01, POL-02).

Whether a candidate is sent depends on what was sent shortly before it, so candidates are folded in
order.  A candidate that comes later than both the cooldown and the week of the one before depends on nothing:
there a series is cut, and the pieces, short arrays of dates, are folded in the JVM, spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.frames import DATE, KEY, series
from tarnlight.functions.scalar import flag
from tarnlight.operators.validate import require


def _accepted(frame: DataFrame, candidate: Column, fields: list[str], step, start: Column, fresh: Column, by: list[str], name: str) -> DataFrame:
    """``frame`` with a boolean column: the rows whose date the fold accepts.

    ``fresh`` tells, of ``_before`` and a candidate's own fields, whether nothing sent before can matter for it: the candidate in ``_before`` is the last
    one that could have been sent.  There the series is cut, and each piece is folded by itself.
    """
    order = Window.partitionBy(*by).orderBy(DATE)
    some = frame.filter(candidate).select(*by, *fields).withColumn("_before", F.lag(F.struct(*fields)).over(order))
    piece = F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    pieces = some.withColumn("_piece", piece).groupBy(*by, "_piece").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_c"))
    sent = pieces.select(*by, F.explode(F.aggregate("_c", start, step, lambda s: s.sent)).alias(DATE)).withColumn(name, F.lit(True))
    return frame.join(sent, [*by, DATE], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def calendar_policy(frame: DataFrame, candidate: str, cooldown_days: int = 3, weekly_limit: int = 2, by: tuple[str, ...] = (KEY,), name: str = "policy_signal") -> DataFrame:
    """At most ``weekly_limit`` a calendar week, each more than ``cooldown_days`` after the last sent (POL-01)."""
    require(cooldown_days >= 0 and weekly_limit >= 0, "limits must not be negative")
    own = frame.withColumn("_week", F.date_trunc("week", F.col(DATE)).cast("date"))
    start = F.struct(F.lit(None).cast("date").alias("last"), F.lit(None).cast("date").alias("week"), F.lit(0).alias("n"), F.expr("cast(array() as array<date>)").alias("sent"))

    def step(s: Column, x: Column) -> Column:
        used = F.when(s.week == x["_week"], s.n).otherwise(0)
        cold = s.last.isNull() | (F.datediff(x[DATE], s.last) > cooldown_days)
        ok = cold & (F.coalesce(used, F.lit(0)) < weekly_limit)
        return F.when(ok, F.struct(x[DATE].alias("last"), x["_week"].alias("week"), (F.coalesce(used, F.lit(0)) + 1).alias("n"), F.array_append(s.sent, x[DATE]).alias("sent"))).otherwise(s)

    fresh = (F.datediff(F.col(DATE), F.col(f"_before.{DATE}")) > cooldown_days) & (F.col("_week") != F.col("_before._week"))
    return _accepted(own, flag(F.col(candidate)), [DATE, "_week"], step, start, fresh, list(by), name).drop("_week")


def publication_policy(frame: DataFrame, candidate: str, cooldown_prints: int, max_in_7d: int = 2, by: tuple[str, ...] = (KEY,), name: str = "policy_signal") -> DataFrame:
    """More than ``cooldown_prints`` publications after the last sent, at most ``max_in_7d`` in seven days (POL-02).

    Positions count all rows of a series.
    """
    require(cooldown_prints >= 0 and max_in_7d >= 0, "limits must not be negative")
    own = frame.withColumn("_place", F.row_number().over(series() if list(by) == [KEY] else _order(by)))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.expr("cast(array() as array<date>)").alias("sent"))

    def step(s: Column, x: Column) -> Column:
        recent = F.size(F.filter(F.slice(s.sent, F.greatest(F.size(s.sent) - max_in_7d + 1, F.lit(1)), F.lit(max(max_in_7d, 1))), lambda d: d >= F.date_sub(x[DATE], 6)))
        ok = (s.last.isNull() | (x["_place"] - s.last > cooldown_prints)) & (recent < max_in_7d)
        return F.when(ok, F.struct(x["_place"].alias("last"), F.array_append(s.sent, x[DATE]).alias("sent"))).otherwise(s)

    fresh = (F.col("_place") - F.col("_before._place") > cooldown_prints) & (F.datediff(F.col(DATE), F.col(f"_before.{DATE}")) > 6)
    return _accepted(own, flag(F.col(candidate)), [DATE, "_place"], step, start, fresh, list(by), name).drop("_place")


def _order(by):
    return Window.partitionBy(*by).orderBy(DATE)
