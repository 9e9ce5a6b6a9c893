"""As-of joins by one union and one window, and their uses.

Facts and probes are united, sorted by time, and each probe takes the last (or next) fact
that stands before (or after) it.  The cost is one shuffle by the series key; nothing grows
with the product of facts and probes, unlike a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.scalar import series_name
from tarnlight.session import written


def asof(probes: DataFrame, facts: DataFrame, keys: list[str], at: str, since: str, values: list[str], direction: str = "backward", tie: str | None = None, days: int | None = None) -> DataFrame:
    """``probes`` with the ``values`` of the fact last known at ``at`` (``since <= at``), or next for ``forward``.

    Of facts with equal keys and time, the one with the largest ``tie`` counts (the largest
    values where none is named).  Probes without a fact get nulls.  ``days`` cuts the time of each key
    into spans, each a window partition of its own, into which the fact of the nearest span that has one
    is carried: so a key that holds most rows runs in many tasks.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    order = F.struct(*([tie] if tie else []), *values)
    one = facts.filter(F.col(since).isNotNull()).groupBy(*keys, since).agg(F.max_by(F.struct(*[F.col(v) for v in values]), order).alias("_fact"))
    kind = one.schema["_fact"].dataType
    payload = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    left = probes.select(*keys, F.col(at).alias("_t"), F.lit(1 if direction == "backward" else 0).alias("_k"), F.lit(None).cast(kind).alias("_fact"), payload.alias("_row"))
    right = one.select(*keys, F.col(since).alias("_t"), F.lit(0 if direction == "backward" else 1).alias("_k"), "_fact", F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    both, parts = left.unionByName(right), [*keys]
    if days:
        both, parts = _carried(written(both.withColumn("_span", _span(F.col("_t"), days)), "asof"), keys, direction), [*keys, "_span"]
    window = Window.partitionBy(*parts).orderBy("_t", "_k")
    if direction == "backward":
        found = F.last("_fact", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.first("_fact", ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("_found", F.when(F.col("_t").isNotNull(), found)).filter(F.col("_row").isNotNull())
    return out.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def _span(at: Column, days: int) -> Column:
    """The number of a span of time; null for no time, which has no fact either way."""
    return F.floor(F.unix_seconds(at.cast("timestamp")) / (86_400 * days))


def _carried(both: DataFrame, keys: list[str], direction: str) -> DataFrame:
    """``both`` with one more fact in each span: the last one of all earlier spans (the first of all later ones), at the span's edge.

    Spans of a key are as few as its time is long, so the window over them is small.
    """
    backward = direction == "backward"
    edge, other = (F.max_by, F.min) if backward else (F.min_by, F.max)
    fact = F.col("_fact").isNotNull()
    spans = both.groupBy(*keys, "_span").agg(edge("_fact", F.when(fact, F.struct("_t", "_k"))).alias("_own"), other("_t").alias("_edge"))
    order = Window.partitionBy(*keys).orderBy(F.col("_span").asc_nulls_first())
    if backward:
        near = F.last("_own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    else:
        near = F.first("_own", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    found = spans.withColumn("_fact", near).filter(F.col("_fact").isNotNull() & F.col("_span").isNotNull())
    extra = found.select(*keys, F.col("_edge").alias("_t"), F.lit(-1 if backward else 2).alias("_k"), "_fact", F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), "_span")
    return both.unionByName(extra)


def annual_reference(panel: DataFrame, value: Column, max_gap_days: int = 7, key: str = "currency", date: str = "effective_date", days: int | None = None) -> DataFrame:
    """``panel`` with ``annual_reference``: the value last known a year before, at most some days older (JOIN-04)."""
    own = panel.withColumns({"_value": value, "_year_ago": F.add_months(date, -12)})
    facts = own.select(key, F.col(date).alias("_ref_date"), F.col("_value").alias("annual_reference"))
    found = asof(own, facts.withColumn("_ref_at", F.col("_ref_date")), [key], "_year_ago", "_ref_date", ["annual_reference", "_ref_at"], days=days)
    near = F.datediff("_year_ago", "_ref_at") <= max_gap_days
    return found.withColumn("annual_reference", F.when(near, F.col("annual_reference"))).drop("_value", "_year_ago", "_ref_at")


def next_holiday(panel: DataFrame, holidays: DataFrame, country: Column, date: str = "effective_date", days: int | None = None) -> DataFrame:
    """``panel`` with ``days_to_holiday``: days to the next holiday of its country, null where none is known (JOIN-05)."""
    own = panel.withColumn("country", country)
    facts = holidays.withColumn("next_holiday", F.col("holiday"))
    found = asof(own, facts, ["country"], date, "holiday", ["next_holiday"], direction="forward", days=days)
    return found.withColumn("days_to_holiday", F.datediff("next_holiday", date).cast("double")).drop("next_holiday", "country")


def causal_context(panel: DataFrame, context: DataFrame, date: str = "effective_date", days: int | None = None) -> DataFrame:
    """``panel`` with a column for each context name: its value last available at the date (JOIN-03).

    Dates meet names in a bounded product (the names are columns, so they are few).
    """
    names = sorted(r[0] for r in context.select("name").distinct().collect())
    if not names:
        return panel
    dates = panel.select(F.col(date)).distinct()
    probes = dates.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    found = asof(probes, context, ["name"], date, "available_at", ["value"], tie="effective_date", days=days)
    wide = found.groupBy(date).pivot("name", names).agg(F.first("value"))
    return panel.join(wide, date, "left")


def external_asof(panel: DataFrame, external: DataFrame, date: str = "effective_date", days: int | None = None) -> DataFrame:
    """(date, series, value, staleness_days): each series as last available at each decision date (JOIN-02)."""
    series = external.withColumn("series", series_name(F.col("series_id")))
    names = sorted(r[0] for r in series.select("series").distinct().collect())  # each becomes columns, so they are few
    probes = panel.select(F.col(date)).distinct().withColumn("series", F.explode(F.array(*[F.lit(n) for n in names]) if names else F.expr("array(cast(null as string))")))
    found = asof(probes, series.withColumn("known_at", F.col("available_at")), ["series"], date, "available_at", ["value", "known_at"], tie="event_date", days=days)
    return found.select(date, "series", "value", F.datediff(date, "known_at").cast("double").alias("staleness_days"))
