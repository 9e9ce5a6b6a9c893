"""Long series cut into chunks, so that one series runs in many tasks.

By default a series is one window partition: one exchange and one sort, and as many tasks as there are
series.  Where few series hold most rows, :class:`Pieces` deals a series out in chunks of equally
many rows.  Every chunk also holds the rows before and after it that frames of its own rows reach, its
halo, so operators see each chunk as a series of its own and need no change; of their result only the chunk's
own rows are kept.  What depends on every earlier row (a run, a running sum, an exponential mean) is carried over by a
boundary state: an aggregate of each chunk, and a window over these aggregates, of which a series has
``rows`` times fewer than rows.

Places are found in two steps: rows are counted by bucket of ``span`` days, and numbered within their bucket
from the sum of the counts before it; so no task sorts a whole series.  Dates are unique in a series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.frames import DATE, KEY
from tarnlight.session import written

SPAN = 1024
PLACE, CHUNK = "_place", "_chunk"


def placed(panel: DataFrame, span: int = SPAN, key: str = KEY, date: str = DATE) -> DataFrame:
    """``panel`` (a table that can be read twice) with ``_place``: rows of the series before a row."""
    bucket = F.floor(F.unix_date(F.col(date).cast("date")) / span).alias("_bucket")
    counts = panel.groupBy(F.col(key).alias("_key"), bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_key", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = panel.select("*", bucket)
    found = own.join(offsets, own[key].eqNullSafe(F.col("_key")) & (own["_bucket"] == offsets["_bucket"])).drop("_key", offsets["_bucket"])
    within = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(date))
    return found.withColumn(PLACE, F.col("_offset") + within - 1).drop("_offset", "_bucket")


class Pieces:
    """The chunks of a panel, written once, with halos of ``back`` and ``ahead`` rows."""

    def __init__(self, panel: DataFrame, rows: int, back: int, ahead: int = 0, key: str = KEY, date: str = DATE, span: int = SPAN):
        if rows < 1 or back < 0 or ahead < 0:
            raise ValueError("a chunk has a row at least, and a halo none or more")
        self.rows, self.key, self.date, self.columns = rows, key, date, panel.columns
        own = placed(written(panel, "series"), span, key, date)
        first = F.greatest(F.floor((F.col(PLACE) - ahead) / rows), F.lit(0))
        last = F.floor((F.col(PLACE) + back) / rows)
        self.table = written(own.withColumn(CHUNK, F.explode(F.sequence(first, last))), "pieces")

    def _own(self) -> Column:
        return F.floor(F.col(PLACE) / self.rows) == F.col(CHUNK)

    def summary(self, **aggregates: Column) -> DataFrame:
        """(key, _chunk, ..): aggregates over each chunk's own rows."""
        return self.table.filter(self._own()).groupBy(self.key, CHUNK).agg(*[v.alias(k) for k, v in aggregates.items()])

    def carry(self, summary: DataFrame, **states: Callable) -> None:
        """Adds columns to all rows of a chunk: each a function of a window over the ``summary`` of the series' earlier chunks."""
        before = Window.partitionBy(self.key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carried = summary.select(F.col(self.key).alias("_key"), F.col(CHUNK).alias("_at"), *[f(before).alias(k) for k, f in states.items()])
        table = self.table
        found = table.join(carried, table[self.key].eqNullSafe(F.col("_key")) & (table[CHUNK] == F.col("_at")), "left").drop("_key", "_at")
        self.table = found

    def run(self, operator: Callable[[DataFrame], DataFrame], whole: bool = False) -> DataFrame:
        """The own rows of what ``operator`` makes of the chunks, each of them a series by its key.

        The operator finds the series' own key in ``<key>.series``, and in ``_start`` the place of a chunk's first own row.
        ``whole`` keeps ``_place`` and ``_chunk`` in the result.
        """
        start = F.col(CHUNK) * self.rows
        cells = self.table.withColumns({self.key: F.struct(F.col(self.key).alias("series"), F.col(CHUNK).alias("chunk")), "_start": start}).drop(CHUNK)
        out = operator(cells).filter(F.floor(F.col(PLACE) / self.rows) == F.col(f"{self.key}.chunk"))
        kept = out.withColumns({CHUNK: F.col(f"{self.key}.chunk"), self.key: F.col(f"{self.key}.series")})
        gone = [c for c in kept.columns if c == "_start" or c.startswith("_in_") or not whole and c in (PLACE, CHUNK)]
        return kept.drop(*gone)
