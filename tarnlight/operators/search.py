"""Search for a rule: screen, shortlist, combine, choose with a policy, confirm (AGG-20, AGG-21, FLT-09, TOP-01 to TOP-03, CTL-05)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.frames import DATE, KEY, PRICE
from tarnlight.functions.scalar import advantage_bps, flag, significant
from tarnlight.operators.metrics import week
from tarnlight.operators.policy import publication_policy
from tarnlight.operators.rules import Rule, add_rules, combine, correlations
from tarnlight.operators.splits import Fold, in_range, purge_tail
from tarnlight.session import written


@dataclass(frozen=True)
class Screening:
    min_signals: int = 50
    min_corridors: int = 4
    min_median_lift: float = 1.0
    min_mean_bps: float = 0.0
    min_positive_share: float = 0.6


def long_rules(frame: DataFrame, rules: list[str], target: str, horizon: int) -> DataFrame:
    """(rule_id, key, date, target, bps, sent) of eligible rows."""
    own = frame.filter(F.col(target).isNotNull() & F.col(f"forward_mean_h{horizon}").isNotNull())
    own = own.withColumn("bps", advantage_bps(F.col(PRICE), F.col(f"forward_mean_h{horizon}")))
    return own.select(KEY, DATE, F.col(target).alias("target"), "bps", *rules).unpivot([KEY, DATE, "target", "bps"], rules, "rule_id", "sent").withColumn("sent", flag(F.col("sent")))


def by_corridor(long: DataFrame, ids: list[str]) -> DataFrame:
    """Lift, value, frequency and clustering of each stream and corridor: the first level of AGG-20."""
    before = F.lag("sent", 1, False).over(Window.partitionBy(*ids, KEY).orderBy(DATE))
    t, s = F.col("target").cast("int"), F.col("sent")
    weeks = F.datediff(F.max(week()), F.min(week())) / 7 + 1
    out = long.withColumn("_next", s & before).groupBy(*ids, KEY).agg(
        F.count_if(s).alias("signal_count"), F.try_divide(F.avg(F.when(s, t)), F.avg(t)).alias("lift"), F.avg(F.when(s, F.col("bps"))).alias("bps_forward"),
        (F.count_if(s) / weeks).alias("signals_per_week"), F.try_divide(F.count_if("_next").cast("double"), F.count_if(s)).alias("cluster_share"),
    )
    return out


def summarize(corridors: DataFrame, ids: list[str]) -> DataFrame:
    """The second level of AGG-20: over corridors, of which those with signals count for quality."""
    some = F.col("signal_count") > 0

    def valid(c: str) -> Column:
        return F.when(some, F.col(c))

    return corridors.groupBy(*ids).agg(
        F.sum("signal_count").alias("signal_count"), F.count_if(some).alias("corridors_with_signals"), F.avg(valid("lift")).alias("mean_lift"),
        F.percentile(valid("lift"), F.lit(0.5)).alias("median_lift"), F.avg(valid("bps_forward")).alias("mean_bps"), F.avg("signals_per_week").alias("mean_signals_per_week"),
        F.coalesce(F.avg(F.when(some, F.coalesce(F.col("lift") > 1, F.lit(False)).cast("int"))), F.lit(0.0)).alias("positive_share"), F.avg(valid("cluster_share")).alias("mean_cluster_share"),
    )


def passes(s: Screening = Screening()) -> Column:
    """FLT-09; null metrics fail."""
    return F.coalesce(
        (F.col("signal_count") >= s.min_signals) & (F.col("corridors_with_signals") >= s.min_corridors) & (F.col("median_lift") > s.min_median_lift)
        & (F.col("mean_bps") > s.min_mean_bps) & (F.col("positive_share") >= s.min_positive_share), F.lit(False))


def rank_key() -> Column:
    """Feasible first, then lift, value, and a frequency near 1.5 a week (TOP-01); to nine digits, so that rules that hold on the same rows tie."""
    lift, bps, weekly = (F.when(F.col(c).isNotNull(), significant(F.col(c))) for c in ("median_lift", "mean_bps", "mean_signals_per_week"))
    feasible = weekly.between(0.8, 2.5) & (bps > 0)
    return F.struct(F.coalesce(feasible, F.lit(False)).cast("int").alias("feasible"), F.coalesce(lift, F.lit(-1.0)).alias("lift"), F.coalesce(bps, F.lit(-1e9)).alias("bps"), (-F.round(F.abs(weekly - 1.5), 9)).alias("near"))


def screen(frame: DataFrame, rules: list[Rule], target: str, horizon: int, screening: Screening = Screening()) -> DataFrame:
    """One row for each rule: summary and whether it passes."""
    names = [r.rule_id for r in rules]
    out = summarize(by_corridor(long_rules(frame, names, target, horizon), ["rule_id"]), ["rule_id"])
    return out.withColumns({"family": F.split("rule_id", "__")[0], "passed": passes(screening)})


def shortlist(screened: DataFrame, catalog: list[str], per_family: int = 5, total: int = 20) -> DataFrame:
    """(rule_id, family, place): the best of each family, then the best of all; of all rules if none passed (TOP-02).

    Ties go to the rule that is first in the ``catalog``.  There is a row for each rule, so one task ranks them.
    """
    nth = F.array_position(F.lit(catalog), F.col("rule_id"))
    own = screened.withColumns({"_key": rank_key(), "_any": F.max(F.col("passed").cast("int")).over(Window.partitionBy(F.lit(1)))})
    pool = own.filter(F.col("passed") | (F.col("_any") == 0))
    best = pool.withColumn("_f", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("_key"), nth))).filter(F.col("_f") <= per_family)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_key"), nth))).filter(F.col("place") <= total).select("rule_id", "family", "place")


def policy_streams(frame: DataFrame, candidates: list[str], cooldowns: tuple[int, ...], target: str, horizon: int) -> DataFrame:
    """(rule_id, cooldown, key, date, target, bps, sent): every candidate thinned by every cooldown.

    All streams are series of their own, so they run in parallel.
    """
    long = frame.withColumn("bps", advantage_bps(F.col(PRICE), F.col(f"forward_mean_h{horizon}"))).select(KEY, DATE, F.col(target).alias("target"), "bps", *candidates).unpivot([KEY, DATE, "target", "bps"], candidates, "rule_id", "raw")
    parts = [publication_policy(long, "raw", c, by=("rule_id", KEY), name="sent").withColumn("cooldown", F.lit(c)) for c in cooldowns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("target IS NOT NULL AND bps IS NOT NULL")


def choose_policy(streams: DataFrame, candidates: list[str], cooldowns: tuple[int, ...]) -> DataFrame:
    """The best candidate and cooldown; of equal keys, the first candidate in order with its first cooldown (TOP-03)."""
    ids = ["rule_id", "cooldown"]
    found = summarize(by_corridor(streams, ids), ids)
    places = [F.array_position(F.lit(candidates), F.col("rule_id")), F.array_position(F.lit(list(cooldowns)), F.col("cooldown"))]
    return found.withColumn("_key", rank_key()).orderBy(F.desc("_key"), *places).limit(1).drop("_key")


def discovery_effect(streams: DataFrame) -> DataFrame:
    """Mean over corridors of lift and value of a chosen stream (AGG-21)."""
    t, s = F.col("target").cast("int"), F.col("sent")
    each = streams.groupBy(KEY).agg(F.try_divide(F.avg(F.when(s, t)), F.avg(t)).alias("l"), F.avg(F.when(s, F.col("bps"))).alias("b"), F.count_if(s).alias("n"), F.avg(t).alias("p"))
    return each.filter("n > 0 AND p > 0").agg(F.avg("l").alias("lift_point"), F.avg("b").alias("bps_point"))


@dataclass(frozen=True)
class Found:
    fold: str
    rule_id: str
    cooldown: int
    screening: DataFrame
    test: DataFrame


def indicator_search(panel: DataFrame, folds: list[Fold], target: str, horizon: int, screening: Screening = Screening(), cooldowns: tuple[int, ...] = (1, 2, 3, 5), rows: int | None = None) -> list[Found]:
    """For each fold: choose on its validation rows, then apply the choice once to its test rows.

    The driver sees a shortlist and one winner a fold; everything else stays distributed.
    """
    frame, rules = add_rules(panel, rows=rows)
    frame = written(frame, "rules")
    family = {r.rule_id: r.family for r in rules}
    out = []
    for fold in folds:
        validation = purge_tail(frame.filter(in_range(fold.val_start, fold.val_end)), horizon)
        screened = screen(validation, rules, target, horizon, screening)
        names = [r["rule_id"] for r in shortlist(screened, list(family)).orderBy("place").collect()]
        validation, candidates = combine(validation, names, family, correlations(validation, names))
        best = choose_policy(policy_streams(validation, candidates, cooldowns, target, horizon), candidates, cooldowns).first()
        test, _ = combine(frame.filter(in_range(fold.test_start, fold.test_end)), names, family)
        stream = policy_streams(test, [best["rule_id"]], (best["cooldown"],), target, horizon)
        out.append(Found(fold.name, best["rule_id"], best["cooldown"], screened.withColumn("fold", F.lit(fold.name)), stream.withColumn("fold", F.lit(fold.name))))
    return out
