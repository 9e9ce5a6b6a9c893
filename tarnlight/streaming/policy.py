"""The calendar policy over a stream of candidates: a few numbers of state for each series, kept without a time limit.

An extension beyond batch evaluation; the batch fold of :mod:`tarnlight.operators.policy` is the reference for results.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_policy(candidates: DataFrame, cooldown_days: int = 3, weekly_limit: int = 2) -> DataFrame:
    """(currency, effective_date, policy_signal) of a streaming frame (currency, effective_date, candidate).

    Each batch's rows of a series are taken in date order; a row older than the last sent one
    is not sent.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, week, used = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values("effective_date")
        sent = []
        for day, wanted in zip(pd.to_datetime(rows["effective_date"]).dt.date, rows["candidate"].fillna(False)):
            monday = (day - dt.timedelta(days=day.weekday())).toordinal()
            count = used if monday == week else 0
            ok = bool(wanted) and (last is None or day.toordinal() - last > cooldown_days) and count < weekly_limit
            if ok:
                last, week, used = day.toordinal(), monday, count + 1
            sent.append(ok)
        if last is not None:
            state.update((last, week, used))
        yield pd.DataFrame({"currency": key[0], "effective_date": rows["effective_date"].to_numpy(), "policy_signal": sent})

    return candidates.groupBy("currency").applyInPandasWithState(run, "currency string, effective_date date, policy_signal boolean", "last int, week int, used int", "append", GroupStateTimeout.NoTimeout)
