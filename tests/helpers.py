"""Small panels and lookups for the tests."""

import datetime as dt

START = dt.date(2024, 1, 1)


def days(n, start=START, business=False):
    out, d = [], start
    while len(out) < n:
        if not business or d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


def panel(spark, prices, currency="AAA", start=START, dates=None, business=False):
    dates = dates or days(len(prices), start, business)
    return spark.createDataFrame([(currency, d, None if p is None else float(p)) for d, p in zip(dates, prices)], "currency string, effective_date date, rub_per_unit double")


def column(df, name, order=("currency", "effective_date")):
    return [r[name] for r in df.orderBy(*order).select(name).collect()]
