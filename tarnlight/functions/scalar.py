"""Scalar column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 10_000.0


def reciprocal(price: Column) -> Column:
    """Units per unit of price; null unless the price is positive."""
    return F.when(price > 0, F.try_divide(F.lit(1.0), price))


def cross_rate(base_per_third: Column, quote_per_third: Column) -> Column:
    """A rate by way of a third currency; null unless the divisor is positive."""
    return F.when(quote_per_third > 0, F.try_divide(base_per_third, quote_per_third))


def positive(price: Column, what: str = "price") -> Column:
    """The price itself; an error where it is not positive."""
    return F.when(price.isNull() | (price > 0), price).otherwise(F.raise_error(F.lit(f"{what} must be positive")).cast("double"))


def advantage_bps(price: Column, reference: Column) -> Column:
    """How much better a price is than a reference, in basis points (lower prices are better)."""
    return (F.try_divide(reference, positive(price)) - 1) * BPS


def regret_bps(price: Column, best_later: Column) -> Column:
    """How much was lost by not waiting for the best later price; null where that is unknown."""
    loss = (F.try_divide(price, positive(best_later, "later price")) - 1) * BPS
    return F.when(loss.isNotNull(), F.greatest(loss, F.lit(0.0)))


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(math.inf)), value)


def flag(value: Column) -> Column:
    """False for null."""
    return F.coalesce(value, F.lit(False))


def corridor(currency: Column, base: str = "RUB") -> Column:
    return F.concat(F.lit(f"{base}->"), currency)


def series_name(value: Column) -> Column:
    """A column-safe name: lower case, other characters as single underscores."""
    return F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), F.lit("_"))


def method_label(kind: Column, groups: Column) -> Column:
    """``MODEL groups`` or the rule's name in words."""
    return F.when(groups.isNotNull(), F.concat_ws(" ", F.upper(kind), groups)).otherwise(F.replace(kind, F.lit("_"), F.lit(" ")))


def message(template: Column, currency: Column, effect: Column) -> Column:
    """A template with ``{currency}`` and ``{effect_pct}`` filled in; a dash where the effect is unknown."""
    shown = F.coalesce(F.format_string("%.2f", F.abs(effect) * 100), F.lit("—"))
    shown = F.when(effect.isNull(), F.lit("—")).otherwise(shown)
    return F.replace(F.replace(template, F.lit("{currency}"), currency), F.lit("{effect_pct}"), shown)


#: Fixed scale of the composite score: a lift factor of 1.3 for each 100 basis points.
LAR_SCALE_BPS = 100.0 / math.log(1.3)
LAR_RHO = 2.0


def lift_at_risk(lift: Column, value: Column, random_value: Column, regret: Column, random_regret: Column, rho: float = LAR_RHO, scale: float = LAR_SCALE_BPS) -> Column:
    """Lift times the exponential of the risk-adjusted utility over that of random sends.

    Null where an input is; beyond the range of a double the factor is infinity or zero.
    """
    exponent = ((value - random_value) - F.lit(rho) * (regret - random_regret)) / F.lit(scale)
    return F.when(exponent > math.log(1.7976931348623157e308), F.lit(math.inf)).when(exponent < math.log(5e-324), F.lit(0.0)).otherwise(lift * F.exp(exponent))


def significant(value: Column, digits: int = 9) -> Column:
    """A double to some significant digits: what ranks and ties are decided by, so that no order of summation decides."""
    return F.format_string(f"%.{digits - 1}e", value.cast("double")).cast("double")
