"""Numeric column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "volume")


def ratio(top: Column, bottom: Column) -> Column:
    """0 where the bottom is 0 and the top known; null where either is unknown."""
    return F.when(bottom == 0, F.when(top.isNotNull(), F.lit(0.0))).otherwise(F.try_divide(top, bottom))


def share(top: Column, bottom: Column) -> Column:
    """Null where the bottom is 0."""
    return F.try_divide(top.cast("double"), F.nullif(bottom, F.lit(0)).cast("double"))


def divided(top: Column, bottom: Column) -> Column:
    """The quotient by IEEE 754: infinite, or NaN for 0 / 0, where the bottom is 0 (with its sign)."""
    return F.when(bottom == 0, top * F.pow(bottom, F.lit(-1.0))).otherwise(top / bottom)


def log(x: Column) -> Column:
    """The natural logarithm by IEEE 754: minus infinity of 0, NaN below."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate over the rows in which both are known: NaN where one doesn't vary, null without such rows."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return divided(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def number(x: Column) -> Column:
    """Text or number as double; null where it isn't a finite number."""
    value = x.cast("string").try_cast("double")
    return F.when(finite(value), value)


def off_grid(x: Column, tick: float, tolerance: float = 1e-8) -> Column:
    """Whether a price isn't a multiple of the tick."""
    steps = x / F.lit(tick)
    return F.coalesce(F.abs(steps - F.rint(steps)) > tolerance, F.lit(False))


def high_below() -> Column:
    return F.coalesce(F.col("high") < F.greatest("open", "close", "low"), F.lit(False))


def low_above() -> Column:
    return F.coalesce(F.col("low") > F.least("open", "close", "high"), F.lit(False))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in pairs)))
