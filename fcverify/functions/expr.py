"""Column expressions shared by the verification operators.

Missing values are NULL throughout; every division is guarded because ANSI mode
raises on a zero divisor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def divide(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero or either side is NULL."""
    return F.try_divide(col(a), col(b))


def no_nan(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def truth(c: Column) -> Column:
    """NULL comparisons count as false, as they do in a boolean mask."""
    return F.coalesce(c, F.lit(False))


def square(c: Column) -> Column:
    return c * c


def rmse(y: Column | str, p: Column | str) -> Column:
    return F.sqrt(F.avg(square(col(y) - col(p))))


def mae(y: Column | str, p: Column | str) -> Column:
    return F.avg(F.abs(col(y) - col(p)))


def relative_skill(model: Column | str, baseline: Column | str, on_zero: str = "null") -> Column:
    """1 - model/baseline. ``on_zero``: 'null', 'zero' or 'raise' for baseline <= 0."""
    m, b = col(model), col(baseline)
    value = F.lit(1.0) - F.try_divide(m, b)
    if on_zero == "null":
        return F.when(b > 0, value)
    if on_zero == "zero":
        return F.when(b > 0, value).when(b.isNotNull(), F.lit(0.0))
    if on_zero == "raise":
        return F.when(b > 0, value).otherwise(
            F.raise_error(F.lit("baseline error must be positive")).cast("double")
        )
    raise ValueError(f"unknown on_zero: {on_zero}")


def variance(c: Column | str, ddof: int = 0) -> Column:
    if ddof not in (0, 1):
        raise ValueError("ddof must be 0 or 1")
    return F.var_pop(col(c)) if ddof == 0 else F.var_samp(col(c))


def variance_ratio(pred: Column, obs: Column, degenerate: float | None = 0.0) -> Column:
    """pred/obs from two variances; ``degenerate`` replaces an observed variance that is not > 0."""
    return F.when(obs > 0, F.try_divide(pred, obs)).otherwise(F.lit(degenerate).cast("double"))


def alpha(y: Column | str = "y_true", p: Column | str = "y_pred", degenerate: float | None = 0.0) -> Column:
    return variance_ratio(F.var_pop(col(p)), F.var_pop(col(y)), degenerate)


def skill_vp(skill: Column | str, ratio: Column | str, cap: bool = False) -> Column:
    r = col(ratio)
    if cap:
        r = F.when(r.isNotNull(), F.least(F.lit(1.0), r))
    return col(skill) * r


def percent(part: Column, total: Column, digits: int | None = 1) -> Column:
    value = F.try_divide(F.lit(100.0) * part, total)
    return value if digits is None else F.round(value, digits)


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )


def warm_cold(month: Column, warm_months=(4, 5, 6, 7, 8, 9)) -> Column:
    return F.when(month.isin(*warm_months), "warm_season").otherwise("cold_season")


def contains_any(text: Column, patterns) -> Column:
    result = F.lit(False)
    for pattern in patterns:
        result = result | text.contains(pattern)
    return result


def table_of(*rows: tuple, names: list[str]) -> Column:
    """Array-of-struct literal: a fixed small table that needs no join when exploded."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
