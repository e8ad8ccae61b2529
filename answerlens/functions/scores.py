"""Scalar measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from answerlens import schemas as S


def rounded(x: Column, digits: int = 5) -> Column:
    """Round halves up at ``digits`` on the scaled value."""
    scale = float(10**digits)
    return F.round(x * F.lit(scale)) / F.lit(scale)


def ratio(num: Column, den: Column, digits: int = 5) -> Column:
    """num / den rounded, 0 where the denominator is null or not positive."""
    return F.when(den > 0, rounded(num.cast("double") / den.cast("double"), digits)).otherwise(F.lit(0.0))


def prominence(mentions: Column, rank: Column) -> Column:
    """mentions / log2(rank + 1); a missing rank counts as 999, a rank <= 0 gives 0."""
    r = F.coalesce(rank, F.lit(S.UNKNOWN_RANK))
    return F.when(r > 0, mentions / F.log2(r + F.lit(1.0))).otherwise(F.lit(0.0))


def trend_code(current: Column, previous: Column) -> Column:
    """Direction of a figure against its predecessor (see the codes in ``schemas``)."""
    fresh = previous.isNull() | (previous == 0)
    return (
        F.when(fresh & (current > 0), S.TREND_NEW)
        .when(fresh, S.TREND_UNKNOWN)
        .when((current == 0) & (previous > 0), S.TREND_GONE)
        .when(current > previous, S.TREND_UP)
        .when(current < previous, S.TREND_DOWN)
        .otherwise(S.TREND_STABLE)
    )


def order_trend_code(current: Column, previous: Column) -> Column:
    """Trend of a rank: an unmentioned entity (-1) is unknown; a larger number reads as UP."""
    return F.when(current == S.NOT_MENTIONED, S.TREND_UNKNOWN).otherwise(trend_code(current, previous))


def change_percent(current: Column, previous: Column) -> Column:
    """Percent change to one digit; 100 where there was nothing before, 0 where there is nothing."""
    prev = F.coalesce(previous, F.lit(0))
    return (
        F.when(prev > 0, rounded((current - prev) / prev * 100, 1))
        .when(current > 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )
