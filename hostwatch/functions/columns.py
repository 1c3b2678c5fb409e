"""Small Column helpers used across operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(c: str | Column, n: int) -> Column:
    """Exact integer floor division, also for negative values."""
    c = as_col(c).cast("long")
    return ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("long")


def epoch_us(c: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp column (UTC session)."""
    return F.unix_micros(as_col(c).cast("timestamp"))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, or ``default`` where den is zero or missing."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(default))


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column for stable comparison.

    A nudge far below the last kept place moves values off exact rounding ties, where
    the last bit of a sum would decide; adding zero drops negative zero.
    """
    return df.select(*[
        (round_half_up(F.col(f.name) + F.lit(1e-9), places) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def round_half_up(value: Column, places: int) -> Column:
    """What F.round returns for a double column, by arithmetic where that is sure to be the same.

    F.round goes through decimal text. Below 2^40 a scaled value is exact to 2^-12, so away from a tie the nearest
    whole number is the one F.round finds, and dividing it gives the double nearest to the rounded decimal. Ties, larger
    values, NaN and infinities are left to F.round.
    """
    scale = F.lit(float(10 ** places))
    scaled = F.abs(value) * scale
    sure = (scaled < F.lit(float(1 << 40))) & (F.abs(scaled - F.floor(scaled).cast("double") - F.lit(0.5)) > F.lit(1e-3))
    return F.when(sure, F.signum(value) * (F.floor(scaled + F.lit(0.5)).cast("double") / scale)).otherwise(F.round(value, places))


def require_columns(df: DataFrame, names, what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}")
