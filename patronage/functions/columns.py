"""Scalar column helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed days, floored (Python ``timedelta.days``).

    Not ``datediff``: two seconds across midnight is 0 elapsed days but 1
    calendar day.
    """
    diff = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(diff / F.lit(MICROS_PER_DAY)).cast("long")


def weekday_mon0(ts: Column) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6 (``F.weekday``, not ``dayofweek``)."""
    return F.weekday(ts).cast("int")


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den; division by zero (and the resulting +-inf / NaN) becomes ``default``."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    out = F.when(F.isnan(out) | (F.abs(out) == float("inf")), F.lit(None)).otherwise(out)
    return F.coalesce(out, F.lit(default)) if default is not None else out


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(x, F.lit(hi)))


def np_round(x: Column, decimals: int = 2) -> Column:
    """Round like NumPy/pandas: half-to-even on the binary value of x*10^d.

    Spark's ``round``/``bround`` round the decimal string of the double, which
    differs for values such as 2.675 (stored as 2.67499...).
    """
    scale = float(10 ** decimals)
    return F.rint(x.cast("double") * F.lit(scale)) / F.lit(scale)


def coerce_double(x: Column, default: float = 0.0) -> Column:
    """``pd.to_numeric(errors='coerce').fillna(default)``."""
    return F.coalesce(x.try_cast("double"), F.lit(default))


def cents_to_money(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100.0)


def non_null_distinct_count(*cols: Column) -> Column:
    """Number of distinct non-null values among the given columns of one row."""
    return F.size(F.array_distinct(F.array_compact(F.array(*cols))))


def scalars(row_df, names=None) -> list[Column]:
    """Columns of a 1-row DataFrame as scalar-subquery columns, packed into ONE
    subquery (a struct) so Spark evaluates the row once however many of the
    values a plan uses."""
    names = list(names or row_df.columns)
    packed = row_df.select(F.struct(*[F.col(n) for n in names]).alias("_s")).scalar()
    return [packed[n] for n in names]
