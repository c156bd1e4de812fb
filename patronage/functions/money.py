"""Exact money: integers of a fixed scale.

A money column holds whole units of 10**-scale of the currency; its scale is a
property of the column (``money_scale`` in the field's metadata, 2 where none is
given), set by the source and passed on by every operator that sums or selects
money.  Sums are integer sums, so they are exact and do not depend on
partitioning; only the last projection divides by 10**scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE_KEY = "money_scale"
CENTS = 2


def scale_of(df: DataFrame, column: str = "unit_cents") -> int:
    """Decimal places of a money column."""
    return int(df.schema[column].metadata.get(SCALE_KEY, CENTS))


def units(value: Column, name: str, scale: int) -> Column:
    """A money column called ``name`` in units of 10**-scale."""
    return value.alias(name, metadata={SCALE_KEY: scale})


def amount(value: Column, scale: int) -> Column:
    """Currency as a double: the one rounding of a money value."""
    return value.cast("double") / F.lit(float(10 ** scale))


def parsed_units(text: Column, scale: int) -> Column:
    """Units of a price given as text; NULL if it is no number, has more than ``scale``
    decimal places or does not fit a long.  Read as a decimal, so no binary
    rounding is involved."""
    exact = text.try_cast("decimal(38,18)") * F.lit(10 ** scale).cast("decimal(12,0)")
    whole = exact.try_cast("decimal(20,0)")
    return F.when(exact == whole, whole.try_cast("long"))
