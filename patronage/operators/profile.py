"""Data-quality profiling of the transaction log.

Every profile is a single aggregation pass (or one group-by) whose result is
a small DataFrame; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import elapsed_days, scalars
from patronage.functions.ordering import quantile_table
from patronage.operators.cleaning import is_cancelled
from patronage.session import materialize

PROFILE_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate",
                   "UnitPrice", "CustomerID", "Country"]


def shape(df: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """B1: row and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(columns)).cast("long").alias("columns"))


def schema_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """B1: position, name, Spark type and non-missing values of each column (all columns by default), from
    the table's own schema and one aggregation."""
    columns = df.columns if columns is None else columns
    wide = df.agg(*[F.count(c).alias(c) for c in columns])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                     F.col(c).alias("non_null")) for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*rows)))


def null_counts(df: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """B2: NULL count per column, one pass, then unpivoted to (column, nulls)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "nulls").select(
        "column", F.col("nulls").cast("long").alias("nulls"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """Rows identical to an earlier row (NULL equals NULL).

    Identical rows collapse in the map-side partial aggregation, so a value
    repeated millions of times costs one hash entry per task."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long")
                      .alias("duplicate_rows"))


def distinct_counts(df: DataFrame,
                    columns: Sequence[str] = ("InvoiceNo", "StockCode", "CustomerID", "Country"),
                    approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column (exact; HyperLogLog++ if
    ``approximate``)."""
    fn = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(*[fn(c).cast("long").alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "distinct")


def date_range(df: DataFrame, col: str = "InvoiceDate") -> DataFrame:
    """First and last timestamp and the whole elapsed days between them."""
    agg = df.agg(F.min(col).alias("first"), F.max(col).alias("last"))
    return agg.select("first", "last", elapsed_days(F.col("last"), F.col("first")).alias("span_days"))


def quality_flags(df: DataFrame) -> DataFrame:
    """Cancelled invoices, negative quantities, non-positive prices:
    count and % of all lines, in one pass."""
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 F.count_if(is_cancelled()).alias("cancelled"),
                 F.count_if(F.col("Quantity") < 0).alias("negative_quantity"),
                 F.count_if(F.col("UnitPrice") <= 0).alias("invalid_price"))
    n = F.col("_n").cast("double")
    return agg.select(
        *[x for c in ("cancelled", "negative_quantity", "invalid_price")
          for x in (F.col(c).cast("long").alias(c),
                    (F.col(c).cast("double") * 100.0 / n).alias(f"{c}_pct"))])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std (n-1), min, 25/50/75 % (exact, interpolated), max
    per column, long format (one row per column).

    Not ``DataFrame.summary()``: its percentiles are approximate.  The source is
    read once for all columns; the moments are one aggregation of the written
    columns and the quantiles of all columns share their selection steps."""
    table = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "describe")
    quartiles = quantile_table(table, columns, [0.25, 0.5, 0.75], written=True)
    wide = table.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (
        ("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    rows = [F.struct(
        F.lit(c).alias("column"), F.col(f"count_{c}").cast("long").alias("count"), F.col(f"mean_{c}").alias("mean"),
        F.col(f"std_{c}").alias("std"), F.col(f"min_{c}").alias("min"),
        *[F.lit(v).cast("double").alias(k) for k, v in zip(("p25", "p50", "p75"), quartiles[c])],
        F.col(f"max_{c}").alias("max")) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), with
    empty bins present: (bin, lo, hi, count)."""
    x = F.col(col).cast("double")
    vals = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    lo, hi = scalars(vals.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")))
    width = (hi - lo) / F.lit(float(bins))
    idx = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1)))
    counts = vals.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("lo"),
                    (lo + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce(F.col("_c"), F.lit(0)).cast("long").alias("count")))
