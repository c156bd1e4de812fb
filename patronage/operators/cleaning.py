"""Cleaning and derived line columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import weekday_mon0
from patronage.functions.money import amount, scale_of, units


def one_day() -> Column:
    return F.make_dt_interval(F.lit(1))


def is_cancelled(col: str = "InvoiceNo") -> Column:
    return F.startswith(F.col(col).cast("string"), F.lit("C"))


def flag_cancelled(log: DataFrame) -> DataFrame:
    return log.withColumn("IsCancelled", is_cancelled())


def drop_cancelled(log: DataFrame) -> DataFrame:
    """C1."""
    return log.filter(~is_cancelled())


def keep_positive_quantity(log: DataFrame) -> DataFrame:
    """C2."""
    return log.filter(F.col("Quantity") > 0)


def keep_positive_price(log: DataFrame) -> DataFrame:
    """C3."""
    return log.filter(F.col("UnitPrice") > 0)


def drop_guests(log: DataFrame) -> DataFrame:
    """C4: drop lines without a customer id (ids stay integral)."""
    return log.filter(F.col("CustomerID").isNotNull()).withColumn(
        "CustomerID", F.col("CustomerID").cast("long"))


def spend_of(lines: DataFrame) -> Column:
    """Quantity x unit price in money units; the column of that name where there is one."""
    return F.col("spend_cents") if "spend_cents" in lines.columns else F.col("Quantity") * F.col("unit_cents")


def spend_scale(lines: DataFrame) -> int:
    return scale_of(lines, "spend_cents" if "spend_cents" in lines.columns else "unit_cents")


def add_spend(lines: DataFrame) -> DataFrame:
    """TotalSpend = Quantity x UnitPrice, kept exactly as integer money units too."""
    scale = scale_of(lines)
    cents = F.col("Quantity") * F.col("unit_cents")
    return lines.select(*[c for c in lines.columns if c not in ("spend_cents", "TotalSpend")],
                        units(cents, "spend_cents", scale), amount(cents, scale).alias("TotalSpend"))


def add_date_parts(lines: DataFrame) -> DataFrame:
    """Year, Month, Day, Weekday (Mon=0), Hour, Date."""
    ts = F.col("InvoiceDate")
    return lines.withColumns({
        "Year": F.year(ts), "Month": F.month(ts), "Day": F.dayofmonth(ts),
        "Weekday": weekday_mon0(ts), "Hour": F.hour(ts), "Date": F.to_date(ts),
    })


def clean_lines(log: DataFrame) -> DataFrame:
    """C1-C4, C6, C7 in the reference's order.  All four filters are plain
    predicates, so Catalyst pushes them below the adapter's joins and into
    the Parquet scan where the column is stored."""
    lines = drop_guests(keep_positive_price(keep_positive_quantity(drop_cancelled(log))))
    return add_date_parts(add_spend(lines))


def cleaning_waterfall(log: DataFrame) -> DataFrame:
    """Rows removed and left after each step, in one pass over the log.

    Output: one row per step (step, name, removed, remaining) plus the
    missing-id share of the rows entering step 4 and the share retained.
    """
    c1 = ~is_cancelled()
    c2 = c1 & (F.col("Quantity") > 0)
    c3 = c2 & (F.col("UnitPrice") > 0)
    c4 = c3 & F.col("CustomerID").isNotNull()
    totals = log.agg(
        F.count(F.lit(1)).alias("n0"), F.count_if(c1).alias("n1"), F.count_if(c2).alias("n2"),
        F.count_if(c3).alias("n3"), F.count_if(c4).alias("n4"))
    def step(i: int, name: str, before: str, after: str) -> Column:
        return F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"),
                        F.col(before).alias("before"), F.col(after).alias("after"))

    steps = F.array(step(1, "cancelled", "n0", "n1"), step(2, "non_positive_quantity", "n1", "n2"),
                    step(3, "non_positive_price", "n2", "n3"),
                    step(4, "missing_customer", "n3", "n4"))
    out = totals.select(F.inline(steps), F.col("n0"), F.col("n4"))
    return out.select(
        F.col("step").cast("int").alias("step"), F.col("name"),
        (F.col("before") - F.col("after")).cast("long").alias("removed"),
        F.col("after").cast("long").alias("remaining"),
        F.try_divide((F.col("before") - F.col("after")).cast("double") * 100.0,
                     F.col("before").cast("double")).alias("removed_pct"),
        F.try_divide(F.col("n4").cast("double") * 100.0, F.col("n0").cast("double"))
        .alias("retained_pct"),
    )


def snapshot_date(lines: DataFrame) -> DataFrame:
    """C8 as a 1-row DataFrame: max(InvoiceDate) + 1 day over the given lines."""
    return lines.agg((F.max("InvoiceDate") + one_day()).alias("snapshot"))


def snapshot_value(lines: DataFrame) -> Column:
    """C8 as a scalar-subquery column, usable inside any other plan.

    Spark evaluates it once and substitutes the value; no join, no collect.
    """
    return snapshot_date(lines).scalar()


def between_days_before(lines: DataFrame, snapshot: Column, start_days: int = 90,
                        end_days: int = 1) -> DataFrame:
    """InvoiceDate in [snapshot - start_days, snapshot - end_days] (closed)."""
    lo = snapshot - F.make_dt_interval(F.lit(start_days))
    hi = snapshot - F.make_dt_interval(F.lit(end_days))
    return lines.filter(F.col("InvoiceDate").between(lo, hi))


def since_days_before(lines: DataFrame, snapshot: Column, days: int = 90) -> DataFrame:
    """InvoiceDate >= snapshot - days."""
    return lines.filter(F.col("InvoiceDate") >= snapshot - F.make_dt_interval(F.lit(days)))
