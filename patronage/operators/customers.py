"""Customer-grain aggregates.

The lines are scanned and joined once: ``customer_lines`` writes the seven
columns that customer tables need.  Every family of measures then reads its own
two to four of them and aggregates in its own grain:

* sums, extremes, weekday and hour counters, windows: per customer;
* distinct invoices (all and recent): per (customer, invoice), then per customer;
* distinct products: per (customer, product), then per customer;
* first country: earliest time per (customer, country), then per customer.

All are hash aggregations with fixed-width buffers and partial aggregation, so no
line is copied for a distinct count and a customer holding a third of all lines
is reduced before the shuffle.  The parts are joined by customer, which is how
each of them is dealt already.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import elapsed_days, safe_div, scalars
from patronage.functions.money import amount, scale_of, units
from patronage.functions.ordering import exact_quantiles, top_mask
from patronage.operators.cleaning import snapshot_value, spend_of, spend_scale
from patronage.session import materialize

CUSTOMER_COLUMNS = ["CustomerID", "Recency", "Frequency", "Monetary", "TotalQuantity",
                    "UniqueProducts", "Country", "AvgTransactionValue",
                    "AvgItemsPerTransaction"]


def first_country_table(lines: DataFrame) -> DataFrame:
    """pandas ``first`` of Country per customer: the first non-null Country in
    time order (ties at the same instant: the smaller country name).

    Kept out of the main customer aggregate on purpose: a string-valued
    aggregation buffer forces Spark into a sort-based aggregation of every
    (expanded) line.  Here the lines collapse in a hash aggregation to one row
    per (customer, country); only that small table is reduced per customer."""
    per = (lines.filter(F.col("Country").isNotNull())
           .groupBy("CustomerID", "Country").agg(F.min("InvoiceDate").alias("_t")))
    return per.groupBy("CustomerID").agg(
        F.min_by("Country", F.struct(F.col("_t"), F.col("Country"))).alias("Country"))


def customer_lines(lines: DataFrame) -> DataFrame:
    """The columns of clean lines that customer tables are made of, written once."""
    return materialize(lines.select("CustomerID", "InvoiceNo", "StockCode", "InvoiceDate", "Country", "Quantity",
                                    units(spend_of(lines), "spend_cents", spend_scale(lines))), "customer-lines")


def _distinct_counts(written: DataFrame, recent: Column | None = None) -> DataFrame:
    """Distinct products and invoices per customer (NULL ones not counted), and the
    invoices with a line for which ``recent`` holds."""
    invoices = written.groupBy("CustomerID", "InvoiceNo").agg(F.max("InvoiceDate").alias("InvoiceDate"))
    known = F.col("InvoiceNo").isNotNull()
    counts = [F.count_if(known).alias("_invoices")]
    if recent is not None:
        counts.append(F.count_if(known & recent).alias("_recent_invoices"))
    products = written.select("CustomerID", "StockCode").distinct().groupBy("CustomerID").agg(
        F.count("StockCode").alias("_products"))
    return invoices.groupBy("CustomerID").agg(*counts).join(products, "CustomerID")


def customer_rfm(lines: DataFrame, snapshot: Column | None = None, written: bool = False) -> DataFrame:
    """E1 + E2 on clean lines.

    Recency = whole days from the last purchase to the snapshot, Frequency =
    distinct invoices, Monetary = spend, TotalQuantity, UniqueProducts, first
    Country, AvgTransactionValue and AvgItemsPerTransaction.  ``monetary_cents``
    keeps the exact integer total for downstream sums, in the lines' money scale.
    ``written`` says that ``lines`` are :func:`customer_lines` already.
    """
    written = lines if written else customer_lines(lines)
    scale = scale_of(written, "spend_cents")
    snap = snapshot if snapshot is not None else snapshot_value(written)
    agg = written.groupBy("CustomerID").agg(
        F.max("InvoiceDate").alias("_last"), F.sum("spend_cents").alias("monetary_cents"),
        F.sum("Quantity").alias("TotalQuantity"))
    agg = (agg.join(_distinct_counts(written), "CustomerID")
           .join(first_country_table(written), "CustomerID", "left"))
    money, frequency = amount(F.col("monetary_cents"), scale), F.col("_invoices").cast("double")
    return agg.select(
        F.col("CustomerID"),
        elapsed_days(snap, F.col("_last")).alias("Recency"),
        F.col("_invoices").cast("long").alias("Frequency"),
        money.alias("Monetary"),
        F.col("TotalQuantity").cast("long").alias("TotalQuantity"),
        F.col("_products").cast("long").alias("UniqueProducts"),
        F.col("Country"),
        (money / frequency).alias("AvgTransactionValue"),
        (F.col("TotalQuantity").cast("double") / frequency).alias("AvgItemsPerTransaction"),
        units(F.col("monetary_cents"), "monetary_cents", scale),
    )


def customer_features(lines: DataFrame, snapshot: Column | None = None,
                      recent_days: int = 90, target_start_days: int = 90,
                      target_end_days: int = 1, cutoff: Column | None = None, written: bool = False) -> DataFrame:
    """E18-E23 (+ E19 ratios) from one scan of the lines.

    Columns: FirstPurchase, LastPurchase, PurchaseCount (lines), TotalMonetary,
    TotalQuantity, UniqueProducts, TransactionCount (distinct invoices),
    Country, CustomerLifespan (elapsed days + 1), AvgTransactionValue,
    AvgItemsPerTransaction, PurchaseFrequency, Recency, Day_0..6_Purchases,
    Hour_0..23_Purchases (all always present, 0 when absent),
    Recent90DaySpend / Recent90DayTransactions (InvoiceDate >= snapshot-90d),
    Actual_Future_Spend (InvoiceDate in [snapshot-90d, snapshot-1d]).

    The published windows overlap: features include the target's days.  With
    ``cutoff`` (a timestamp) there is no such leak: features take lines strictly
    before it, as if it were the snapshot, and Actual_Future_Spend the lines
    strictly after it up to ``target_start_days`` days later; customers without an
    earlier line have no row.  ``written`` says that ``lines`` are
    :func:`customer_lines` already.
    """
    written = lines if written else customer_lines(lines)
    scale = scale_of(written, "spend_cents")
    ts, cents = F.col("InvoiceDate"), F.col("spend_cents")
    if cutoff is None:
        snap = snapshot if snapshot is not None else snapshot_value(written)
        target = ts.between(snap - F.make_dt_interval(F.lit(target_start_days)),
                            snap - F.make_dt_interval(F.lit(target_end_days)))
        past, later = written, None
    else:
        snap = cutoff
        past = written.where(ts < snap)
        later = written.where((ts > snap) & (ts <= snap + F.make_dt_interval(F.lit(target_start_days))))
        target = F.lit(False)
    recent = ts >= snap - F.make_dt_interval(F.lit(recent_days))
    wd = F.weekday(ts)
    hr = F.hour(ts)
    aggs = [
        F.min(ts).alias("FirstPurchase"), F.max(ts).alias("LastPurchase"),
        F.count(F.lit(1)).alias("PurchaseCount"), F.sum(cents).alias("monetary_cents"),
        F.sum("Quantity").alias("TotalQuantity"),
        F.sum(F.when(recent, cents).otherwise(0)).alias("recent_cents"),
        F.sum(F.when(target, cents).otherwise(0)).alias("target_cents"),
    ]
    aggs += [F.count_if(wd == i).alias(f"Day_{i}_Purchases") for i in range(7)]
    aggs += [F.count_if(hr == i).alias(f"Hour_{i}_Purchases") for i in range(24)]
    agg = past.groupBy("CustomerID").agg(*aggs)
    agg = (agg.join(_distinct_counts(past, recent), "CustomerID")
           .join(first_country_table(past), "CustomerID", "left"))
    if later is not None:
        spent = later.groupBy("CustomerID").agg(F.sum("spend_cents").alias("_later"))
        agg = agg.drop("target_cents").join(spent, "CustomerID", "left").withColumn(
            "target_cents", F.coalesce("_later", F.lit(0)))
    money = amount(F.col("monetary_cents"), scale)
    lifespan = elapsed_days(F.col("LastPurchase"), F.col("FirstPurchase")) + 1
    tx = F.col("_invoices").cast("double")
    return agg.select(
        "CustomerID", "FirstPurchase", "LastPurchase",
        F.col("PurchaseCount").cast("long").alias("PurchaseCount"),
        money.alias("TotalMonetary"),
        F.col("TotalQuantity").cast("long").alias("TotalQuantity"),
        F.col("_products").cast("long").alias("UniqueProducts"),
        F.col("_invoices").cast("long").alias("TransactionCount"),
        "Country",
        lifespan.alias("CustomerLifespan"),
        safe_div(money, tx).alias("AvgTransactionValue"),
        safe_div(F.col("TotalQuantity"), tx).alias("AvgItemsPerTransaction"),
        safe_div(tx, lifespan).alias("PurchaseFrequency"),
        elapsed_days(snap, F.col("LastPurchase")).alias("Recency"),
        *[F.col(f"Day_{i}_Purchases").cast("long").alias(f"Day_{i}_Purchases") for i in range(7)],
        *[F.col(f"Hour_{i}_Purchases").cast("long").alias(f"Hour_{i}_Purchases")
          for i in range(24)],
        amount(F.col("recent_cents"), scale).alias("Recent90DaySpend"),
        F.col("_recent_invoices").cast("long").alias("Recent90DayTransactions"),
        amount(F.col("target_cents"), scale).alias("Actual_Future_Spend"),
        *[units(F.col(c), c, scale) for c in ("monetary_cents", "recent_cents", "target_cents")],
    )


def future_spend(lines: DataFrame, snapshot: Column | None = None, start_days: int = 90,
                 end_days: int = 1) -> DataFrame:
    """E23 on its own: spend per customer in [snapshot-start, snapshot-end]."""
    snap = snapshot if snapshot is not None else snapshot_value(lines)
    win = lines.filter(F.col("InvoiceDate").between(
        snap - F.make_dt_interval(F.lit(start_days)), snap - F.make_dt_interval(F.lit(end_days))))
    return win.groupBy("CustomerID").agg(
        amount(F.sum(spend_of(lines)), spend_scale(lines)).alias("Actual_Future_Spend"))


# ---------------------------------------------------------------- reports E3-E9, E24

def overall_kpis(customers: DataFrame) -> DataFrame:
    """One row of headline statistics over the customer table."""
    base = customers.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("monetary_cents").alias("_rev_cents"),
        F.avg(F.col("Recency").cast("double")).alias("recency_mean"),
        # whole days: a bounded number of values
        F.percentile(F.col("Recency"), F.array(*[F.lit(p) for p in (0.5, 0.25, 0.75)])).alias("_rq"),
        F.avg(F.col("Frequency").cast("double")).alias("frequency_mean"),
    )
    mq = exact_quantiles(customers, "Monetary", [0.5, 0.9], ["monetary_median", "monetary_p90"])
    fq = exact_quantiles(customers, "Frequency", [0.5, 0.9], ["frequency_median", "frequency_p90"])
    rev = amount(F.col("_rev_cents"), scale_of(customers, "monetary_cents"))
    return base.select(
        F.col("customers").cast("long").alias("customers"),
        rev.alias("revenue"),
        (rev / F.col("customers").cast("double")).alias("revenue_mean"),
        "recency_mean",
        F.col("_rq")[0].alias("recency_median"), F.col("_rq")[1].alias("recency_p25"),
        F.col("_rq")[2].alias("recency_p75"),
        "frequency_mean",
        *[v.alias(n) for v, n in zip(scalars(fq), ["frequency_median", "frequency_p90"])],
        (rev / F.col("customers").cast("double")).alias("monetary_mean"),
        *[v.alias(n) for v, n in zip(scalars(mq), ["monetary_median", "monetary_p90"])],
    )


def top_countries(df: DataFrame, n: int = 10, col: str = "Country") -> DataFrame:
    """Top-n values by row count with their share of all rows.

    The rows are counted once, per value; that small table is written, its sum
    is the total, and the top-n is a TakeOrderedAndProject (bounded by n).
    Ties are broken by name."""
    counts = materialize(df.groupBy(col).agg(F.count(F.lit(1)).alias("count")), "value-counts")
    total = counts.agg(F.sum("count")).scalar()
    return (counts.orderBy(F.col("count").desc(), F.col(col).asc_nulls_last()).limit(n)
            .select(col, F.col("count").cast("long").alias("count"),
                    (F.col("count").cast("double") * 100.0 / total.cast("double")).alias("pct")))


def pareto(customers: DataFrame, share: float = 0.2) -> DataFrame:
    """E5: top k = int(share * n) customers by Monetary (ties: lower id first).

    Output: customers, top_k, top_revenue_pct, top_mean, bottom_mean.  The k-th
    (Monetary, id) pair is selected; each row is compared with it, none is sorted.
    """
    frac = Fraction(share).limit_denominator(10_000)   # int(0.2 * n) == n div 5
    num, den = frac.numerator, frac.denominator
    scale = scale_of(customers, "monetary_cents")
    ranked, n = top_mask(customers.select("CustomerID", "monetary_cents"), "monetary_cents", "CustomerID",
                         lambda rows: rows * num // den, "_in_top")
    agg = ranked.agg(
        F.count(F.lit(1)).alias("customers"), F.sum("monetary_cents").alias("_tot"),
        F.sum(F.when(F.col("_in_top"), F.col("monetary_cents"))).alias("_top"))
    agg = agg.withColumn("top_k", F.lit(n * num // den))
    top = amount(F.coalesce(F.col("_top"), F.lit(0)), 0)
    tot = amount(F.col("_tot"), 0)
    unit = float(10 ** scale)
    return agg.select(
        F.col("customers").cast("long").alias("customers"),
        F.col("top_k").cast("long").alias("top_k"),
        F.try_divide(top * 100.0, tot).alias("top_revenue_pct"),
        F.try_divide(top / unit, F.col("top_k").cast("double")).alias("top_mean"),
        F.try_divide((tot - top) / unit,
                     (F.col("customers") - F.col("top_k")).cast("double")).alias("bottom_mean"),
    )


def engagement_bands(customers: DataFrame, active: int = 30, dormant: int = 90) -> DataFrame:
    """Active (<=30 d), Dormant (31-90 d), At Risk (>90 d): count and %."""
    band = (F.when(F.col("Recency") <= active, F.lit("Active"))
            .when(F.col("Recency") <= dormant, F.lit("Dormant")).otherwise(F.lit("At Risk")))
    total = customers.agg(F.count(F.lit(1))).scalar()
    return (customers.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("customers"))
            .select("band", F.col("customers").cast("long").alias("customers"),
                    (F.col("customers").cast("double") * 100.0 / total.cast("double"))
                    .alias("pct")))


def country_share(customers: DataFrame, country: str = "United Kingdom") -> DataFrame:
    """Share of customers and revenue of one country."""
    hit = F.col("Country") == F.lit(country)
    agg = customers.agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(hit).alias("customers"),
        F.sum("monetary_cents").alias("_tot"),
        F.sum(F.when(hit, F.col("monetary_cents")).otherwise(0)).alias("_rev"))
    return agg.select(
        F.lit(country).alias("country"), F.col("customers").cast("long").alias("customers"),
        (F.col("customers").cast("double") * 100.0 / F.col("_n").cast("double"))
        .alias("customers_pct"),
        amount(F.col("_rev"), scale_of(customers, "monetary_cents")).alias("revenue"),
        F.try_divide(F.col("_rev").cast("double") * 100.0, F.col("_tot").cast("double"))
        .alias("revenue_pct"))


def repeat_buyers(customers: DataFrame) -> DataFrame:
    """One-time vs repeat buyers."""
    agg = customers.agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("Frequency") == 1).alias("one_time"),
        F.count_if(F.col("Frequency") > 1).alias("repeat"),
        F.avg(F.when(F.col("Frequency") > 1, F.col("Frequency").cast("double")))
        .alias("repeat_mean_frequency"))
    n = F.col("_n").cast("double")
    return agg.select(
        F.col("one_time").cast("long").alias("one_time"),
        (F.col("one_time").cast("double") * 100.0 / n).alias("one_time_pct"),
        F.col("repeat").cast("long").alias("repeat"),
        (F.col("repeat").cast("double") * 100.0 / n).alias("repeat_pct"),
        "repeat_mean_frequency")


def value_groups(customers: DataFrame, high_q: float = 0.75, low_q: float = 0.25) -> DataFrame:
    """High (Monetary >= p75) and low (<= p25) groups; ties join both sides."""
    hi_t, lo_t = scalars(exact_quantiles(customers, "Monetary", [high_q, low_q], ["hi", "lo"]))
    groups = F.array(
        F.struct(F.lit("high").alias("grp"), (F.col("Monetary") >= hi_t).alias("hit")),
        F.struct(F.lit("low").alias("grp"), (F.col("Monetary") <= lo_t).alias("hit")))
    exploded = customers.select("Recency", "Frequency", F.inline(groups)).filter("hit")
    return exploded.groupBy("grp").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(F.col("Recency").cast("double")).alias("recency_mean"),
        F.avg(F.col("Frequency").cast("double")).alias("frequency_mean"),
    ).select("grp", F.col("customers").cast("long").alias("customers"),
             "recency_mean", "frequency_mean")


def target_summary(features: DataFrame) -> DataFrame:
    """Mean, max and % zero of Actual_Future_Spend (pass the train split)."""
    scale = scale_of(features, "target_cents")
    return features.agg(
        (amount(F.sum("target_cents"), scale) / F.count(F.lit(1)).cast("double")).alias("target_mean"),
        amount(F.max("target_cents"), scale).alias("target_max"),
        (F.count_if(F.col("target_cents") == 0).cast("double") * 100.0
         / F.count(F.lit(1)).cast("double")).alias("target_zero_pct"))
