"""Queries: single-step filters, previews, ranks and top-k lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import binning as BN
from patronage.operators import cleaning as CL
from patronage.operators import profile as PR
from patronage.plans import oracle_sql as O
from patronage.plans.catalog import clean, customers, historical, log, register, snapshot


def _count(df):
    return df.agg(F.count(F.lit(1)).alias("lines"), F.sum("Quantity").alias("quantity"))


@register("C2_keep_positive_quantity", O.compose(
    "SELECT count(*) AS lines, CAST(sum(Quantity) AS BIGINT) AS quantity FROM log WHERE Quantity > 0",
    ["log"]))
def c2(spark, sf):
    return _count(CL.keep_positive_quantity(log(spark, sf)))


@register("C3_keep_positive_price", O.compose(
    "SELECT count(*) AS lines, CAST(sum(Quantity) AS BIGINT) AS quantity FROM logx WHERE UnitPrice > 0",
    ["logx"]))
def c3(spark, sf):
    return _count(CL.keep_positive_price(log(spark, sf)))


@register("C9_target_window_lines", O.compose("""
SELECT count(*) AS lines, CAST(sum(Quantity) AS BIGINT) AS quantity FROM clean, snap
WHERE InvoiceDate BETWEEN snapshot - INTERVAL 90 DAY AND snapshot - INTERVAL 1 DAY""", ["clean", "snap"]))
def c9(spark, sf):
    return _count(CL.between_days_before(clean(spark, sf), snapshot(spark, sf), 90, 1))


@register("C10_recent_lines", O.compose("""
SELECT count(*) AS lines, CAST(sum(Quantity) AS BIGINT) AS quantity FROM clean, snap
WHERE InvoiceDate >= snapshot - INTERVAL 90 DAY""", ["clean", "snap"]))
def c10(spark, sf):
    return _count(CL.since_days_before(clean(spark, sf), snapshot(spark, sf), 90))


@register("B7_negative_quantities", O.compose("""
SELECT count(*) FILTER (WHERE Quantity < 0) AS negative_quantity,
  count(*) FILTER (WHERE Quantity < 0) * 100.0 / CAST(count(*) AS DOUBLE) AS negative_quantity_pct
FROM log""", ["log"]))
def b7(spark, sf):
    return PR.quality_flags(log(spark, sf)).select("negative_quantity", "negative_quantity_pct")


@register("B8_invalid_prices", O.compose("""
SELECT count(*) FILTER (WHERE UnitPrice <= 0) AS invalid_price,
  count(*) FILTER (WHERE UnitPrice <= 0) * 100.0 / CAST(count(*) AS DOUBLE) AS invalid_price_pct
FROM logx""", ["logx"]))
def b8(spark, sf):
    return PR.quality_flags(log(spark, sf)).select("invalid_price", "invalid_price_pct")


@register("A6_preview", O.compose("""
SELECT CustomerID, Recency, Frequency, Monetary FROM cust ORDER BY CustomerID LIMIT 5""", ["cust"]))
def a6(spark, sf):
    return customers(spark, sf).select("CustomerID", "Recency", "Frequency", "Monetary") \
        .orderBy("CustomerID").limit(5)


@register("F2_rank_first_monetary", O.compose("""
SELECT CustomerID, Monetary, row_number() OVER (ORDER BY monetary_cents, CustomerID) AS rank FROM cust""",
                                              ["cust"]))
def f2(spark, sf):
    c = customers(spark, sf).select("CustomerID", "Monetary", "monetary_cents")
    return BN.rank_first(c, "monetary_cents", out="rank").select("CustomerID", "Monetary", "rank")


@register("F5_top20_historical", O.compose("""
SELECT CustomerID, CLV_Historical, TransactionCount FROM hist
ORDER BY CLV_Historical DESC, CustomerID LIMIT 20""", ["hist"]))
def f5(spark, sf):
    return BN.top_k(historical(spark, sf), "CLV_Historical", 20).select(
        "CustomerID", "CLV_Historical", "TransactionCount")


@register("F8_monetary_quantiles", O.compose("""
SELECT quantile_cont(Monetary, 0.25) AS q25, quantile_cont(Monetary, 0.75) AS q75,
       quantile_cont(Monetary, 0.8) AS q80, quantile_cont(Monetary, 0.9) AS q90,
       quantile_cont(Monetary, 0.99) AS q99 FROM cust""", ["cust"]))
def f8(spark, sf):
    return BN.scalar_quantiles(customers(spark, sf), "Monetary", [0.25, 0.75, 0.8, 0.9, 0.99])


@register("B11_histogram_recency", O.compose("""
SELECT * FROM (WITH v AS (SELECT CAST(Recency AS DOUBLE) AS x FROM cust),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
c AS (SELECT CAST(CASE WHEN mm.hi = mm.lo THEN 0
         ELSE least(floor((x - mm.lo) * (50.0 / (mm.hi - mm.lo))), 49) END AS INTEGER) AS bin,
         count(*) AS n FROM v, mm GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(50))
SELECT g.bin, mm.lo + g.bin * ((mm.hi - mm.lo) / 50.0) AS lo,
       mm.lo + (g.bin + 1) * ((mm.hi - mm.lo) / 50.0) AS hi, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM g CROSS JOIN mm LEFT JOIN c ON g.bin = c.bin)""", ["cust"]))
def b11r(spark, sf):
    return PR.histogram(customers(spark, sf), "Recency", 50)


def _events_clean(spark, sf):
    from patronage.sources import read_table, transactions_from_events
    return CL.clean_lines(transactions_from_events(read_table(spark, sf, "events")))


@register("A3_events_customer_rfm", O.compose(
    "SELECT CustomerID, Recency, Frequency, Monetary, TotalQuantity, UniqueProducts, Country, "
    "AvgTransactionValue, AvgItemsPerTransaction FROM ecust", ["ecust"]))
def a3e(spark, sf):
    """Second source: purchase events as the log, then the customer table."""
    from patronage.operators.customers import customer_rfm
    return customer_rfm(_events_clean(spark, sf)).select(
        "CustomerID", "Recency", "Frequency", "Monetary", "TotalQuantity", "UniqueProducts",
        "Country", "AvgTransactionValue", "AvgItemsPerTransaction")


@register("H2_events_lifetimes_summary", O.compose(
    "SELECT CustomerID, frequency, recency, T, monetary_value FROM elt", ["elt"]))
def h2e(spark, sf):
    from patronage.operators.clv_prob import lifetimes_summary
    lines = _events_clean(spark, sf)
    return lifetimes_summary(lines, CL.snapshot_value(lines)).select(
        "CustomerID", "frequency", "recency", "T", "monetary_value")


# ------------------------------------------------------------ explicit inventory rows
# (each of these is also part of a larger query above; registered on its own
# so every inventory id has a runnable, checkable entry)

from patronage.plans.catalog import features, quartile_clusters, segmented  # noqa: E402


@register("C6_total_spend", O.compose("""
SELECT Country, CAST(sum(spend_cents) AS BIGINT) / 100.0 AS TotalSpend, count(*) AS lines
FROM clean GROUP BY Country""", ["clean"]))
def c6(spark, sf):
    return clean(spark, sf).groupBy("Country").agg(
        (F.sum("spend_cents").cast("double") / 100.0).alias("TotalSpend"),
        F.count(F.lit(1)).alias("lines"))


@register("C7_date_parts", O.compose("""
SELECT Year, Month, Weekday, Hour, count(*) AS lines FROM clean GROUP BY 1, 2, 3, 4""", ["clean"]))
def c7(spark, sf):
    return clean(spark, sf).groupBy("Year", "Month", "Weekday", "Hour").agg(
        F.count(F.lit(1)).alias("lines"))


@register("E2_transaction_averages", O.compose(
    "SELECT CustomerID, AvgTransactionValue, AvgItemsPerTransaction FROM cust", ["cust"]))
def e2(spark, sf):
    return customers(spark, sf, hub=False).select(
        "CustomerID", "AvgTransactionValue", "AvgItemsPerTransaction")


@register("E19_lifespan_frequency", O.compose(
    "SELECT CustomerID, CustomerLifespan, PurchaseFrequency, Recency FROM feat", ["feat"]))
def e19(spark, sf):
    return features(spark, sf, hub=False).select(
        "CustomerID", "CustomerLifespan", "PurchaseFrequency", "Recency")


_DAYS = [f"Day_{i}_Purchases" for i in range(7)]
_HOURS = [f"Hour_{i}_Purchases" for i in range(24)]


@register("E20_weekday_pivot", O.compose(f"SELECT CustomerID, {', '.join(_DAYS)} FROM feat", ["feat"]))
def e20(spark, sf):
    return features(spark, sf, hub=False).select("CustomerID", *_DAYS)


@register("E21_hour_pivot", O.compose(f"SELECT CustomerID, {', '.join(_HOURS)} FROM feat", ["feat"]))
def e21(spark, sf):
    return features(spark, sf, hub=False).select("CustomerID", *_HOURS)


@register("F1_recency_quartile_edges", O.compose("""
SELECT quantile_cont(Recency, 0.0) AS e0, quantile_cont(Recency, 0.25) AS e1,
       quantile_cont(Recency, 0.5) AS e2, quantile_cont(Recency, 0.75) AS e3,
       quantile_cont(Recency, 1.0) AS e4 FROM cust""", ["cust"]))
def f1(spark, sf):
    return BN.scalar_quantiles(customers(spark, sf), "Recency", [0.0, 0.25, 0.5, 0.75, 1.0],
                               ["e0", "e1", "e2", "e3", "e4"])


@register("F3_frequency_monetary_scores", O.compose(
    "SELECT CustomerID, F_Score, M_Score FROM rfm", ["rfm"]))
def f3(spark, sf):
    from patronage.operators.binning import qcut_of_rank
    c = customers(spark, sf)
    c = qcut_of_rank(c, "Frequency", "F_Score")
    return qcut_of_rank(c, "monetary_cents", "M_Score").select("CustomerID", "F_Score", "M_Score")


@register("G4_segment_of_score", O.compose(
    "SELECT RFM_Score, Segment, count(*) AS customers FROM seg GROUP BY 1, 2", ["seg"]))
def g4(spark, sf):
    return segmented(spark, sf).groupBy("RFM_Score", "Segment").agg(
        F.count(F.lit(1)).alias("customers"))


@register("J5_cluster_names", O.compose(
    "SELECT Cluster, Cluster_Name, count(*) AS customers FROM clus GROUP BY 1, 2", ["clus"]))
def j5(spark, sf):
    return quartile_clusters(spark, sf).groupBy("Cluster", "Cluster_Name").agg(
        F.count(F.lit(1)).alias("customers"))


@register("H11_discounted_clv")
def h11(spark, sf):
    from patronage.plans.catalog import prob_model
    return prob_model(spark, sf)[3].select("CustomerID", "CLV_365d", "CLV_3y_discounted")


@register("G10_segment_actions")
def g10(spark, sf):
    from patronage.operators.clv_prob import bgnbd_quadrants
    from patronage.operators.outputs import segment_action
    from patronage.plans.catalog import prob_model
    q = bgnbd_quadrants(prob_model(spark, sf)[3])
    return q.groupBy("segment").agg(F.count(F.lit(1)).alias("customers")).withColumn(
        "action", segment_action(F.col("segment")))
