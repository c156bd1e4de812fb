"""Queries: sources, cleaning, customer table, RFM segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.plans import oracle_sql as O
from patronage.plans.catalog import clean, customers, log, register, segmented, ts_out

LOG_OUT = ["InvoiceNo", "StockCode", "Quantity", "UnitPrice", "CustomerID", "Country"]
CUST_OUT = ["CustomerID", "Recency", "Frequency", "Monetary", "TotalQuantity", "UniqueProducts",
            "Country", "AvgTransactionValue", "AvgItemsPerTransaction"]


@register("A3_transactions_from_star", O.compose(
    "SELECT InvoiceNo, StockCode, Quantity, InvoiceDate, UnitPrice, CustomerID, Country FROM logx",
    ["logx"]))
def a3(spark, sf):
    return log(spark, sf).select(*LOG_OUT[:3], ts_out("InvoiceDate"), *LOG_OUT[3:])


@register("C1_drop_cancelled", O.compose(
    "SELECT count(*) AS lines, CAST(sum(Quantity) AS BIGINT) AS quantity FROM log "
    "WHERE NOT starts_with(InvoiceNo, 'C')", ["log"]))
def c1(spark, sf):
    from patronage.operators.cleaning import drop_cancelled
    return drop_cancelled(log(spark, sf)).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("Quantity").alias("quantity"))


@register("C4_clean_lines", O.compose(
    "SELECT InvoiceNo, StockCode, Quantity, InvoiceDate, UnitPrice, CustomerID, Country, "
    "TotalSpend, Year, Month, Day, Weekday, Hour, Date FROM clean", ["clean"]))
def c4(spark, sf):
    return clean(spark, sf).select(*LOG_OUT[:3], ts_out("InvoiceDate"), *LOG_OUT[3:],
                                   "TotalSpend", "Year", "Month", "Day", "Weekday", "Hour", "Date")


@register("C8_snapshot_date", O.compose("SELECT snapshot FROM snap", ["snap"]))
def c8(spark, sf):
    from patronage.operators.cleaning import snapshot_date
    return snapshot_date(clean(spark, sf)).select(ts_out("snapshot"))


@register("E1_customer_rfm", O.compose(f"SELECT {', '.join(CUST_OUT)} FROM cust", ["cust"]))
def e1(spark, sf):
    return customers(spark, sf, hub=False).select(*CUST_OUT)


@register("G5_rfm_segments", O.compose(
    "SELECT CustomerID, Recency, Frequency, Monetary, R_Score, F_Score, M_Score, RFM_Score, "
    "RFM_Sum, Segment FROM seg", ["seg"]))
def g5(spark, sf):
    return segmented(spark, sf).select(
        "CustomerID", "Recency", "Frequency", "Monetary", "R_Score", "F_Score", "M_Score",
        "RFM_Score", "RFM_Sum", "Segment")


@register("E10_segment_stats", O.compose(f"""
SELECT Segment, {O.np_round_sql('sum(monetary_cents) / 100.0 / CAST(count(*) AS DOUBLE)')} AS Monetary,
  {O.np_round_sql('sum(Frequency) / CAST(count(*) AS DOUBLE)')} AS Frequency,
  {O.np_round_sql('sum(Recency) / CAST(count(*) AS DOUBLE)')} AS Recency,
  count(*) AS CustomerID
FROM seg GROUP BY Segment""", ["seg"]))
def e10(spark, sf):
    from patronage.operators.segments import segment_stats
    return segment_stats(segmented(spark, sf))
