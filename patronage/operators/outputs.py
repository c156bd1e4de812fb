"""Marketing outputs and text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import np_round
from patronage.functions.lookups import WEEKDAY_NAMES

# FIXED VALUES - per-customer recommendation texts, in rule order.
REC_PRIORITY = "Priority retention program"
REC_PERSONAL = "Personalized offers"
REC_WINBACK = "Win-back campaign"
REC_UPSELL = "Upsell premium products"
REC_CROSS = "Cross-sell complementary items"

# FIXED VALUES - recommended actions per value tier (Low depends on the sign
# of its acquisition ROI).
TIER_ACTIONS = {
    "High": ["Priority 1: Retention & loyalty programs", "Dedicated account managers",
             "Exclusive offers and early access",
             "Referral programs (they bring similar customers)"],
    "Medium": ["Focus on upsell and cross-sell", "Frequency-based rewards",
               "Personalized product recommendations", "Test different engagement strategies"],
    "Low+": ["Cost-effective acquisition channels", "Entry-level product promotions",
             "Educational content to increase engagement", "Low-cost retention efforts"],
    "Low-": ["Re-evaluate acquisition strategy", "Focus on quality over quantity",
             "Improve targeting to find higher-value customers"],
}

# FIXED VALUES - probabilistic segment -> action text, tested in this order
# by substring (so "At Risk High Spender" receives the "At Risk" text).
SEGMENT_ACTIONS = [
    ("High Potential", "Invest in retention, offer loyalty rewards"),
    ("At Risk", "Win-back campaigns, special offers"),
    ("Loyal Low Spender", "Upsell opportunities, product recommendations"),
    ("At Risk High Spender", "Priority retention, personalized outreach"),
]


def recommendations(tier: Column, recency: Column, frequency: Column, avg_value: Column,
                    limit: int = 3) -> Column:
    """Ordered rules, the first ``limit`` joined by '; ' (native arrays,
    no Python UDF)."""
    high = tier == F.lit("High")
    recs = F.array_compact(F.array(
        F.when(high, F.lit(REC_PRIORITY)),
        F.when(high, F.lit(REC_PERSONAL)),
        F.when(high & (recency > 30), F.lit(REC_WINBACK)),
        F.when((frequency > 10) & (avg_value < 50), F.lit(REC_UPSELL)),
        F.when(recency < 7, F.lit(REC_CROSS))))
    return F.array_join(F.slice(recs, 1, limit), "; ")


def customer_master(customers: DataFrame, clv: DataFrame, segments: DataFrame) -> DataFrame:
    """Customers inner-joined with CLV (CLV_Historical, CLV_Tier) and
    segments (Segment), plus the Recommendations text.  Columns are selected
    before the joins so no name collides."""
    master = (customers.join(clv.select("CustomerID", "CLV_Historical", "CLV_Tier"), "CustomerID")
              .join(segments.select("CustomerID", "Segment"), "CustomerID"))
    return master.withColumn("Recommendations", recommendations(
        F.col("CLV_Tier"), F.col("Recency"), F.col("Frequency"), F.col("AvgTransactionValue")))


def marketing_lists(master: DataFrame, email_col: str | None = None) -> dict[str, DataFrame]:
    """customer_master, high_value_list (CLV_Tier High) and
    at_risk_list (Recency > 90); Email is carried when the data has it."""
    email = F.col(email_col) if email_col else F.lit(None).cast("string")
    cols = [F.col("CustomerID"), email.alias("Email"), F.col("Recommendations")]
    return {
        "customer_master": master,
        "high_value_list": master.filter(F.col("CLV_Tier") == "High").select(*cols),
        "at_risk_list": master.filter(F.col("Recency") > 90).select(*cols),
    }


def segment_action(segment: Column) -> Column:
    """Action text of a probabilistic segment (substring tests in order;
    'Medium' gets none)."""
    expr = None
    for key, text in SEGMENT_ACTIONS:
        cond = segment.contains(key)
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr


def tier_actions(roi: DataFrame) -> DataFrame:
    """Recommended actions per tier, one row per (Tier, rank, action)."""
    def arr(key: str) -> Column:
        return F.array(*[F.lit(a) for a in TIER_ACTIONS[key]])
    actions = (F.when(F.col("Tier") == "High", arr("High"))
               .when(F.col("Tier") == "Medium", arr("Medium"))
               .when(F.col("Acquisition_ROI") > 0, arr("Low+")).otherwise(arr("Low-")))
    return roi.select("Tier", F.posexplode(actions).alias("rank", "action")).select(
        "Tier", (F.col("rank") + 1).cast("int").alias("rank"), "action")


def driver_label(feature: Column) -> Column:
    """Plain-language driver of a feature name (first matching rule)."""
    day_idx = F.split(feature, "_").getItem(1)
    day_name = F.element_at(F.array(*[F.lit(d) for d in WEEKDAY_NAMES]),
                            day_idx.try_cast("int") + 1)
    return (F.when(feature.contains("TotalMonetary"), F.lit("High total historical spend"))
            .when(feature.contains("TransactionCount"), F.lit("High purchase frequency"))
            .when(feature.contains("AvgTransactionValue"), F.lit("High average transaction value"))
            .when(feature.contains("Recency"), F.lit("Recent purchases (low recency)"))
            .when(feature.contains("Day_"), F.concat(F.lit("Frequent purchases on "), day_name))
            .when(feature.contains("Hour_"),
                  F.concat(F.lit("Frequent purchases at "), day_idx, F.lit(":00"))))


def metric_trends(history: DataFrame, decimals: int = 4) -> DataFrame:
    """Mean and std of mae, rmse, r2 per model (empty history -> no rows)."""
    aggs = []
    for m in ("mae", "rmse", "r2"):
        aggs += [np_round(F.avg(m), decimals).alias(f"{m}_mean"),
                 np_round(F.stddev_samp(m), decimals).alias(f"{m}_std")]
    return history.groupBy("model").agg(*aggs)
