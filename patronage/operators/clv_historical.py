"""Historical CLV (H1) from the one-pass customer feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.binning import tier_cut


def historical_clv(features: DataFrame, days: int = 365, weights=(0.3, 0.4, 0.3),
                   quarter_factor: float = 4.0, tier: bool = True) -> DataFrame:
    """H1: three extrapolations of past spend and their weighted blend.

    CLV_DailyAvg = TotalMonetary / CustomerLifespan * days
    CLV_FrequencyBased = TransactionCount / CustomerLifespan * days * AvgTransactionValue
    CLV_RecentBased = Recent90DaySpend * 4 (quarter to year, as published)
    CLV_Historical = 0.3, 0.4, 0.3 blend; CLV_Tier by the 33 % / 66 % cut.
    The 90-day window columns come from the same group-by as the features
    (no second pass, no join).
    """
    life = F.col("CustomerLifespan").cast("double")
    daily = F.col("TotalMonetary") / life
    out = features.select(
        "CustomerID", "TotalMonetary", "TransactionCount", "CustomerLifespan",
        "AvgTransactionValue", "Recent90DaySpend", "Recent90DayTransactions",
        daily.alias("DailySpend"),
        (daily * F.lit(float(days))).alias("CLV_DailyAvg"),
        (F.col("TransactionCount").cast("double") / life * F.lit(float(days))
         * F.col("AvgTransactionValue")).alias("CLV_FrequencyBased"),
        (F.col("Recent90DaySpend") * F.lit(float(quarter_factor))).alias("CLV_RecentBased"),
    )
    w1, w2, w3 = (float(w) for w in weights)
    out = out.withColumn("CLV_Historical", F.col("CLV_DailyAvg") * w1
                         + F.col("CLV_FrequencyBased") * w2 + F.col("CLV_RecentBased") * w3)
    if tier:
        out = tier_cut(out, "CLV_Historical", "CLV_Tier")
    return out
