"""CLV comparison, ensemble, ROI and opportunity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import clip, coerce_double
from patronage.functions.ordering import exact_quantiles, quantile_table, top_mask
from patronage.operators.binning import tier_cut
from patronage.session import materialize

CLV_COLS = ("CLV_Historical", "CLV_ML", "CLV_Probabilistic")

# FIXED VALUES - ROI assumptions (currency units per customer).
ACQUISITION_COST = {"Low": 50.0, "Medium": 100.0, "High": 200.0}
RETENTION_COST_MULTIPLIER = 0.3
RETENTION_LIFT = 0.20


def assemble_clv(base: DataFrame, historical: DataFrame | None, ml: DataFrame | None,
                 probabilistic: DataFrame | None) -> DataFrame:
    """One row per customer of ``base`` with the three CLVs and tiers.

    Inputs are (CustomerID, CLV_Historical, CLV_Tier), (CustomerID, CLV_ML,
    CLV_Tier_ML), (CustomerID, CLV_Probabilistic, CLV_Tier_Prob); missing
    methods give NULL columns.  All joins are left joins on the customer key
    (shuffle-partitioned once by AQE; identical keys co-partition)."""
    out = base.select("CustomerID")
    parts = [(historical, "CLV_Historical", "CLV_Tier"), (ml, "CLV_ML", "CLV_Tier_ML"),
             (probabilistic, "CLV_Probabilistic", "CLV_Tier_Prob")]
    for df, value, tier in parts:
        if df is None:
            out = out.withColumns({value: F.lit(None).cast("double"),
                                   tier: F.lit(None).cast("string")})
            continue
        tier_col = F.col(tier) if tier in df.columns else F.lit(None).cast("string").alias(tier)
        out = out.join(df.select("CustomerID", value, tier_col), "CustomerID", "left")
    return out


def ensemble_clv(comparison: DataFrame, transactions: DataFrame | None = None,
                 cap: float = 0.6, ml_weight: float = 0.4, scale: float = 20.0,
                 stage: bool = True) -> DataFrame:
    """Weighted blend of the three CLVs.

    w_h = clip(n/20, 0, .6), w_p = clip(1 - n/20, 0, .6), w_ml = .4, each
    divided by their sum; missing or non-numeric CLVs count as 0; n is the
    customer's TransactionCount (0 when absent, 1 when no table is given).
    """
    ens = comparison.select("CustomerID", *[coerce_double(F.col(c)).alias(c) for c in CLV_COLS])
    if transactions is not None:
        ens = ens.join(transactions.select("CustomerID", "TransactionCount"), "CustomerID", "left")
        ens = ens.withColumn("TransactionCount",
                             F.coalesce(F.col("TransactionCount").cast("double"), F.lit(0.0)))
    else:
        ens = ens.withColumn("TransactionCount", F.lit(1.0))
    n = F.col("TransactionCount")
    wh = clip(n / F.lit(scale), 0.0, cap)
    wp = clip(F.lit(1.0) - n / F.lit(scale), 0.0, cap)
    wm = F.lit(float(ml_weight))
    total = wh + wp + wm
    ens = ens.withColumns({"weight_historical": wh / total, "weight_probabilistic": wp / total,
                           "weight_ml": wm / total})
    ens = ens.withColumn("CLV_Final",
                         F.col("weight_historical") * F.col("CLV_Historical")
                         + F.col("weight_probabilistic") * F.col("CLV_Probabilistic")
                         + F.col("weight_ml") * F.col("CLV_ML"))
    if stage:
        # the tier cut reads the blend twice (quantiles, then labels): pin the
        # joined result once instead of re-running the four-way join
        ens = materialize(ens, "ensemble")
    return tier_cut(ens, "CLV_Final", "CLV_Tier_Final")


def clv_correlations(comparison: DataFrame) -> DataFrame:
    """Pairwise-complete Pearson correlations of the three CLVs."""
    h, m, p = CLV_COLS
    return comparison.agg(F.corr(h, m).alias("corr_hist_ml"), F.corr(h, p).alias("corr_hist_prob"),
                          F.corr(m, p).alias("corr_ml_prob"))


def method_summary(comparison: DataFrame) -> DataFrame:
    """Total, mean, median and std (n-1) per method; NULLs skipped."""
    names = {"CLV_Historical": "Historical", "CLV_ML": "Machine Learning",
             "CLV_Probabilistic": "Probabilistic"}
    values = materialize(comparison.select(*[F.col(c).cast("double").alias(c) for c in names]), "methods")
    medians = quantile_table(values, list(names), [0.5], written=True)
    long = values.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("Method"), F.col(c).alias("x"), F.lit(medians[c][0]).cast("double").alias("m"))
        for c, label in names.items()])))
    return long.groupBy("Method").agg(
        F.sum("x").alias("total"), F.avg("x").alias("mean"), F.max("m").alias("median"), F.stddev_samp("x").alias("std"))


def top_decile_summary(df: DataFrame, col: str, share_div: int = 10) -> DataFrame:
    """Total of the top int(n/10) customers by ``col`` plus total, mean
    and median of the whole column."""
    vals = df.select("CustomerID", F.col(col).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull())
    vals = materialize(vals, "top-decile")
    ranked, _ = top_mask(vals, "_v", "CustomerID", lambda n: n // share_div, "_top")
    med = F.lit(quantile_table(vals, ["_v"], [0.5], written=True)["_v"][0]).cast("double")
    return ranked.agg(
        F.sum(F.when(F.col("_top"), F.col("_v"))).alias("top_total"),
        F.sum("_v").alias("total"), F.avg("_v").alias("mean")).withColumn("median", med)


def roi_by_tier(ensemble: DataFrame, tier_col: str = "CLV_Tier_Final",
                value_col: str = "CLV_Final") -> DataFrame:
    """ROI of acquisition and retention per tier (fixed assumptions)."""
    cost_map = F.create_map(*[x for k, v in ACQUISITION_COST.items() for x in (F.lit(k), F.lit(v))])
    per = ensemble.filter(F.col(tier_col).isNotNull()).groupBy(F.col(tier_col).alias("Tier")).agg(
        F.avg(value_col).alias("Avg_CLV"), F.count(F.lit(1)).alias("Customers"))
    acq = F.try_element_at(cost_map, F.col("Tier"))
    ret = acq * F.lit(RETENTION_COST_MULTIPLIER)
    lifted = F.col("Avg_CLV") * F.lit(1.0 + RETENTION_LIFT)
    return per.select(
        "Tier", "Avg_CLV", F.col("Customers").cast("long").alias("Customers"),
        acq.alias("Acquisition_Cost"), ((F.col("Avg_CLV") - acq) / acq).alias("Acquisition_ROI"),
        ret.alias("Retention_Cost"),
        ((lifted - F.col("Avg_CLV") - ret) / ret).alias("Retention_ROI"))


def tier_agreement_3(comparison: DataFrame, cols=("CLV_Tier", "CLV_Tier_ML",
                                                  "CLV_Tier_Prob")) -> DataFrame:
    """% of customers whose non-null tiers are all equal (exactly one
    distinct non-null value; rows with no tier at all disagree)."""
    agree = F.size(F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in cols])))) == 1
    return comparison.agg((F.avg(agree.cast("double")) * 100.0).alias("agreement_pct"))


def top_overlaps(comparison: DataFrame, k: int = 10) -> DataFrame:
    """Overlap of the top-k customer lists of each pair of methods."""
    from patronage.operators.binning import overlap_size, top_k
    tops = {c: top_k(comparison, c, k).select("CustomerID") for c in CLV_COLS}
    h, m, p = CLV_COLS
    spark = comparison.sparkSession
    return spark.range(1).select(
        overlap_size(tops[h], tops[m]).alias("hist_ml"),
        overlap_size(tops[h], tops[p]).alias("hist_prob"),
        overlap_size(tops[m], tops[p]).alias("ml_prob"))


def trimming_limit(df: DataFrame, col: str, q: float = 0.99) -> DataFrame:
    """I4: the p99 of a CLV column (used to trim plot axes)."""
    return exact_quantiles(df, col, [q], ["limit"])


def high_value_low_frequency(ens: DataFrame, k: int = 10, max_tx: int = 5) -> DataFrame:
    """High tier with fewer than 5 transactions, top k by CLV_Final."""
    return (ens.filter((F.col("CLV_Tier_Final") == "High") & (F.col("TransactionCount") < max_tx))
            .orderBy(F.col("CLV_Final").desc(), F.col("CustomerID")).limit(k))


def high_frequency_low_value(ens: DataFrame, k: int = 10, min_tx: int = 10) -> DataFrame:
    """At least 10 transactions and Low tier, top k by CLV_Final."""
    return (ens.filter((F.col("TransactionCount") >= min_tx) & (F.col("CLV_Tier_Final") == "Low"))
            .orderBy(F.col("CLV_Final").desc(), F.col("CustomerID")).limit(k))


def top_quintile(ens: DataFrame, q: float = 0.8) -> DataFrame:
    """Customers with CLV_Final >= p80: count and total value."""
    cut = exact_quantiles(ens, "CLV_Final", [q], ["cut"]).select("cut").scalar()
    return ens.filter(F.col("CLV_Final") >= cut).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("CLV_Final").alias("total_value"))
