"""Queries: customer features, historical CLV, comparison, ensemble, ROI, outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import ensemble as EN
from patronage.operators import outputs as OUT
from patronage.plans import oracle_sql as O
from patronage.plans.catalog import (comparison, customers, ensemble, features, historical,
                                     register, segmented, ts_out)

FEAT_OUT = (["CustomerID"] + ["PurchaseCount", "TotalMonetary", "TotalQuantity", "UniqueProducts",
                              "TransactionCount", "Country", "CustomerLifespan",
                              "AvgTransactionValue", "AvgItemsPerTransaction",
                              "PurchaseFrequency", "Recency"]
            + [f"Day_{i}_Purchases" for i in range(7)] + [f"Hour_{i}_Purchases" for i in range(24)])


@register("E18_customer_features", O.compose(
    f"SELECT FirstPurchase, LastPurchase, {', '.join(FEAT_OUT)} FROM feat", ["feat"]))
def e18(spark, sf):
    return features(spark, sf, hub=False).select(ts_out("FirstPurchase"), ts_out("LastPurchase"),
                                                 *FEAT_OUT)


@register("E22_recent_activity", O.compose(
    "SELECT CustomerID, Recent90DaySpend, Recent90DayTransactions FROM feat", ["feat"]))
def e22(spark, sf):
    return features(spark, sf, hub=False).select("CustomerID", "Recent90DaySpend",
                                                 "Recent90DayTransactions")


@register("E23_future_spend", O.compose("""
SELECT CustomerID, CAST(sum(spend_cents) AS BIGINT) / 100.0 AS Actual_Future_Spend FROM clean, snap
WHERE InvoiceDate BETWEEN snapshot - INTERVAL 90 DAY AND snapshot - INTERVAL 1 DAY GROUP BY CustomerID""",
                                        ["clean", "snap"]))
def e23(spark, sf):
    from patronage.operators.customers import future_spend
    from patronage.plans.catalog import clean, snapshot
    return future_spend(clean(spark, sf), snapshot(spark, sf))


@register("E24_target_summary", O.compose("""
SELECT sum(target_cents) / 100.0 / CAST(count(*) AS DOUBLE) AS target_mean,
  max(target_cents) / 100.0 AS target_max,
  CAST(count(*) FILTER (WHERE target_cents = 0) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE) AS target_zero_pct
FROM feat JOIN mlds USING (CustomerID) WHERE is_train""", ["feat", "mlds"]))
def e24(spark, sf):
    from patronage.operators.clv_ml import train_part
    from patronage.operators.customers import target_summary
    return target_summary(features(spark, sf, hub=False).where(train_part()))


H1_OUT = ["CustomerID", "DailySpend", "CLV_DailyAvg", "CLV_FrequencyBased", "Recent90DaySpend",
          "Recent90DayTransactions", "CLV_RecentBased", "CLV_Historical", "CLV_Tier"]


@register("H1_historical_clv", O.compose(f"SELECT {', '.join(H1_OUT)} FROM hist", ["hist"]))
def h1(spark, sf):
    return historical(spark, sf).select(*H1_OUT)


@register("F4_tier_counts", O.compose("""
SELECT CLV_Tier, count(*) AS customers, avg(CLV_Historical) AS avg_clv FROM hist GROUP BY CLV_Tier""",
                                      ["hist"]))
def f4(spark, sf):
    return historical(spark, sf).groupBy("CLV_Tier").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("CLV_Historical").alias("avg_clv"))


CMP_OUT = ["CustomerID", "CLV_Historical", "CLV_Tier", "CLV_ML", "CLV_Tier_ML",
           "CLV_Probabilistic", "CLV_Tier_Prob"]


@register("I1_assemble_clv", O.compose(f"SELECT {', '.join(CMP_OUT)} FROM cmp", ["cmp"]))
def i1(spark, sf):
    return comparison(spark, sf).select(*CMP_OUT)


ENS_OUT = ["CustomerID", "CLV_Historical", "CLV_ML", "CLV_Probabilistic", "TransactionCount",
           "weight_historical", "weight_probabilistic", "weight_ml", "CLV_Final", "CLV_Tier_Final"]


@register("I2_ensemble_clv", O.compose(f"SELECT {', '.join(ENS_OUT)} FROM ens", ["ens"]))
def i2(spark, sf):
    return ensemble(spark, sf).select(*ENS_OUT)


@register("E25_clv_correlations", O.compose("""
SELECT corr(CLV_Historical, CLV_ML) AS corr_hist_ml, corr(CLV_Historical, CLV_Probabilistic) AS corr_hist_prob,
       corr(CLV_ML, CLV_Probabilistic) AS corr_ml_prob FROM cmp""", ["cmp"]))
def e25(spark, sf):
    return EN.clv_correlations(comparison(spark, sf))


@register("E26_method_summary", O.compose(" UNION ALL ".join(f"""
SELECT '{label}' AS Method, sum({c}) AS total, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median,
       stddev_samp({c}) AS std FROM cmp""" for c, label in [
    ("CLV_Historical", "Historical"), ("CLV_ML", "Machine Learning"),
    ("CLV_Probabilistic", "Probabilistic")]), ["cmp"]))
def e26(spark, sf):
    return EN.method_summary(comparison(spark, sf))


@register("E27_top_decile_historical", O.compose("""
WITH r AS (SELECT CLV_Historical AS v, row_number() OVER (ORDER BY CLV_Historical DESC, CustomerID) AS rk,
                  count(*) OVER () AS n FROM hist WHERE CLV_Historical IS NOT NULL)
SELECT sum(v) FILTER (WHERE rk <= n // 10) AS top_total, sum(v) AS total, avg(v) AS mean,
       quantile_cont(v, 0.5) AS median FROM r""", ["hist"]))
def e27(spark, sf):
    return EN.top_decile_summary(historical(spark, sf), "CLV_Historical")


@register("E30_roi_by_tier", O.compose("""
WITH t AS (SELECT CLV_Tier_Final AS Tier, avg(CLV_Final) AS Avg_CLV, count(*) AS Customers
           FROM ens WHERE CLV_Tier_Final IS NOT NULL GROUP BY 1),
c AS (SELECT *, CASE Tier WHEN 'Low' THEN CAST(50 AS DOUBLE) WHEN 'Medium' THEN CAST(100 AS DOUBLE)
                          WHEN 'High' THEN CAST(200 AS DOUBLE) END AS acq FROM t)
SELECT Tier, Avg_CLV, Customers, acq AS Acquisition_Cost, (Avg_CLV - acq) / acq AS Acquisition_ROI,
  acq * CAST(0.3 AS DOUBLE) AS Retention_Cost,
  (Avg_CLV * CAST(1.2 AS DOUBLE) - Avg_CLV - acq * CAST(0.3 AS DOUBLE)) / (acq * CAST(0.3 AS DOUBLE)) AS Retention_ROI
FROM c""", ["ens"]))
def e30(spark, sf):
    return EN.roi_by_tier(ensemble(spark, sf))


def _actions_sql() -> str:
    rows = []
    for key, acts in OUT.TIER_ACTIONS.items():
        for i, a in enumerate(acts, 1):
            rows.append(f"('{key}', {i}, '{a}')")
    return "(VALUES " + ", ".join(rows) + ") AS a(k, rank, action)"


@register("G11_tier_actions", O.compose(f"""
WITH t AS (SELECT CLV_Tier_Final AS Tier, avg(CLV_Final) AS Avg_CLV FROM ens
           WHERE CLV_Tier_Final IS NOT NULL GROUP BY 1),
r AS (SELECT Tier, CASE WHEN Tier = 'High' THEN 'High' WHEN Tier = 'Medium' THEN 'Medium'
        WHEN (Avg_CLV - CAST(50 AS DOUBLE)) / CAST(50 AS DOUBLE) > 0 THEN 'Low+' ELSE 'Low-' END AS k FROM t)
SELECT r.Tier, CAST(a.rank AS INTEGER) AS rank, a.action FROM r JOIN {_actions_sql()} ON r.k = a.k""",
                                        ["ens"]))
def g11(spark, sf):
    return OUT.tier_actions(EN.roi_by_tier(ensemble(spark, sf)))


@register("G8_tier_agreement_3", O.compose("""
SELECT avg(CASE WHEN len(list_distinct(list_filter([CLV_Tier, CLV_Tier_ML, CLV_Tier_Prob], lambda x: x IS NOT NULL))) = 1
                THEN 1.0 ELSE 0.0 END) * 100.0 AS agreement_pct FROM cmp""", ["cmp"]))
def g8(spark, sf):
    return EN.tier_agreement_3(comparison(spark, sf))


def _top_ids(col: str) -> str:
    return (f"(SELECT CustomerID FROM cmp WHERE {col} IS NOT NULL "
            f"ORDER BY {col} DESC, CustomerID LIMIT 10)")


@register("I3_top10_overlap", O.compose(f"""
SELECT (SELECT count(*) FROM ({_top_ids('CLV_Historical')} INTERSECT {_top_ids('CLV_ML')})) AS hist_ml,
       (SELECT count(*) FROM ({_top_ids('CLV_Historical')} INTERSECT {_top_ids('CLV_Probabilistic')})) AS hist_prob,
       (SELECT count(*) FROM ({_top_ids('CLV_ML')} INTERSECT {_top_ids('CLV_Probabilistic')})) AS ml_prob""",
                                        ["cmp"]))
def i3(spark, sf):
    return EN.top_overlaps(comparison(spark, sf))


@register("I4_p99_limit", O.compose(
    "SELECT quantile_cont(CLV_Historical, 0.99) AS limit FROM cmp", ["cmp"]))
def i4(spark, sf):
    return EN.trimming_limit(comparison(spark, sf), "CLV_Historical")


@register("G13_high_value_low_frequency", O.compose("""
SELECT CustomerID, CLV_Final, TransactionCount FROM ens
WHERE CLV_Tier_Final = 'High' AND TransactionCount < 5 ORDER BY CLV_Final DESC, CustomerID LIMIT 10""",
                                                    ["ens"]))
def g13(spark, sf):
    return EN.high_value_low_frequency(ensemble(spark, sf)).select(
        "CustomerID", "CLV_Final", "TransactionCount")


@register("G14_high_frequency_low_value", O.compose("""
SELECT CustomerID, CLV_Final, TransactionCount FROM ens
WHERE TransactionCount >= 10 AND CLV_Tier_Final = 'Low' ORDER BY CLV_Final DESC, CustomerID LIMIT 10""",
                                                    ["ens"]))
def g14(spark, sf):
    return EN.high_frequency_low_value(ensemble(spark, sf)).select(
        "CustomerID", "CLV_Final", "TransactionCount")


@register("G15_top_quintile", O.compose("""
SELECT count(*) AS customers, sum(CLV_Final) AS total_value FROM ens
WHERE CLV_Final >= (SELECT quantile_cont(CLV_Final, 0.8) FROM ens)""", ["ens"]))
def g15(spark, sf):
    return EN.top_quintile(ensemble(spark, sf))


_REC_SQL = f"""array_to_string(list_slice(list_filter([
  CASE WHEN h.CLV_Tier = 'High' THEN '{OUT.REC_PRIORITY}' END,
  CASE WHEN h.CLV_Tier = 'High' THEN '{OUT.REC_PERSONAL}' END,
  CASE WHEN h.CLV_Tier = 'High' AND c.Recency > 30 THEN '{OUT.REC_WINBACK}' END,
  CASE WHEN c.Frequency > 10 AND c.AvgTransactionValue < 50 THEN '{OUT.REC_UPSELL}' END,
  CASE WHEN c.Recency < 7 THEN '{OUT.REC_CROSS}' END], lambda x: x IS NOT NULL), 1, 3), '; ')"""

O.fragment("master", ["cust", "hist", "seg"], f"""
SELECT c.CustomerID, c.Recency, c.Frequency, c.Monetary, c.AvgTransactionValue, h.CLV_Historical,
       h.CLV_Tier, s.Segment, {_REC_SQL} AS Recommendations
FROM cust c JOIN hist h ON c.CustomerID = h.CustomerID JOIN seg s ON c.CustomerID = s.CustomerID
""")

MASTER_OUT = ["CustomerID", "Recency", "Frequency", "Monetary", "AvgTransactionValue",
              "CLV_Historical", "CLV_Tier", "Segment", "Recommendations"]


def master(spark, sf):
    return OUT.customer_master(customers(spark, sf), historical(spark, sf), segmented(spark, sf))


@register("G12_customer_master", O.compose(f"SELECT {', '.join(MASTER_OUT)} FROM master", ["master"]))
def g12(spark, sf):
    return master(spark, sf).select(*MASTER_OUT)


@register("G16_high_value_list", O.compose(
    "SELECT CustomerID, CAST(NULL AS VARCHAR) AS Email, Recommendations FROM master "
    "WHERE CLV_Tier = 'High'", ["master"]))
def g16h(spark, sf):
    return OUT.marketing_lists(master(spark, sf))["high_value_list"]


@register("G16_at_risk_list", O.compose(
    "SELECT CustomerID, CAST(NULL AS VARCHAR) AS Email, Recommendations FROM master "
    "WHERE Recency > 90", ["master"]))
def g16a(spark, sf):
    return OUT.marketing_lists(master(spark, sf))["at_risk_list"]
