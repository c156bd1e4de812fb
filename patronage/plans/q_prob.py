"""Queries: lifetimes summaries, BG/NBD + Gamma-Gamma, probabilistic CLV."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import clv_prob as P
from patronage.plans import oracle_sql as O
from patronage.plans.catalog import clean, lifetimes, materialize, prob_model, register

BG = P.PUBLISHED_BGNBD
GG = P.PUBLISHED_GAMMA_GAMMA
SUMMARY_OUT = ["CustomerID", "frequency", "recency", "T", "monetary_value"]


@register("H2_lifetimes_summary", O.compose(f"SELECT {', '.join(SUMMARY_OUT)} FROM lt", ["lt"]))
def h2(spark, sf):
    return lifetimes(spark, sf).select(*SUMMARY_OUT)


@register("H3_calibration_holdout", O.compose("SELECT * FROM calh", ["calh"]))
def h3(spark, sf):
    from patronage.plans.catalog import snapshot
    snap = snapshot(spark, sf)
    return P.calibration_holdout(clean(spark, sf), snap - F.make_dt_interval(F.lit(90)), snap)


@register("H4_repeat_customers", O.compose(
    f"SELECT {', '.join(SUMMARY_OUT)} FROM lt WHERE frequency > 0", ["lt"]))
def h4(spark, sf):
    return P.repeat_customers(lifetimes(spark, sf)).select(*SUMMARY_OUT)


@register("H5_bgnbd_loglik_fixed", O.compose(
    f"SELECT count(*) AS customers, sum({O.bgnbd_ll_sql(*BG.as_tuple())}) AS loglik "
    "FROM lt WHERE frequency > 0", ["lt"]))
def h5ll(spark, sf):
    rep = P.repeat_customers(lifetimes(spark, sf))
    return rep.agg(F.count(F.lit(1)).alias("customers"), F.sum(P.bgnbd_loglik(
        F.col("frequency"), F.col("recency"), F.col("T"), *BG.as_tuple())).alias("loglik"))


@register("H5_bgnbd_fit")
def h5(spark, sf):
    return P.params_frame(spark, P.bgnbd_fit(materialize(lifetimes(spark, sf))))


@register("H6_gamma_gamma_fit")
def h6(spark, sf):
    return P.params_frame(spark, P.gamma_gamma_fit(materialize(lifetimes(spark, sf))))


@register("H7_expected_purchases_fixed", O.compose(
    f"SELECT CustomerID, {O.expected_purchases_sql(*BG.as_tuple(), 90.0)} AS predicted_purchases_90d "
    "FROM lt WHERE frequency > 0", ["lt"]))
def h7(spark, sf):
    rep = P.repeat_customers(lifetimes(spark, sf))
    return rep.select("CustomerID", P.expected_purchases(
        F.lit(90.0), F.col("frequency"), F.col("recency"), F.col("T"), BG)
        .alias("predicted_purchases_90d"))


@register("H8_p_alive_fixed", O.compose(
    f"SELECT CustomerID, {O.p_alive_sql(*BG.as_tuple())} AS probability_alive FROM lt", ["lt"]))
def h8(spark, sf):
    s = lifetimes(spark, sf)
    return s.select("CustomerID", P.p_alive(F.col("frequency"), F.col("recency"), F.col("T"), BG)
                    .alias("probability_alive"))


@register("H9_gamma_gamma_value_fixed", O.compose(
    f"SELECT CustomerID, {O.gg_value_sql(*GG.as_tuple())} AS predicted_avg_value FROM lt "
    "WHERE frequency > 0", ["lt"]))
def h9(spark, sf):
    rep = P.repeat_customers(lifetimes(spark, sf))
    return rep.select("CustomerID", P.gamma_gamma_value(F.col("frequency"), F.col("monetary_value"),
                                                        GG).alias("predicted_avg_value"))


PROB_OUT = ["CustomerID", "frequency", "recency", "T", "monetary_value", "predicted_avg_value",
            "probability_alive", "predicted_purchases_30d", "CLV_30d", "predicted_purchases_90d",
            "CLV_90d", "predicted_purchases_365d", "CLV_365d", "CLV_3y_discounted", "CLV_Tier_Prob"]


@register("H10_probabilistic_clv")
def h10(spark, sf):
    return prob_model(spark, sf)[3].select(*PROB_OUT)


@register("H12_prob_tier_counts")
def h12(spark, sf):
    return prob_model(spark, sf)[3].groupBy("CLV_Tier_Prob").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("CLV_365d").alias("avg_clv"))


@register("H13_expected_transactions")
def h13(spark, sf):
    return P.expected_transactions(prob_model(spark, sf)[3])


@register("G9_bgnbd_quadrants")
def g9(spark, sf):
    return P.bgnbd_quadrants(prob_model(spark, sf)[3]).select(
        "CustomerID", "probability_alive", "predicted_purchases_90d", "segment")


@register("E28_quadrant_summary")
def e28(spark, sf):
    return P.quadrant_summary(P.bgnbd_quadrants(prob_model(spark, sf)[3]))


@register("E29_horizon_totals")
def e29(spark, sf):
    return P.horizon_totals(prob_model(spark, sf)[3])


@register("D9_p_alive_grid_fixed", O.compose(f"""
WITH t AS (SELECT avg(T) AS T FROM lt WHERE frequency > 0),
g AS (SELECT CAST(floor(range / 13) * 5 AS BIGINT) AS frequency, CAST((range % 13) * 30 AS DOUBLE) AS recency
      FROM range(143))
SELECT g.frequency, g.recency, t.T,
  CASE WHEN g.recency < t.T THEN {O.p_alive_sql(*BG.as_tuple(), x='g.frequency', tx='g.recency', T='t.T')}
       ELSE 0.0 END AS probability_alive
FROM g, t""", ["lt"]))
def d9(spark, sf):
    return P.scoring_grid(lifetimes(spark, sf), BG, with_purchases=False)


@register("D9_scoring_grid")
def d9b(spark, sf):
    summary, bg, gg, scored = prob_model(spark, sf)
    return P.scoring_grid(summary, bg)


def _fixed_scores(spark, sf):
    """The 90-day scores under the published parameters, made once."""
    x, tx, T = F.col("frequency"), F.col("recency"), F.col("T")
    return materialize(P.repeat_customers(lifetimes(spark, sf)).select(
        "CustomerID", "monetary_value", P.p_alive(x, tx, T, BG).alias("probability_alive"),
        P.expected_purchases(F.lit(90.0), x, tx, T, BG).alias("predicted_purchases_90d")))


_FIXED_Q = f"""
WITH s AS (SELECT CustomerID, monetary_value, {O.p_alive_sql(*BG.as_tuple())} AS probability_alive,
                  {O.expected_purchases_sql(*BG.as_tuple(), 90.0)} AS predicted_purchases_90d
           FROM lt WHERE frequency > 0),
m AS (SELECT quantile_cont(predicted_purchases_90d, 0.5) AS med FROM s)
SELECT s.*, CASE
  WHEN probability_alive > 0.7 AND predicted_purchases_90d > med THEN 'High Potential'
  WHEN probability_alive < 0.3 AND predicted_purchases_90d < med THEN 'At Risk'
  WHEN probability_alive > 0.7 AND predicted_purchases_90d < med THEN 'Loyal Low Spender'
  WHEN probability_alive < 0.3 AND predicted_purchases_90d > med THEN 'At Risk High Spender'
  ELSE 'Medium' END AS segment
FROM s, m"""


def _action_sql(col: str) -> str:
    from patronage.operators.outputs import SEGMENT_ACTIONS
    return "CASE " + " ".join(f"WHEN contains({col}, '{k}') THEN '{v}'"
                              for k, v in SEGMENT_ACTIONS) + " END"


@register("G9_bgnbd_quadrants_fixed", O.compose(
    f"SELECT CustomerID, probability_alive, predicted_purchases_90d, segment FROM ({_FIXED_Q})",
    ["lt"]))
def g9f(spark, sf):
    return P.bgnbd_quadrants(_fixed_scores(spark, sf)).select(
        "CustomerID", "probability_alive", "predicted_purchases_90d", "segment")


@register("E28_quadrant_summary_fixed", O.compose(f"""
WITH q AS ({_FIXED_Q})
SELECT segment, count(*) AS customers,
  CAST(count(*) AS DOUBLE) * 100.0 / CAST((SELECT count(*) FROM q) AS DOUBLE) AS pct,
  avg(predicted_purchases_90d) AS mean_predicted_purchases, avg(probability_alive) AS mean_probability_alive,
  avg(monetary_value) AS mean_monetary_value, {_action_sql('segment')} AS action
FROM q GROUP BY segment""", ["lt"]))
def e28f(spark, sf):
    return P.quadrant_summary(P.bgnbd_quadrants(_fixed_scores(spark, sf)))


# ------------------------------------------------------- all scores under the published parameters

def _ep(t) -> str:
    return O.expected_purchases_sql(*BG.as_tuple(), float(t), terms=2000)


_RATE = 1.1 ** (1.0 / 12.0) - 1.0
_SCORED = f"""
SELECT CustomerID, frequency, recency, T, monetary_value, v AS predicted_avg_value, probability_alive,
  {", ".join(f"p{h} AS predicted_purchases_{h}d, p{h} * v AS CLV_{h}d" for h in (30, 90, 365))}
FROM (SELECT *, {O.gg_value_sql(*GG.as_tuple())} AS v, {O.p_alive_sql(*BG.as_tuple())} AS probability_alive,
  {", ".join(f"{_ep(h)} AS p{h}" for h in (30, 90, 365))} FROM lt WHERE frequency > 0)"""
_TIERED = f"""
SELECT s.*, CASE WHEN CLV_365d <= lo THEN 'Low' WHEN CLV_365d <= hi THEN 'Medium' ELSE 'High' END AS CLV_Tier_Prob
FROM ({_SCORED}) s, (SELECT quantile_cont(CLV_365d, 1.0 / 3) AS lo, quantile_cont(CLV_365d, 2.0 / 3) AS hi FROM ({_SCORED})) q"""
FIXED_OUT = [c for c in PROB_OUT if c != "CLV_3y_discounted"]


def _published(spark, sf, discount=False):
    return P.probabilistic_clv(lifetimes(spark, sf), BG, GG, discount=discount)


@register("H10_probabilistic_clv_fixed", O.compose(f"SELECT {', '.join(FIXED_OUT)} FROM ({_TIERED})", ["lt"]))
def h10f(spark, sf):
    return _published(spark, sf).select(*FIXED_OUT)


@register("H11_discounted_clv_fixed", O.compose(f"""
WITH rep AS (SELECT *, {O.gg_value_sql(*GG.as_tuple())} AS v FROM lt WHERE frequency > 0),
 per AS (SELECT CustomerID, m, {O.expected_purchases_sql(*BG.as_tuple(), '(30.0 * m)', terms=2000)} * v / pow({1.0 + _RATE!r}, m) AS x
         FROM rep, range(1, 37) r(m))
SELECT CustomerID, sum(x) AS CLV_3y_discounted FROM per GROUP BY 1""", ["lt"]))
def h11f(spark, sf):
    return _published(spark, sf, discount=True).select("CustomerID", "CLV_3y_discounted")


@register("H12_prob_tier_counts_fixed", O.compose(f"""
SELECT CLV_Tier_Prob, count(*) AS customers, avg(CLV_365d) AS avg_clv FROM ({_TIERED}) GROUP BY 1""", ["lt"]))
def h12f(spark, sf):
    return _published(spark, sf).groupBy("CLV_Tier_Prob").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("CLV_365d").alias("avg_clv"))


@register("H13_expected_transactions_fixed", O.compose(f"""
SELECT sum(predicted_purchases_90d) AS expected_transactions_90d, avg(probability_alive) AS mean_probability_alive
FROM ({_SCORED})""", ["lt"]))
def h13f(spark, sf):
    return P.expected_transactions(_published(spark, sf))


@register("E29_horizon_totals_fixed", O.compose(f"WITH s AS ({_SCORED}) " + " UNION ALL ".join(
    f"SELECT 'CLV_{h}d' AS measure, sum(CLV_{h}d) AS total, avg(CLV_{h}d) AS mean, quantile_cont(CLV_{h}d, 0.5) AS median FROM s"
    for h in (30, 90, 365)), ["lt"]))
def e29f(spark, sf):
    return P.horizon_totals(_published(spark, sf))


@register("G10_segment_actions_fixed", O.compose(f"""
SELECT segment, count(*) AS customers, CASE WHEN contains(segment, 'High Potential') THEN 'Invest in retention, offer loyalty rewards'
  WHEN contains(segment, 'At Risk') THEN 'Win-back campaigns, special offers'
  WHEN contains(segment, 'Loyal Low Spender') THEN 'Upsell opportunities, product recommendations' END AS action
FROM ({_FIXED_Q}) GROUP BY segment""", ["lt"]))
def g10f(spark, sf):
    from patronage.operators.outputs import segment_action
    q = P.bgnbd_quadrants(_fixed_scores(spark, sf))
    return q.groupBy("segment").agg(F.count(F.lit(1)).alias("customers")).withColumn("action", segment_action(F.col("segment")))


@register("D9_scoring_grid_fixed", O.compose(f"""
WITH t AS (SELECT avg(T) AS T FROM lt WHERE frequency > 0),
g AS (SELECT CAST(floor(range / 13) * 5 AS BIGINT) AS frequency, CAST((range % 13) * 30 AS DOUBLE) AS recency, T FROM range(143), t)
SELECT frequency, recency, T, CASE WHEN recency < T THEN {O.p_alive_sql(*BG.as_tuple())} ELSE 0.0 END AS probability_alive,
  CASE WHEN recency < T THEN {_ep(90)} ELSE 0.0 END AS predicted_purchases FROM g""", ["lt"]))
def d9f(spark, sf):
    return P.scoring_grid(lifetimes(spark, sf), BG)


def _gg_ll_sql(p, q, v, x="CAST(frequency AS DOUBLE)", m="monetary_value") -> str:
    return (f"(lgamma({p} * {x} + {q}) - lgamma({p} * {x}) - lgamma({q}) + {q} * ln({v}) + ({p} * {x} - 1) * ln({m}) "
            f"+ {p} * {x} * ln({x}) - ({p} * {x} + {q}) * ln({x} * {m} + {v}))")


@register("H6_gamma_gamma_loglik_fixed", O.compose(
    f"SELECT count(*) AS customers, sum({_gg_ll_sql(*GG.as_tuple())}) AS loglik FROM lt WHERE frequency > 0 AND monetary_value > 0", ["lt"]))
def h6ll(spark, sf):
    rep = P.repeat_customers(lifetimes(spark, sf)).where("monetary_value > 0")
    return rep.agg(F.count(F.lit(1)).alias("customers"), F.sum(P.gamma_gamma_loglik(
        F.col("frequency"), F.col("monetary_value"), *GG.as_tuple())).alias("loglik"))
