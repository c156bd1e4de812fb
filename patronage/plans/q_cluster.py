"""Queries: scaling, clustering (MLlib k-means and a deterministic assignment),
cluster reports and the comparison with RFM segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import clustering as K
from patronage.operators import segments as S
from patronage.plans import oracle_sql as O
from patronage.plans.catalog import (clusters_with_segments, customers, data_version, quartile_clusters, register,
                                     segmented)


@register("J1_standardize", O.compose(
    "SELECT CustomerID, Recency_log_z, Frequency_log_z, Monetary_log_z FROM z", ["z"]))
def j1(spark, sf):
    return K.standardize(K.log_features(customers(spark, sf))).select(
        "CustomerID", "Recency_log_z", "Frequency_log_z", "Monetary_log_z")


@register("C15_log_features", O.compose(
    "SELECT CustomerID, Recency_log, Frequency_log, Monetary_log FROM zbase", ["zbase"]))
def c15(spark, sf):
    return K.log_features(customers(spark, sf)).select(
        "CustomerID", "Recency_log", "Frequency_log", "Monetary_log")


@register("J6_assign_nearest", O.compose(
    "SELECT CustomerID, Cluster, Cluster_Name FROM clus", ["clus"]))
def j6(spark, sf):
    return quartile_clusters(spark, sf).select("CustomerID", "Cluster", "Cluster_Name")


@register("E11_cluster_profile", O.compose("SELECT * FROM cprof", ["cprof"]))
def e11(spark, sf):
    return K.cluster_profile(quartile_clusters(spark, sf))


@register("E12_normalized_profile", O.compose("""
SELECT Cluster,
  CASE WHEN max(Recency) OVER () > min(Recency) OVER () THEN (Recency - min(Recency) OVER ()) / (max(Recency) OVER () - min(Recency) OVER ()) END AS Recency_norm,
  CASE WHEN max(Frequency) OVER () > min(Frequency) OVER () THEN (Frequency - min(Frequency) OVER ()) / (max(Frequency) OVER () - min(Frequency) OVER ()) END AS Frequency_norm,
  CASE WHEN max(Monetary) OVER () > min(Monetary) OVER () THEN (Monetary - min(Monetary) OVER ()) / (max(Monetary) OVER () - min(Monetary) OVER ()) END AS Monetary_norm
FROM cprof""", ["cprof"]))
def e12(spark, sf):
    return K.normalized_profile(K.cluster_profile(quartile_clusters(spark, sf)))


@register("E13_named_summary", O.compose("""
SELECT Cluster, Cluster_Name, count(*) AS customers, avg(CAST(Recency AS DOUBLE)) AS recency_mean,
  sum(monetary_cents) / 100.0 / CAST(count(*) AS DOUBLE) AS monetary_mean FROM clus GROUP BY 1, 2""",
                                         ["clus"]))
def e13(spark, sf):
    return K.named_summary(quartile_clusters(spark, sf))


@register("D1_clusters_with_segments", O.compose("SELECT * FROM cmpseg", ["cmpseg"]))
def d1(spark, sf):
    return clusters_with_segments(spark, sf)


@register("E14_crosstab", O.compose("""
WITH b AS (SELECT Cluster_Name, Segment FROM cmpseg WHERE Cluster_Name IS NOT NULL AND Segment IS NOT NULL),
  r AS (SELECT DISTINCT Cluster_Name FROM b), c AS (SELECT DISTINCT Segment FROM b)
SELECT r.Cluster_Name, c.Segment, count(b.Segment) AS count FROM r CROSS JOIN c
LEFT JOIN b ON b.Cluster_Name = r.Cluster_Name AND b.Segment = c.Segment GROUP BY 1, 2""", ["cmpseg"]))
def e14(spark, sf):
    return S.crosstab_long(clusters_with_segments(spark, sf), "Cluster_Name", "Segment")


_TIERS = (f"SELECT *, {O.tier_case('Segment')} AS RFM_Tier, {O.tier_case('Cluster_Name')} AS Kmeans_Tier "
          "FROM cmpseg")


@register("G6_value_tiers", O.compose(
    f"SELECT CustomerID, Segment, Cluster_Name, RFM_Tier, Kmeans_Tier FROM ({_TIERS})", ["cmpseg"]))
def g6(spark, sf):
    return S.add_value_tiers(clusters_with_segments(spark, sf)).select(
        "CustomerID", "Segment", "Cluster_Name", "RFM_Tier", "Kmeans_Tier")


@register("G7_tier_agreement", O.compose(
    f"SELECT avg(CASE WHEN coalesce(RFM_Tier = Kmeans_Tier, false) THEN 1.0 ELSE 0.0 END) * 100.0 "
    f"AS agreement_pct FROM ({_TIERS})", ["cmpseg"]))
def g7(spark, sf):
    return S.tier_agreement(S.add_value_tiers(clusters_with_segments(spark, sf)))


@register("E15_tier_crosstab_pct", O.compose(f"""
WITH t AS ({_TIERS}), b AS (SELECT * FROM t WHERE RFM_Tier IS NOT NULL AND Kmeans_Tier IS NOT NULL),
  r AS (SELECT DISTINCT RFM_Tier FROM b), c AS (SELECT DISTINCT Kmeans_Tier FROM b)
SELECT r.RFM_Tier, c.Kmeans_Tier,
  CAST(count(b.RFM_Tier) AS DOUBLE) * 100.0 / CAST((SELECT count(*) FROM b) AS DOUBLE) AS pct
FROM r CROSS JOIN c LEFT JOIN b ON b.RFM_Tier = r.RFM_Tier AND b.Kmeans_Tier = c.Kmeans_Tier
GROUP BY 1, 2""", ["cmpseg"]))
def e15(spark, sf):
    return S.crosstab_pct(S.add_value_tiers(clusters_with_segments(spark, sf)), "RFM_Tier",
                          "Kmeans_Tier")


@register("E16_distinct_labels", O.compose(
    "SELECT count(DISTINCT Segment) AS n_Segment, count(DISTINCT Cluster_Name) AS n_Cluster_Name "
    "FROM cmpseg", ["cmpseg"]))
def e16(spark, sf):
    return S.distinct_labels(clusters_with_segments(spark, sf), "Segment", "Cluster_Name")


@register("E17_separation_ratio", O.compose("""
WITH w AS (SELECT sum(var_pop(CAST(Recency AS DOUBLE)) * count(Recency) + var_pop(CAST(Frequency AS DOUBLE)) * count(Frequency)
                      + var_pop(Monetary) * count(Monetary)) OVER () AS wss FROM seg GROUP BY Segment LIMIT 1),
t AS (SELECT var_pop(CAST(Recency AS DOUBLE)) * count(Recency) + var_pop(CAST(Frequency AS DOUBLE)) * count(Frequency)
             + var_pop(Monetary) * count(Monetary) AS tss FROM seg)
SELECT CASE WHEN tss > 0 THEN (tss - wss) / tss ELSE 0.0 END AS separation_ratio FROM w, t""", ["seg"]))
def e17(spark, sf):
    return S.separation_ratio(segmented(spark, sf))


@register("J3_kmeans_segments")
def j3(spark, sf):
    return K.kmeans_segments(customers(spark, sf)).select(
        "CustomerID", "Recency", "Frequency", "Monetary", "Cluster", "Cluster_Name")


_SWEEP: dict = {}


def _sweep(spark, sf):
    """k = 2..10, 10 starts each (published settings), once per session and
    version of the data; the result is a 9-row table."""
    key = data_version(spark, sf)
    if key not in _SWEEP:
        _SWEEP[key] = [tuple(r) for r in K.kmeans_sweep(customers(spark, sf)).collect()]
    return spark.createDataFrame(_SWEEP[key], "k int, wcss double, silhouette double")


@register("J2_kmeans_sweep")
def j2(spark, sf):
    return _sweep(spark, sf)


@register("J4_silhouette")
def j4(spark, sf):
    return K.silhouette(K.kmeans_segments(customers(spark, sf), keep_features=True))


@register("J4_euclidean_silhouette", O.compose("""
WITH p AS (SELECT CAST(c.Cluster AS VARCHAR) AS label, z.CustomerID AS id, z.Recency_log_z AS x, z.Frequency_log_z AS y,
    z.Monetary_log_z AS m FROM clus c JOIN z ON z.CustomerID = c.CustomerID
    ORDER BY md5(CAST(z.CustomerID AS VARCHAR)) LIMIT 2000),
  size AS (SELECT label, count(*) AS n FROM p GROUP BY 1),
  d AS (SELECT a.id, a.label AS own, b.label, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)
      + (a.m - b.m) * (a.m - b.m))) AS total FROM p a CROSS JOIN p b GROUP BY 1, 2, 3),
  e AS (SELECT d.id, max(CASE WHEN d.own = d.label THEN n END) AS n,
      max(CASE WHEN d.own = d.label THEN total / greatest(n - 1, 1) END) AS near,
      min(CASE WHEN d.own <> d.label THEN total / n END) AS other FROM d JOIN size ON size.label = d.label GROUP BY 1)
SELECT count(*) AS rows, (SELECT count(*) FROM size) AS clusters,
  round(avg(CASE WHEN n > 1 AND greatest(near, other) > 0 THEN (other - near) / greatest(near, other) ELSE 0.0 END), 6) AS silhouette
FROM e""", ["clus", "z"]))
def j4_euclidean(spark, sf):
    out = K.euclidean_silhouette(quartile_clusters(spark, sf), max_rows=2000)
    return out.withColumn("silhouette", F.round("silhouette", 6))


@register("J7_best_k")
def j7(spark, sf):
    return K.best_k(_sweep(spark, sf))
