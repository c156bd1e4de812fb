"""Queries: profiling (B), cleaning waterfall (C5), customer reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import customers as C
from patronage.operators import profile as P
from patronage.plans import oracle_sql as O
from patronage.plans.catalog import clean, customers, log, register, segmented, ts_out

COLS = P.PROFILE_COLUMNS


def logd(spark, sf):
    return log(spark, sf, with_description=True)


@register("B1_shape", O.compose(
    "SELECT count(*) AS rows, CAST(8 AS BIGINT) AS columns FROM logd", ["logd"]))
def b1(spark, sf):
    return P.shape(logd(spark, sf))


@register("B2_null_counts", O.compose(" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM logd"
    for c in COLS), ["logd"]))
def b2(spark, sf):
    return P.null_counts(logd(spark, sf))


@register("B3_duplicate_rows", O.compose(
    "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM "
    f"(SELECT count(*) AS n FROM logd GROUP BY {', '.join(COLS)})", ["logd"]))
def b3(spark, sf):
    return P.duplicate_rows(logd(spark, sf))


_B4 = ("InvoiceNo", "StockCode", "CustomerID", "Country")


@register("B4_distinct_counts", O.compose(" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS distinct FROM log" for c in _B4), ["log"]))
def b4(spark, sf):
    return P.distinct_counts(log(spark, sf), _B4)


@register("B5_date_range", O.compose(
    "SELECT min(InvoiceDate) AS first, max(InvoiceDate) AS last, "
    f"(epoch_us(max(InvoiceDate)) - epoch_us(min(InvoiceDate))) // {O.DAY_US} AS span_days FROM log",
    ["log"]))
def b5(spark, sf):
    return P.date_range(log(spark, sf)).select(ts_out("first"), ts_out("last"), "span_days")


@register("B6_quality_flags", O.compose("""
SELECT count(*) FILTER (WHERE starts_with(InvoiceNo, 'C')) AS cancelled,
  count(*) FILTER (WHERE starts_with(InvoiceNo, 'C')) * 100.0 / CAST(count(*) AS DOUBLE) AS cancelled_pct,
  count(*) FILTER (WHERE Quantity < 0) AS negative_quantity,
  count(*) FILTER (WHERE Quantity < 0) * 100.0 / CAST(count(*) AS DOUBLE) AS negative_quantity_pct,
  count(*) FILTER (WHERE UnitPrice <= 0) AS invalid_price,
  count(*) FILTER (WHERE UnitPrice <= 0) * 100.0 / CAST(count(*) AS DOUBLE) AS invalid_price_pct
FROM logx""", ["logx"]))
def b6(spark, sf):
    return P.quality_flags(log(spark, sf))


@register("B9_top_countries", O.compose("""
SELECT Country, count(*) AS count, count(*) * 100.0 / CAST((SELECT count(*) FROM log) AS DOUBLE) AS pct
FROM log GROUP BY Country ORDER BY count DESC, Country LIMIT 10""", ["log"]))
def b9(spark, sf):
    return C.top_countries(log(spark, sf))


def _describe_sql(src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS column, count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean,
  stddev_samp(CAST({c} AS DOUBLE)) AS std, CAST(min({c}) AS DOUBLE) AS min,
  quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {src}"""
                              for c in cols)


@register("B10_describe_lines", O.compose(_describe_sql("logx", ["Quantity", "UnitPrice"]), ["logx"]))
def b10(spark, sf):
    return P.describe(log(spark, sf), ["Quantity", "UnitPrice"])


@register("B10_describe_customers", O.compose(
    _describe_sql("cust", ["Recency", "Frequency", "Monetary"]), ["cust"]))
def b10c(spark, sf):
    return P.describe(customers(spark, sf), ["Recency", "Frequency", "Monetary"])


def _hist_sql(src: str, col: str, bins: int) -> str:
    return f"""
WITH v AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
c AS (SELECT CAST(CASE WHEN mm.hi = mm.lo THEN 0
         ELSE least(floor((x - mm.lo) * ({float(bins)} / (mm.hi - mm.lo))), {bins - 1}) END AS INTEGER) AS bin,
         count(*) AS n FROM v, mm GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT g.bin, mm.lo + g.bin * ((mm.hi - mm.lo) / {float(bins)}) AS lo,
       mm.lo + (g.bin + 1) * ((mm.hi - mm.lo) / {float(bins)}) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM g CROSS JOIN mm LEFT JOIN c ON g.bin = c.bin"""


@register("B11_histogram_monetary", O.compose(
    "SELECT * FROM (" + _hist_sql("cust", "Monetary", 50) + ")", ["cust"]))
def b11(spark, sf):
    return P.histogram(customers(spark, sf), "Monetary", 50)


@register("B12_segment_counts", O.compose("""
SELECT Segment, count(*) AS count, count(*) * 100.0 / CAST((SELECT count(*) FROM seg) AS DOUBLE) AS pct
FROM seg GROUP BY Segment""", ["seg"]))
def b12(spark, sf):
    from patronage.operators.segments import value_counts
    return value_counts(segmented(spark, sf), "Segment")


@register("C5_cleaning_waterfall", O.compose("""
WITH t AS (SELECT count(*) AS n0,
  count(*) FILTER (WHERE NOT starts_with(InvoiceNo, 'C')) AS n1,
  count(*) FILTER (WHERE NOT starts_with(InvoiceNo, 'C') AND Quantity > 0) AS n2,
  count(*) FILTER (WHERE NOT starts_with(InvoiceNo, 'C') AND Quantity > 0 AND UnitPrice > 0) AS n3,
  count(*) FILTER (WHERE NOT starts_with(InvoiceNo, 'C') AND Quantity > 0 AND UnitPrice > 0
                   AND CustomerID IS NOT NULL) AS n4 FROM logx),
s AS (SELECT 1 AS step, 'cancelled' AS name, n0 AS b, n1 AS a, n0, n4 FROM t
  UNION ALL SELECT 2, 'non_positive_quantity', n1, n2, n0, n4 FROM t
  UNION ALL SELECT 3, 'non_positive_price', n2, n3, n0, n4 FROM t
  UNION ALL SELECT 4, 'missing_customer', n3, n4, n0, n4 FROM t)
SELECT CAST(step AS INTEGER) AS step, name, CAST(b - a AS BIGINT) AS removed, CAST(a AS BIGINT) AS remaining,
  CAST(b - a AS DOUBLE) * 100.0 / CAST(b AS DOUBLE) AS removed_pct,
  CAST(n4 AS DOUBLE) * 100.0 / CAST(n0 AS DOUBLE) AS retained_pct FROM s""", ["logx"]))
def c5(spark, sf):
    from patronage.operators.cleaning import cleaning_waterfall
    return cleaning_waterfall(log(spark, sf))


@register("E3_overall_kpis", O.compose("""
SELECT count(*) AS customers, sum(monetary_cents) / 100.0 AS revenue,
  sum(monetary_cents) / 100.0 / CAST(count(*) AS DOUBLE) AS revenue_mean,
  avg(CAST(Recency AS DOUBLE)) AS recency_mean,
  quantile_cont(Recency, 0.5) AS recency_median, quantile_cont(Recency, 0.25) AS recency_p25,
  quantile_cont(Recency, 0.75) AS recency_p75,
  avg(CAST(Frequency AS DOUBLE)) AS frequency_mean,
  quantile_cont(Frequency, 0.5) AS frequency_median, quantile_cont(Frequency, 0.9) AS frequency_p90,
  sum(monetary_cents) / 100.0 / CAST(count(*) AS DOUBLE) AS monetary_mean,
  quantile_cont(Monetary, 0.5) AS monetary_median, quantile_cont(Monetary, 0.9) AS monetary_p90
FROM cust""", ["cust"]))
def e3(spark, sf):
    return C.overall_kpis(customers(spark, sf))


@register("E4_customers_per_country", O.compose("""
SELECT Country, count(*) AS count, count(*) * 100.0 / CAST((SELECT count(*) FROM cust) AS DOUBLE) AS pct
FROM cust GROUP BY Country ORDER BY count DESC, Country LIMIT 10""", ["cust"]))
def e4(spark, sf):
    return C.top_countries(customers(spark, sf))


@register("E5_pareto", O.compose("""
WITH r AS (SELECT monetary_cents, row_number() OVER (ORDER BY monetary_cents DESC, CustomerID) AS rk,
                  count(*) OVER () AS n FROM cust),
a AS (SELECT max(n) AS customers, max(n // 5) AS top_k, sum(monetary_cents) AS tot,
             sum(monetary_cents) FILTER (WHERE rk <= n // 5) AS top FROM r)
SELECT CAST(customers AS BIGINT) AS customers, CAST(top_k AS BIGINT) AS top_k,
  CAST(coalesce(top, 0) AS DOUBLE) * 100.0 / CAST(tot AS DOUBLE) AS top_revenue_pct,
  CAST(coalesce(top, 0) AS DOUBLE) / 100.0 / CAST(top_k AS DOUBLE) AS top_mean,
  (CAST(tot AS DOUBLE) - CAST(coalesce(top, 0) AS DOUBLE)) / 100.0 / CAST(customers - top_k AS DOUBLE) AS bottom_mean
FROM a""", ["cust"]))
def e5(spark, sf):
    return C.pareto(customers(spark, sf))


@register("E6_engagement_bands", O.compose("""
SELECT CASE WHEN Recency <= 30 THEN 'Active' WHEN Recency <= 90 THEN 'Dormant' ELSE 'At Risk' END AS band,
  count(*) AS customers, count(*) * 100.0 / CAST((SELECT count(*) FROM cust) AS DOUBLE) AS pct
FROM cust GROUP BY 1""", ["cust"]))
def e6(spark, sf):
    return C.engagement_bands(customers(spark, sf))


def _country_sql(country: str) -> str:
    return f"""
SELECT '{country}' AS country, count(*) FILTER (WHERE Country = '{country}') AS customers,
  CAST(count(*) FILTER (WHERE Country = '{country}') AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE) AS customers_pct,
  CAST(coalesce(sum(monetary_cents) FILTER (WHERE Country = '{country}'), 0) AS DOUBLE) / 100.0 AS revenue,
  CAST(coalesce(sum(monetary_cents) FILTER (WHERE Country = '{country}'), 0) AS DOUBLE) * 100.0
    / CAST(sum(monetary_cents) AS DOUBLE) AS revenue_pct
FROM cust"""


# The test data has no 'United Kingdom'; the share query uses a country that it
# has, passed as the same parameter to both engines.
SHARE_COUNTRY = "NATION_0"


@register("E7_country_share", O.compose(_country_sql(SHARE_COUNTRY), ["cust"]))
def e7(spark, sf):
    return C.country_share(customers(spark, sf), SHARE_COUNTRY)


@register("E8_repeat_buyers", O.compose("""
SELECT count(*) FILTER (WHERE Frequency = 1) AS one_time,
  CAST(count(*) FILTER (WHERE Frequency = 1) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE) AS one_time_pct,
  count(*) FILTER (WHERE Frequency > 1) AS repeat,
  CAST(count(*) FILTER (WHERE Frequency > 1) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE) AS repeat_pct,
  avg(CAST(Frequency AS DOUBLE)) FILTER (WHERE Frequency > 1) AS repeat_mean_frequency
FROM cust""", ["cust"]))
def e8(spark, sf):
    return C.repeat_buyers(customers(spark, sf))


@register("E9_value_groups", O.compose("""
WITH q AS (SELECT quantile_cont(Monetary, 0.75) AS hi, quantile_cont(Monetary, 0.25) AS lo FROM cust),
g AS (SELECT 'high' AS grp, c.* FROM cust c, q WHERE c.Monetary >= q.hi
      UNION ALL SELECT 'low' AS grp, c.* FROM cust c, q WHERE c.Monetary <= q.lo)
SELECT grp, count(*) AS customers, avg(CAST(Recency AS DOUBLE)) AS recency_mean,
       avg(CAST(Frequency AS DOUBLE)) AS frequency_mean FROM g GROUP BY grp""", ["cust"]))
def e9(spark, sf):
    return C.value_groups(customers(spark, sf))
