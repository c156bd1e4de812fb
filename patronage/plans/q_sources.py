"""Queries: the CSV reader with rejects, dates, exact money, schema, bins with merged edges, sketch quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import binning as BN
from patronage.operators import profile as PR
from patronage.operators.cleaning import add_spend, clean_lines
from patronage.operators.customers import customer_rfm
from patronage.operators.segments import separation_ratio
from patronage.plans import oracle_sql as O
from patronage.plans.catalog import customers, log, materialize, register, ts_out
from patronage.session import new_folder
from patronage.sources import read_log

DATE_FORMAT = "M/d/yyyy H:mm"
SCALE = 4

#: The order behind an invoice number decides which lines of the written log cannot be read.
_ORDER = "CAST(replace(InvoiceNo, 'C', '') AS BIGINT)"
_DAMAGE = {"Malformed Quantity": 101, "unreadable InvoiceDate": 103, "Malformed UnitPrice": 107, "Malformed CustomerID": 109}


def csv_log(spark, sf):
    """The log as CSV: month-first dates, prices with parts of a cent, and lines that cannot be read."""
    order = F.expr(_ORDER.replace("BIGINT", "long"))

    def damaged(kind, text, instead):
        return F.when(order % _DAMAGE[kind] == 0, F.lit(instead)).otherwise(text)
    fine = F.col("unit_cents") * 100 + (F.col("line") % 8) * 12
    price = (fine.cast("decimal(20,0)") / F.lit(10 ** SCALE).cast("decimal(5,0)")).cast(f"decimal(38,{SCALE})").cast("string")
    path = new_folder(spark, "csv")
    log(spark, sf).select(
        "InvoiceNo", "StockCode", "Description",
        damaged("Malformed Quantity", F.col("Quantity").cast("string"), "abc").alias("Quantity"),
        damaged("unreadable InvoiceDate", F.date_format("InvoiceDate", DATE_FORMAT), "bad").alias("InvoiceDate"),
        damaged("Malformed UnitPrice", price, "free").alias("UnitPrice"),
        damaged("Malformed CustomerID", F.col("CustomerID").cast("double").cast("string"), "x1").alias("CustomerID"),
        "Country").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_log(spark, path, date_format=DATE_FORMAT, money_scale=SCALE)


O.fragment("rawlog", ["log"], f"""
SELECT *, unit_cents * 100 + (line % 8) * 12 AS unit4, CASE {" ".join(
    f"WHEN {_ORDER} % {n} = 0 THEN '{kind}'" for kind, n in _DAMAGE.items())} END AS reason FROM log
""")
O.fragment("csvlog", ["rawlog"], "SELECT * FROM rawlog WHERE reason IS NULL")


@register("A1_read_transactions", O.compose("""
SELECT InvoiceNo, StockCode, Quantity, InvoiceDate, CAST(unit4 AS DOUBLE) / 10000 AS UnitPrice, CustomerID, Country
FROM csvlog""", ["csvlog"]))
def a1(spark, sf):
    return csv_log(spark, sf).lines.select("InvoiceNo", "StockCode", "Quantity", ts_out("InvoiceDate"), "UnitPrice",
                                           "CustomerID", "Country")


@register("A1_rejected_lines", O.compose(
    "SELECT InvoiceNo, StockCode, reason FROM rawlog WHERE reason IS NOT NULL", ["rawlog"]))
def a1r(spark, sf):
    return csv_log(spark, sf).rejects.select("InvoiceNo", "StockCode", F.substring_index("reason", ":", 1).alias("reason"))


@register("A2_parse_dates", O.compose("""
SELECT CASE WHEN reason = 'unreadable InvoiceDate' THEN NULL ELSE CAST(InvoiceDate AS DATE) END AS day, count(*) AS lines,
  min(CASE WHEN reason = 'unreadable InvoiceDate' THEN NULL ELSE InvoiceDate END) AS earliest
FROM rawlog WHERE reason IS NULL OR reason = 'unreadable InvoiceDate' GROUP BY 1""", ["rawlog"]))
def a2(spark, sf):
    """Lines per day, and those whose date cannot be read."""
    read = csv_log(spark, sf)
    bad = read.rejects.where("reason like 'unreadable InvoiceDate%'").select(F.lit(None).cast("timestamp").alias("InvoiceDate"))
    return (read.lines.select("InvoiceDate").union(bad).groupBy(F.to_date("InvoiceDate").alias("day"))
            .agg(F.count(F.lit(1)).alias("lines"), F.min("InvoiceDate").cast("timestamp_ntz").alias("earliest")))


@register("C6_exact_spend", O.compose("""
SELECT InvoiceNo, StockCode, CAST(Quantity * unit4 AS DOUBLE) / 10000 AS TotalSpend FROM csvlog""", ["csvlog"]))
def c6x(spark, sf):
    """Quantity x price for prices with four decimal places."""
    return add_spend(csv_log(spark, sf).lines).select("InvoiceNo", "StockCode", "TotalSpend")


@register("E1_exact_monetary", O.compose("""
SELECT CustomerID, CAST(sum(Quantity * unit4) AS BIGINT) AS units, CAST(CAST(sum(Quantity * unit4) AS BIGINT) AS DOUBLE) / 10000 AS Monetary,
  count(DISTINCT InvoiceNo) AS Frequency
FROM csvlog WHERE NOT starts_with(InvoiceNo, 'C') AND Quantity > 0 AND unit4 > 0 AND CustomerID IS NOT NULL GROUP BY 1""", ["csvlog"]))
def e1x(spark, sf):
    """The customer table of the CSV log: money sums at four decimal places."""
    c = customer_rfm(clean_lines(csv_log(spark, sf).lines))
    return c.select("CustomerID", F.col("monetary_cents").alias("units"), "Monetary", "Frequency")


@register("B1_schema", O.compose("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count({x}) AS non_null FROM log" for i, (c, t, x) in enumerate([
        ("InvoiceNo", "string", "InvoiceNo"), ("StockCode", "string", "StockCode"), ("Description", "string", "NULL"),
        ("Quantity", "bigint", "Quantity"), ("InvoiceDate", "timestamp", "InvoiceDate"), ("UnitPrice", "double", "unit_cents"),
        ("CustomerID", "bigint", "CustomerID"), ("Country", "string", "Country"), ("unit_cents", "bigint", "unit_cents"),
        ("line", "bigint", "line")])) + ")", ["log"]))
def b1s(spark, sf):
    return PR.schema_table(log(spark, sf))


@register("F1_merged_edges", O.compose("""
WITH x AS (SELECT CustomerID, Frequency // 4 AS v FROM cust),
 e AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest([quantile_cont(v, 0.0), quantile_cont(v, 0.125), quantile_cont(v, 0.25),
   quantile_cont(v, 0.375), quantile_cont(v, 0.5), quantile_cont(v, 0.625), quantile_cont(v, 0.75), quantile_cont(v, 0.875)]) AS edge FROM x),
 inner_edges AS (SELECT DISTINCT edge FROM e WHERE edge > (SELECT min(edge) FROM e))
SELECT x.v AS fours, CAST(1 + (SELECT count(*) FROM inner_edges WHERE x.v > edge) AS INTEGER) AS bin, count(*) AS customers
FROM x GROUP BY x.v""", ["cust"]))
def f1m(spark, sf):
    """Eighths of a column with few values: repeated edges are merged."""
    c = customers(spark, sf).select("CustomerID", F.expr("Frequency div 4").alias("fours"))
    return BN.qcut(c, "fours", 8, list(range(1, 9)), "bin", duplicates="merge").groupBy("fours", "bin").agg(
        F.count(F.lit(1)).alias("customers"))


@register("F8_approximate_quantiles", O.compose("""
SELECT true AS q25_close, true AS q50_close, true AS q99_close, count(*) AS customers FROM cust""", ["cust"]))
def f8a(spark, sf):
    """Whether the sketch's quantiles are rows within its stated error of the wanted ranks."""
    c = customers(spark, sf)
    probs, names, accuracy = [0.25, 0.5, 0.99], ["q25", "q50", "q99"], 200
    row = BN.scalar_quantiles(c, "Monetary", probs, names, exact=False, accuracy=accuracy).first()
    n = F.count(F.lit(1))

    def close(p, v):
        below, upto = F.count_if(F.col("Monetary") < v), F.count_if(F.col("Monetary") <= v)
        return (below <= n * p + n / accuracy + 1) & (upto >= n * p - n / accuracy - 1)
    return c.agg(*[close(p, row[k]).alias(f"{k}_close") for p, k in zip(probs, names)], n.alias("customers"))


@register("J7_best_k_of_bins", O.compose("WITH " + ", ".join(f"""
b{k} AS (SELECT Monetary AS x, ({" + ".join(["1"] + [f"CAST({k} * (rk - 1) > {i} * (n - 1) AS INTEGER)" for i in range(1, k)])}) AS g
  FROM (SELECT Monetary, row_number() OVER (ORDER BY monetary_cents, CustomerID) AS rk, count(*) OVER () AS n FROM cust)),
s{k} AS (SELECT {k} AS k, ((SELECT var_pop(x) * count(x) FROM b{k}) - sum(w)) / (SELECT var_pop(x) * count(x) FROM b{k})
  - {k} * 0.02 AS silhouette FROM (SELECT var_pop(x) * count(x) AS w FROM b{k} GROUP BY g))""" for k in range(2, 11))
    + " SELECT arg_max(k, silhouette) AS k FROM (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(2, 11)) + ")", ["cust"]))
def j7b(spark, sf):
    """The number of equal bins of Monetary with the best separation, less 0.02 a bin."""
    from functools import reduce
    from patronage.operators.clustering import best_k
    c = customers(spark, sf).select("CustomerID", "Monetary", "monetary_cents")
    rows = [separation_ratio(BN.qcut_of_rank(c, "monetary_cents", "g", q=k), "g", ("Monetary",)).select(
        F.lit(k).alias("k"), (F.col("separation_ratio") - F.lit(k * 0.02)).alias("silhouette")) for k in range(2, 11)]
    return best_k(materialize(reduce(lambda a, b: a.unionByName(b), rows)))
