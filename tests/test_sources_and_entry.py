"""Sources, sinks, the driver contract and a few oracle spot checks."""

import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_read_transactions_csv(spark):
    d = tempfile.mkdtemp(prefix="patronage-csv-")
    path = os.path.join(d, "log.csv")
    with open(path, "w", encoding="latin-1") as fh:
        fh.write("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n")
        fh.write("536365,85123A,CAFÉ MUG,6,12/1/2010 8:26,2.55,17850.0,United Kingdom\n")
        fh.write("C536379,D,Discount,-1,12/1/2010 9:41,27.5,14527.0,United Kingdom\n")
        fh.write("536414,22139,,56,not a date,0,,United Kingdom\n")
    from patronage.sources import read_transactions
    df = read_transactions(spark, path, date_format="M/d/yyyy H:mm", on_error="null")
    rows = df.orderBy("line").collect()
    assert rows[0]["Description"] == "CAFÉ MUG" and rows[0]["unit_cents"] == 255
    assert rows[0]["CustomerID"] == 17850 and rows[0]["InvoiceDate"].hour == 8
    assert rows[2]["InvoiceDate"] is None and rows[2]["CustomerID"] is None


@pytest.mark.parametrize("line, says", [
    ("1,A,x,1,not a date,2.55,1.0,UK", "unreadable InvoiceDate"),
    ("1,A,x,abc,12/1/2010 8:26,2.55,1.0,UK", "MALFORMED|Malformed"),
    ("1,A,x,1000,12/1/2010 8:26,0.001,1.0,UK", "whole cents")])
def test_read_transactions_refuses_what_it_cannot_hold(spark, line, says):
    from patronage.sources import read_transactions
    path = os.path.join(tempfile.mkdtemp(prefix="patronage-csv-"), "log.csv")
    with open(path, "w", encoding="latin-1") as fh:
        fh.write("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n" + line + "\n")
    with pytest.raises(Exception, match=says):
        read_transactions(spark, path, date_format="M/d/yyyy H:mm").collect()


def test_read_transactions_takes_nan_as_missing(spark):
    from patronage.sources import read_transactions
    path = os.path.join(tempfile.mkdtemp(prefix="patronage-csv-"), "log.csv")
    with open(path, "w", encoding="latin-1") as fh:
        fh.write("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
                 "1,A,x,1,12/1/2010 8:26,NaN,NaN,UK\n")
    row = read_transactions(spark, path, date_format="M/d/yyyy H:mm").first()
    assert row["CustomerID"] is None and row["UnitPrice"] is None and row["unit_cents"] is None


def test_country_share_is_not_empty(spark):
    import __spark_entry__ as E
    row = E.queries()["E7_country_share"](spark, SF).first()
    assert row["customers"] > 0 and row["revenue"] > 0 and row["revenue_pct"] > 0


def test_hypergeometric_series_that_does_not_converge_raises():
    from patronage.functions.special import scaled_hyp2f1
    with pytest.raises(ArithmeticError):
        scaled_hyp2f1(1.0, 1.0, 2.0, 0.999999, 0.0, max_terms=5)


def test_metric_history_append_and_trends(spark):
    from patronage.operators.outputs import metric_trends
    from patronage.sources.sinks import append_metrics, metrics_row, read_metrics
    path = tempfile.mkdtemp(prefix="patronage-hist-") + "/history"
    append_metrics(metrics_row(spark, "m1", 1.0, 2.0, 0.5), path)
    append_metrics(metrics_row(spark, "m1", 3.0, 4.0, 0.7), path)
    trends = metric_trends(read_metrics(spark, path)).first()
    assert trends["mae_mean"] == 2.0 and abs(trends["r2_mean"] - 0.6) < 1e-12


def test_marketing_outputs_sink(spark, edge_log):
    from patronage.operators.cleaning import clean_lines
    from patronage.operators.clv_historical import historical_clv
    from patronage.operators.customers import customer_features, customer_rfm
    from patronage.operators.outputs import customer_master, marketing_lists
    from patronage.sources.sinks import write_marketing_outputs
    lines = clean_lines(edge_log)
    cust = customer_rfm(lines)
    seg = cust.select("CustomerID", F.lit("Others").alias("Segment"))
    hist = historical_clv(customer_features(lines), tier=False).withColumn("CLV_Tier", F.lit("High"))
    lists = marketing_lists(customer_master(cust, hist, seg))
    out = tempfile.mkdtemp(prefix="patronage-out-")
    write_marketing_outputs(lists, out)
    back = spark.read.parquet(f"{out}/high_value_list")
    assert back.count() == 2
    rec = {r["CustomerID"]: r["Recommendations"] for r in lists["customer_master"].collect()}
    assert rec[1] == "Priority retention program; Personalized offers; Cross-sell complementary items"


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_oracle_spot_checks(spark):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for key in ("E1_customer_rfm", "G5_rfm_segments", "H2_lifetimes_summary"):
        got = sorted(tuple(r) for r in E.queries()[key](spark, SF).collect())
        want = sorted(con.execute(E.oracle_sql()[key]).fetchall())
        assert len(got) == len(want)
        for a, b in zip(got, want):
            for x, y in zip(a, b):
                if isinstance(x, float):
                    assert abs(x - y) <= 1e-9 * max(1.0, abs(y))
                else:
                    assert x == y
