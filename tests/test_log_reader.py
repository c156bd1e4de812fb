"""Reading a log with lines that cannot be read, and prices with parts of a cent."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from patronage.functions.money import scale_of
from patronage.operators.cleaning import clean_lines
from patronage.operators.clustering import rfm_quartile_clusters  # noqa: F401  (import check)
from patronage.operators.clv_prob import calibration_holdout, lifetimes_summary
from patronage.operators.customers import (
    country_share, customer_features, customer_rfm, future_spend, overall_kpis, pareto, target_summary)
from patronage.operators.segments import segment_stats
from patronage.sources import parse_invoice_dates, read_log, read_transactions, write_csv
from patronage.session import materialize

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"
GOOD = ["1,A,mug,10,2024-01-02 10:00:00,0.125,1,UK", "2,B,cup,1000,2024-01-03 11:00:00,0.001,1.0,UK",
        "3,C,,1,2024-01-04 12:00:00,2.55,NaN,France", "4,D,jar,,2024-01-04 12:00:00,,2,France"]
BAD = {"5,A,x,abc,2024-01-05 10:00:00,1,1,UK": "Malformed Quantity: abc", "6,A,x,1.5,2024-01-05 10:00:00,1,1,UK": "Malformed Quantity: 1.5",
       "7,A,x,1,bad,1,1,UK": "unreadable InvoiceDate: bad", "8,A,x,1,2024-01-05 10:00:00,free,1,UK": "Malformed UnitPrice: free",
       "9,A,x,1,2024-01-05 10:00:00,0.00001,1,UK": "UnitPrice has more than 4 decimal places",
       "10,A,x,1,2024-01-05 10:00:00,1,abc,UK": "Malformed CustomerID: abc", "11,A,x": "Malformed line: 11,A,x",
       "12,A,x,1,2024-01-05 10:00:00,1,1,UK,more": "Malformed line: 12,A"}


def csv(lines, header=HEADER, name="log.csv"):
    path = os.path.join(tempfile.mkdtemp(prefix="patronage-csv-"), name)
    with open(path, "w", encoding="latin-1") as fh:
        fh.write("\n".join([header, *lines]) + "\n")
    return path


NARROW = {"count": lambda df: df.count(), "by country": lambda df: df.groupBy("Country").count().collect(),
          "one column": lambda df: df.select("StockCode").collect(), "description": lambda df: df.select("Description").collect(),
          "sum": lambda df: df.agg(F.sum("Quantity")).first(), "no column": lambda df: df.select(F.lit(1)).collect()}


@pytest.mark.parametrize("query", NARROW)
@pytest.mark.parametrize("line", BAD)
def test_a_line_that_cannot_be_read_ends_any_query(spark, line, query):
    path = csv([*GOOD, line])
    with pytest.raises(Exception, match=BAD[line].split(":")[0]):
        NARROW[query](read_transactions(spark, path, money_scale=4))


@pytest.mark.parametrize("query", NARROW)
def test_skipped_lines_are_out_of_any_query(spark, query):
    every, good = csv([*GOOD, *BAD]), csv(GOOD)
    got = NARROW[query](read_transactions(spark, every, on_error="skip", money_scale=4))
    want = NARROW[query](read_transactions(spark, good, money_scale=4))
    assert sorted(map(str, got)) == sorted(map(str, want)) if isinstance(got, list) else got == want


def test_lines_and_rejects_from_one_scan(spark):
    log = read_log(spark, csv([*GOOD[:2], *BAD, *GOOD[2:]]))
    assert log.seen.get == {"lines": 4, "rejects": 8}
    assert [r["InvoiceNo"] for r in log.lines.orderBy("line").collect()] == ["1", "2", "3", "4"]
    rejects = log.rejects.orderBy("line").collect()
    for r, (line, reason) in zip(rejects, BAD.items(), strict=True):
        assert r["reason"].startswith(reason)
        assert r["InvoiceNo"] == line.split(",")[0]
    assert rejects[2]["InvoiceDate"] == "bad" and rejects[0]["Quantity"] == "abc"
    assert {r["unit_cents"] for r in log.lines.collect()} == {1250, 10, 25500, None} and scale_of(log.lines) == 4


@pytest.mark.parametrize("lines", [GOOD, list(BAD), []])
def test_a_log_with_one_part_empty(spark, lines):
    log = read_log(spark, csv(lines))
    good = sum(x in GOOD for x in lines)
    assert log.lines.count() == good and log.rejects.count() == len(lines) - good
    assert log.seen.get == {"lines": good, "rejects": len(lines) - good}
    assert log.lines.groupBy("Country").count().count() == (2 if good else 0)


def test_columns_are_found_by_name(spark):
    names = HEADER.split(",")
    mixed = [names[i] for i in (7, 0, 6, 1, 5, 2, 4, 3)] + ["Extra"]
    lines = []
    for x in GOOD:
        f = dict(zip(names, x.split(",")))
        lines.append(",".join([*[f[c] for c in mixed[:-1]], "e"]))
    got = read_transactions(spark, csv(lines, ",".join(mixed)), money_scale=4).drop("line").collect()
    assert got == read_transactions(spark, csv(GOOD), money_scale=4).drop("line").collect()
    with pytest.raises(ValueError, match="UnitPrice"):
        read_transactions(spark, csv([], HEADER.replace("UnitPrice", "Price")))


def test_quoted_line_ends(spark):
    lines = ['1,A,"two\nlines, one",3,2024-01-02 10:00:00,1,1,UK']
    row = read_transactions(spark, csv(lines), multi_line=True).first()
    assert (row["Description"], row["Quantity"]) == ("two\nlines, one", 3)
    assert read_log(spark, csv(lines)).seen.get["rejects"] == 2


def test_typed_sources_are_checked_too(spark):
    rows = [("1", "A", "x", 2, dt.datetime(2024, 1, 1), 0.125, 1.0, "UK"), ("2", "A", "x", 2, dt.datetime(2024, 1, 1), 0.00001, 1.5, "UK")]
    df = materialize(spark.createDataFrame(rows, "InvoiceNo string, StockCode string, Description string, Quantity long, "
                                           "InvoiceDate timestamp, UnitPrice double, CustomerID double, Country string"))
    path = os.path.dirname(df.inputFiles()[0])
    log = read_log(spark, path, fmt="parquet")
    assert log.seen.get == {"lines": 1, "rejects": 1}
    assert log.lines.first()["unit_cents"] == 1250


def test_dates(spark):
    df = spark.createDataFrame([("12/1/2010 8:26",), ("bad",), (None,)], "InvoiceDate string")
    got = [r[0] for r in parse_invoice_dates(df, "M/d/yyyy H:mm", on_error="null").collect()]
    assert got == [dt.datetime(2010, 12, 1, 8, 26), None, None]
    with pytest.raises(Exception, match="unreadable InvoiceDate: bad"):
        parse_invoice_dates(df, "M/d/yyyy H:mm").collect()


def test_prices_below_a_cent_are_exact_everywhere(spark):
    """0.125 x 10 = 1.25 and 0.001 x 1000 = 1, in every sum that the library makes of money."""
    log = read_transactions(spark, csv(GOOD), money_scale=4)
    lines = clean_lines(log)
    assert {r["InvoiceNo"]: r["TotalSpend"] for r in lines.collect()} == {"1": 1.25, "2": 1.0}
    customers = materialize(customer_rfm(lines))
    assert scale_of(customers, "monetary_cents") == 4
    assert customers.first()["Monetary"] == 2.25 and customers.first()["monetary_cents"] == 22500
    features = customer_features(lines)
    row = features.first()
    assert (row["TotalMonetary"], row["Recent90DaySpend"], row["Actual_Future_Spend"]) == (2.25, 2.25, 2.25)
    snap = F.lit(dt.datetime(2024, 1, 5)).cast("timestamp")
    assert future_spend(lines, snap).first()["Actual_Future_Spend"] == 2.25
    assert overall_kpis(customers).first()["revenue"] == 2.25
    assert country_share(customers, "UK").first()["revenue"] == 2.25
    assert pareto(customers, 1.0).first()["top_mean"] == 2.25
    assert target_summary(features).first()["target_max"] == 2.25
    assert segment_stats(customers.withColumn("Segment", F.lit("s"))).first()["Monetary"] == 2.25
    assert lifetimes_summary(lines, snap).first()["monetary_value"] == 1.0
    day = F.lit(dt.datetime(2024, 1, 2, 23)).cast("timestamp")
    assert calibration_holdout(lines, day, snap).first()["monetary_value_holdout"] == 1.0


def test_csv_round_trip(spark, edge_log):
    path = tempfile.mkdtemp(prefix="patronage-csv-") + "/out"
    write_csv(edge_log, path)
    back = read_transactions(spark, path)
    assert sorted(map(str, back.drop("line").collect())) == sorted(map(str, edge_log.drop("line").collect()))
    log = read_transactions(spark, csv(GOOD), money_scale=4)
    write_csv(log, path)
    assert sorted(map(str, read_transactions(spark, path, money_scale=4).drop("line").collect())) == sorted(map(str, log.drop("line").collect()))


def test_features_without_leakage(spark):
    """With a cutoff, features end strictly before it and the target begins strictly after."""
    day = lambda d, h=12: dt.datetime(2024, 3, d, h)
    rows = [("1", "A", None, 1, day(1), 1.0, 1, "UK", 100, 0), ("2", "B", None, 2, day(5), 1.0, 1, "UK", 100, 1),
            ("3", "A", None, 4, day(10, 0), 1.0, 1, "UK", 100, 2), ("4", "A", None, 8, day(10, 1), 1.0, 1, "UK", 100, 3),
            ("5", "C", None, 16, day(20), 1.0, 2, "UK", 100, 4), ("6", "C", None, 32, dt.datetime(2024, 6, 30), 1.0, 1, "UK", 100, 5),
            ("7", "C", None, 64, day(2), 1.0, 3, "UK", 100, 6)]
    lines = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, Description string, Quantity long, InvoiceDate timestamp, "
                                  "UnitPrice double, CustomerID long, Country string, unit_cents long, line long")
    cut = F.lit(dt.datetime(2024, 3, 10)).cast("timestamp")
    got = {r["CustomerID"]: r for r in customer_features(lines, cutoff=cut).collect()}
    assert set(got) == {1, 3}  # customer 2 has no line before the cutoff
    assert (got[1]["TotalQuantity"], got[1]["TransactionCount"], got[1]["UniqueProducts"]) == (3, 2, 2)
    assert (got[1]["Recency"], got[1]["Recent90DaySpend"], got[1]["Actual_Future_Spend"]) == (4, 3.0, 8.0)
    assert got[3]["Actual_Future_Spend"] == 0.0
