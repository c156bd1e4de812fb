"""Hand-made edge log (FIXTURES.md section 3), worked by hand."""

import datetime as dt

from pyspark.sql import functions as F

from patronage.operators import cleaning as C
from patronage.operators import customers as U
from patronage.operators import profile as PR
from patronage.operators.clv_historical import historical_clv
from patronage.operators.clv_prob import lifetimes_summary


def test_profile_and_waterfall(edge_log):
    assert PR.duplicate_rows(edge_log).first()["duplicate_rows"] == 1
    wf = {r["step"]: r["remaining"] for r in C.cleaning_waterfall(edge_log).collect()}
    assert [wf[i] for i in (1, 2, 3, 4)] == [8, 7, 6, 5]
    retained = C.cleaning_waterfall(edge_log).first()["retained_pct"]
    assert abs(retained - 55.5555555) < 1e-4


def test_snapshot_and_rfm(edge_log):
    lines = C.clean_lines(edge_log)
    snap = C.snapshot_date(lines).first()["snapshot"]
    assert snap == dt.datetime(2024, 1, 6, 8, 0)
    rfm = {r["CustomerID"]: r for r in U.customer_rfm(lines).collect()}
    assert (rfm[1]["Recency"], rfm[1]["Frequency"], rfm[1]["Monetary"]) == (2, 2, 36.0)
    assert (rfm[1]["TotalQuantity"], rfm[1]["UniqueProducts"]) == (8, 2)
    assert (rfm[2]["Recency"], rfm[2]["Frequency"], rfm[2]["Monetary"]) == (1, 1, 15.0)
    assert rfm[1]["AvgTransactionValue"] == 18.0 and rfm[1]["AvgItemsPerTransaction"] == 4.0


def test_features_and_historical_clv(edge_log):
    lines = C.clean_lines(edge_log)
    feat = {r["CustomerID"]: r for r in U.customer_features(lines).collect()}
    assert feat[1]["CustomerLifespan"] == 2 and feat[1]["PurchaseFrequency"] == 1.0
    assert feat[1]["Day_0_Purchases"] == 3 and feat[1]["Day_2_Purchases"] == 1
    assert feat[1]["Hour_10_Purchases"] == 3 and feat[1]["Hour_9_Purchases"] == 1
    assert feat[2]["Day_4_Purchases"] == 1 and feat[2]["Hour_8_Purchases"] == 1
    h = {r["CustomerID"]: r for r in historical_clv(U.customer_features(lines), tier=False).collect()}
    assert h[1]["CLV_DailyAvg"] == 6570.0 and h[1]["CLV_RecentBased"] == 144.0
    assert abs(h[1]["CLV_Historical"] - 4642.2) < 1e-9
    assert abs(h[2]["CLV_Historical"] - 3850.5) < 1e-9


def test_lifetimes_summary(edge_log):
    lines = C.clean_lines(edge_log)
    snap = C.snapshot_value(lines)
    s = {r["CustomerID"]: r for r in lifetimes_summary(lines, snap).collect()}
    assert (s[1]["frequency"], s[1]["recency"], s[1]["T"], s[1]["monetary_value"]) == (1, 2.0, 5.0, 20.0)
    assert (s[2]["frequency"], s[2]["recency"], s[2]["T"], s[2]["monetary_value"]) == (0, 0.0, 1.0, 0.0)


def test_profile_counts(edge_log):
    flags = PR.quality_flags(edge_log).first()
    assert (flags["cancelled"], flags["negative_quantity"], flags["invalid_price"]) == (1, 2, 1)
    nulls = {r["column"]: r["nulls"] for r in PR.null_counts(edge_log).collect()}
    assert nulls["CustomerID"] == 1 and nulls["Description"] == 9
    rng = PR.date_range(edge_log).first()
    assert rng["span_days"] == 4
    hist = PR.histogram(edge_log, "Quantity", 5).collect()
    assert sum(r["count"] for r in hist) == 9 and len(hist) == 5
