import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from patronage.session import build_session
    ckpt = tempfile.mkdtemp(prefix="patronage-test-ckpt-")
    s = build_session("local[4]", app="patronage-tests", shuffle_partitions=4,
                      conf={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def edge_log(spark):
    """The 9-line hand-made log of FIXTURES.md section 3."""
    import datetime as dt
    rows = [
        ("1001", "A", 2, dt.datetime(2024, 1, 1, 10), 5.00, 1, "United Kingdom"),
        ("1001", "B", 1, dt.datetime(2024, 1, 1, 10), 3.00, 1, "United Kingdom"),
        ("1001", "B", 1, dt.datetime(2024, 1, 1, 10), 3.00, 1, "United Kingdom"),
        ("1002", "A", 4, dt.datetime(2024, 1, 3, 9), 5.00, 1, "United Kingdom"),
        ("C1003", "A", -4, dt.datetime(2024, 1, 4, 9), 5.00, 1, "United Kingdom"),
        ("1004", "A", -1, dt.datetime(2024, 1, 4, 10), 5.00, 2, "France"),
        ("1005", "B", 1, dt.datetime(2024, 1, 5, 10), 0.00, 2, "France"),
        ("1006", "B", 1, dt.datetime(2024, 1, 5, 11), 3.00, None, "France"),
        ("1007", "C", 10, dt.datetime(2024, 1, 5, 8), 1.50, 2, "France"),
    ]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(
        [(r[0], r[1], None, r[2], r[3], r[4], r[5], r[6], i) for i, r in enumerate(rows)],
        "InvoiceNo string, StockCode string, Description string, Quantity long, "
        "InvoiceDate timestamp, UnitPrice double, CustomerID long, Country string, line long")
    return df.withColumn("unit_cents", F.round(F.col("UnitPrice") * 100).cast("long"))
