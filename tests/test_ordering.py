"""Distributed rank and exact quantiles against pandas / numpy."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patronage.functions.ordering import exact_quantiles, global_row_number
from patronage.operators.binning import qcut, qcut_of_rank, tier_cut


def _frame(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, x double")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=60))
def test_global_row_number_matches_sort(spark, values):
    df = _frame(spark, values)
    got = [r["id"] for r in global_row_number(df, ["x", "id"], num_partitions=3)
           .orderBy("rank").collect()]
    want = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert got == want
    ranks = [r["rank"] for r in global_row_number(df, ["x", "id"], num_partitions=3).collect()]
    assert sorted(ranks) == list(range(1, len(values) + 1))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=80))
def test_exact_quantiles_match_pandas(spark, values):
    probs = [0.0, 0.25, 0.33, 0.5, 0.66, 0.9, 1.0]
    row = exact_quantiles(_frame(spark, values), "x", probs, num_partitions=3).first()
    want = pd.Series(values).quantile(probs).tolist()
    for got, exp in zip(row, want):
        assert abs(got - exp) <= 1e-9 * max(1.0, abs(exp))


def test_exact_quantiles_hot_value(spark):
    # one value holds a third of all rows: collapsed before the ordering
    vals = [7.0] * 300 + list(np.linspace(0, 100, 600))
    row = exact_quantiles(_frame(spark, vals), "x", [0.1, 0.5, 0.9], num_partitions=4).first()
    want = pd.Series(vals).quantile([0.1, 0.5, 0.9]).tolist()
    assert all(abs(a - b) < 1e-9 for a, b in zip(row, want))


def test_qcut_matches_pandas(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 400, 500)
    df = _frame(spark, vals)
    got = {r["id"]: r["b"] for r in qcut(df, "x", 4, [4, 3, 2, 1], "b").collect()}
    want = pd.qcut(pd.Series(vals.astype(float)), 4, labels=[4, 3, 2, 1]).astype(int)
    assert [got[i] for i in range(len(vals))] == want.tolist()
    got_p = {r["id"]: r["b"] for r in qcut(df, "x", 4, [4, 3, 2, 1], "b",
                                           method="percentile").collect()}
    assert got_p == got


def test_qcut_of_rank_matches_pandas(spark):
    rng = np.random.default_rng(5)
    vals = rng.integers(1, 20, 333)
    df = _frame(spark, vals).withColumnRenamed("id", "CustomerID")
    got = {r["CustomerID"]: r["s"] for r in qcut_of_rank(df, "x", "s").collect()}
    s = pd.Series(vals.astype(float))
    want = pd.qcut(s.rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
    assert [got[i] for i in range(len(vals))] == want.tolist()


def test_tier_cut_covers_all_rows(spark):
    vals = np.random.default_rng(9).normal(100, 30, 400)
    df = _frame(spark, vals)
    out = tier_cut(df, "x", "t").groupBy("t").count().collect()
    assert sum(r["count"] for r in out) == 400 and {r["t"] for r in out} == {"Low", "Medium", "High"}
    lo, hi = np.quantile(vals, [0.33, 0.66])
    want = pd.cut(pd.Series(vals), [-np.inf, lo, hi, np.inf], labels=["Low", "Medium", "High"])
    got = {r["id"]: r["t"] for r in tier_cut(df, "x", "t").collect()}
    assert [got[i] for i in range(400)] == want.astype(str).tolist()


def test_tier_cut_duplicate_edges_raise(spark):
    import pytest
    df = _frame(spark, [0.0] * 10 + [1.0])
    with pytest.raises(Exception):
        tier_cut(df, "x", "t").collect()
    assert tier_cut(df, "x", "t", duplicates="allow").filter(F.col("t") == "Low").count() == 10
