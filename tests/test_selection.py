"""Selection by histogram refinement against sorting; scaled money; approximate quantiles."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patronage.functions.ordering import (
    Selection, approx_quantiles, pairs_at, quantile_table, rank_bins, top_mask)
from patronage.operators.binning import qcut, scalar_quantiles


def table(spark, values, kind="double"):
    rows = [(i, None if v is None else (float(v) if kind == "double" else int(v))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"k long, v {kind}").repartition(3)


CASES = {
    "ties": [3, 1, 3, 3, 1, 2, 3, 3] * 40,
    "long tail": [*np.exp(np.random.default_rng(1).normal(0, 6, 400)), 1e12, 1e-9, 0.0, -5.0],
    "close": [1.0 + i * 2.0 ** -50 for i in range(200)],
    "one value": [7] * 50,
    "one row": [7],
    "negative": list(range(-90, 90)),
    "nulls": [None, 4, None, 2, 2, None, 9],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("buckets,fetch", [(4, 3), (64, 10)])
def test_values_at_all_ranks(spark, name, buckets, fetch):
    """Few buckets and little fetching make every step refine."""
    values = CASES[name]
    kept = sorted(float(v) for v in values if v is not None)
    s = Selection(table(spark, values), {"v": F.col("v")}, buckets=buckets, fetch=fetch)
    ranks = sorted({1, len(kept), *np.linspace(1, len(kept), 9).astype(int).tolist()})
    got = s.at({"v": ranks})
    assert s.n == {"v": len(kept)}
    for r in ranks:
        x = got["v", r]
        assert x.value == kept[r - 1]
        assert (x.within, x.equal) == (r - kept.index(x.value), kept.count(x.value))


def test_longs_beyond_doubles(spark):
    values = [2 ** 62 + i for i in range(-20, 20)] + [-2 ** 62 + 1, 5]
    got = Selection(table(spark, values, "long"), {"v": F.col("v")}, buckets=4, fetch=2).at({"v": [1, 2, 3, 20, 42]})
    want = sorted(values)
    assert [got["v", r].value for r in (1, 2, 3, 20, 42)] == [want[r - 1] for r in (1, 2, 3, 20, 42)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(min_value=-3, max_value=3), min_size=1, max_size=50), st.integers(2, 6))
def test_pairs_bins_and_top_match_sorting(spark, values, q):
    df = table(spark, values, "long")
    order = sorted((v, i) for i, v in enumerate(values))
    n = len(values)
    cuts, rows = pairs_at(df, F.col("v"), F.col("k"), lambda n: list(range(1, n + 1)))
    assert rows == n
    for r, pair in cuts.items():
        after = {x["k"] for x in df.where(pair.before(F.col("v"), F.col("k"))).collect()} if r in (1, n, n // 2) else None
        assert after is None or after == {i for _, i in order[r:]}
    got = {x["k"]: x["b"] for x in rank_bins(df, "v", "k", "b", q).collect()}
    assert got == {i: 1 + sum(q * r > k * (n - 1) for k in range(1, q)) for r, (_, i) in enumerate(order)}
    marked, _ = top_mask(df, "v", "k", lambda n: n // 3, "t")
    best = sorted((-v, i) for i, v in enumerate(values))[:n // 3]
    assert {x["k"] for x in marked.where("t").collect()} == {i for _, i in best}


def test_missing_values_have_no_bin_and_no_place(spark):
    df = table(spark, [None, 1, float("nan"), 3, 2, 5])
    assert {r["k"]: r["b"] for r in rank_bins(df.where("v is null or v = v").where("not isnan(v) or v is null"), "v", "k", "b", 2)
            .collect()} == {0: None, 1: 1, 3: 2, 4: 1, 5: 2}
    marked, n = top_mask(df.where("v is null or not isnan(v)"), "v", "k", lambda n: 2, "t")
    assert n == 4 and {r["k"] for r in marked.where("t").collect()} == {3, 5}
    empty = df.limit(0)
    assert top_mask(empty, "v", "k", lambda n: 0, "t")[0].count() == 0 and rank_bins(empty, "v", "k", "b").count() == 0
    assert quantile_table(empty, ["v"], [0.5]) == {"v": [None]}


def test_quantiles_of_several_columns_match_pandas(spark):
    rng = np.random.default_rng(4)
    a, b = rng.lognormal(3, 2, 3000), rng.integers(0, 50, 3000)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = quantile_table(df, ["a", "b"], probs)
    assert np.allclose(got["a"], np.quantile(a, probs), rtol=1e-12) and np.allclose(got["b"], np.quantile(b, probs))
    with pytest.raises(ValueError):
        quantile_table(spark.createDataFrame([(1.0,), (float("inf"),)], "v double"), ["v"], [0.5])


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_approximate_quantiles_keep_their_error(spark, accuracy):
    values = np.random.default_rng(8).lognormal(0, 2, 5000)
    probs = [0.01, 0.25, 0.5, 0.9, 0.99]
    df = table(spark, values.tolist())
    ordered = np.sort(values)
    for row in (approx_quantiles(df, "v", probs, accuracy=accuracy).first(),
                scalar_quantiles(df, "v", probs, exact=False, accuracy=accuracy).first()):
        for p, v in zip(probs, row):
            rank = np.searchsorted(ordered, v) + 1
            assert abs(rank - p * len(values)) <= len(values) / accuracy + 1
    exact = scalar_quantiles(df, "v", probs).first()
    assert np.allclose(list(exact), np.quantile(values, probs), rtol=1e-12)


def test_merged_duplicate_edges(spark):
    df = table(spark, [0] * 6 + [1, 2, 3, 4])
    with pytest.raises(Exception, match="unique"):
        qcut(df, "v", 4, [1, 2, 3, 4], "b").collect()
    merged = {r["v"]: r["b"] for r in qcut(df, "v", 4, [1, 2, 3, 4], "b", duplicates="merge").collect()}
    allowed = {r["v"]: r["b"] for r in qcut(df, "v", 4, [1, 2, 3, 4], "b", duplicates="allow").collect()}
    codes = pd.qcut(pd.Series([0.0] * 6 + [1, 2, 3, 4]), 4, labels=False, duplicates="drop") + 1
    assert merged == dict(zip([0.0] * 6 + [1, 2, 3, 4], codes.tolist())) and allowed[4.0] == 4


def test_euclidean_silhouette_of_a_sample(spark):
    import hashlib

    import numpy as np

    from patronage.operators.clustering import euclidean_silhouette
    rng = np.random.default_rng(4)
    rows = [(int(i), str("abc"[i % 3]), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(600, 2)) * 2)]
    rows += [(1000, "alone", 50.0, 50.0), (1001, None, 0.0, 0.0), (1002, "a", None, 0.0), (1003, "a", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "CustomerID long, Cluster string, x double, y double").repartition(5)

    def brute(rows):
        rows = [r for r in rows if None not in r]
        scores = []
        for i, (_, own, x, y) in enumerate(rows):
            by = {}
            for j, (_, label, u, v) in enumerate(rows):
                if i != j:
                    by.setdefault(label, []).append(((x - u) ** 2 + (y - v) ** 2) ** 0.5)
            near = by.pop(own, None)
            other = min(sum(d) / len(d) for d in by.values())
            scores.append(0.0 if near is None else (other - sum(near) / len(near)) / max(other, sum(near) / len(near)))
        return sum(scores) / len(scores)

    whole = euclidean_silhouette(df, ("x", "y")).first()
    assert (whole["rows"], whole["clusters"]) == (602, 4) and abs(whole["silhouette"] - brute(rows)) < 1e-9
    named = sorted((r for r in rows if None not in r), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
    some = euclidean_silhouette(df, ("x", "y"), max_rows=200).first()
    assert some["rows"] == 200 and abs(some["silhouette"] - brute(named[:200])) < 1e-9
    assert euclidean_silhouette(df.where("Cluster = 'a'"), ("x", "y")).first()["silhouette"] is None
    assert euclidean_silhouette(df.limit(0), ("x", "y")).first()["rows"] == 0
