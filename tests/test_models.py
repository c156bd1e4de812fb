"""Parameter recovery, prediction properties, ensemble and ML helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.operators import clv_prob as P
from patronage.operators.ensemble import ensemble_clv
from simulate import simulate_bgnbd


def test_bgnbd_and_gamma_gamma_recovery(spark):
    df = spark.createDataFrame(simulate_bgnbd(n=20000))
    bg = P.bgnbd_fit(df, include_one_time=True)
    for got, true in zip(bg.as_tuple(), (0.8, 30.0, 0.6, 2.5)):
        assert abs(got - true) / true < 0.15, bg
    gg = P.gamma_gamma_fit(df)
    for got, true in zip(gg.as_tuple(), (6.0, 4.0, 15.0)):
        assert abs(got - true) / true < 0.15, gg


def test_gradients_are_the_slopes_of_the_likelihoods():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, 200).astype(float)
    T = rng.uniform(1, 10, 200)
    tx = np.where(x > 0, T * rng.uniform(0.05, 1, 200), 0.0)
    m = rng.uniform(0.5, 80, 200)
    for loglik, gradient, args, theta in (
            (P.bgnbd_loglik_np, P.bgnbd_gradient_np, (x, tx, T), (0.8, 3.0, 0.6, 2.5)),
            (P.bgnbd_loglik_np, P.bgnbd_gradient_np, (x, tx, T), (60.0, 900.0, 0.02, 7.0)),
            (P.gamma_gamma_loglik_np, P.gamma_gamma_gradient_np, (x + 1, m), (6.0, 4.0, 15.0))):
        for i, slopes in enumerate(gradient(*args, *theta)):
            h = 1e-5 * theta[i]
            up, down = ([t + s * (k == i) for k, t in enumerate(theta)] for s in (h, -h))
            want = (loglik(*args, *up) - loglik(*args, *down)) / (2 * h)
            assert np.allclose(slopes, want, rtol=1e-5, atol=1e-6 * max(1, np.abs(want).max()))


def test_a_fit_says_whether_it_converged(spark):
    data = simulate_bgnbd(n=3000, seed=2)
    df = spark.createDataFrame(data)
    bg = P.bgnbd_fit(df, include_one_time=True)
    assert bg.converged and bg.iterations > 2
    with pytest.warns(RuntimeWarning, match="not converged"):
        assert not P.bgnbd_fit(df, include_one_time=True, max_iter=2).converged
    with pytest.raises(RuntimeError):
        P.gamma_gamma_fit(df, max_iter=1, raise_error=True)
    gg = P.gamma_gamma_fit(df)
    free = df.limit(1).withColumns({"frequency": F.lit(2).cast(df.schema["frequency"].dataType),
                                    "monetary_value": F.lit(0.0)})
    more = P.gamma_gamma_fit(df.union(free).union(free.withColumn("monetary_value", F.lit(None).cast("double"))))
    assert gg.converged and gg.left_out == 0 and more.left_out == 2
    assert np.allclose(gg.as_tuple(), more.as_tuple(), rtol=1e-4)
    row = P.params_frame(spark, more).first()
    assert row["converged"] is True and row["left_out"] == 2.0
    with pytest.raises(ValueError):
        P.bgnbd_fit(df.limit(0))


def test_prediction_properties(spark):
    df = spark.createDataFrame(simulate_bgnbd(n=400, seed=11))
    bg = P.PUBLISHED_BGNBD
    x, tx, T = F.col("frequency"), F.col("recency"), F.col("T")
    out = df.select(P.p_alive(x, tx, T, bg).alias("pa"),
                    *[P.expected_purchases(F.lit(float(t)), x, tx, T, bg).alias(f"e{t}")
                      for t in (30, 90, 365)]).collect()
    for r in out:
        assert 0.0 <= r["pa"] <= 1.0
        assert 0.0 <= r["e30"] <= r["e90"] + 1e-12 <= r["e365"] + 2e-12


def test_ensemble_weights_sum_to_one(spark):
    rows = [(i, float(i), None if i % 3 == 0 else float(2 * i), float(i % 7)) for i in range(1, 60)]
    cmp = spark.createDataFrame(rows, "CustomerID long, CLV_Historical double, CLV_ML double, "
                                      "CLV_Probabilistic double")
    tx = spark.createDataFrame([(i, i % 25) for i in range(1, 60)], "CustomerID long, TransactionCount long")
    ens = ensemble_clv(cmp, tx).collect()
    for r in ens:
        assert abs(r["weight_historical"] + r["weight_probabilistic"] + r["weight_ml"] - 1) < 1e-12
        assert r["CLV_Tier_Final"] in ("Low", "Medium", "High")


def test_importance_only_of_a_best_tree_model(spark):
    from pyspark.ml.linalg import Vectors

    from patronage.operators.clv_ml import ML_FEATURES, best_model_importance

    class Tree:
        featureImportances = Vectors.dense([float(i) for i in range(len(ML_FEATURES))])

    models = {"tree": Tree(), "line": object()}

    def importance(tree_r2, line_r2):
        metrics = spark.createDataFrame([("tree", tree_r2), ("line", line_r2)], "model string, r2 double")
        return best_model_importance(spark, metrics, models).collect()

    got = importance(0.9, 0.5)
    assert len(got) == 15 and got[0]["feature"] == ML_FEATURES[-1] and got[0]["model"] == "tree"
    assert importance(0.5, 0.9) == []


def test_crosstab_has_every_cell(spark):
    from patronage.operators.segments import crosstab_long, crosstab_pct, crosstab_wide
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), (None, "x"), ("c", None)]
    df = spark.createDataFrame(rows, "r string, c string")
    cells = {("a", "x"): 2, ("a", "y"): 1, ("b", "x"): 0, ("b", "y"): 1}
    assert {(r["r"], r["c"]): r["count"] for r in crosstab_long(df, "r", "c").collect()} == cells
    assert {(r["r"], r["c"]): r["pct"] for r in crosstab_pct(df, "r", "c").collect()} == {
        k: v * 25.0 for k, v in cells.items()}
    assert sorted(map(tuple, crosstab_wide(df, "r", "c").collect())) == [("a", 2, 1), ("b", 0, 1)]
    assert crosstab_long(df.where("false"), "r", "c").collect() == []


def test_ml_split_is_deterministic(spark):
    from patronage.operators.clv_ml import split_bucket
    df = spark.range(1, 2001).withColumnRenamed("id", "CustomerID")
    a = df.select("CustomerID", split_bucket().alias("b"))
    b = df.repartition(7).select("CustomerID", split_bucket().alias("b"))
    assert sorted(a.collect()) == sorted(b.collect())
    share = a.filter(F.col("b") < 80).count() / 2000
    assert 0.75 < share < 0.85


def test_forest_is_grown_in_parts_side_by_side(spark):
    from patronage.operators import clv_ml as M
    forest = M.model_presets(10)["Random Forest"]
    parts = M.forest_parts(forest)
    assert [p.getNumTrees() for p in parts] == [10] * 10 and len({p.getSeed() for p in parts}) == 10
    assert all(p.getMaxDepth() == 30 and p.getMaxBins() == 64 for p in parts)
    assert [p.getNumTrees() for p in M.forest_parts(forest, size=40)] == [40, 40, 20]

    rows = spark.range(60).select("id", *[(F.col("id") * 7 % (5 + i)).cast("double").alias(c) for i, c in enumerate(M.ML_FEATURES)])
    data = rows.select(F.col("id").alias("CustomerID"), *M.ML_FEATURES,
                       (F.col("id") % 9 + F.col("Recency")).alias(M.TARGET), (F.col("id") % 5 > 0).alias("is_train")).coalesce(1)
    metrics, models = M.train_models(data, models=["Random Forest"])
    forest = models["Random Forest"]
    assert forest.getNumTrees == 100 and len(forest.parts) == 10
    assert abs(forest.featureImportances.toArray().sum() - 1) < 1e-9
    scored = M.assemble(data).orderBy("CustomerID")
    got = [r["prediction"] for r in forest.transform(scored).orderBy("CustomerID").collect()]
    each = [[r["p"] for r in p.setPredictionCol("p").transform(scored).orderBy("CustomerID").collect()] for p in forest.parts]
    assert np.allclose(got, np.mean(each, axis=0))
    assert metrics.collect()[0]["mae"] >= 0


def test_k_means_fits_of_a_sweep_share_their_passes(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from patronage.operators import clustering as K
    from patronage.session import materialize
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(m, 0.4, (60, 3)) for m in (-3.0, 0.0, 2.5)])
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], ", ".join(f"{c} double" for c in K._Z))
    vectors = materialize(VectorAssembler(inputCols=list(K._Z), outputCol="features").transform(df))
    starts = [(2, 42), (3, 42), (5, 43)]
    fits = K._fit_all(vectors, starts, 300, 1e-4)
    for k, seed in starts:
        want = KMeans(k=k, seed=seed, maxIter=300, tol=1e-4, featuresCol="features").fit(vectors)
        centres, cost = fits[k, seed]
        assert np.allclose(centres, want.clusterCenters())
        assert abs(cost - want.summary.trainingCost) < 1e-6 * cost
    # passes over the points: as many as the slowest fit needs, not the sum over the fits
    passes = []
    table, collect = type(vectors), type(vectors).collect
    try:
        table.collect = lambda self: passes.append(1) or collect(self)
        K._fit_all(vectors, starts, 2, 0.0)
    finally:
        table.collect = collect
    assert len(passes) == 2


def test_a_point_between_two_centres_counts_once():
    import pandas as pd

    from patronage.operators.clustering import _lloyd_sums

    class Shared:
        value = [(7, np.array([[-1.0, 0, 0], [1.0, 0, 0], [9.0, 0, 0]])), (9, np.array([[0.0, 0, 2]]))]

    points = pd.DataFrame([[0.0, 0, 0], [2.0, 0, 0], [0.0, 0, 0]])
    got = next(iter(_lloyd_sums(Shared, block=2)(iter([points, points]))))
    assert got[["fit", "cluster", "n"]].to_numpy().tolist() == [[7, 0, 4], [7, 1, 2], [7, 2, 0], [9, 0, 6]]
    assert np.allclose(got.groupby("fit")["cost"].sum(), [6, 32]) and np.allclose(got["s0"], [0, 4, 0, 4])
