"""Trees grown by tasks against MLlib's."""

import numpy as np
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from patronage.operators import clv_ml as M
from patronage.operators import trees as T


def customers(spark, n=400, seed=3):
    """Features of few and of many values, a target that is often 0."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 100, (n, len(M.ML_FEATURES))), 2)
    x[:, 9:] = rng.integers(0, 6, (n, x.shape[1] - 9))
    x[:, 12] = 1.0
    y = np.where(rng.random(n) < 0.4, 0.0, np.round(x[:, 0] + 3 * x[:, 10] + rng.normal(0, 2, n), 2))
    schema = "CustomerID long, " + ", ".join(f"{c} double" for c in [*M.ML_FEATURES, M.TARGET])
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], schema) \
        .withColumn("is_train", F.col("CustomerID") % 4 > 0).coalesce(1)


def predictions(model, df):
    return np.array([r["prediction"] for r in model.transform(df).orderBy("CustomerID").select("prediction").collect()])


def test_boosted_trees_are_those_of_mllib(spark):
    data = M.assemble(customers(spark, n=1500)).cache()
    train = data.where("is_train")
    est = {d: GBTRegressor(maxIter=6, maxDepth=d, stepSize=0.3, seed=1, featuresCol="features", labelCol=M.TARGET) for d in (2, 5)}
    got = T.grow_models(train, M.TARGET, {f"gbt{d}": e for d, e in est.items()})
    for d, e in est.items():
        want = e.fit(train)
        assert got[f"gbt{d}"].getNumTrees == 6
        assert np.allclose(predictions(got[f"gbt{d}"], train), predictions(want, train))
        # splits that part the train rows alike may part other rows differently
        assert np.mean(np.isclose(predictions(got[f"gbt{d}"], data), predictions(want, data))) > 0.98
        if d == 2:
            assert np.allclose(got["gbt2"].featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-6)


def test_a_deep_tree_is_that_of_mllib(spark):
    data = M.assemble(customers(spark, n=600, seed=4)).cache()
    x = np.array([r["features"].toArray() for r in data.orderBy("CustomerID").collect()])
    y = np.array([r[M.TARGET] for r in data.orderBy("CustomerID").collect()])
    edges = [T.split_points(*T._merge(x[:, f], np.ones(len(x))), 64) for f in range(x.shape[1])]
    assert len(edges[0]) == 63 and len(edges[9]) == 5 and len(edges[12]) == 0
    binned = T._binned(x, edges)
    tree, _ = T.grow(binned, y, np.ones(len(y)), [len(e) + 1 for e in edges], 30)
    want = DecisionTreeRegressor(maxDepth=30, maxBins=64, featuresCol="features", labelCol=M.TARGET, seed=1).fit(data)
    assert len(tree.left) == want.numNodes
    assert np.allclose(tree.predict(binned), predictions(want, data))
    # a row that is drawn three times counts as three rows
    times = np.arange(len(y)) % 4
    often = np.repeat(np.arange(len(y)), times)
    drawn = times > 0
    a, _ = T.grow(binned[:, drawn], y[drawn], times[drawn].astype(float), [len(e) + 1 for e in edges], 30)
    b, _ = T.grow(binned[:, often], y[often], np.ones(len(often)), [len(e) + 1 for e in edges], 30)
    assert np.allclose(a.predict(binned), b.predict(binned))


def test_histograms_and_sorted_rows_give_the_same_split():
    rng = np.random.default_rng(6)
    node = np.sort(rng.integers(0, 40, 300))
    node = np.unique(node, return_inverse=True)[1]
    x, w, y = rng.integers(0, 16, 300), rng.integers(1, 4, 300).astype(float), rng.integers(0, 9, 300).astype(float)
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    W, S = np.add.reduceat(w, starts), np.add.reduceat(w * y, starts)
    dense = T._dense_split(node * 16 + x, w, w * y, W, S, 16, False)
    by_rows = T._sorted_split(node * 16 + x, w, w * y, node, W, S, 16, np.cumsum(W) - W, np.cumsum(S) - S)
    assert np.allclose(dense[0], by_rows[0])
    assert (dense[1] == by_rows[1])[np.isfinite(dense[0])].all()


def test_draws_do_not_depend_on_the_order_of_rows():
    key = np.random.default_rng(1).integers(-2**62, 2**62, 50_000)
    a = T.draws(key, 42, 3, 1.0)
    assert (T.draws(key[::-1], 42, 3, 1.0)[::-1] == a).all() and (T.draws(key, 42, 4, 1.0) != a).any()
    shares = np.bincount(a.astype(int), minlength=4)[:4] / len(a)
    assert np.allclose(shares, [0.3679, 0.3679, 0.1839, 0.0613], atol=0.01)
    assert abs(T.draws(key, 42, 3, 0.5).mean() - 0.5) < 0.02


def test_thinned_values_keep_their_ranks():
    v = np.random.default_rng(2).lognormal(3, 1, 40_000)
    found, n = T._merge(v, np.ones(len(v)), 1000)
    assert n.sum() == len(v) and len(found) <= 1000
    exact, thin = (T.split_points(*m, 64) for m in (T._merge(v, np.ones(len(v))), (found, n)))
    shares = [np.searchsorted(np.sort(v), e) / len(v) for e in (exact, thin)]
    assert len(thin) == 63 and np.abs(shares[0] - shares[1]).max() < 0.002


def test_all_tree_models_take_a_few_jobs(spark):
    data = customers(spark)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    metrics, models = M.train_models(data, models=["Gradient Boosting", "GBT deep", "Random Forest", "Linear Regression"])
    rows = {r["model"]: r for r in metrics.collect()}
    # MLlib submits a job a level of each boosted tree, over a thousand here
    assert jobs() - before < 100
    assert [models[m].getNumTrees for m in ("Gradient Boosting", "GBT deep", "Random Forest")] == [100] * 3
    assert len(rows) == 4 and all(r["mae"] >= 0 for r in rows.values())
    # the same models from other partitions, also without the rows' scope
    again, same = M.train_models(data.repartition(5), models=["GBT deep", "Random Forest"])
    scored = M.assemble(data)
    for name in ("GBT deep", "Random Forest"):
        assert np.allclose(predictions(models[name], scored), predictions(same[name], scored))
    out = models["Random Forest"].transform(scored)
    assert out.columns == [*scored.columns, "prediction"] and out.count() == 400
    assert models["Random Forest"].transform(scored.where("false")).count() == 0


def test_models_outlive_the_scope_they_were_fitted_in(spark):
    from patronage.session import scope
    data = customers(spark, n=80)
    with scope(spark):
        _, models = M.train_models(data, models=["Random Forest"])
    assert len(predictions(models["Random Forest"], M.assemble(data))) == 80


def test_more_rows_than_may_be_broadcast_stay_with_mllib(spark, monkeypatch):
    monkeypatch.setattr(T, "LOCAL_ROWS", 10)
    monkeypatch.setattr(M, "model_presets", lambda n, seed: {
        "forest": RandomForestRegressor(numTrees=12, maxDepth=4, featureSubsetStrategy="all", seed=seed),
        "boosted": GBTRegressor(maxIter=2, maxDepth=2, seed=seed), "line": LinearRegression()})
    metrics, models = M.train_models(customers(spark, n=80))
    assert isinstance(models["forest"], M.ForestParts) and not isinstance(models["boosted"], T.GrownTrees)
    assert metrics.count() == 3


def test_only_settings_that_tasks_follow_are_grown_by_them():
    assert T.grows(GBTRegressor()) and T.grows(RandomForestRegressor(featureSubsetStrategy="all"))
    for est in (RandomForestRegressor(), GBTRegressor(subsamplingRate=0.5), GBTRegressor(lossType="absolute"),
                GBTRegressor(minInstancesPerNode=3), GBTRegressor(maxBins=300), LinearRegression()):
        assert not T.grows(est)


def test_a_grown_model_scores_every_customer(spark):
    data = customers(spark, n=300)
    _, models = M.train_models(data, models=["Gradient Boosting"])
    got = M.predict_clv(data, model=models["Gradient Boosting"], duplicates="allow").orderBy("CustomerID").collect()
    want = predictions(models["Gradient Boosting"], M.assemble(data))
    assert [r["CustomerID"] for r in got] == list(range(300)) and isinstance(models["Gradient Boosting"], T.GrownTrees)
    assert np.allclose([r["Predicted_CLV_1Year"] for r in got], want * 365 / 90)


def test_importances_of_the_best_grown_model(spark):
    metrics, models = M.train_models(customers(spark, n=300), models=["Gradient Boosting", "Linear Regression"])
    alone = metrics.where("model = 'Gradient Boosting'")
    got = M.best_model_importance(spark, alone, models).collect()
    assert isinstance(models["Gradient Boosting"], T.GrownTrees)
    held = models["Gradient Boosting"].featureImportances.toArray()
    assert len(got) == 15 and got[0]["feature"] == "TransactionCount" and abs(held.sum() - 1) < 1e-9
    assert np.allclose([r["importance"] for r in got], np.sort(held)[::-1][:15])


def test_driver_labels_of_a_grown_forest(spark):
    from patronage.operators.outputs import driver_label
    _, models = M.train_models(customers(spark, n=200), models=["Random Forest"])
    assert isinstance(models["Random Forest"], T.GrownTrees)
    top = M.feature_importance(models["Random Forest"], top=5).select(driver_label(F.col("feature")).alias("driver"), "feature").collect()
    assert len(top) == 5 and tuple(top[0]) == ("High purchase frequency", "TransactionCount")
