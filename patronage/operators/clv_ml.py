"""Machine-learning CLV (J8-J18): linear models on Spark MLlib, trees grown by tasks.

The feature table comes from the single customer group-by; the assembled
vectors are cached once and shared by every model.  Training and scoring are
MLlib's distributed estimators; metrics are plain aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators import trees
from patronage.operators.binning import tier_cut
from patronage.session import materialize

BASE_FEATURES = ["TransactionCount", "TotalMonetary", "TotalQuantity", "UniqueProducts",
                 "CustomerLifespan", "AvgTransactionValue", "AvgItemsPerTransaction",
                 "PurchaseFrequency", "Recency"]
DAY_FEATURES = [f"Day_{i}_Purchases" for i in range(7)]
HOUR_FEATURES = [f"Hour_{i}_Purchases" for i in (9, 10, 11, 12, 13, 14, 15)]
ML_FEATURES = BASE_FEATURES + DAY_FEATURES + HOUR_FEATURES
TARGET = "Actual_Future_Spend"


def split_bucket(key: str = "CustomerID") -> F.Column:
    """Deterministic 0..99 bucket from the md5 of the key (same in any engine)."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10) \
        .cast("long") % 100


def train_part(train_pct: int = 80, key: str = "CustomerID") -> F.Column:
    """Whether a customer is in the train split."""
    return split_bucket(key) < train_pct


def ml_dataset(features: DataFrame, train_pct: int = 80) -> DataFrame:
    """J8 + J9: the 23 features, the 90-day target (0 when absent) and a
    deterministic 80/20 split (``is_train``).  The split hashes the customer
    id instead of ``randomSplit``, so it does not depend on partitioning."""
    cols = [F.col(c).cast("double").alias(c) for c in ML_FEATURES]
    return features.select(
        "CustomerID", *cols, F.coalesce(F.col(TARGET), F.lit(0.0)).alias(TARGET),
        train_part(train_pct).alias("is_train"))


def assemble(dataset: DataFrame, features: Sequence[str] = ML_FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features",
                           handleInvalid="keep").transform(dataset)


def model_presets(n_train: int, seed: int = 42) -> dict:
    """J10-J14.  The two extra boosted-tree libraries of the published study
    are re-aimed as MLlib GBT presets (deep/fast and wide)."""
    return {
        "Random Forest": RandomForestRegressor(numTrees=100, maxDepth=30, maxBins=64,
                                               featureSubsetStrategy="all", seed=seed),
        "Gradient Boosting": GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed),
        "GBT deep": GBTRegressor(maxIter=100, maxDepth=6, stepSize=0.3, seed=seed),
        "GBT wide": GBTRegressor(maxIter=100, maxDepth=5, stepSize=0.1, seed=seed),
        "Linear Regression": LinearRegression(regParam=0.0, solver="normal"),
        # scikit-learn's Ridge(alpha) minimises |r|^2 + alpha |w|^2; MLlib
        # minimises |r|^2 / 2n + lambda/2 |w|^2, so lambda = alpha / n.
        "Ridge Regression": LinearRegression(regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                             standardization=False, solver="normal"),
    }


#: Trees of a forest that are grown by one MLlib fit.
PART_TREES = 10


class ForestParts:
    """One random forest out of MLlib forests that were grown side by side: the
    prediction is the mean over all trees, and so are the importances."""

    def __init__(self, parts: Sequence):
        self.parts = list(parts)
        self.weights = [p.getNumTrees for p in self.parts]

    @property
    def getNumTrees(self) -> int:
        return sum(self.weights)

    @property
    def featureImportances(self):
        total = sum(w * p.featureImportances.toArray() for w, p in zip(self.weights, self.parts))
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def transform(self, dataset: DataFrame) -> DataFrame:
        out, names = dataset, [f"_part_{i}" for i in range(len(self.parts))]
        for name, part in zip(names, self.parts):
            out = part.setPredictionCol(name).transform(out)
        total = sum((F.col(n) * F.lit(float(w)) for n, w in zip(names, self.weights)), F.lit(0.0))
        return out.withColumn("prediction", total / F.lit(float(self.getNumTrees))).drop(*names)


def forest_parts(forest: RandomForestRegressor, size: int = PART_TREES) -> list[RandomForestRegressor]:
    """The forest's trees dealt to fits of at most ``size`` trees, each with its own seed.

    Deep trees cost MLlib a dense histogram a node, which one task a partition fills
    and reduces, so a single fit of a small table keeps one core busy."""
    n, seed = forest.getNumTrees(), forest.getSeed()
    return [forest.copy({forest.numTrees: min(size, n - at), forest.seed: seed + at}) for at in range(0, n, size)]


def regression_metrics(pred: DataFrame, label: str = TARGET,
                       prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R^2 = 1 - SSE/SST as one aggregation, of all rows or per group."""
    err = F.col(prediction) - F.col(label)
    # SST = n * var_pop(y): one pass, no second scan for the mean
    return pred.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.lit(1.0) - F.sum(err * err) / (F.var_pop(label) * F.count(label))).alias("r2"))


def train_models(dataset: DataFrame, models: Sequence[str] | None = None, seed: int = 42,
                 parallelism: int = 8):
    """Fit each model on the train split, score the test split.

    Returns (metrics DataFrame sorted by R^2, dict of fitted models)."""
    data = materialize(assemble(dataset).select("CustomerID", "features", TARGET, "is_train"), "ml-data")
    train = data.filter("is_train")
    test = data.filter(~F.col("is_train"))
    n_train = train.count()
    presets = model_presets(n_train, seed)
    chosen = models or list(presets)
    # tasks grow whole trees of as many rows as may be broadcast; more rows are MLlib's
    grown = {n: presets[n] for n in chosen if 0 < n_train <= trees.LOCAL_ROWS and trees.grows(presets[n])}
    fits = []
    for name in (n for n in chosen if n not in grown):
        est = presets[name].setFeaturesCol("features").setLabelCol(TARGET)
        forest = isinstance(est, RandomForestRegressor)
        fits.extend((name, part) for part in (forest_parts(est) if forest else [est]))
    # boosted trees grow one after another: their fits are the longest and go first
    fits.sort(key=lambda f: not isinstance(f[1], GBTRegressor))

    # independent estimators: submit their jobs concurrently (MLlib tuning's
    # ``parallelism`` pattern); results are keyed by name, so order is fixed
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(fits) + 1))) as pool:
        growth = pool.submit(trees.grow_models, train, TARGET, grown) if grown else None
        done = list(pool.map(lambda f: f[1].fit(train), fits))
        fitted = growth.result() if growth else {}
    for name in (n for n in chosen if n not in grown):
        found = [m for (n, _), m in zip(fits, done) if n == name]
        fitted[name] = ForestParts(found) if isinstance(presets[name], RandomForestRegressor) else found[0]
    rows = None
    for name in chosen:
        m = regression_metrics(fitted[name].transform(test)).select(F.lit(name).alias("model"), "*")
        rows = m if rows is None else rows.unionByName(m)
    return rows.orderBy(F.col("r2").desc()), fitted


def feature_importance(model, features: Sequence[str] = ML_FEATURES, top: int = 15):
    """Importances of a tree model as (feature, importance), top 15;
    None for models without importances."""
    if not hasattr(model, "featureImportances"):
        return None
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)


def best_model_importance(spark, metrics: DataFrame, models: dict, top: int = 15) -> DataFrame:
    """(feature, importance, model) of the best model by R^2; no row when that
    model has no importances, as in the published code."""
    best = metrics.orderBy(F.col("r2").desc()).first()["model"]
    found = feature_importance(models[best], top=top)
    if found is None:
        return spark.createDataFrame([], "feature string, importance double, model string")
    return found.withColumn("model", F.lit(best))


def predict_clv(dataset: DataFrame, model=None, prediction_col: str | None = None,
                days: int = 365, duplicates: str = "raise") -> DataFrame:
    """90-day prediction x days / 90 and the 33 %/66 % tier.

    Either a fitted ``model`` or an existing ``prediction_col`` is used."""
    if model is not None:
        scored = model.transform(assemble(dataset)).select("CustomerID", "prediction")
    else:
        scored = dataset.select("CustomerID", F.col(prediction_col).alias("prediction"))
    out = scored.select("CustomerID", F.col("prediction").alias("Predicted_90Day_Spend"),
                        (F.col("prediction") * (F.lit(float(days)) / F.lit(90.0)))
                        .alias("Predicted_CLV_1Year"))
    return tier_cut(out, "Predicted_CLV_1Year", "CLV_Tier_ML", duplicates=duplicates)


def actual_vs_predicted(dataset: DataFrame, predictions: DataFrame) -> DataFrame:
    """Test customers with actual 90-day spend x 4 (as published) and
    the predicted yearly CLV."""
    test = dataset.filter(~F.col("is_train")).select("CustomerID", TARGET)
    return test.join(predictions.select("CustomerID", "Predicted_CLV_1Year"), "CustomerID").select(
        "CustomerID", (F.col(TARGET) * F.lit(4.0)).alias("Actual_Yearly"), "Predicted_CLV_1Year")
