"""k-means segmentation on Spark MLlib (J1-J7) and cluster reports.

The clustering input is three log features per customer; it is written once
and shared by every fit of a k sweep.  Starting centres and silhouettes are
MLlib's distributed implementations; one Spark job does an iteration of all fits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import np_round, scalars
from patronage.functions.lookups import cluster_name
from patronage.functions.money import amount, scale_of
from patronage.session import materialize

RFM = ("Recency", "Frequency", "Monetary")
LOG_COLS = ("Recency_log", "Frequency_log", "Monetary_log")


def log_features(customers: DataFrame, cols: Sequence[str] = RFM) -> DataFrame:
    """log1p of Recency, Frequency and Monetary."""
    return customers.withColumns({f"{c}_log": F.log1p(F.col(c).cast("double")) for c in cols})


def standardize(df: DataFrame, cols: Sequence[str] = LOG_COLS, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std, like scikit-learn's StandardScaler.

    MLlib's StandardScaler divides by the sample std; the population moments
    are computed here as scalar subqueries (one small aggregation)."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    values = dict(zip(stats.columns, scalars(stats)))
    out = df
    for c in cols:
        m, s = values[f"m_{c}"], values[f"s_{c}"]
        out = out.withColumn(f"{c}{suffix}", F.when(s > 0, (F.col(c) - m) / s).otherwise(F.lit(0.0)))
    return out


def scaled_vectors(customers: DataFrame) -> DataFrame:
    """CustomerID, Monetary and the standardised log-RFM vector ``features``."""
    z = standardize(log_features(customers))
    cols = [f"{c}_z" for c in LOG_COLS]
    return VectorAssembler(inputCols=cols, outputCol="features").transform(z)


_Z = tuple(f"{c}_z" for c in LOG_COLS)
_STEP = "fit int, cluster int, n long, cost double, " + ", ".join(f"s{i} double" for i in range(len(_Z)))


def _lloyd_sums(shared, block: int = 256):
    """Per fit and cluster: rows and sums of the coordinates of a partition; the squared distances to the nearest
    centres are the fit's, given with its last cluster.  Squared distances less the point's own length are one
    matrix product for all fits."""

    def run(batches):
        fits = shared.value
        sizes = [len(c) for _, c in fits]
        ends = np.cumsum(sizes)
        centres = np.vstack([c for _, c in fits])
        map_to = np.hstack([-2.0 * centres, (centres * centres).sum(axis=1)[:, None]])
        held = np.zeros((len(centres), centres.shape[1] + 2))
        for pdf in batches:
            points = pdf.to_numpy(dtype="float64")
            for i in range(0, len(points), block):
                x = np.hstack([points[i:i + block], np.ones((len(points[i:i + block]), 1))])
                apart = map_to @ x.T
                least = np.minimum.reduceat(apart, ends - sizes, axis=0)
                near = np.empty_like(apart)
                for f, (end, size) in enumerate(zip(ends, sizes)):
                    np.equal(apart[end - size:end], least[f], out=near[end - size:end])
                sums = near @ x
                if sums[:, -1].sum() > len(x) * len(fits):  # equally near centres: the first one
                    for end, size in zip(ends, sizes):
                        part = near[end - size:end]
                        part *= np.cumsum(part, axis=0) == 1
                    sums = near @ x
                held[:, :-1] += sums
                held[ends - 1, -1] += least.sum(axis=1) + (x[:, :-1] ** 2).sum()
        out = pd.DataFrame({"fit": np.repeat(np.array([f for f, _ in fits], dtype="int32"), sizes),
                            "cluster": np.concatenate([np.arange(n, dtype="int32") for n in sizes]),
                            "n": held[:, -2].astype("int64"), "cost": held[:, -1]})
        yield out.assign(**{f"s{i}": held[:, i] for i in range(held.shape[1] - 2)})

    return run


def _fit_all(vectors: DataFrame, starts: Sequence[tuple[int, int]], max_iter: int, tol: float,
             parallelism: int = 8) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """k-means of every (k, seed) of ``starts`` as {(k, seed): (centres, cost)}.

    MLlib's k-means|| finds the starting centres (fits without iterations, submitted
    from a small thread pool).  The iterations are MLlib's too, but one Spark job does
    a step of all fits that still move: a pass over the points gives one row a fit and
    cluster, so jobs and driver traffic do not multiply with the number of fits.
    ``vectors`` is a written table with the coordinates and their vector."""
    from concurrent.futures import ThreadPoolExecutor

    def start(fit):
        k, seed = fit
        model = KMeans(k=k, seed=seed, maxIter=0, featuresCol="features", predictionCol="Cluster").fit(vectors)
        return np.array(model.clusterCenters(), dtype="float64")

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(starts)))) as pool:
        centres = list(pool.map(start, starts))
    costs = [0.0] * len(starts)
    moving = list(range(len(starts)))
    points = vectors.select(*_Z)
    sc = vectors.sparkSession.sparkContext
    for _ in range(max_iter):
        if not moving:
            break
        shared = sc.broadcast([(f, centres[f]) for f in moving])
        sums = points.mapInPandas(_lloyd_sums(shared), _STEP).groupBy("fit", "cluster").agg(
            *[F.sum(c).alias(c) for c in ("n", "cost", *(f"s{i}" for i in range(len(_Z))))])
        rows = sums.collect()
        shared.destroy()
        for f in moving:
            costs[f] = 0.0
        still = set()
        for f, cluster, n, cost, *total in rows:
            costs[f] += cost
            if n:  # an empty cluster keeps its centre
                new = np.array(total) / n
                if ((new - centres[f][cluster]) ** 2).sum() > tol * tol:
                    still.add(f)
                centres[f][cluster] = new
        moving = [f for f in moving if f in still]
    return {fit: (centres[i], costs[i]) for i, fit in enumerate(starts)}


def _fit_best(vectors: DataFrame, ks: Sequence[int], seed: int, n_init: int, max_iter: int,
              tol: float) -> dict[int, tuple[np.ndarray, float]]:
    """Best of ``n_init`` k-means starts (seeds seed, seed+1, ...) for each k as {k: (centres, cost)}:
    the lowest cost, ties to the lower seed."""
    seeds = range(seed, seed + n_init)
    fits = _fit_all(vectors, [(k, s) for k in ks for s in seeds], max_iter, tol)
    return {k: fits[k, min(seeds, key=lambda s: (fits[k, s][1], s))] for k in ks}


def _labelled(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` with the Cluster of the nearest centre."""
    rows = [(i, *map(float, c)) for i, c in enumerate(centres)]
    schema = "cluster int, " + ", ".join(f"c{i} double" for i in range(centres.shape[1]))
    return assign_nearest(vectors, vectors.sparkSession.createDataFrame(rows, schema), _Z)


def kmeans_sweep(customers: DataFrame, ks: Sequence[int] = range(2, 11), seed: int = 42,
                 n_init: int = 10, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """Within-cluster sum of squares and silhouette for each k (best of
    ``n_init`` starts).  Silhouette is MLlib's squared-Euclidean silhouette."""
    vectors = materialize(scaled_vectors(customers).select("CustomerID", *_Z, "features"), "vectors")
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="Cluster")
    from concurrent.futures import ThreadPoolExecutor
    best = _fit_best(vectors, list(ks), seed, n_init, max_iter, tol)

    def one(k):
        centres, cost = best[k]
        return int(k), float(cost), float(evaluator.evaluate(_labelled(vectors, centres)))

    with ThreadPoolExecutor(max_workers=3) as pool:
        rows = list(pool.map(one, ks))
    return customers.sparkSession.createDataFrame(rows, "k int, wcss double, silhouette double")


def best_k(sweep: DataFrame) -> DataFrame:
    """K with the highest silhouette."""
    return sweep.agg(F.max_by("k", "silhouette").alias("k"))


def kmeans_segments(customers: DataFrame, k: int = 4, seed: int = 42, n_init: int = 10,
                    max_iter: int = 300, tol: float = 1e-4, keep_features: bool = False) -> DataFrame:
    """J3 + J5: fit (best of ``n_init`` starts), predict, renumber clusters by
    mean Monetary (descending, so ids are stable across runs) and name them."""
    vectors = materialize(scaled_vectors(customers), "vectors")
    centres, _ = _fit_best(vectors, [k], seed, n_init, max_iter, tol)[k]
    pred = _labelled(vectors, centres)
    order = pred.groupBy("Cluster").agg(F.avg("Monetary").alias("_m"))
    # rank clusters by mean spend: at most k rows, a window over k rows is fine
    from pyspark.sql import Window
    order = order.select("Cluster", (F.row_number().over(
        Window.orderBy(F.col("_m").desc(), F.col("Cluster"))) - 1).alias("_new"))
    out = pred.join(F.broadcast(order), "Cluster").withColumn("Cluster", F.col("_new").cast("int"))
    named = out.withColumn("Cluster_Name", cluster_name(F.col("Cluster"))).drop("_new")
    return named if keep_features else named.drop("features")


def silhouette(labelled: DataFrame, label: str = "Cluster") -> DataFrame:
    """Squared-Euclidean silhouette of a labelling of the scaled features."""
    if "features" not in labelled.columns:
        labelled = scaled_vectors(labelled)
    score = ClusteringEvaluator(featuresCol="features", predictionCol=label).evaluate(labelled)
    return labelled.sparkSession.createDataFrame([(float(score),)], "silhouette double")


#: Most rows that :func:`euclidean_silhouette` compares with each other.
SILHOUETTE_ROWS = 10_000
_BLOCK = 256


def euclidean_silhouette(labelled: DataFrame, cols: Sequence[str] = tuple(f"{c}_z" for c in LOG_COLS), label: str = "Cluster",
                         id_col: str = "CustomerID", max_rows: int = SILHOUETTE_ROWS) -> DataFrame:
    """J4 with plain Euclidean distances: (rows, clusters, silhouette), one row.

    The measure needs the distance of every pair, so it is taken over the rows
    with the smallest md5 of their id, ``max_rows`` at most (all of them in a
    smaller table).  Those are broadcast (eight bytes a value, so bounded), and
    every task compares its rows with them in blocks.  A row that is alone in its
    cluster scores 0, as does one whose distances are all 0.  Rows with a NULL
    label or coordinate are left out; with fewer than two clusters the silhouette
    is NULL."""
    spark = labelled.sparkSession
    points = labelled.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"),
                             *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    points = points.dropna(subset=points.columns[1:]).withColumn("h", F.md5(F.col("id").cast("string")))
    # ties of the hash are repeated ids: their rows are ordered by what they hold
    sample = materialize(points.orderBy("h", *points.columns[1:-1]).limit(max_rows).drop("h", "id"), "silhouette")
    held = sample.toArrow().to_pandas()
    names, codes = np.unique(held["label"].to_numpy(dtype=str), return_inverse=True)
    if len(names) < 2:
        return spark.createDataFrame([(len(held), len(names), None)], "rows long, clusters long, silhouette double")
    at = held.drop(columns="label").to_numpy(dtype="float64")
    shared = spark.sparkContext.broadcast((at, codes, names))

    def score(batches):
        at, codes, names = shared.value
        sizes = np.bincount(codes, minlength=len(names))
        member = np.eye(len(names))[codes]
        for pdf in batches:
            own_code = np.searchsorted(names, pdf.pop("label").to_numpy(dtype=str))
            x = pdf.to_numpy(dtype="float64")
            for i in range(0, len(x), _BLOCK):
                block, own = x[i:i + _BLOCK], own_code[i:i + _BLOCK]
                square = np.zeros((len(block), len(at)))
                for j in range(at.shape[1]):
                    square += (block[:, j, None] - at[None, :, j]) ** 2
                total = np.sqrt(square) @ member
                here = np.arange(len(block))
                mean = total / sizes
                near = total[here, own] / np.maximum(sizes[own] - 1, 1)
                mean[here, own] = np.inf
                other = mean.min(axis=1)
                most = np.maximum(near, other)
                s = np.where((sizes[own] > 1) & (most > 0), (other - near) / np.where(most > 0, most, 1.0), 0.0)
                yield pd.DataFrame({"s": s})

    return sample.mapInPandas(score, "s double").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(names)).cast("long").alias("clusters"), F.avg("s").alias("silhouette"))


def centres_by(df: DataFrame, group: Column, cols: Sequence[str]) -> DataFrame:
    """Mean of ``cols`` per group as (cluster, c0, c1, ...)."""
    return df.groupBy(group.cast("int").alias("cluster")).agg(
        *[F.avg(c).alias(f"c{i}") for i, c in enumerate(cols)])


def assign_nearest(df: DataFrame, centres: DataFrame, cols: Sequence[str],
                   out: str = "Cluster") -> DataFrame:
    """Nearest centre (squared Euclidean; ties to the lower id).

    The centres (k rows) travel as ONE array value of a scalar subquery, so
    the assignment is a per-row expression: no join, no shuffle."""
    packed = centres.agg(F.collect_list(F.struct(
        "cluster", *[F.col(f"c{i}") for i in range(len(cols))])).alias("cs")).scalar()

    def dist(c: Column) -> Column:
        total = None
        for i, name in enumerate(cols):
            d = F.col(name) - c[f"c{i}"]
            total = d * d if total is None else total + d * d
        return F.struct(total.alias("d"), c["cluster"].alias("cluster"))

    # the subquery is bound to a column first: higher-order functions may not
    # contain subqueries themselves
    staged = df.withColumn("_centres", packed)
    return staged.withColumn(out, F.array_min(F.transform(F.col("_centres"), dist))["cluster"]
                             .cast("int")).drop("_centres")


def rfm_quartile_clusters(customers: DataFrame) -> DataFrame:
    """J6 on data-derived centres: one Lloyd step from the R-score quartiles.

    Centres = mean standardised log-RFM per Recency quartile (cluster =
    R_Score - 1); each customer is assigned to its nearest centre.  Fully
    deterministic, so the assignment is checkable in SQL."""
    from patronage.operators.binning import qcut
    z = standardize(log_features(customers))
    z = qcut(z, "Recency", 4, [4, 3, 2, 1], "R_Score", method="percentile")
    cols = [f"{c}_z" for c in LOG_COLS]
    cent = centres_by(z, F.col("R_Score") - 1, cols)
    return assign_nearest(z, cent, cols).withColumn("Cluster_Name", cluster_name(F.col("Cluster")))


def cluster_profile(clustered: DataFrame, decimals: int | None = 2) -> DataFrame:
    """Size, mean R/F/M/TotalQuantity/UniqueProducts, % customers,
    revenue and % revenue per cluster, sorted by mean Monetary."""
    rnd = (lambda c: np_round(c, decimals)) if decimals is not None else (lambda c: c)
    scale = scale_of(clustered, "monetary_cents")
    n_all, rev_all = scalars(clustered.agg(F.count(F.lit(1)).alias("n"),
                                           F.sum("monetary_cents").alias("rev")))
    per = clustered.groupBy("Cluster").agg(
        F.count(F.lit(1)).alias("CustomerID"),
        *[rnd(F.avg(F.col(c).cast("double"))).alias(c) for c in ("Recency", "Frequency")],
        rnd(amount(F.sum("monetary_cents"), scale) / F.count(F.lit(1)).cast("double")).alias("Monetary"),
        *[rnd(F.avg(F.col(c).cast("double"))).alias(c) for c in ("TotalQuantity", "UniqueProducts")],
        F.sum("monetary_cents").alias("_rev"))
    return per.select(
        "Cluster", F.col("CustomerID").cast("long").alias("CustomerID"), "Recency", "Frequency",
        "Monetary", "TotalQuantity", "UniqueProducts",
        np_round(F.col("CustomerID").cast("double") / n_all.cast("double") * 100.0, 1)
        .alias("pct_customers"),
        amount(F.col("_rev"), scale).alias("Total_Revenue"),
        np_round(F.col("_rev").cast("double") / rev_all.cast("double") * 100.0, 1)
        .alias("pct_revenue")).orderBy(F.col("Monetary").desc())


def normalized_profile(profile: DataFrame, cols: Sequence[str] = RFM) -> DataFrame:
    """Min-max normalised cluster means (NULL where max = min)."""
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(1))   # k rows only
    out = profile.select("Cluster", *cols)
    for c in cols:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        out = out.withColumn(f"{c}_norm", F.when(hi > lo, (F.col(c) - lo) / (hi - lo)))
    return out.select("Cluster", *[f"{c}_norm" for c in cols])


def named_summary(clustered: DataFrame) -> DataFrame:
    """Count, mean Recency and mean Monetary per cluster name."""
    return clustered.groupBy("Cluster", "Cluster_Name").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(F.col("Recency").cast("double")).alias("recency_mean"),
        (amount(F.sum("monetary_cents"), scale_of(clustered, "monetary_cents")) / F.count(F.lit(1)).cast("double"))
        .alias("monetary_mean"))
