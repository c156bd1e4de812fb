"""Helpers that exist for cluster scale: sizing, materialisation, k-means pieces."""

from pyspark.sql import functions as F

from patronage.operators.clustering import assign_nearest, centres_by
from patronage.session import cluster_conf, materialize


def test_cluster_conf_bounds():
    big = cluster_conf(100e12, 8000)
    assert 24000 <= int(big["spark.sql.shuffle.partitions"]) <= 200_000
    small = cluster_conf(1e9, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_materialize_writes_under_checkpoint_dir(spark):
    df = materialize(spark.range(10).withColumn("x", F.col("id") * 2), "test")
    paths = df.inputFiles()
    ckpt = spark.sparkContext.getCheckpointDir().replace("file:", "")
    assert paths and all(ckpt.rstrip("/") in p for p in paths)
    assert df.agg(F.sum("x")).first()[0] == 90


def test_assign_nearest_ties_to_lower_id(spark):
    pts = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 0.5), (4, 9.0)], "id long, v double")
    cents = spark.createDataFrame([(1, 1.0), (0, 0.0), (2, 10.0)], "cluster int, c0 double")
    got = {r["id"]: r["Cluster"] for r in assign_nearest(pts, cents, ["v"]).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 2}


def test_centres_by_group_means(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "g int, v double")
    got = {r["cluster"]: r["c0"] for r in centres_by(df, F.col("g"), ["v"]).collect()}
    assert got == {0: 2.0, 1: 5.0}
