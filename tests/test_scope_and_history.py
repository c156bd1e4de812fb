"""Intermediate tables end with their scope; run history counts finished runs once; one fact scan a customer table."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from patronage.operators.outputs import metric_trends
from patronage.session import materialize, new_folder, scope
from patronage.sources import append_run, read_runs

SF = "/root/testdata/sf0.001"


def folders(spark):
    base = spark.sparkContext.getCheckpointDir().replace("file:", "")
    return {f for f in os.listdir(base) if f.startswith("patronage-")}


def test_scope_deletes_what_it_does_not_keep(spark):
    before = folders(spark)
    with scope(spark) as outer:
        with scope(spark) as keep:
            a = materialize(spark.range(5), "a")
            b = keep(materialize(a.withColumn("x", F.lit(1)), "b"))
        assert len(folders(spark) - before) == 1
        assert b.count() == 5
        new_folder(spark, "never-written")
        assert outer(b) is b
    assert len(folders(spark) - before) == 1 and b.count() == 5


def test_scope_cleans_up_after_errors(spark):
    before = folders(spark)
    with pytest.raises(RuntimeError), scope(spark):
        materialize(spark.range(5), "a")
        raise RuntimeError
    assert folders(spark) == before


@pytest.mark.parametrize("key", ["E1_customer_rfm", "E18_customer_features", "G12_customer_master", "D1_clusters_with_segments"])
def test_a_query_leaves_no_folder(spark, key):
    import __spark_entry__ as E
    before = folders(spark)
    with scope(spark):
        assert E.queries()[key](spark, SF).count() > 0
    assert folders(spark) == before


@pytest.mark.parametrize("key,hubs", [("E1_customer_rfm", 0), ("G12_customer_master", 2), ("D1_clusters_with_segments", 1)])
def test_the_facts_are_joined_once_and_each_hub_is_written_once(spark, key, hubs):
    import __spark_entry__ as E
    before = folders(spark)
    df = E.queries()[key](spark, SF)
    made = [f.split("-")[1] for f in folders(spark) - before]
    assert made.count("customer") == 1 and made.count("hub") == hubs
    plan = df._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "Expand" not in plan


def test_customer_tables_have_no_expand(spark, edge_log):
    from patronage.operators.cleaning import clean_lines
    from patronage.operators.customers import customer_features, customer_rfm
    for table in (customer_rfm(clean_lines(edge_log)), customer_features(clean_lines(edge_log))):
        table.collect()
        plan = table._jdf.queryExecution().toString()
        assert "Expand" not in plan


def test_run_history(spark):
    path = tempfile.mkdtemp(prefix="patronage-runs-") + "/history"
    assert read_runs(spark, path).count() == 0 and metric_trends(read_runs(spark, path)).count() == 0

    def run(value):
        return spark.createDataFrame([("m", value, 2.0 * value, 0.5)], "model string, MAE double, RMSE double, R2 double")
    append_run(run(1.0), path, "a")
    append_run(run(3.0), path, "b")
    append_run(run(5.0), path, "b")  # retried: the last attempt counts
    # a run that died between its rows and its entry
    half = run(100.0).select(F.current_timestamp().alias("ts"), "model", F.col("MAE").alias("mae"), F.col("RMSE").alias("rmse"),
                             F.col("R2").alias("r2"), F.lit("c").alias("run_id"), F.lit("x").alias("attempt"))
    half.write.mode("append").parquet(f"{path}/rows")
    got = {r["run_id"]: r["mae"] for r in read_runs(spark, path).collect()}
    assert got == {"a": 1.0, "b": 5.0}
    row = metric_trends(read_runs(spark, path)).first()
    assert row["mae_mean"] == 3.0 and row["mae_std"] == round(8 ** 0.5, 4) and row["r2_std"] == 0.0
