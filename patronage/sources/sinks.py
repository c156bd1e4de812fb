"""Sinks (A4, A5): marketing outputs and the model-metric history."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("mae", T.DoubleType(), True),
    T.StructField("rmse", T.DoubleType(), True),
    T.StructField("r2", T.DoubleType(), True),
])


def write_marketing_outputs(outputs: dict[str, DataFrame], path: str,
                            partition_col: str | None = "CLV_Tier",
                            mode: str = "overwrite") -> None:
    """A4 sink: one Parquet dataset per output; partitioned by tier when present."""
    for name, df in outputs.items():
        writer = df.write.mode(mode)
        if partition_col and partition_col in df.columns:
            writer = writer.partitionBy(partition_col)
        writer.parquet(f"{path}/{name}")


def append_metrics(metrics: DataFrame, path: str) -> None:
    """A5: append evaluation rows {ts, model, mae, rmse, r2} to the history.

    Keys are lower case everywhere (the training report used MAE/RMSE/R2).
    Append mode writes new files only, so concurrent writers never clobber
    earlier history.
    """
    cols = {c.lower(): c for c in metrics.columns}
    ts = F.col(cols["ts"]) if "ts" in cols else F.current_timestamp()
    out = metrics.select(
        ts.cast("timestamp").alias("ts"),
        F.col(cols["model"]).cast("string").alias("model"),
        F.col(cols["mae"]).cast("double").alias("mae"),
        F.col(cols["rmse"]).cast("double").alias("rmse"),
        F.col(cols["r2"]).cast("double").alias("r2"),
    )
    out.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).parquet(path)


RUN_SCHEMA = T.StructType([*METRIC_SCHEMA.fields, T.StructField("run_id", T.StringType()), T.StructField("attempt", T.StringType())])
_DONE_SCHEMA = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("attempt", T.StringType()),
                             T.StructField("done", T.TimestampType())])


def append_run(metrics: DataFrame, path: str, run_id: str) -> None:
    """A5, once per run: the rows of an evaluation run {model, mae, rmse, r2 and ts if given}.

    The rows are appended under a fresh attempt, and only then the attempt is entered as done; appends add files
    and change none, so writers need no lock.  A run that is appended again (a retried job) counts once,
    with its last attempt; one that died before it was done does not count."""
    attempt = uuid.uuid4().hex
    cols = {c.lower(): c for c in metrics.columns}
    ts = F.col(cols["ts"]) if "ts" in cols else F.current_timestamp()
    rows = metrics.select(ts.cast("timestamp").alias("ts"), F.col(cols["model"]).cast("string").alias("model"),
                          *[F.col(cols[c]).cast("double").alias(c) for c in ("mae", "rmse", "r2")],
                          F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"))
    rows.write.mode("append").parquet(f"{path}/rows")
    done = metrics.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"),
                                                F.current_timestamp().alias("done"))
    done.write.mode("append").parquet(f"{path}/done")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every run that is done, each of its last attempt; no rows before the first run."""
    def table(name: str, schema: T.StructType) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    last = table("done", _DONE_SCHEMA).groupBy("run_id").agg(F.max_by("attempt", F.struct("done", "attempt")).alias("attempt"))
    return table("rows", RUN_SCHEMA).join(last, ["run_id", "attempt"]).select(
        "run_id", "ts", "model", "mae", "rmse", "r2")


def metrics_row(spark: SparkSession, model: str, mae: float, rmse: float, r2: float,
                ts: _dt.datetime | None = None) -> DataFrame:
    ts = ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame([(ts, model, float(mae), float(rmse), float(r2))],
                                 METRIC_SCHEMA)
