"""Registry of the named queries (one per operator of the inventory).

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame built from the
test tables under ``sf_dir``; ``oracle`` holds the DuckDB twin where the
operator is expressible in SQL.
"""

from __future__ import annotations

import contextvars
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.plans import oracle_sql as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            token = _SHARED.set({})
            try:
                return fn(spark, sf_dir)
            finally:
                _SHARED.reset(token)
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return run
    return deco


# ----------------------------------------------------------------------- shared inputs

#: Tables that the query being built has made; none outlive its building.
_SHARED: contextvars.ContextVar = contextvars.ContextVar("patronage-shared", default=None)


def shared(name: str, sf_dir: str, build: Callable[[], object]):
    """What ``build`` makes, once within one query."""
    made = _SHARED.get()
    if made is None:
        return build()
    if (name, sf_dir) not in made:
        made[name, sf_dir] = build()
    return made[name, sf_dir]


def data_version(spark: SparkSession, sf_dir: str) -> tuple:
    """Application, folder and the sizes and times of its files: what fits and sweeps, which
    several queries use, are kept under, so that a rewritten table is fitted anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = [fs.getFileStatus(f.getPath()) for f in fs.listStatus(path) if f.getPath().getName().split(".")[0] in (
        "lineitem", "orders", "customer", "nation")]
    files = [f for t in tables for f in (fs.listStatus(t.getPath()) if t.isDirectory() else [t])]
    return (spark.sparkContext.applicationId, sf_dir,
            tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage into ``spark.checkpoint.dir`` (survives executor loss)."""
    from patronage.session import materialize as _m
    return _m(df, "hub")


def log(spark: SparkSession, sf_dir: str, with_description: bool = False) -> DataFrame:
    from patronage.sources import load_log
    return load_log(spark, sf_dir, with_description)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patronage.operators.cleaning import clean_lines
    return clean_lines(log(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean lines' columns that customer tables are made of: the fact join of a query, written once."""
    from patronage.operators.customers import customer_lines
    return shared("lines", sf_dir, lambda: customer_lines(clean(spark, sf_dir)))


def snapshot(spark: SparkSession, sf_dir: str):
    """The snapshot date (max clean InvoiceDate + 1 day) as a literal column.

    One scalar, like the published global, so later plans use a constant and
    time windows are plain predicates; read from the written lines."""
    from patronage.operators.cleaning import snapshot_date

    def find():
        return snapshot_date(lines(spark, sf_dir)).select(F.unix_micros("snapshot").alias("us")).first()["us"]
    return F.timestamp_micros(F.lit(shared("snapshot", sf_dir, find)))


def customers(spark: SparkSession, sf_dir: str, hub: bool = True) -> DataFrame:
    """The customer hub table.  With ``hub=True`` it is materialised once per
    query, so every rank, quantile and report downstream re-reads it instead
    of re-running the group-bys; a query that only returns the table itself
    uses ``hub=False`` (no write)."""
    from patronage.operators.customers import customer_rfm

    def build():
        return customer_rfm(lines(spark, sf_dir), snapshot(spark, sf_dir), written=True)
    return shared("customers", sf_dir, lambda: materialize(build())) if hub else build()


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patronage.operators.segments import rfm_segments
    return shared("segmented", sf_dir, lambda: rfm_segments(customers(spark, sf_dir)))


def ts_out(col: str):
    """Timestamps leave the engine as TIMESTAMP_NTZ (UTC wall clock)."""
    return F.col(col).cast("timestamp_ntz").alias(col)


# import the query modules so they register themselves
from patronage.plans import q_core, q_profile  # noqa: E402,F401


def features(spark: SparkSession, sf_dir: str, hub: bool = True) -> DataFrame:
    from patronage.operators.customers import customer_features

    def build():
        return customer_features(lines(spark, sf_dir), snapshot(spark, sf_dir), written=True)
    return shared("features", sf_dir, lambda: materialize(build())) if hub else build()


def historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patronage.operators.clv_historical import historical_clv
    return historical_clv(features(spark, sf_dir))


def standin_scores(spark: SparkSession, sf_dir: str, tiers: bool = True):
    """Deterministic stand-ins for the model-based CLVs (oracle checks of the
    comparison / ensemble arithmetic; the real models are in q_ml / q_prob).
    ``tiers=False`` skips the per-method tier cuts (their quantile passes)
    when only the values are needed."""
    from patronage.operators.binning import qcut, tier_cut
    from patronage.operators.clv_historical import historical_clv
    feat = features(spark, sf_dir)
    hist = historical_clv(feat, tier=tiers)
    ml = feat.filter(F.col("CustomerID") % 10 != 0).select(
        "CustomerID", (F.col("TotalMonetary") * F.lit(0.5)
                       + F.col("Actual_Future_Spend") * (F.lit(365.0) / F.lit(90.0))).alias("CLV_ML"))
    prob = hist.filter(F.col("TransactionCount") > 1).select(
        "CustomerID", (F.col("CLV_DailyAvg") * F.lit(0.5)).alias("CLV_Probabilistic"))
    if tiers:
        ml = tier_cut(ml, "CLV_ML", "CLV_Tier_ML")
        prob = qcut(prob, "CLV_Probabilistic", 3, ["Low", "Medium", "High"], "CLV_Tier_Prob")
    return feat, hist, ml, prob


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patronage.operators.ensemble import assemble_clv
    feat, hist, ml, prob = standin_scores(spark, sf_dir)
    return assemble_clv(feat, hist, ml, prob)


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patronage.operators.ensemble import assemble_clv, ensemble_clv
    feat, hist, ml, prob = standin_scores(spark, sf_dir, tiers=False)
    return ensemble_clv(assemble_clv(feat, hist, ml, prob), feat)


from patronage.plans import q_clv  # noqa: E402,F401


def lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patronage.operators.clv_prob import lifetimes_summary
    return lifetimes_summary(lines(spark, sf_dir), snapshot(spark, sf_dir))


_PROB: dict = {}


def prob_fits(spark: SparkSession, sf_dir: str):
    """Summary (materialised) and the fitted BG/NBD and Gamma-Gamma
    parameters; the 7 numbers are kept for the session and version of the data."""
    from patronage.operators.clv_prob import bgnbd_fit, gamma_gamma_fit
    key = data_version(spark, sf_dir)
    summary = shared("summary", sf_dir, lambda: materialize(lifetimes(spark, sf_dir)))
    if key not in _PROB:
        _PROB[key] = (bgnbd_fit(summary), gamma_gamma_fit(summary))
    return (summary, *_PROB[key])


def prob_model(spark: SparkSession, sf_dir: str):
    """Summary, fits and the scored customers (materialised: the Arrow UDFs
    run once)."""
    from patronage.operators.clv_prob import probabilistic_clv
    summary, bg, gg = prob_fits(spark, sf_dir)
    scored = shared("scored", sf_dir, lambda: materialize(probabilistic_clv(summary, bg, gg)))
    return summary, bg, gg, scored


from patronage.plans import q_prob  # noqa: E402,F401


def quartile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patronage.operators.clustering import rfm_quartile_clusters
    return shared("quartile_clusters", sf_dir, lambda: rfm_quartile_clusters(customers(spark, sf_dir)))


def clusters_with_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means style clusters left-joined with the RFM segments."""
    cl = quartile_clusters(spark, sf_dir).select(
        "CustomerID", "Recency", "Frequency", "Monetary", "Cluster", "Cluster_Name")
    seg = segmented(spark, sf_dir).select("CustomerID", "Segment", "RFM_Sum")
    return cl.join(seg, "CustomerID", "left")


from patronage.plans import q_cluster  # noqa: E402,F401


def ml_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patronage.operators.clv_ml import ml_dataset
    return ml_dataset(features(spark, sf_dir))


from patronage.plans import q_ml  # noqa: E402,F401
from patronage.plans import q_extra, q_sources  # noqa: E402,F401
