"""Session helpers.

The library never changes cluster-level settings behind the caller's back, with
two exceptions that results depend on: the session time zone is pinned to UTC
(timestamps in the log are wall-clock UTC) and a checkpoint directory must be
known before the distributed rank is used.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "patronage",
                  shuffle_partitions: int | None = None,
                  conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``patronage`` importable in the Python workers.

    The Arrow UDFs and ``mapInPandas`` functions live in this package; a
    deployment normally ships it with ``--py-files``.  When the workers
    cannot see it yet, the package is zipped once and added with
    ``addPyFile`` (Spark distributes it to every executor)."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="patronage-pyfiles-")
    archive = shutil.make_archive(os.path.join(staging, "patronage"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="patronage")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def pin_utc(spark: SparkSession) -> None:
    """Timestamps are interpreted as UTC wall clock throughout."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, honouring ``spark.checkpoint.dir``.

    On a cluster the shared folder named in ``spark.checkpoint.dir`` is used.
    Only a local-mode session (tests, laptop) without that setting gets a fresh
    folder under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) before running ranking operators on a cluster")
        configured = tempfile.mkdtemp(prefix="patronage-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCOPES: contextvars.ContextVar = contextvars.ContextVar("patronage-folders", default=())


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint directory.  It is deleted when the driver's JVM
    ends, or earlier by the :func:`scope` that it was asked for in."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/patronage-{name}-{uuid.uuid4().hex}"
    for folders in _SCOPES.get()[-1:]:
        folders.append(path)
    return path


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    fs, jpath = _filesystem(spark, path)
    fs.deleteOnExit(jpath)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Delete the intermediate tables made inside when the block ends::

        with scope(spark) as keep:
            result = keep(materialize(query(spark, path)))

    Nothing that still reads them may be used afterwards, but for the tables
    passed to ``keep`` (results of :func:`materialize`), which the surrounding
    scope takes over."""
    folders: list[str] = []
    kept: list[str] = []

    def keep(df):
        files = df.inputFiles()
        kept.extend(p for p in folders if any(os.path.basename(p) in f for f in files))
        return df

    token = _SCOPES.set((*_SCOPES.get(), folders))
    try:
        yield keep
    finally:
        _SCOPES.reset(token)
        for outer in _SCOPES.get()[-1:]:
            outer.extend(kept)
        for path in folders:
            if path not in kept:
                fs, jpath = _filesystem(spark, path)
                fs.delete(jpath, True)


def materialize(df, name: str = "stage", partition_by: str | None = None):
    """Cut lineage: write ``df`` as Parquet under the checkpoint directory and
    read it back.

    One job (a reliable RDD checkpoint computes its input twice unless it is
    also cached), columnar storage, and the re-read supports column pruning
    and filter pushdown.  The folder is the shared ``spark.checkpoint.dir``
    on a cluster, so the result survives the loss of any executor; it goes when
    the application ends, or with its :func:`scope`.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _delete_at_exit(spark, path)
    # a partition column is inferred and an empty partitioned table has no file: the schema is given
    return (spark.read.schema(df.schema) if partition_by else spark.read).parquet(path)


def cluster_conf(input_bytes: float, total_cores: int, shuffle_fraction: float = 0.25,
                 target_partition_bytes: int = 256 * 1024 * 1024,
                 max_shuffle_partitions: int = 200_000) -> dict[str, str]:
    """Sizing for a large cluster (pass to ``build_session(conf=...)``).

    * scan splits of ~256 MB (``maxPartitionBytes``) keep a task's input in
      memory with room for the join / aggregation buffers;
    * the initial shuffle partition count targets ~256 MB per partition of
      the largest shuffle, estimated as ``shuffle_fraction`` of the input (the
      fact join ships projected columns; the customer aggregate ships partial
      aggregates), at least 3 waves over the cores and at most
      ``max_shuffle_partitions`` (map-status size grows with maps x reducers);
      AQE then coalesces small partitions and splits skewed ones;
    * generous task / stage retries, so lost executors cost re-runs of their
      tasks only.
    """
    wanted = int(input_bytes * shuffle_fraction / target_partition_bytes)
    shuffle = min(max(wanted, 3 * total_cores, 200), max_shuffle_partitions)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.task.maxFailures": "8",
        "spark.stage.maxConsecutiveAttempts": "8",
    }
