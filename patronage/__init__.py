"""patronage: customer analytics on Spark DataFrames.

Every operator takes and returns a ``pyspark.sql.DataFrame``; the heavy work
(scans, joins, group-bys, ranks, likelihood sums) runs as Spark jobs.
"""

from patronage.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
