"""cohortkit: generate, validate and compare receipt and page cohorts with Spark DataFrames.

Every operator takes and returns DataFrames (or Columns) and is built from native Spark
expressions, so Catalyst can prune, push down and fuse the whole plan.
"""

from cohortkit.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
