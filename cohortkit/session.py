"""Spark session set-up shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on for correct results (not for speed).
REQUIRED_CONF = {
    # Wall-clock semantics: timestamps are NTZ and compared with an engine that has no zones.
    "spark.sql.session.timeZone": "UTC",
    # Duplicate JSON keys: last one wins, as in Python's decoder.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Defaults for scale; a cluster's own settings win (only set when absent).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only small sides; the fixed-size dimensions are hinted explicitly.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "cohortkit", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. ``master`` is only applied when creating a local session."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("COHORTKIT_DRIVER_MEMORY", _local_heap()))
        # checkpoint files of collected DataFrames are removed, so scratch space does not grow
        builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        if shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def _local_heap() -> str:
    """Driver heap for a local session: 60 % of physical memory, at most 16 GB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"


def configure(spark: SparkSession) -> SparkSession:
    """Apply required settings and fill scale defaults that the cluster left unset."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    for k, v in DEFAULT_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator to a shared file system and is used as is. Only
    when it is unset (local tests) a private scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="cohortkit-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def run_folder(spark: SparkSession) -> str:
    """This application's own folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/run-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the run's folder, for written intermediate tables."""
    import uuid

    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete the tables that this run wrote to the shared folder. To be called when its results have been
    stored elsewhere: DataFrames built before may read them."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, of=None):
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder
    named by ``spark.checkpoint.dir``.

    Used where one intermediate feeds several branches of a plan (which would otherwise each
    recompute it from the scans) and it is much smaller than its inputs. Survives executor loss:
    the data is in the shared folder, not on an executor.

    ``of`` names the frame that ``df`` only projects or filters: if that is materialized itself,
    reading it again costs no more than reading a copy, so none is made.
    """
    if of is not None and getattr(of, _STORED, False):
        out = df
    else:
        checkpoint_dir(df.sparkSession)
        out = df.checkpoint(eager=True)
    setattr(out, _STORED, True)
    return out


_STORED = "_cohortkit_stored"
