"""Dataset files (S7, S8, S11): JSON Lines sink with a timestamped name, newest-dataset source.

Every path is under the shared folder named by ``spark.checkpoint.dir`` unless the caller
passes one; nothing is written to a machine-local folder on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET_PREFIX = "page_samples_"


def write_dataset(df: DataFrame, base: str, stamp: str, prefix: str = DATASET_PREFIX) -> str:
    """Write ``df`` as UTF-8 JSON Lines to ``{base}/{prefix}{stamp}``.

    ``stamp`` is ``yyyyMMdd_HHmmss`` of the caller's clock; an existing folder is an error.
    """
    path = f"{base.rstrip('/')}/{prefix}{stamp}"
    df.write.mode("errorifexists").json(path)
    return path


def latest_dataset(spark: SparkSession, base: str, schema: str | None = None, prefix: str = DATASET_PREFIX) -> DataFrame:
    """Read the newest ``{prefix}*`` folder under ``base``.

    Newest by file modification time, ties by name; raises when there is none. The listing
    is a distributed scan of file metadata (content is not read).
    """
    from pyspark.errors import AnalysisException

    try:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.json")
                 .load(f"{base.rstrip('/')}/{prefix}*")
                 .select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), "modificationTime"))
        newest = files.groupBy("folder").agg(F.max("modificationTime").alias("mtime")) \
            .agg(F.max_by("folder", F.struct("mtime", "folder")).alias("folder")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            newest = None
        else:
            raise
    if newest is None or newest["folder"] is None:
        raise FileNotFoundError(f"no {prefix}* dataset under {base}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(newest["folder"])
