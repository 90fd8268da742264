"""Session settings and the one way intermediate results are written down.

Joins on a table or question id are plain joins: where one id holds a large share of the rows, adaptive execution splits its
partition by measured size and repeats the small side for the splits alone. Nothing is salted or placed by hand, which would
turn that off.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Runtime SQL settings the plans are laid out for. They change speed, never results.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # sizes on disk are compressed, so the static limit is low; measured sizes decide the rest
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.session.timeZone": "UTC",
    # hash joins where every partition of the build side is measured to be small, sorts elsewhere
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # token and cluster work is heavy for its bytes: keep tasks apart that are small on disk
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # a task holds the rows of its partition sorted or hashed, some thirty times their bytes on disk: partitions are not put
    # together beyond this
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # an Arrow batch is held whole by a Python worker, so its rows and its bytes are both limited
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # a hot key is split between tasks even where that costs another shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it; local sessions get one of their own."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="tablesieve-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read on from there.

    Used where a result feeds several later passes: it is computed once, later passes see
    the same values even after an executor is lost, and the lineage ends there. Columns and
    filters of the later passes reach the table's scan, and its size on disk is what decides
    whether a join may broadcast it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
