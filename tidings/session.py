"""Session settings shared by every job.

Nothing here creates a cluster; on a cluster the session comes from the
launcher and only the SQL settings below are applied at runtime.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings every job relies on (all are session-scoped SQL confs).
RUNTIME_CONF = {
    # DATE(ts) and hour truncation mean UTC days/hours.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small shuffles, split skewed join
    # partitions, turn sort-merge joins into broadcast joins when the
    # measured build side is small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Partition-level merges overwrite only the partitions they touch.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A repeated name in a JSON object is legal; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def ensure_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library depends on; idempotent."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidings") -> SparkSession:
    """Session for tests and the local bench (a cluster brings its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDINGS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_session(spark)


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster).  Only when it
    is unset and Spark runs in this process (tests) a scratch folder is
    created; on a cluster that is an error, since executors could not see it.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        # setCheckpointDir appends a per-application folder; use its parent.
        return current.rstrip("/").rsplit("/", 1)[0]
    if not re.match(r"local($|\[)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tidings-ckpt-")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique table path inside the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
