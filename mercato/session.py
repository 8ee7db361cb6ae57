"""Session helpers.

The library never changes session settings behind the caller's back; these helpers are for
entry points (bench, tests, examples) that own the session.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "mercato") -> SparkSession:
    """A session with the settings the plans are tuned for (AQE on, UI off)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a hot join key even when that costs an extra shuffle after the join
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # remove reliable checkpoint files (global rank / ntile) once their DataFrames are gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only when it is unset.

    On a cluster the directory must be a shared folder named by ``spark.checkpoint.dir``;
    a machine-local temporary folder is only acceptable in local mode (tests).
    """
    try:
        sc = spark.sparkContext
    except Exception as e:  # noqa: BLE001 - remote session: the server's spark.checkpoint.dir applies
        remote = spark.conf.get("spark.checkpoint.dir", None)
        if not remote:
            raise RuntimeError("spark.checkpoint.dir is not set on the server") from e
        return remote
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/ABFS) for this cluster"
        )
    local_dir = tempfile.mkdtemp(prefix="mercato-ck-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


_SCRATCH: dict[str, SparkSession] = {}  # folders made by scratch() and not discarded yet


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's shared checkpoint folder. What is there is removed by
    :func:`discard`, at the latest when the program ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH[path] = spark
    return path


def discard(path: str) -> None:
    """Remove a folder that :func:`scratch` named, by the file system that it lies on."""
    spark = _SCRATCH.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be gone
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


@atexit.register
def _discard_all() -> None:
    for path in list(_SCRATCH):
        discard(path)
