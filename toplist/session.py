"""Session construction for tests, the benchmark and command-line use.

Library operators never create sessions; they take one.  On a cluster the
session comes from the launcher and its ``spark.checkpoint.dir`` names the
shared scratch folder; :func:`scratch_dir` reads it and falls back to a fresh
local folder only on a ``local`` master (tests).  On any other master an unset
folder is an error: executors would write to disks nobody else can read.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "toplist") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def command_session(app: str = "toplist") -> SparkSession:
    """The launcher's session (master and settings of the submit); a local one when started as plain Python."""
    return SparkSession.builder.appName(app).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a fresh local folder when unset on a local master.

    Raises ``RuntimeError`` when it is unset on any other master.

    Sessions without a local ``SparkContext`` handle (Spark Connect) keep the
    server's setting untouched.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        sc = None
    base = sc.getConf().get("spark.checkpoint.dir", None) if sc is not None else None
    if not base:
        try:
            base = spark.conf.get("spark.checkpoint.dir")
        except Exception:
            base = None
    if sc is None:
        return base or ""
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="toplist-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the cluster's checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh scratch folder and read back: lineage ends there, and rows stay as they were dealt."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
