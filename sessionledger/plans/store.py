"""Shared-folder storage for intermediate results that several jobs read."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, str], str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; on one machine,
    where none is set, make one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sessionledger-", dir="/tmp"))
    return sc.getCheckpointDir()


def written_table(spark: SparkSession, name: str, build) -> DataFrame:
    """The Parquet table ``name``, written by ``build()`` on first use in this
    application. It outlives lost executors, and later readers keep column
    pruning and filter pushdown, which a checkpointed RDD does not."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _WRITTEN:
        digest = hashlib.sha256(name.encode()).hexdigest()[:16]
        path = f"{ensure_checkpoint_dir(spark)}/tables/{digest}"
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder for a sink's output."""
    return f"{ensure_checkpoint_dir(spark)}/out/{name}-{uuid.uuid4().hex}"
