"""Session construction and the shared scratch / checkpoint folder.

On a cluster the session already carries ``spark.checkpoint.dir`` (a shared
folder every executor can reach); it is read, never replaced.  Only when it is
unset -- local runs and tests -- a private folder under the system temp dir is
chosen.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keep whole-stage codegen for the wide vector aggregates (64..1024 columns)
    "spark.sql.codegen.maxFields": "2048",
}


def get_session(master: str | None = None, app: str = "newsloom", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only if none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="newsloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir) if _settable(spark) else None
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def _settable(spark: SparkSession) -> bool:
    try:
        return spark.conf.isModifiable("spark.checkpoint.dir")
    except Exception:  # pragma: no cover - older API
        return False


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint dir (never a machine-local temp dir on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/newsloom-scratch/{name}-{uuid.uuid4().hex[:12]}"
    if path.startswith("/"):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return path
