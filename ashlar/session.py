"""Session helpers."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(name: str = "ashlar", cpus: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one it provides."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", os.environ.get("ASHLAR_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="ashlar-")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder the session names in ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is missing and all executors run
    inside this very process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
