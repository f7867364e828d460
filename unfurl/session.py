"""Sessions for single-machine use; on a cluster pass your own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    n = cpus or os.cpu_count() or 1
    b = SparkSession.builder.master(f"local[{n}]").appName("unfurl")
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir and read from there, so
    that what follows does not compute it again, also when executors are lost. A
    local session without such a folder gets one of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="unfurl-"))
    return df.checkpoint()
