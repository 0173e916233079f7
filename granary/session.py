"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Folders below the shared one that this process has written and not released.
INTERMEDIATES: list[str] = []

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Feature names keep their case: "Flow" and "flow" are two columns.
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "granary", master: str | None = None, **settings) -> SparkSession:
    """Session with the engine's settings; ``settings`` override (dots as ``__``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    overrides = {k.replace("__", "."): str(v) for k, v in settings.items()}
    for key, value in {**SESSION_SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings for the jobs started inside; what was there before is put back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting falls back to a temporary folder:
    on a cluster a machine-local path would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/granary/{tag}-{uuid.uuid4().hex}"
    INTERMEDIATES.append(path)
    return path


def release_intermediates(spark: SparkSession) -> int:
    """Delete the folders that this process has asked ``shared_dir`` for; returns how many.

    Call it when the results of the queries so far are written or no longer needed.
    """
    released = 0
    while INTERMEDIATES:
        path = spark._jvm.org.apache.hadoop.fs.Path(INTERMEDIATES.pop())
        released += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return released


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_many_tasks(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores: rows of few bytes but much work would by their size lie in a handful of tasks."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
