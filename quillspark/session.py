"""A session with the settings that the engine expects."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import EngineError

#: A side is broadcast by hand only if its counted rows take at most so much; a larger one shuffles.
BROADCAST_BYTES = 64 << 20

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def create(app: str = "quillspark", master: str | None = None, **settings: str) -> SparkSession:
    """A session; on a cluster the master comes from the submit command."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from the session; one is set only where none is and all runs on this machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not context.master.split("[")[0] == "local":
        raise EngineError("a cluster needs spark.checkpoint.dir, a folder that all executors share", "NO_SHARED_FOLDER")
    found = found or f"file://{os.path.join(tempfile.gettempdir(), 'quillspark')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fits(df: DataFrame, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df's counted rows take at most limit; the count stops there."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df hinted for broadcast if its counted size is within limit; Spark chooses otherwise."""
    return F.broadcast(df) if fits(df, row_bytes, limit) else df


class Latest:
    """Runs one query at a time for a caller: a new one cancels the one before it, whose result nobody waits for."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag = spark, ""

    def run(self, action: Callable):
        old, self.tag = self.tag, f"latest-{uuid.uuid4().hex}"
        if old:
            self.spark.interruptTag(old)
        mine = self.tag
        self.spark.addTag(mine)
        try:
            return action()
        finally:
            self.spark.removeTag(mine)
