"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import shared_folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path below ``spark.checkpoint.dir`` that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_like(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


TEXT_ROWS, TEXT_BYTES = 1_000, 2 << 20


def text_batches(spark: SparkSession) -> None:
    """Let Python workers get at most TEXT_ROWS rows or about TEXT_BYTES bytes at a time; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def process_cache(kind: str) -> dict:
    """A dictionary that lives as long as the Python process, for what tasks of one worker can share.

    Task functions travel with their code, so globals of this package begin anew with each task.
    One ``kind`` is held at a time: what an earlier stage loaded goes when the next one asks.
    """
    held = sys.modules.setdefault("_repalign_cache", types.ModuleType("_repalign_cache")).__dict__
    if held.get("kind") != kind:
        held.clear()
        held.update(kind=kind, values={})
    return held["values"]
