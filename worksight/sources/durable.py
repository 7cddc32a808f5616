"""Intermediate results that several stages read, written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def durable(df: DataFrame) -> DataFrame:
    """The rows of df in the checkpoint folder, lineage cut, so that a lost executor loses nothing.

    The session's spark.checkpoint.dir is the folder. Only where none is set and all runs in
    one process, as in tests, a temporary folder takes its place.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def together(spark: SparkSession, *parts: Callable[[], T]) -> list[T]:
    """What the functions give, run side by side: the jobs of one take the cores that those of the others leave idle."""
    with ThreadPoolExecutor(len(parts)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(part)) for part in parts]]
