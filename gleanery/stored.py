"""Cutting lineage through tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of this process that are still there, by path.
_LEFT: dict[str, SparkContext] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where the session names none, a local master (as in tests) gets a temporary one; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "gleanery-checkpoints"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back, with the path. What isn't dropped before goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _LEFT[path] = spark.sparkContext
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder, for what is written there in several steps; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/folder-{uuid.uuid4().hex}"
    _LEFT[path] = spark.sparkContext
    return path


def table(df: DataFrame) -> DataFrame:
    return written(df)[0]


def _delete(sc: SparkContext, path: str) -> None:
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables of ``written`` that no later plan reads."""
    for path in paths:
        _delete(spark.sparkContext, path)
        _LEFT.pop(path, None)


@atexit.register
def _drop_left() -> None:
    """A result may still read its tables, so that they stay until the driver ends (or its context was stopped)."""
    for path, sc in _LEFT.items():
        if sc._jsc is not None:
            with contextlib.suppress(Exception):  # nothing more can be done while the interpreter ends
                _delete(sc, path)


def bounded(keys: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A written table of ``keys``, to be broadcast if it is counted to have at most ``most_rows`` rows; else joined as Spark sees fit."""
    out = table(keys)
    return F.broadcast(out) if out.count() <= most_rows else out
