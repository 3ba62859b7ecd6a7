"""Bounded memory of Python workers, which Spark keeps for later tasks and stages."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # a C library without it
        return None


#: Rows of an Arrow batch at most. Batches are counted in rows and not in bytes, and texts may be long.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session holds Arrow batches to ``BATCH_ROWS`` rows from now on, unless it has a smaller number already."""
    conf = df.sparkSession.conf
    now = int(conf.get(_BATCH))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def release() -> None:
    """Give memory that nothing uses any more back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


#: What workers keep from task to task of a stage, by name, and how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *clear: Callable[[], None], keep: str | None = None):
    """``run`` over a task's batches; at the task's end caches are cleared and memory is given back.

    What another stage kept in this worker is dropped first, all but ``keep``.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, drop in KEPT.items():
            if name != keep:
                drop()
        try:
            yield from run(batches)
        finally:
            for f in clear:
                f()
            release()

    return whole


class Seen:
    """Keys met lately, at most ``most`` of them. A key may be taken for a new one again, never the reverse."""

    def __init__(self, most: int = 1 << 17):
        self.most, self.keys = most, set()

    def fresh(self, keys: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Which of ``keys`` are to be used and new."""
        out = np.zeros(len(keys), bool)
        for i in np.flatnonzero(use).tolist():
            k = int(keys[i])
            if k not in self.keys:
                if len(self.keys) >= self.most:
                    self.keys.clear()
                self.keys.add(k)
                out[i] = True
        return out
