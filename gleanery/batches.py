"""Arrow batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of an Arrow batch at most where workers hold what they make of a whole batch: batches are counted in rows, and texts may be long.
ROWS = 2000
_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small(df: DataFrame) -> DataFrame:
    """``df``, whose session holds Arrow batches to ``ROWS`` rows from now on, unless it has a smaller number already."""
    conf = df.sparkSession.conf
    now = int(conf.get(_CONF))
    if now <= 0 or now > ROWS:
        conf.set(_CONF, str(ROWS))
    return df
