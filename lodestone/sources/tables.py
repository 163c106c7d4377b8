"""Tables as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table with less than this for each core is read by fewer tasks than there are cores, down to one for a row group.
SPLIT_BYTES = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores if their table is too small to have a split for each; larger ones stay as they are split.

    For work that costs far more than to move the rows, which is never more than ``SPLIT_BYTES`` for each core.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPLIT_BYTES else rows
