"""Sums of small numpy arrays over the partitions of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_over_partitions(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int, groups: int = 16) -> np.ndarray:
    """The sum of what ``each`` makes of every partition (float64, ``size`` numbers).

    Two levels: the partitions' arrays meet in ``groups`` tasks, which add them as
    they come, and the driver adds one array from each of these.
    """

    def one(batches):
        got = each(batches)
        if got is not None:
            yield pa.RecordBatch.from_pydict({"sum": [np.ascontiguousarray(got, np.float64).tobytes()]}, schema=pa.schema([("sum", pa.binary())]))

    def add(batches):
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw, np.float64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sum": [total.tobytes()]}, schema=pa.schema([("sum", pa.binary())]))

    parts = df.mapInArrow(one, "sum binary").withColumn("part", F.spark_partition_id())
    sums = parts.repartition(groups, "part").select("sum").mapInArrow(add, "sum binary")
    total = np.zeros(size)
    for row in sums.toLocalIterator():
        total += np.frombuffer(row["sum"], np.float64)
    return total
