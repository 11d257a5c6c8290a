"""The shared folder and tables written there, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a partition of dealt() holds on average.
ROWS_A_TASK = 400_000
_own_dirs: dict[str, str] = {}
#: Paths of tables that an application has written, for clear().
_tables: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else the context's checkpoint folder; on one machine alone (tests) a temporary one."""
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", context.master or ""):  # a local cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own_dirs[context.applicationId], ignore_errors=True)
    return _own_dirs[context.applicationId]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, without lineage. clear() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by keys, given about how many rows it has: to more partitions where it has more, so that what a task holds stays the same.

    Where there are few, their number is left to Spark."""
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that written() has made in this application, once nothing reads them any more; how many there were."""
    context = spark.sparkContext
    paths = _tables.pop(context.applicationId, [])
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
