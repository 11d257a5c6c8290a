"""What the operators share: table access, staged tables, byte-level word splitting.

Words are split on UTF-8 bytes. ``bytes.lower`` folds A-Z only and
``bytes.split`` cuts at ``[\\x20\\x09-\\x0D]`` only, which are exactly the two
rules that the operators' contracts state; no non-ASCII byte is ever touched.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.staging import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Maps every ASCII byte outside [0-9a-z] (upper case folded first) to a space.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stage:
    """Tables written to the shared folder, so that lost executors lose no work.

    ``keep(df)`` writes and rereads a table; ``drop(df)`` deletes one that no
    later plan reads, ``drop_but(df)`` all but one.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, df: DataFrame) -> None:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._delete(path)

    def drop_but(self, df: DataFrame) -> None:
        kept = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
        for n in range(1, self.n + 1):
            if str(n) not in kept:
                self._delete(f"{self.base}/{n}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(c: Column) -> Column:
    """Folds A-Z only. Texts of ASCII alone take the fast built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def id_bucket(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(c.cast("string").cast("binary")) % n


def free_name(columns: Iterable[str], name: str) -> str:
    """name, with underscores in front until no column clashes."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@functools.cache
def one_product_thread() -> None:
    """Spark's tasks are the parallelism: numpy's library for matrix products takes one thread, where it can be told."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(str(path)).scipy_openblas_set_num_threads64_(1)


_slot: dict = {}


def worker_slot(key, make):
    """What a Python worker keeps from task to task: one thing, so that operators after one another don't add up.

    Another key frees what was kept."""
    if key not in _slot:
        _slot.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # freed memory goes back to the system, where the C library can
            ctypes.CDLL(None).malloc_trim(0)
        _slot[key] = make()
    return _slot[key]


class WordIds(dict):
    """bytes -> number, new words numbered as they come; ``words`` holds them in order."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n
