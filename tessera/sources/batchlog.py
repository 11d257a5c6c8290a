"""Tables that grow by batches, each of which counts once however often it is written.

A batch is written to a folder of its own and then committed by a small file under
its id, which the store creates or refuses in one step. Readers see committed
batches alone. A job that died before its commit left nothing that is read, and
writes its folder anew; a batch that is committed already is not written again.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class BatchLog:
    """kind: parquet, json or csv (CSV files have no header lines: columns are kept once, in the log)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> None:
        self.spark, self.path, self.schema, self.kind = spark, path.rstrip("/"), schema, kind
        self._create("schema.json", schema.json())
        kept = self.spark.read.text(f"{self.path}/log/schema.json", wholetext=True).head()[0]
        if T.StructType.fromJson(json.loads(kept)) != schema:
            raise ValueError(f"{self.path} holds rows of another schema")

    def append(self, df: DataFrame, batch: str) -> bool:
        """Adds a batch; False (and nothing written) where its id is committed already."""
        if not re.fullmatch(r"[\w.-]+", batch) or batch.startswith(("_", ".")):
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.batches():
            return False
        # a folder for each attempt, so that two writers of one batch don't mix; the commit names the one that counts
        folder = f"{batch}/{uuid.uuid4().hex}"
        df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in self.schema]).write.format(self.kind).save(f"{self.path}/{folder}")
        return self._create(f"{batch}.commit", folder)

    def batches(self) -> dict[str, str]:
        """Committed ids with their folders."""
        rows = self.spark.read.text(f"{self.path}/log/*", wholetext=True).selectExpr("_metadata.file_name AS name", "value").where("name LIKE '%.commit'").collect()
        return {r.name.removesuffix(".commit"): r.value for r in sorted(rows)}

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        folders = [f"{self.path}/{f}" for f in self.batches().values()]
        return self.spark.read.schema(self.schema).format(self.kind).load(folders) if folders else self.spark.createDataFrame([], self.schema)

    def _create(self, name: str, text: str) -> bool:
        """Makes a file of the log; False where it is there."""
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{name}")
        store = at.getFileSystem(context._jsc.hadoopConfiguration())
        if store.exists(at):
            return False
        try:
            out = store.create(at, False)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True
