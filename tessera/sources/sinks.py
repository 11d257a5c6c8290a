"""Writers: test cases, checkpoints, notes, versioned snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.combos import merge_new_only
from tessera.operators.digest import database_digest, row_digest
from tessera.sources.configs import KINDS, write_config


def write_any(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes by the path's ending: json, csv, txt, md, parquet, yaml, toml."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in KINDS:
        write_config(df, path, mode)
    elif kind in ("txt", "md"):
        df.select(F.col(df.columns[0]).cast("string")).write.mode(mode).text(path)
    elif kind in ("json", "csv", "parquet"):
        df.write.mode(mode).options(**({"header": True} if kind == "csv" else {})).format(kind).save(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def write_array(df: DataFrame, path: str) -> None:
    """Rows as one JSON array in one file of the folder at path: a list of test cases, streamed through one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines, first = ["["], True
        for frame in frames:
            for value in frame["value"]:
                lines.append(value if first else f",{value}")
                first = False
            yield pd.DataFrame({"value": lines})
            lines = []
        yield pd.DataFrame({"value": [*lines, "]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def append_runs(df: DataFrame, path: str, by: str) -> None:
    """Adds finished runs to a table partitioned by a column; each call adds files and rewrites none."""
    df.write.mode("append").partitionBy(by).parquet(path)


def merge_test_cases(spark: SparkSession, path: str, new: DataFrame, target: str, key: str = "id") -> DataFrame:
    """The cases at path and the new ones whose id none of them has, written to target."""
    merge_new_only(spark.read.schema(new.schema).json(path), new, key).write.mode("overwrite").json(target)
    return spark.read.schema(new.schema).json(target)


MANIFEST = "table_name string, path string, n bigint, digest string"


def _observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and what a pass over it counts and sums of its rows' digests."""
    seen = Observation(name)
    part = lambda i: F.conv(F.substring(row_digest(df.columns), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(2)]
    return df.observe(seen, F.count(F.lit(1)).alias("n"), *sums), seen


def _digest(seen: Observation) -> str:
    return ":".join(str(seen.get[c]) for c in ("n", "s0", "s1"))


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table under path, and a manifest with its rows and digest, both counted in the pass that writes.

    The manifest comes last: a folder without one is no snapshot. A path that exists is an error, so snapshots never change."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        watched, seen = _observed(df, name)
        watched.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")
        rows.append((name, f"{path}/{name}.parquet", seen.get["n"], _digest(seen)))
    made = spark.createDataFrame(rows, MANIFEST)
    made.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest.json")
    return made


def restored(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot."""
    return {r.table_name: spark.read.parquet(r.path) for r in spark.read.schema(MANIFEST).json(f"{path}/manifest.json").collect()}


def changed_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """(table_name, n, n_before, changed) of tables against a snapshot's manifest; tables that one side lacks count as changed."""
    spark = next(iter(tables.values())).sparkSession
    before, now = spark.read.schema(MANIFEST).json(f"{path}/manifest.json"), []
    for name, df in tables.items():
        watched, seen = _observed(df, f"{name} again")
        watched.write.format("noop").mode("overwrite").save()
        now.append((name, seen.get["n"], _digest(seen)))
    after = spark.createDataFrame(now, "table_name string, n bigint, after string")
    return before.select("table_name", F.col("n").alias("n_before"), "digest").join(after, "table_name", "full").select("table_name", "n", "n_before", (~F.col("digest").eqNullSafe(F.col("after"))).alias("changed"))


def guarded(tables: dict[str, DataFrame], path: str, run: Callable[[dict[str, DataFrame]], object]) -> object:
    """What run makes of the tables, between a snapshot and a look at whether they are still what they were; an error where not."""
    snapshot(tables, path)
    made = run(tables)
    if off := [r.table_name for r in changed_tables(tables, path).where("changed").collect()]:
        raise RuntimeError(f"tables changed during the run: {sorted(off)}")
    return made


def unchanged(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> bool:
    """Do two states of a database hold the same rows?"""
    return database_digest(before).head()["digest"] == database_digest(after).head()["digest"]
