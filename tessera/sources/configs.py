"""YAML and TOML as rows: files are read by Spark, whichever store holds them, and parsed in the tasks, a file or document at a time."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # then JSON, which is YAML too, is all that is read and written
    yaml = None

KINDS = {"yaml": "yaml", "yml": "yaml", "toml": "toml"}
#: Where a TOML file keeps a table's rows.
ROWS = "rows"


def parse(text: str, kind: str) -> list[object]:
    """A file's documents: those of a YAML stream, the rows of a TOML file that has nothing but rows, else the one that it is."""
    if kind == "toml":
        found = tomllib.loads(text)
        return found[ROWS] if list(found) == [ROWS] and isinstance(found[ROWS], list) else [found]
    if yaml is None:
        return [json.loads(part) for part in text.split("\n---\n") if part.strip("-\n ")]
    return [d for d in yaml.safe_load_all(text) if d is not None]


def _toml(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k)} = {_toml(v)}" for k, v in value.items() if v is not None) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(_toml(v) for v in value if v is not None) + "]"
    # a JSON text is a TOML one but for the delete character
    return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f") if isinstance(value, str) else repr(value)


def render(value: dict, kind: str) -> str:
    """One document as a part of a file. TOML knows no null: such fields are left out."""
    if kind == "toml":
        lines = [f"{json.dumps(k)} = {_toml(v)}" for k, v in value.items() if v is not None]
        return "\n".join([f"[[{ROWS}]]", *lines])
    return "---\n" + (json.dumps(value, ensure_ascii=False) if yaml is None else yaml.safe_dump(value, sort_keys=False, allow_unicode=True)).rstrip("\n")


def _kind(path: str) -> str:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in KINDS:
        raise ValueError(f"no configuration in .{kind}; known: {sorted(KINDS)}")
    return KINDS[kind]


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, data): a row for each document of the files at path, with its data as VARIANT. Dates come as ISO texts.

    path may name a file, a folder that write_config made, or a pattern with an ending."""
    kind = _kind(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, text in zip(frame["path"], frame["text"], strict=True):
                docs = [json.dumps(d, default=str) for d in parse(text, kind)]
                yield pd.DataFrame({"path": [name] * len(docs), "place": range(len(docs)), "json": docs})

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.mapInPandas(run, "path string, place bigint, json string").select("path", "place", F.parse_json("json").alias("data"))


def write_config(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each row as a document: a folder of text files under a path that ends in yaml or toml, a file for each partition."""
    kind = _kind(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"value": [render(json.loads(x), kind) for x in frame["json"]]})

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
    rows.mapInPandas(run, "value string").write.mode(mode).text(path)
