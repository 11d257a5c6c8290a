"""Readers of tool schemas, rules, result files, tasks and plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.toolgraph import field_name, input_types
from tessera.sources.configs import KINDS, read_config

PARAM = "struct<type:string,description:string,enum:array<string>>"
TOOL_FILE = f"tools array<struct<name:string,description:string,`input-type`:array<string>,`output-type`:array<string>,input:map<string,{PARAM}>,output:struct<type:string,description:string>>>"
RULE_FILE = "subgoals array<struct<details:string,category:string>>"
#: Rule categories that are known; others count as compliance rules.
RULE_KINDS = ("compliance_rule", "output_rule", "tool_call_rule")


def driver_tables(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def read_tools(spark: SparkSession, path: str) -> DataFrame:
    """tool, description, params, inputs, outputs, param_types of a JSON tool file.

    A text parameter with allowed values is an enum. Types are those that names and output descriptions imply."""
    t = spark.read.schema(TOOL_FILE).json(path, multiLine=True).select(F.inline("tools"))
    params = F.coalesce(F.map_keys("input"), F.array().cast("array<string>"))
    kinds = F.transform_values("input", lambda _, v: F.when((v["type"] == "string") & v["enum"].isNotNull(), "enum").otherwise(v["type"]))
    out = F.when(F.col("output").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lower(field_name(F.col("output.description"), F.coalesce("output.type", F.lit("string"))))))
    return t.select(F.col("name").alias("tool"), "description", params.alias("params"), input_types(params).alias("inputs"), out.alias("outputs"), kinds.alias("param_types"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """details, category (unknown ones become compliance rules), place."""
    r = spark.read.schema(RULE_FILE).json(path, multiLine=True).select(F.posexplode("subgoals").alias("place", "r"))
    return r.select("place", "r.details", F.when(F.col("r.category").isin(*RULE_KINDS), F.col("r.category")).otherwise("compliance_rule").alias("category"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A file by its ending: json, csv, txt, md, parquet; of yaml and toml each document as VARIANT."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        return spark.read.json(path, multiLine=True)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in KINDS:
        return read_config(spark, path)
    if kind in ("txt", "md"):
        return read_text(spark, path)
    raise ValueError(f"no reader for .{kind}")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Names of files that match, sorted; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length").orderBy("path")


def select_tasks(tasks: DataFrame, ids: list[str] | None = None, num_tasks: int | None = None, id_col: str = "id") -> DataFrame:
    """All tasks; or those of a list, of which num_tasks are taken. An id that no task has is an error."""
    if ids is None:
        return tasks
    wanted = tasks.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{id_col} string, _o int")
    missing = [r[0] for r in wanted.join(tasks.select(F.col(id_col).cast("string").alias(id_col)), id_col, "left_anti").select(id_col).collect()]
    if missing:
        raise ValueError(f"unknown tasks: {sorted(missing)}")
    out = tasks.join(F.broadcast(wanted), id_col).orderBy("_o")
    return (out if num_tasks is None else out.limit(num_tasks)).drop("_o")


def sample_rows(df: DataFrame, key: str, n: int = 2) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(key).limit(n)


SIMULATIONS = (
    "info struct<git_commit:string,seed:bigint,num_trials:bigint,max_steps:bigint,max_errors:bigint,domain:string,user_llm:string,agent_llm:string>, "
    "tasks array<struct<id:string,actions:array<struct<name:string,requestor:string>>>>, "
    "simulations array<struct<id:string,task_id:string,trial:bigint,seed:bigint,duration:double,agent_cost:double,user_cost:double,termination_reason:string,reward:double,messages:array<struct<role:string,content:string>>>>"
)


def flatten_results(results: DataFrame) -> DataFrame:
    """One row a simulation, with its run's info and its task's action counts (-1 where the only action is a transfer)."""
    sims = results.select("info", "tasks", F.inline("simulations"))
    task = F.get(F.filter("tasks", lambda t: t["id"] == F.col("task_id")), F.lit(0))
    acts = F.coalesce(task["actions"], F.from_json(F.lit("[]"), "array<struct<name:string,requestor:string>>"))
    only = (F.size(acts) == 1) & F.contains(F.lower(F.get(acts, F.lit(0))["name"]), F.lit("transfer"))
    of = lambda who: F.when(only, -1).otherwise(F.size(F.filter(acts, lambda a: a["requestor"] == who)))
    n: Column = F.when(only, -1).otherwise(F.size(acts))
    return sims.select(
        F.col("id").alias("simulation_id"), "task_id", "trial", "seed", "reward", "agent_cost", "user_cost", "termination_reason", "duration", F.size("messages").alias("num_messages"),
        *[F.col(f"info.{c}").alias(f"info_{c}") for c in ("git_commit", "seed", "num_trials", "max_steps", "max_errors", "domain", "user_llm", "agent_llm")],
        of("assistant").alias("task_num_agent_actions"), of("user").alias("task_num_user_actions"), n.alias("task_num_actions"),
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return flatten_results(spark.read.schema(SIMULATIONS).json(path, multiLine=True))
