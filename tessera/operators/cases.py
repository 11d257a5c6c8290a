"""Building and checking of test cases: inputs, validity, tool calls, times."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_SUBGOALS = 3
JSON_TYPES = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), list: T.ArrayType(T.StringType()), dict: T.MapType(T.StringType(), T.StringType())}


def check_inputs(prd: str, subgoals: list, tools: list, weights: dict[str, float], path_length: int, subgoal_limit: int) -> None:
    """Raises on empty inputs, weights outside [0, 1] or not summing to one, and limits out of range."""
    for name, value in (("prd", prd.strip()), ("subgoals", subgoals), ("tools", tools)):
        if not value:
            raise ValueError(f"{name} is empty")
    if any(not 0 <= w <= 1 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-3:
        raise ValueError("weights must lie in [0, 1] and sum to 1")
    if path_length < 1:
        raise ValueError("path length must be positive")
    if not 1 <= subgoal_limit <= MOST_SUBGOALS:
        raise ValueError(f"subgoal limit must lie between 1 and {MOST_SUBGOALS}")


def check_pass_k(k: int, trials: int) -> None:
    if k < 1 or trials < 1 or k > trials:
        raise ValueError(f"k ({k}) must lie between 1 and the number of trials ({trials})")


def input_error(prd: Column, subgoals: Column, tools: Column, weights: Column, path_length: Column, subgoal_limit: Column) -> Column:
    """The first fault of a request's inputs, as check_inputs names them; null where there is none. weights: a map."""
    values = F.map_values(weights)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    bad = F.exists(values, lambda w: (w < 0) | (w > 1)) | (F.abs(total - 1) > 1e-3)
    return (
        F.when(F.coalesce(F.trim(prd), F.lit("")) == "", "prd is empty").when(F.size(subgoals) < 1, "subgoals is empty").when(F.size(tools) < 1, "tools is empty").when(bad, "weights must lie in [0, 1] and sum to 1")
        .when(path_length < 1, "path length must be positive").when(~subgoal_limit.between(1, MOST_SUBGOALS), f"subgoal limit must lie between 1 and {MOST_SUBGOALS}")
    )


def pass_k_error(k: Column, trials: Column) -> Column:
    """What is wrong with a k for a number of trials; null where nothing is."""
    return F.when((k < 1) | (trials < 1) | (k > trials), F.format_string("k (%d) must lie between 1 and the number of trials (%d)", k, trials))


def is_valid_task(mode: Column, n_actions: Column, only_tool_calls: Column, has_history: Column, has_ticket: Column) -> Column:
    """May a task run in its mode? gold: it has an action; solo: a history of tool calls alone, else a ticket and an action."""
    solo = F.when(has_history, only_tool_calls).otherwise(has_ticket & (n_actions > 0))
    return F.when(mode == "gold", n_actions > 0).when(mode == "solo", solo).otherwise(F.lit(True))


def grade_rows(grades: DataFrame, group: str, order: str, grade: str) -> DataFrame:
    """Each group's valid grades in order; invalid (null) ones are dropped, not set to 0."""
    kept = grades.where(F.col(grade).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, grade))).alias("x"))
    return kept.select(group, F.transform("x", lambda r: r[grade]).alias("grades"))


def tool_calls(proposed: Column, path: Column, returns: Column) -> Column:
    """Expected calls: the proposed ones (name, parameters, order) if any, else the path's tools without parameters.

    A call without an order takes its place; returns maps tools to what they give, others are unknown."""
    empty = F.create_map().cast("map<string,string>")
    from_path = F.transform(path, lambda n, i: F.struct(n.alias("name"), empty.alias("parameters"), i.cast("int").alias("order")))
    given = F.transform(proposed, lambda c, i: F.struct(c["name"].alias("name"), F.coalesce(c["parameters"], empty).alias("parameters"), F.coalesce(c["order"], i.cast("int")).alias("order")))
    calls = F.when(F.size(F.coalesce(proposed, F.array().cast("array<struct<name:string,parameters:map<string,string>,order:int>>"))) > 0, given).otherwise(from_path)
    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), c["parameters"].alias("parameters"), c["order"].alias("order"), F.coalesce(F.try_element_at(returns, c["name"]), F.lit("unknown")).alias("returns")))


def synthetic_times(messages: DataFrame, trajectory: str, turn: str, end: Column) -> DataFrame:
    """A second between messages, the last one a second before the given end; turns count from 0."""
    n = messages.groupBy(trajectory).agg(F.count(F.lit(1)).alias("_n"))
    return messages.join(n, trajectory).withColumn("timestamp", F.timestamp_add("SECOND", F.col(turn) - F.col("_n"), end)).drop("_n")


def first_batch(combos: DataFrame, size: int) -> DataFrame:
    """The combinations with the lowest indices."""
    return combos.where(F.col("idx") < size)


def model_name(name: Column) -> Column:
    """The base model of a fine-tuned one (ft:base:…), else the name."""
    base = F.regexp_extract(name, r"^ft:([^:]+):", 1)
    return F.when(base != "", base).otherwise(name)


def tool_schema(function) -> tuple[str, T.StructType]:
    """A tool's description and parameters, from a function's docstring and signature."""
    hints = inspect.signature(function, eval_str=True).parameters.values()
    fields = [T.StructField(p.name, JSON_TYPES.get(p.annotation, T.StringType()), p.default is not inspect.Parameter.empty) for p in hints if p.name not in ("self", "state")]
    return inspect.getdoc(function) or "", T.StructType(fields)


def next_speaker(speaker: Column, is_tool_call: Column, is_stop: Column) -> Column:
    """Who acts after a message: the environment after a tool call, the caller after its result (caller here: the agent), else the other side; null after a stop."""
    return F.when(is_stop, F.lit(None).cast("string")).when(is_tool_call, "environment").when(speaker == "agent", "user").otherwise("agent")


def termination(messages: DataFrame, trajectory: str, turn: str, stop: Column, error: Column, max_steps: int = 200, max_errors: int = 10, compat: bool = True) -> DataFrame:
    """(trajectory, steps, reason): where a run ends and why, over its recorded steps; null where nothing ends it.

    The first step with a stop (agent_stop or user_stop by speaker), at the step limit, or with too many errors. Where
    several come at one step, errors go before the limit and the limit before the stop. compat: errors are never
    counted, as in the rule this follows, whose counter stays at 0; then too_many_errors cannot come."""
    w = Window.partitionBy(trajectory).orderBy(turn)
    errors = F.lit(0) if compat else F.sum(error.cast("int")).over(w)
    m = messages.withColumn("_at", F.row_number().over(w) - 1).withColumn("_errors", errors)
    why = F.when(F.col("_errors") >= max_errors, "too_many_errors").when(F.col("_at") + 1 >= max_steps, "max_steps").when(stop, F.concat("speaker", F.lit("_stop")))
    m = m.withColumn("_why", why)
    first = F.min_by(F.struct("_at", "_why"), F.when(F.col("_why").isNotNull(), F.col("_at")))
    found = m.groupBy(trajectory).agg(first.alias("_f"), F.count(F.lit(1)).alias("_n"))
    return found.select(trajectory, F.coalesce(F.col("_f._at") + 1, F.col("_n")).cast("bigint").alias("steps"), F.col("_f._why").alias("reason"))


@dataclass(frozen=True)
class Intent:
    """What a user may want: which rows it can be about, the prompt for one, and what must hold after."""

    name: str
    about: Callable[[DataFrame], DataFrame]
    prompt: Callable[[], Column]
    conditions: dict[str, Callable[[], Column]]


def sampled_intents(intents: list[Intent], rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(intent, key, prompt): for each intent a seeded sample of n of the rows it can be about, with prompts."""
    parts = []
    for intent in intents:
        chance = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(intent.name), F.col(key).cast("string")).cast("binary"))
        parts.append(intent.about(rows).orderBy(chance, key).limit(n).select(F.lit(intent.name).alias("intent"), key, intent.prompt().alias("prompt")))
    return reduce(DataFrame.unionByName, parts)


def intent_outcomes(intents: list[Intent], sampled: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(intent, key, condition, met) of each sampled row's intent on the rows as they are afterwards; a row that is gone meets nothing."""
    parts = []
    for intent in intents:
        own = sampled.where(F.col("intent") == intent.name).select("intent", key).join(after, key, "left")
        checks = [F.struct(F.lit(n).alias("condition"), F.coalesce(c(), F.lit(False)).alias("met")) for n, c in intent.conditions.items()]
        parts.append(own.select("intent", key, F.inline(F.array(*checks))))
    return reduce(DataFrame.unionByName, parts)


def find_run(runs: DataFrame, requests: DataFrame, run: str, task: str, trial: str) -> DataFrame:
    """requests (asked) with the run that each names, null where none is: "id" by the run's id, "task-trial" by these two, "#n" the n-th run by id."""
    two = F.split("asked", "-")
    ask = requests.withColumn("_n", F.when(F.col("asked").startswith("#"), F.substring("asked", 2, 18).try_cast("bigint"))).withColumn("_task", F.when(F.size(two) == 2, F.get(two, F.lit(0)))).withColumn("_trial", F.when(F.size(two) == 2, F.get(two, F.lit(1)).try_cast("bigint")))
    ids = runs.select(F.col(run).alias("_run"), F.col(run).cast("string").alias("_id"), F.col(task).cast("string").alias("_t"), F.col(trial).cast("bigint").alias("_k"))
    most = ask.agg(F.max("_n")).head()[0] or 0
    places = ids.orderBy("_run").limit(most).withColumn("_n", F.row_number().over(Window.orderBy("_run")).cast("bigint")).select("_n", F.col("_run").alias("_by_place"))
    by_pair = ids.groupBy(F.col("_t").alias("_task"), F.col("_k").alias("_trial")).agg(F.min("_run").alias("_by_pair"))
    by_id = ids.select(F.col("_id").alias("asked"), F.col("_run").alias("_by_id"))
    j = ask.join(by_id, "asked", "left").join(by_pair, ["_task", "_trial"], "left").join(places, "_n", "left")
    return j.select(*requests.columns, F.coalesce("_by_id", "_by_pair", "_by_place").alias("run"))


def postconditions(rows: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """(key, condition, met) for each named condition on a sampled intent's row."""
    checks = [F.struct(F.lit(n).alias("condition"), F.coalesce(c, F.lit(False)).alias("met")) for n, c in conditions.items()]
    return rows.select(key, F.inline(F.array(*checks)))


def pick_row(rows: DataFrame, group: str, order: list[str], index: int) -> DataFrame:
    """The row of each group at a place counted from 1."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") == index).drop("_n")
