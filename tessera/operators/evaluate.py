"""Scoring of recorded trajectories: pairing, matching, rewards, costs, recoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARLY_ENDS = ("too_many_errors", "max_steps")
STOP_TOKENS = ("###STOP###", "###TRANSFER###", "###OUT-OF-SCOPE###")


def turn_index(messages: DataFrame, trajectory: str, time: str, position: str) -> DataFrame:
    """Messages numbered from 0 by time; equal times keep their order."""
    return messages.withColumn("turn_idx", F.row_number().over(Window.partitionBy(trajectory).orderBy(time, position)).cast("bigint") - 1)


def call_response_pairs(messages: DataFrame, trajectory: str, turn: str, role: str, asks: str = "user", answers: str = "assistant") -> DataFrame:
    """Each message of one role with the message of the other that directly follows it."""
    w = Window.partitionBy(trajectory).orderBy(turn)
    return messages.withColumn("next_role", F.lead(role).over(w)).withColumn("next_turn", F.lead(turn).over(w)).where((F.col(role) == asks) & (F.col("next_role") == answers)).select(trajectory, F.col(turn).alias("call_turn"), F.col("next_turn").alias("response_turn"))


def paired_calls(messages: DataFrame, trajectory: str, turn: str, role: str, calls: str, answer_id: str, content: str) -> DataFrame:
    """Each tool call with its answer: (trajectory, turn, ordinal, call_id, name, answer_turn, answer_id, content, error).

    A message's n calls (calls: array of structs with id and name) are answered by the n tool messages that directly
    follow it, the first by the first. error: "id mismatch" where the two ids differ, "answer missing" where another
    message or the end comes first, "call missing" for tool messages beyond the calls; ordinals count from 0."""
    w = Window.partitionBy(trajectory).orderBy(turn)
    m = messages.withColumn("_block", F.sum(F.when(F.col(role) == "tool", 0).otherwise(1)).over(w))
    tool = F.col(role) == "tool"
    answers = F.array_sort(F.collect_list(F.when(tool, F.struct(F.col(turn).alias("turn"), F.col(answer_id).alias("id"), F.col(content).alias("content")))))
    head = F.max(F.when(~tool, F.struct(F.col(turn).alias("turn"), F.col(calls).alias("calls"))))
    blocks = m.groupBy(trajectory, "_block").agg(head.alias("_head"), answers.alias("_answers"))
    each = blocks.select(trajectory, F.col("_head.turn").alias("turn"), F.posexplode(F.arrays_zip(F.coalesce("_head.calls", F.array().cast(messages.schema[calls].dataType)).alias("call"), F.col("_answers").alias("answer"))).alias("ordinal", "_p"))
    call, answer = F.col("_p.call"), F.col("_p.answer")
    error = F.when(call.isNull(), "call missing").when(answer.isNull(), "answer missing").when(~call["id"].eqNullSafe(answer["id"]), "id mismatch")
    return each.select(trajectory, "turn", "ordinal", call["id"].alias("call_id"), call["name"].alias("name"), answer["turn"].alias("answer_turn"), answer["id"].alias("answer_id"), answer["content"].alias("content"), error.alias("error"))


def history_violations(messages: DataFrame, trajectory: str, turn: str, role: str, n_calls: str) -> DataFrame:
    """Messages with n tool calls that are not followed by exactly n tool messages; a shortfall at the end counts too."""
    w = Window.partitionBy(trajectory).orderBy(turn)
    block = F.sum(F.when(F.col(role) != "tool", 1).otherwise(0)).over(w)
    blocks = messages.withColumn("block", block).groupBy(trajectory, "block").agg(F.coalesce(F.max(n_calls), F.lit(0)).alias("calls"), F.count_if(F.col(role) == "tool").alias("answers"), F.min(turn).alias("turn"))
    return blocks.where("calls <> answers").select(trajectory, "turn", "calls", "answers")


def text_has(content: Column, info: Column) -> Column:
    """Does the text hold the information? Case folded; commas are taken out of the text alone."""
    return F.contains(F.replace(F.lower(content), F.lit(","), F.lit("")), F.lower(info))


def communicate_checks(runs: DataFrame, infos: DataFrame, messages: DataFrame, trajectory: str, task: str, content: str, role: str) -> DataFrame:
    """(trajectory, info, met) for each piece of information that the trajectory's task asks for: did any assistant text say it?

    runs: (trajectory, task), infos: (task, info). Assistant texts meet the pieces of their own task alone, and what
    they say is gathered before it is shuffled by trajectory and piece; trajectories without texts have all unmet."""
    wanted = runs.select(trajectory, task).join(infos.select(task, "info").distinct(), task).select(trajectory, "info")
    said = messages.where((F.col(role) == "assistant") & (F.length(F.trim(content)) > 0)).select(trajectory, content)
    heard = said.join(wanted, trajectory).groupBy(trajectory, "info").agg(F.bool_or(text_has(F.col(content), F.col("info"))).alias("_heard"))
    return wanted.join(heard, [trajectory, "info"], "left").select(trajectory, "info", F.coalesce("_heard", F.lit(False)).alias("met"))


def communicate_rewards(runs: DataFrame, checks: DataFrame, trajectory: str) -> DataFrame:
    """(trajectory, reward): 1 where all that the task asks for was said, or it asks for nothing; else 0."""
    missed = checks.where("NOT met").select(trajectory).distinct().withColumn("_missed", F.lit(True))
    return runs.select(trajectory).join(missed, trajectory, "left").select(trajectory, F.when(F.col("_missed"), 0.0).otherwise(1.0).alias("reward"))


def arguments_match(gold: Column, call: Column, compare: Column | None = None) -> Column:
    """Do a gold action's arguments (map of JSON values) agree with a call's?

    Over the keys named in compare; where that is null, over the keys of the
    call, so gold arguments that the call leaves out do not count, and a call
    without arguments matches any gold one."""
    keys = F.map_keys(call) if compare is None else F.coalesce(compare, F.map_keys(call))
    pick = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: F.array_contains(keys, k))))
    return (F.size(keys) == 0) | (pick(gold) == pick(call))


def action_checks(gold: DataFrame, calls: DataFrame, on: list[str], match: Column | None = None) -> DataFrame:
    """Distinct gold actions, each with whether any call of the same trajectory matches it: order and repeats do not count.

    With a match: one join, and one aggregation by the gold action itself."""
    if match is None:
        hit = calls.select(*on).distinct().withColumn("_hit", F.lit(True))
        return gold.distinct().join(hit, on, "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")
    return gold.join(calls, on, "left").groupBy(*gold.columns).agg(F.coalesce(F.bool_or(match), F.lit(False)).alias("matched"))


def combine_rewards(basis: Column, channels: dict[str, Column], ended: Column | None = None, has_criteria: Column | None = None) -> Column:
    """Product of the channels that the basis names; early ends give 0 before all else, no criteria gives 1."""
    out = F.lit(1.0)
    for name, value in channels.items():
        out = out * F.when(F.array_contains(basis, name), value.cast("double")).otherwise(F.lit(1.0))
    if has_criteria is not None:
        out = F.when(~has_criteria, 1.0).otherwise(out)
    return out if ended is None else F.when(ended.isin(*EARLY_ENDS), 0.0).otherwise(out)


def channel_success(basis: Column, channel: str, value: Column) -> Column:
    """1 or 0 by the channel's reward; null where the basis lacks the channel, 0 where the reward is missing."""
    return F.when(F.array_contains(basis, channel), F.coalesce((value == 1).cast("int"), F.lit(0)))


def conversation_cost(messages: DataFrame, trajectory: str, role: str, cost: str) -> DataFrame:
    """Cost by role; one missing cost makes all of the trajectory's costs null. Tool messages do not count."""
    m = messages.where(F.col(role) != "tool")
    missing = F.bool_or(F.col(cost).isNull())
    by = lambda r: F.when(~missing, F.coalesce(F.sum(F.when(F.col(role) == r, F.col(cost))), F.lit(0)))
    return m.groupBy(trajectory).agg(by("assistant").alias("agent_cost"), by("user").alias("user_cost"))


def token_usage(messages: DataFrame, trajectory: str, usage: str) -> DataFrame:
    """Sum of usage; missing ones count as none."""
    return messages.groupBy(trajectory).agg(F.coalesce(F.sum(usage), F.lit(0)).alias("tokens"))


def recovery_metrics(steps: DataFrame, trajectory: str, tool: str, order: list[str], is_error: Column) -> DataFrame:
    """Steps, errors, and successes whose previous call of the same tool failed."""
    w = Window.partitionBy(trajectory, tool).orderBy(*order)
    marked = steps.withColumn("_e", is_error).withColumn("_before", F.lag("_e").over(w))
    return marked.groupBy(trajectory).agg(F.count(F.lit(1)).alias("total_steps"), F.count_if("_e").alias("error_count"), F.count_if(~F.col("_e") & F.coalesce("_before", F.lit(False))).alias("recovery_count"))


def first_success(steps: DataFrame, trajectory: str, tool: str, order: str, result: str, is_error: Column) -> DataFrame:
    return steps.where(~is_error).groupBy(trajectory, tool).agg(F.min_by(result, order).alias(result))


def transcript(messages: DataFrame, trajectory: str, turn: str, role: str, content: str) -> DataFrame:
    """One text for each trajectory: a line "role: content" for each message; no content prints as None."""
    line = F.concat(F.col(role), F.lit(": "), F.coalesce(F.col(content), F.lit("None")))
    return messages.groupBy(trajectory).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))


def has_stop_token(content: Column, is_tool_call: Column) -> Column:
    hit = F.lit(False)
    for t in STOP_TOKENS:
        hit = hit | F.contains(content, F.lit(t))
    return ~is_tool_call & F.coalesce(hit, F.lit(False))


def flip_roles(role: Column) -> Column:
    return F.when(role == "user", "assistant").when(role == "assistant", "user").otherwise(role)


def is_tool_call(calls: Column) -> Column:
    """A message with a list of calls is a tool call, an empty list included."""
    return calls.isNotNull()


def all_met(checks: Column) -> Column:
    """1 where every check of the list holds, else 0; an empty or missing list is met."""
    return F.when(F.forall(F.coalesce(checks, F.array().cast("array<boolean>")), lambda x: F.coalesce(x, F.lit(False))), 1.0).otherwise(0.0)


ASSERTIONS = "struct<results:array<struct<expectedOutcome:string,reasoning:string,metExpectation:boolean>>>"


def assertion_results(completion: Column) -> Column:
    """What a judge's JSON answer says of each assertion: array of (assertion, met). An answer that does not parse gives an empty array."""
    found = F.from_json(completion, ASSERTIONS)["results"]
    empty = F.array().cast("array<struct<assertion:string,met:boolean>>")
    return F.coalesce(F.transform(found, lambda r: F.struct(r["expectedOutcome"].alias("assertion"), F.coalesce(r["metExpectation"], F.lit(False)).alias("met"))), empty)


def assertion_reward(results: Column) -> Column:
    """1 where all results that came back are met: an assertion without a result is no failure."""
    return all_met(F.transform(results, lambda r: r["met"]))


def env_assertion(result: Column, expected: Column) -> Column:
    """Does a check of the environment give what is asserted? No result does not."""
    return F.coalesce(result == expected, F.lit(False))


#: Which channels each kind of evaluation looks at: fixed names.
EVALUATIONS = {"env": ("DB", "ENV_ASSERTION"), "communicate": ("COMMUNICATE",), "action": ("ACTION",), "nl_assertions": ("NL_ASSERTION",), "all": ("DB", "ENV_ASSERTION", "ACTION", "NL_ASSERTION", "COMMUNICATE")}


def evaluate(kind: str, basis: Column, channels: dict[str, Column], ended: Column | None = None, has_criteria: Column | None = None) -> Column:
    """The reward of one kind of evaluation; "all" multiplies the channels that the task's basis names, the others take their own channels whatever the basis says."""
    if kind not in EVALUATIONS:
        raise ValueError(f"unknown evaluation {kind!r}; known: {sorted(EVALUATIONS)}")
    picked = {c: v for c, v in channels.items() if c in EVALUATIONS[kind]}
    used = basis if kind == "all" else F.array(*map(F.lit, EVALUATIONS[kind]))
    return combine_rewards(used, picked, ended, has_criteria)


def action_rows(simulations: DataFrame, checks: str) -> DataFrame:
    """A row for each action check of each simulation; simulations without checks have none."""
    return simulations.select(*[c for c in simulations.columns if c != checks], F.inline(checks))


def with_tool_kind(rows: DataFrame, kinds: DataFrame, requestor: str, tool: str) -> DataFrame:
    """rows with the kind (read, write, think, generic) that the requestor's tool has, null where it has none. kinds: (requestor, tool, kind)."""
    k = kinds.select(F.col("requestor").alias(requestor), F.col("tool").alias(tool), "kind")
    return rows.join(k, [requestor, tool], "left")


def write_action_accuracy(rows: DataFrame, simulation: str, met: str) -> DataFrame:
    """For each simulation: checks of writing tools, and how many of them are met."""
    write = F.coalesce(F.col("kind") == "write", F.lit(False))
    return rows.groupBy(simulation).agg(F.count_if(write).alias("write_checks"), F.count_if(write & F.col(met)).alias("write_met"))
