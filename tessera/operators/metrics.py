"""Trajectory metrics: pass^k, success, cost, breakdowns, votes, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def is_success(reward: Column) -> Column:
    """A reward of one, within a millionth."""
    return reward.between(1 - TOLERANCE, 1 + TOLERANCE)


def pass_hat_k(runs: DataFrame, task: str, success: Column, ks: tuple[int, ...] = (1, 2, 3), strict: bool = False, trials: str | None = None) -> DataFrame:
    """For each task: n runs, c successes, and C(c, k) / C(n, k) for each k.

    The quotient is the product of (c - i) / (n - i), so nothing overflows. A k
    above n gives null, or fails the query where strict. trials: the column of the number of
    runs that were planned; its largest is kept as num_trials."""
    planned = [F.max(trials).alias("num_trials")] if trials else []
    counted = runs.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.count_if(success).alias("c"), *planned)

    def value(k: int) -> Column:
        short = F.raise_error(F.lit(f"fewer than {k} runs of a task")).cast("double") if strict else F.lit(None).cast("double")
        up, down = (reduce(lambda a, b: a * b, [F.col(x).cast("double") - i for i in range(k)]) for x in ("c", "n"))
        return F.when(F.col("n") < k, short).when(F.col("c") < k, 0.0).otherwise(up / down)

    return counted.select(F.col(task), "n", "c", *["num_trials"] * bool(trials), *[value(k).alias(f"pass_{k}") for k in ks])


def overall(per_task: DataFrame, ks: tuple[int, ...] = (1, 2, 3), digits: int = 9) -> DataFrame:
    """Means over tasks, each task weighing the same; null values are left out.

    max_k: the planned number of runs (num_trials, the largest) or the runs of the task with fewest, whichever is less."""
    fewest = F.min("n")
    return per_task.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("n").alias("runs"),
        (F.least(F.max("num_trials"), fewest) if "num_trials" in per_task.columns else fewest).alias("max_k"),
        *[F.round(F.avg(f"pass_{k}"), digits).alias(f"mean_pass_{k}") for k in ks],
    )


def first_per_group(rows: DataFrame, group: str, columns: list[str], order: str) -> DataFrame:
    """The first value that is not null of each column, by order."""
    return rows.groupBy(group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def only_failed(runs: DataFrame, success: Column) -> DataFrame:
    return runs.where(~F.coalesce(success, F.lit(False)))


def all_failed_tasks(runs: DataFrame, task: str, success: Column) -> DataFrame:
    """Tasks without one success."""
    return runs.groupBy(task).agg(F.count_if(success).alias("c")).where("c = 0").select(task)


def cost_by_group(runs: DataFrame, group: str, cost: Column) -> DataFrame:
    """Number, total and mean cost; sums are exact to the cent."""
    total = F.sum(cost.cast("decimal(18,2)")).cast("double")
    return runs.groupBy(group).agg(F.count(cost).alias("n"), total.alias("total_cost"), F.round(total / F.count(cost), 6).alias("mean_cost"))


def success_pivot(checks: DataFrame, action: str, mode: str, modes: list[str], success: Column) -> DataFrame:
    """Success rate of each action in each mode, and the action's share of all checks. Modes are named, so no job looks for them."""
    per = checks.groupBy(action).agg(
        F.count(F.lit(1)).alias("checks"),
        *[F.round(F.avg(F.when(F.col(mode) == m, success.cast("double"))), 6).alias(f"rate_{m}") for m in modes],
    )
    whole = checks.agg(F.count(F.lit(1)).alias("whole"))
    return per.crossJoin(F.broadcast(whole)).select(action, *[f"rate_{m}" for m in modes], F.round(F.col("checks") / F.col("whole"), 6).alias("frequency"))


def majority_vote(votes: DataFrame, group: str, choice: str, order: str) -> DataFrame:
    """The choice with most votes; of equal ones the one that was cast first."""
    tally = votes.groupBy(group, choice).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    return tally.groupBy(group).agg(F.max_by(F.struct(choice, "votes"), F.struct(F.col("votes"), -F.col("first"))).alias("x")).select(group, F.col(f"x.{choice}").alias("winner"), F.col("x.votes").alias("votes"))


def vote_tally(grades: DataFrame, group: str, grade: Column) -> DataFrame:
    """Grades of 1, of 0, and invalid (null) ones."""
    return grades.groupBy(group).agg(F.count_if(grade == 1).alias("complete"), F.count_if(grade == 0).alias("incomplete"), F.count_if(grade.isNull()).alias("invalid"))


def difficulty(calls: Column, parallel: Column) -> Column:
    """Two calls at most: easy; four or more, or parallel ones: hard; else medium."""
    return F.when(calls <= 2, "easy").when((calls >= 4) | parallel, "hard").otherwise("medium")


def task_metrics(actions: DataFrame, task: str, name: str, requestor: str) -> DataFrame:
    """Actions of each requestor; -1 where a task's only action is a transfer."""
    n = actions.groupBy(task).agg(F.count(F.lit(1)).alias("num_actions"), F.count_if(F.col(requestor) == "assistant").alias("agent"), F.count_if(F.col(requestor) == "user").alias("usr"), F.max(F.lower(name)).alias("one"))
    only = (F.col("num_actions") == 1) & F.contains("one", F.lit("transfer"))
    return n.select(task, *[F.when(only, F.lit(-1).cast("bigint")).otherwise(F.col(c)).alias(a) for c, a in (("num_actions", "num_actions"), ("agent", "num_agent_actions"), ("usr", "num_user_actions"))])
