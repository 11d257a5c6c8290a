"""Tool environments: tools with kinds for two sides, dispatch, and replay of recorded calls.

A toolkit is a class whose marked functions take (state, **arguments); kinds are
``read``, ``write``, ``think`` and ``generic``. An environment has one for the
assistant and possibly one for the user; each side has its own part of the state.

Replays are folds in order: Spark deals runs to tasks and sorts each run's calls,
and a task streams them and holds one run's state at a time, however long runs are.
"""

from __future__ import annotations

import copy
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import GROUNDING_PATTERNS
from tessera.operators.domain import TRANSFERRED
from tessera.operators.replay import merged, state_digest

KINDS = ("read", "write", "think", "generic")
AGENT, USER = "assistant", "user"


def tool(kind: str = "read") -> Callable:
    """Marks a function of a toolkit as a tool of a kind."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {KINDS}")

    def mark(f: Callable) -> Callable:
        f.tool_kind = kind
        return f

    return mark


class Toolkit:
    @classmethod
    def tools(cls) -> dict[str, Callable]:
        """Functions that are marked in the class or in one it inherits from, as the class defines them."""
        return {n: getattr(cls, n) for n in cls.kinds()}

    @classmethod
    def kinds(cls) -> dict[str, str]:
        """The kind of each tool, by its last mark."""
        return {n: f.tool_kind for base in reversed(cls.__mro__) for n, f in vars(base).items() if hasattr(f, "tool_kind")}


def serialised(value: object) -> str:
    """What a tool returns as text: texts as they are, all else as JSON in which numbers and truth values stand as texts."""

    def plain(v: object) -> object:
        if v is None or isinstance(v, str):
            return v
        if isinstance(v, bool | int | float):
            return str(v)
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, date):
            return v.isoformat()
        raise ValueError(f"Unsupported type: {type(v).__name__}")

    return value if isinstance(value, str) else json.dumps(plain(value))


def same_content(a: str, b: str) -> bool:
    """Equal as JSON where both are, else as texts."""

    def read(x: str) -> object:
        try:
            return json.loads(x)
        except ValueError:
            return x

    return read(a) == read(b)


@dataclass(frozen=True)
class Environment:
    assistant: type[Toolkit] | None
    user: type[Toolkit] | None = None
    solo: bool = False

    def __post_init__(self) -> None:
        if self.solo and (both := set(self._names(self.assistant)) & set(self._names(self.user))):
            raise ValueError(f"Tool names overlap: {sorted(both)}")

    @staticmethod
    def _names(kit: type[Toolkit] | None) -> dict[str, Callable]:
        return kit.tools() if kit else {}

    def call(self, state: dict, name: str, requestor: str, arguments: dict) -> object:
        """The tool's result. Solo: the assistant may use the user's tools, which go first, and the user none."""
        if requestor not in (AGENT, USER):
            raise ValueError(f"Invalid requestor: {requestor}")
        if requestor == USER and self.solo:
            raise ValueError("User tool calls are not allowed in solo mode")
        side = USER if requestor == USER or self.solo and name in self._names(self.user) else AGENT
        kit = self.user if side == USER else self.assistant
        if kit is None:
            raise ValueError("User tools not available" if side == USER else "Tools not available")
        if name not in kit.tools():
            raise ValueError(f"Tool '{name}' not found.")
        return kit.tools()[name](state[side], **arguments)

    def respond(self, state: dict, name: str, requestor: str, arguments: str | None) -> tuple[str, bool]:
        """(content, error): whatever is raised becomes an error content."""
        try:
            return serialised(self.call(state, name, requestor, json.loads(arguments or "{}"))), False
        except Exception as error:
            return f"Error: {error}", True

    def tool_rows(self, spark: SparkSession) -> DataFrame:
        """(requestor, tool, kind) of all tools."""
        rows = [(side, n, k) for side, kit in ((AGENT, self.assistant), (USER, self.user)) if kit for n, k in kit.kinds().items()]
        return spark.createDataFrame(rows, "requestor string, tool string, kind string")


class Support(Toolkit):
    """What every domain's assistant has beside its own tools: a hand-over to people, and room to think."""

    @tool("generic")
    def transfer_to_human_agents(state, summary):
        return TRANSFERRED

    @tool("think")
    def think(state, thought):
        return ""


def begin(start: dict) -> dict:
    return {AGENT: copy.deepcopy(start.get(AGENT, {})), USER: copy.deepcopy(start.get(USER, {}))}


def responses(calls: DataFrame, env: Environment, start: dict, key: str) -> DataFrame:
    """(key, content, error) of calls (key, name, requestor, arguments), each on a state of its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [env.respond(begin(start), r.name, r.requestor, r.arguments) for r in frame[["name", "requestor", "arguments"]].itertuples(index=False)]
            yield pd.DataFrame({key: frame[key], "content": [c for c, _ in got], "error": [e for _, e in got]})

    return calls.select(key, "name", "requestor", "arguments").mapInPandas(run, f"{key} {calls.schema[key].dataType.simpleString()}, content string, error boolean")


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _runs(calls: DataFrame, group: list[str], order: str, starts: DataFrame | None) -> DataFrame:
    """Calls with each run's start row before them, dealt by run and sorted."""
    wanted = [*group, order, "name", "requestor", "arguments", "expected"]
    if "requestor" not in calls.columns:
        calls = calls.withColumn("requestor", F.lit(AGENT))
    if "expected" not in calls.columns:
        calls = calls.withColumn("expected", F.lit(None).cast("string"))
    rows = calls.select(*wanted, F.lit(None).cast("string").alias("data"))
    if starts is not None:
        rows = rows.unionByName(starts.select(*group, "data"), allowMissingColumns=True)
    return rows.repartition(*group).sortWithinPartitions(*group, F.col("data").isNull(), order)


def replay_runs(calls: DataFrame, env: Environment, start: dict, group: list[str], order: str, starts: DataFrame | None = None) -> DataFrame:
    """(group, agent_digest, user_digest, n_calls, n_errors, mismatch) of each run of calls (group, order, name, arguments[, requestor, expected]).

    starts: (group, data), JSON laid over the start of a run; runs that only it names are replayed without calls.
    mismatch: the number of the first call whose content differs from the recorded one; the run goes on."""
    schema = _fields(calls, group) + ", agent_digest string, user_digest string, n_calls bigint, n_errors bigint, mismatch bigint"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, counts, done = None, {}, [0, 0, None], []

        def close() -> None:
            done.append((*now, state_digest(state[AGENT]), state_digest(state[USER]), *counts))

        def frame_of() -> pd.DataFrame:
            out = pd.DataFrame(done, columns=[*group, "agent_digest", "user_digest", "n_calls", "n_errors", "mismatch"])
            done.clear()
            return out.astype({"mismatch": "Int64"})

        for frame in frames:
            keys = list(frame[group].itertuples(index=False, name=None))
            for key, r in zip(keys, frame.itertuples(), strict=True):
                if key != now:
                    if now is not None:
                        close()
                    now, state, counts = key, begin(start), [0, 0, None]
                if r.data is not None:
                    state = merged(state, json.loads(r.data))
                    continue
                content, error = env.respond(state, r.name, r.requestor, r.arguments)
                if counts[2] is None and r.expected is not None and not same_content(content, r.expected):
                    counts[2] = counts[0]
                counts[0] += 1
                counts[1] += error
            if done:
                yield frame_of()
        if now is not None:
            close()
            yield frame_of()

    return _runs(calls, group, order, starts).mapInPandas(run, schema)


def gold_matches(calls: DataFrame, gold: DataFrame, env: Environment, start: dict, task: str, simulation: str, order: str, starts: DataFrame | None = None) -> DataFrame:
    """Does each simulation end in the state that its task's gold actions lead to, on both sides?

    calls (task, simulation, ...) and gold (task, ...) are replayed from the same start; errors of gold actions are
    passed over. Each task's gold actions are replayed once. A task without gold actions ends where it starts."""
    mine = None
    if starts is not None:
        mine = calls.select(task, simulation).distinct().join(starts, task)
    ran = replay_runs(calls, env, start, [task, simulation], order, mine)
    ends = replay_runs(gold, env, start, [task], order, starts).select(task, F.col("agent_digest").alias("_agent"), F.col("user_digest").alias("_user"))
    first = begin(start)
    agent = F.col("agent_digest") == F.coalesce("_agent", F.lit(state_digest(first[AGENT])))
    user = F.col("user_digest") == F.coalesce("_user", F.lit(state_digest(first[USER])))
    j = ran.join(ends, task, "left").withColumn("agent_match", agent).withColumn("user_match", user)
    return j.withColumn("db_match", F.col("agent_match") & F.col("user_match")).drop("_agent", "_user")


def executed_chains(calls: DataFrame, env: Environment, start: dict, shard: str, chain: str, order: str, patterns: tuple[str, ...] = GROUNDING_PATTERNS, starts: DataFrame | None = None) -> DataFrame:
    """Runs each chain of a shard's state in order and rolls it back: (shard, chain, n_calls, n_domain_errors, stopped_at, content, is_valid, reached, restored).

    calls: (shard, chain, order, name, arguments[, requestor]). A chain stops at its first grounding error (one whose
    content fits a pattern); other errors are the domain's and are passed over. reached is the digest of the state where
    the chain ended, restored the one after rollback, from which the shard's next chain starts."""
    grounding = re.compile("|".join(f"({p})" for p in patterns), re.IGNORECASE)
    out = ["n_calls", "n_domain_errors", "stopped_at", "content", "is_valid", "reached", "restored"]
    schema = _fields(calls, [shard, chain]) + f", n_calls bigint, n_domain_errors bigint, stopped_at {calls.schema[order].dataType.simpleString()}, content string, is_valid boolean, reached string, restored string"
    rows = _runs(calls, [shard, chain], order, None)
    if starts is not None:
        least = calls.groupBy(shard).agg(F.min(chain).alias(chain), F.min(order).alias(order))
        rows = rows.unionByName(starts.select(shard, "data").join(least, shard), allowMissingColumns=True)
    rows = rows.repartition(shard).sortWithinPartitions(shard, F.col("data").isNull(), chain, order)

    def digest(state: dict) -> str:
        return hashlib.sha256((state_digest(state[AGENT]) + state_digest(state[USER])).encode()).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, saved, now, done = None, {}, "", None, []

        def close() -> None:
            nonlocal state, now
            if now is not None:
                reached, state = digest(state), json.loads(saved)
                done.append((*now["key"], now["n"], now["domain"], now["stop"], now["content"], now["stop"] is None, reached, digest(state)))
            now = None

        def frame_of() -> pd.DataFrame:
            made = pd.DataFrame(done, columns=[shard, chain, *out])
            done.clear()
            return made.astype({"stopped_at": "Int64"}) if "stopped_at bigint" in schema or "stopped_at int" in schema else made

        for frame in frames:
            keys = list(frame[[shard, chain]].itertuples(index=False, name=None))
            for key, place, r in zip(keys, frame[order], frame.itertuples(), strict=True):
                if key[0] != at:
                    close()
                    at, state = key[0], begin(start)
                    saved = json.dumps(state)
                if r.data is not None:
                    state = merged(state, json.loads(r.data))
                    saved = json.dumps(state)
                    continue
                if now is None or now["key"] != key:
                    close()
                    now = {"key": key, "n": 0, "domain": 0, "stop": None, "content": None}
                if now["stop"] is not None:
                    continue
                content, error = env.respond(state, r.name, r.requestor, r.arguments)
                now["n"] += 1
                if error and grounding.search(content):
                    now |= {"stop": place, "content": content}
                else:
                    now["domain"] += error
            if done:
                yield frame_of()
        close()
        if done:
            yield frame_of()

    return rows.mapInPandas(run, schema)
