"""Environments: toolkits, dispatch in both modes, replays and chains against plain loops."""

import copy
import hashlib
import json
import random
import sys
from datetime import date

import pytest
from pyspark import cloudpickle

from tessera.operators import environments
from tessera.operators.environments import Environment, Toolkit, tool
from tessera.operators.replay import merged, state_digest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't have this file on their path


class Base(Toolkit):
    @tool("read")
    def get(state, key):
        if key not in state:
            raise ValueError(f"{key} not found")
        return state[key]

    @tool("think")
    def think(state, thought):
        return ""


class Desk(Base):
    @tool("write")
    def put(state, key, value):
        if value == 0:
            raise ValueError("zero is against the policy")
        state[key] = value
        return {"put": value, "on": date(2024, 5, 1), "ok": True, "all": [1, None]}

    def helper(state):
        raise AssertionError("no tool")


class Phone(Toolkit):
    @tool("write")
    def ring(state):
        state["rings"] = state.get("rings", 0) + 1
        return state["rings"]


def test_toolkits_collect_inherited_tools():
    assert Desk.kinds() == {"get": "read", "think": "think", "put": "write"}
    assert Base.kinds() == {"get": "read", "think": "think"}
    with pytest.raises(ValueError):
        tool("other")


def test_dispatch_by_requestor_and_mode():
    both, solo, alone = Environment(Desk, Phone), Environment(Desk, Phone, solo=True), Environment(Desk)
    state = environments.begin({})
    assert both.respond(state, "ring", "user", None) == ('"1"', False)
    assert both.respond(state, "ring", "assistant", None) == ("Error: Tool 'ring' not found.", True)
    assert solo.respond(state, "ring", "assistant", None) == ('"2"', False)
    assert solo.respond(state, "ring", "user", None) == ("Error: User tool calls are not allowed in solo mode", True)
    assert alone.respond(state, "ring", "user", None) == ("Error: User tools not available", True)
    assert Environment(None).respond(state, "get", "assistant", None) == ("Error: Tools not available", True)
    assert both.respond(state, "get", "someone", None) == ("Error: Invalid requestor: someone", True)
    assert both.respond(state, "put", "assistant", '{"key": "a", "value": 2}')[0] == '{"put": "2", "on": "2024-05-01", "ok": "True", "all": ["1", null]}'
    assert both.respond(state, "put", "assistant", '{"key": "a"}')[0].startswith("Error: ") and both.respond(state, "get", "assistant", "no json")[1]
    assert both.respond(state, "helper", "assistant", None) == ("Error: Tool 'helper' not found.", True)
    assert state == {"assistant": {"a": 2}, "user": {"rings": 2}}

    class Loud(Desk):
        @tool()
        def ring(state):
            return "?"

    Environment(Loud, Phone)
    with pytest.raises(ValueError, match="overlap"):
        Environment(Loud, Phone, solo=True)


def made(seed, runs, n):
    rng = random.Random(seed)
    rows = []
    for r in range(runs):
        for k in range(rng.randrange(1, n)):
            name = rng.choice(["get", "put", "put", "ring", "think", "nothing"] if rng.random() < 0.8 else ["put"])
            args = {"get": {"key": rng.choice("abc")}, "put": {"key": rng.choice("abc"), "value": rng.randrange(4)}, "think": {"thought": "x"}}.get(name, {})
            rows.append((r % 3, r, k, name, "user" if name == "ring" and rng.random() < 0.7 else "assistant", json.dumps(args)))
    return rows


ENV, START = Environment(Desk, Phone), {"assistant": {"a": 1}}
SCHEMA = "task bigint, run bigint, k bigint, name string, requestor string, arguments string"


def slow_run(calls, data, expected=None):
    state, errors, mismatch = merged(environments.begin(START), data), 0, None
    for n, (_, _, k, name, who, args) in enumerate(calls):
        content, error = ENV.respond(state, name, who, args)
        errors += error
        if mismatch is None and expected and k in expected and expected[k] != content:
            mismatch = n
    return state, errors, mismatch


def test_gold_matches_equal_plain_loops(spark):
    rows, gold = made(1, 24, 12), [(t, 0, *rest) for t, r, *rest in made(2, 2, 6)]
    rows += [(0, 50, *g[2:]) for g in gold if g[0] == 0] + [(1, 51, 0, "get", "assistant", '{"key": "a"}'), (7, 60, 0, "get", "assistant", '{"key": "a"}'), (7, 61, 0, "ring", "user", "{}")]
    starts = {0: {"user": {"rings": 5}}, 1: {"assistant": {"a": {"x": 1}}}}
    frame = lambda rs: spark.createDataFrame(rs, SCHEMA).repartition(4)
    data = spark.createDataFrame([(t, json.dumps(d)) for t, d in starts.items()], "task bigint, data string")
    got = environments.gold_matches(frame(rows), frame(gold).drop("run"), ENV, START, "task", "run", "k", data).collect()
    ends = {t: slow_run(sorted(g for g in gold if g[0] == t), starts.get(t, {}))[0] for t in range(8)}
    assert len(got) == len({r[1] for r in rows}) and {r.db_match for r in got} == {True, False}
    for r in got:
        state, errors, _ = slow_run(sorted(x for x in rows if x[1] == r.run), starts.get(r.task, {}))
        assert (r.n_errors, r.agent_digest, r.user_digest) == (errors, state_digest(state["assistant"]), state_digest(state["user"]))
        assert (r.agent_match, r.user_match) == (state["assistant"] == ends[r.task]["assistant"], state["user"] == ends[r.task]["user"])


def test_mismatches_compare_json(spark):
    calls = [(0, "put", '{"key": "b", "value": 2}', '{"all":["1",null],"put":"2","ok":"True","on":"2024-05-01"}'), (1, "get", '{"key": "b"}', None), (2, "get", '{"key": "b"}', '"3"'), (3, "get", '{"key": "b"}', '"4"')]
    df = spark.createDataFrame([("r", *c) for c in calls] + [("s", *c) for c in calls[:2]], "run string, k int, name string, arguments string, expected string")
    assert {r.run: (r.mismatch, r.n_calls) for r in environments.replay_runs(df, ENV, START, ["run"], "k").collect()} == {"r": (2, 4), "s": (None, 2)}


def test_chains_roll_back(spark):
    rows = made(3, 40, 9)
    starts = {1: {"assistant": {"b": 9}}}
    data = spark.createDataFrame([(t, json.dumps(d)) for t, d in starts.items()], "task bigint, data string")
    got = environments.executed_chains(spark.createDataFrame(rows, SCHEMA).repartition(5), ENV, START, "task", "run", "k", starts=data).collect()
    digest = lambda s: hashlib.sha256((state_digest(s["assistant"]) + state_digest(s["user"])).encode()).hexdigest()
    assert len(got) == len({r[1] for r in rows}) and {r.is_valid for r in got} == {True, False}
    for r in got:
        first = merged(environments.begin(START), starts.get(r.task, {}))
        state, n, domain, stop = copy.deepcopy(first), 0, 0, None
        for _, _, k, name, who, args in sorted(x for x in rows if x[1] == r.run):
            content, error = ENV.respond(state, name, who, args)
            n += 1
            if error and "not found" in content:
                stop = k
                break
            domain += error
        assert (r.n_calls, r.n_domain_errors, r.stopped_at, r.is_valid, r.reached, r.restored) == (n, domain, stop, stop is None, digest(state), digest(first))
