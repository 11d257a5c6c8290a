"""Replay of recorded tool calls on a state, and completions from a provider.

A trajectory is a state machine, so each (task, simulation) group replays in one
Pandas group; a group is one conversation, bounded by the run's step limit.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Tool = Callable[[dict, dict], object]


def merged(base: dict, update: dict) -> dict:
    """update laid over base: objects merge key by key, lists and scalars are replaced."""
    out = dict(base)
    for k, v in update.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def state_digest(state: dict) -> str:
    return hashlib.sha256(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()


def dispatch(tools: dict[str, Tool], name: str, state: dict, arguments: dict) -> tuple[str, bool]:
    """(content, error): exceptions and unknown tools become error contents."""
    try:
        if name not in tools:
            raise ValueError(f"Tool '{name}' not found.")
        result = tools[name](state, arguments)
        return (result if isinstance(result, str) else json.dumps(result, sort_keys=True, default=str)), False
    except Exception as error:
        return f"Error: {error}", True


def replay(calls: DataFrame, tools: dict[str, Tool], start: dict, group: list[str], order: str, check: bool = False) -> DataFrame:
    """calls (group, order, name, arguments as JSON[, expected]) -> (group, digest, n_calls, n_errors, mismatch).

    check compares each content with the recorded one (expected); the first that differs is in mismatch."""
    schema = ", ".join(f"`{c}` {calls.schema[c].dataType.simpleString()}" for c in group) + ", digest string, n_calls bigint, n_errors bigint, mismatch bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, errors, mismatch = json.loads(json.dumps(start)), 0, None
        rows = pdf.sort_values(order)
        for i, row in enumerate(rows.itertuples()):
            content, error = dispatch(tools, row.name, state, json.loads(row.arguments or "{}"))
            errors += error
            if check and mismatch is None and row.expected is not None and row.expected != content:
                mismatch = i
        head = {c: [rows[c].iloc[0]] for c in group}
        return pd.DataFrame(head | {"digest": [state_digest(state)], "n_calls": [len(rows)], "n_errors": [errors], "mismatch": pd.array([mismatch], dtype="Int64")})

    return calls.groupBy(*group).applyInPandas(run, schema)


def completions(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Answers of a model, replayed: requests with the completion recorded under the same key, null where there is none.

    Equal requests are looked up once."""
    asked = requests.select(key).distinct().join(responses.select(key, "completion"), key, "left")
    return requests.join(asked, key, "left")


class Registry:
    """Named things; a name is given once."""

    def __init__(self) -> None:
        self._items: dict[str, object] = {}

    def register(self, name: str, item: object) -> None:
        if name in self._items:
            raise ValueError(f"{name} is registered already")
        self._items[name] = item

    def get(self, name: str) -> object:
        if name not in self._items:
            raise KeyError(f"nothing is registered as {name}")
        return self._items[name]

    def names(self) -> list[str]:
        return sorted(self._items)
