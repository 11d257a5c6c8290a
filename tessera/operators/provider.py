"""Completions from a model: bounded parallel requests in the tasks, with back-off.

Spark deals distinct requests to tasks; each task keeps ``parallel`` of them in
flight and answers come back in their rows. A client is made once for each task by a
function of no arguments that can be pickled; it takes a payload and returns the
completion, or raises. Nothing here knows a network: tests and queries use stubs,
``tessera.operators.replay.completions`` replays recorded answers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK, GONE_WRONG, TOO_MANY = 200, 500, 429
#: Statuses of errors that another try does not mend.
FINAL = (400, 401, 403, 404)
GAVE_UP = "maximum number of retries exceeded"


class ProviderError(Exception):
    """An answer of the provider that is none, with its status."""

    def __init__(self, status: int, message: str = "") -> None:
        super().__init__(message)
        self.status, self.message = status, message


@dataclass(frozen=True)
class Settings:
    """Defaults of a request, and how long to try: tries, seconds in all, the first wait (which doubles)."""

    model: str = ""
    temperature: float = 0.0
    max_tokens: int = 1024
    tries: int = 10
    seconds: float = 300
    wait: float = 1.0

    def payload(self, prompt: str, system: str | None = None, model: str | None = None, temperature: float | None = None, max_tokens: int | None = None) -> dict:
        """What the client gets. Values that are missing or 0 take the default."""
        messages = [{"role": "system", "content": system}] if system else []
        return {"model": model or self.model, "temperature": temperature or self.temperature, "max_tokens": max_tokens or self.max_tokens, "messages": [*messages, {"role": "user", "content": prompt}]}


def asked(client: Callable[[dict], str], payload: dict, settings: Settings, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> tuple[int, str, str | None, int]:
    """(status, completion, error, tries) of one request."""
    began, wait = clock(), settings.wait
    for n in range(1, settings.tries + 1):
        try:
            return OK, client(payload), None, n
        except Exception as error:
            status = error.status if isinstance(error, ProviderError) else None
            if status in FINAL:
                return status, "", error.message, n
            if n == settings.tries or clock() - began + wait > settings.seconds:
                if status == TOO_MANY:
                    return status, "", GAVE_UP, n
                return (status, "", error.message, n) if status else (GONE_WRONG, "", f"Unexpected error: {error}", n)
        sleep(wait)
        wait *= 2
    raise ValueError("tries must be one or more")


ANSWER = "status int, completion string, error string, tries int"
OPTIONS = {"system": "string", "model": "string", "temperature": "double", "max_tokens": "int"}


def completed(requests: DataFrame, make_client: Callable[[], Callable[[dict], str]], prompt: str = "prompt", settings: Settings = Settings(), parallel: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests with status, completion, error and tries. Equal requests (prompt and options alike) are asked once.

    Optional columns of requests: system, model, temperature, max_tokens."""
    by = [prompt, *[c for c in OPTIONS if c in requests.columns]]
    distinct = requests.select(*by).distinct()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema) + ", " + ANSWER

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        with ThreadPoolExecutor(parallel) as pool:
            for frame in frames:
                rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
                loads = [settings.payload(r[prompt], **{c: r[c] for c in by[1:]}) for r in rows]
                answers = list(pool.map(lambda x: asked(client, x, settings, sleep), loads))
                yield frame.assign(**{c: [a[i] for a in answers] for i, c in enumerate(("status", "completion", "error", "tries"))})

    answers = distinct.mapInPandas(run, schema)
    names = {c: f"_a_{c}" for c in by}
    same = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(names[c]))
        same = one if same is None else same & one
    return requests.join(answers.withColumnsRenamed(names), same, "left").drop(*names.values())
