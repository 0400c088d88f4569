"""Model calls as one operator: a client once a partition, some calls at a time, retries with pauses, errors as a column."""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words in the type or text of an error after which the same call may succeed.
TRANSIENT_WORDS = (
    "timeout", "timed out", "connection", "connect error", "temporarily", "unavailable", "reset by peer", "broken pipe", "eof",
    "rate limit", "ratelimit", "overloaded", "too many requests", "502", "503", "504", "429", "remote end closed",
)


def is_transient(error: BaseException) -> bool:
    """Whether an error says that the network or the service was in the way, not the request."""
    said = f"{type(error).__name__}: {error}".lower()
    return any(word in said for word in TRANSIENT_WORDS)


@dataclass(frozen=True)
class Retry:
    """At most ``tries`` calls; between them ``first`` seconds, doubled each time up to ``longest``, and up to a quarter more."""

    tries: int = 3
    first: float = 1.5
    longest: float = 20.0
    transient: Callable[[BaseException], bool] = is_transient
    wait: Callable[[float], Any] = time.sleep

    def pauses(self) -> Iterator[float]:
        pause = self.first
        for _ in range(self.tries - 1):
            yield min(self.longest, pause) * random.uniform(1, 1.25)
            pause *= 2

    def __call__(self, work: Callable[[], Any]) -> Any:
        """What ``work`` returns. Errors that another try wouldn't mend, and the last one, go through."""
        for pause in self.pauses():
            try:
                return work()
            except Exception as error:
                if not self.transient(error):
                    raise
            self.wait(pause)
        return work()


@dataclass(frozen=True)
class Client:
    """A model behind ``make``, which is called once in each partition's task, as connections can't travel."""

    make: Callable[[], Callable]


def opened(call: Callable | Client) -> Callable:
    return call.make() if isinstance(call, Client) else call


def infer(rows: DataFrame, call: Callable[[dict], Any] | Client, answer: str, at_once: int = 8, retry: Retry = Retry()) -> DataFrame:
    """``rows`` with ``answer`` (of the given type) and ``error``: one of them is null.

    ``call`` takes a row as a dict. ``at_once`` calls of a task are under way at a time, and as many answers wait at
    most, so memory doesn't grow with the partition. A call that fails after its retries gives an error in its
    row and nothing else. The calls are made again wherever Spark computes the result again: keep it if it is used twice.
    """
    kept = T.StructType([*rows.schema, *T.StructType.fromDDL(f"answer {answer}, error string")])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                if not len(frame):
                    continue
                client = client or opened(call)
                waiting: deque[Future] = deque()
                answers, errors = [], []

                def settle() -> None:
                    try:
                        answers.append(waiting.popleft().result())
                        errors.append(None)
                    except Exception as error:  # noqa: BLE001 - one bad row must not end the job
                        answers.append(None)
                        errors.append(f"{type(error).__name__}: {error}")

                for row in frame.to_dict("records"):
                    if len(waiting) == at_once:
                        settle()
                    waiting.append(pool.submit(retry, lambda row=row: client(row)))
                while waiting:
                    settle()
                yield frame.assign(answer=pd.Series(answers, index=frame.index, dtype=object), error=pd.Series(errors, index=frame.index, dtype=object))

    return rows.mapInPandas(ask, kept)
