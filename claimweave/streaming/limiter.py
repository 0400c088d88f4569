"""The sliding-window rate limiter as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimweave.operators.stateful import LIMIT, WINDOW_SECONDS, accept

OUTPUT = "session long, turn_id long, at double, allowed boolean"


class Limiter(StatefulProcessor):
    """State of a session: the accepted times of its last window, at most ``limit`` of them."""

    def __init__(self, limit: int = LIMIT, window: float = WINDOW_SECONDS):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", T.StructType([T.StructField("at", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "turn_id"])  # one micro-batch of one session
        held = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        allowed, kept = accept(frame["at"].to_numpy(), self.limit, self.window, held)
        self.recent.put([(t,) for t in kept])
        yield frame[["session", "turn_id", "at"]].assign(allowed=allowed)

    def close(self) -> None:
        pass


def limit_stream(turns: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> DataFrame:
    """Streamed turns ``(session, turn_id, at)`` with ``allowed``; needs the RocksDB state store."""
    return turns.groupBy("session").transformWithStateInPandas(Limiter(limit, window), OUTPUT, outputMode="Append", timeMode="None")
