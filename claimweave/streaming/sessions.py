"""Chat sessions as keyed state of a stream: turns outlive the driver, another company opens a new conversation, idle ones expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session string, conversation int, ticker string, seq long, turns int, event string"
HEAD = "conversation int, ticker string, seen long"
TURN = "role string, text string"


class Sessions(StatefulProcessor):
    """State of a session: its conversation's number and company, when it was last seen, and its turns by ``seq``.

    Conversations count upwards from 0 and so does nothing else: a turn for another company, or after the session has
    been idle for ``idle`` seconds of event time, begins a new one without turns. A turn that comes again replaces itself.
    """

    def __init__(self, idle: float):
        self.idle = int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.turns = handle.getMapState("turns", "seq long", TURN)

    def _new(self, conversation: int, ticker: str | None, seen: int) -> None:
        self.turns.clear()
        self.head.update((conversation, ticker, seen))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["seq"], kind="stable")  # one micro-batch of one session
        out = []
        for row in frame.itertuples():
            at = int(row.at.value // 1_000_000)
            conversation, ticker, seen = self.head.get() if self.head.exists() else (-1, None, 0)
            if conversation < 0 or ticker != row.ticker or at - seen >= self.idle:
                conversation, seen = conversation + 1, 0
                self._new(conversation, row.ticker, at)
                event = "opened"
            else:
                event = "turn"
            self.turns.updateValue((int(row.seq),), (row.role, row.text))
            self.head.update((conversation, row.ticker, max(seen, at)))
            out.append((key[0], conversation, row.ticker, int(row.seq), sum(1 for _ in self.turns.keys()), event))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self.head.get()[2] + self.idle)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        conversation, ticker, seen = self.head.get()
        n = sum(1 for _ in self.turns.keys())
        self._new(conversation, None, seen)  # the number stays, so that the next conversation has another
        yield pd.DataFrame([(key[0], conversation, ticker, None, n, "expired")], columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def session_stream(turns: DataFrame, idle: float = 3600.0, late: str = "1 minute") -> DataFrame:
    """Streamed turns ``(session, seq, ticker, role, text, at)`` as events: ``opened``, ``turn`` and ``expired``, with the number of turns held.

    Needs the RocksDB state store. Turns later than ``late`` behind the newest are dropped.
    """
    timed = turns.select("session", "seq", "ticker", "role", "text", "at").withWatermark("at", late)
    return timed.groupBy("session").transformWithStateInPandas(Sessions(idle), OUTPUT, outputMode="Append", timeMode="EventTime")


def held_turns(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The turns that the state behind a checkpoint holds: ``(session, seq, role, text)``; the query needn't run."""
    rows = spark.read.format("statestore").option("stateVarName", "turns").load(checkpoint)
    return rows.select(F.col("key.session").alias("session"), F.col("user_map_key.seq").alias("seq"), "user_map_value.role", "user_map_value.text")
