"""Keyed state in batch form: rate limits, job states, answer streams, conversation guards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import render as R
from claimweave.functions import text as T

LIMIT, WINDOW_SECONDS = 20, 60.0


def accept(times: np.ndarray, limit: int, window: float, recent: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which turns at the given times are let through, and the accepted times still in the window.

    A turn is refused when ``limit`` accepted ones are younger than ``window`` seconds; refused turns
    don't count.
    """
    kept, out = list(recent or ()), []
    for t in times:
        kept = [k for k in kept if t - k < window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(float(t))
    return out, kept


def _limit_sorted(limit: int, window: float):
    """Rows come sorted by (session, at): one session's accepted times are all that is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, recent = None, []
        for frame in frames:
            frame = frame.reset_index(drop=True)
            allowed = np.zeros(len(frame), dtype=bool)
            keys = frame["session"].to_numpy()
            cuts = [0, *(i for i in range(1, len(frame)) if keys[i] != keys[i - 1]), len(frame)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if keys[lo] != session:
                        session, recent = keys[lo], []
                    allowed[lo:hi], recent = accept(frame["at"].to_numpy()[lo:hi], limit, window, recent)
            yield frame.assign(allowed=allowed)

    return run


def rate_limit(turns: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> DataFrame:
    """Turns ``(session, turn_id, at)`` (seconds) with ``allowed``.

    The recurrence needs a session's turns in order, so they are sorted by key inside partitions and
    streamed; memory is one session's window, however long the session is.
    """
    rows = turns.select("session", "turn_id", "at").repartition("session").sortWithinPartitions("session", "at", "turn_id")
    return rows.mapInPandas(_limit_sorted(limit, window), f"{rows.schema.simpleString()[7:-1].replace(':', ' ')}, allowed boolean")


def latest_jobs(events: DataFrame) -> DataFrame:
    """The newest state of each job."""
    rest = [c for c in events.columns if c != "job_id"]
    return events.groupBy("job_id").agg(F.max_by(F.struct(*rest), "seq").alias("state")).select("job_id", "state.*")


def replay_answers(events: DataFrame) -> DataFrame:
    """Final text of each turn of an answer stream ``(turn_id, seq, event, data)``.

    A retry discards the tokens before it; ``failed`` tells whether an error came.
    """
    last = Window.partitionBy("turn_id")
    rows = events.withColumn("retry_at", F.max(F.when(F.col("event") == "retry", F.col("seq"))).over(last))
    live = F.when((F.col("event") == "token") & (F.col("seq") > F.coalesce("retry_at", F.lit(-1))), F.struct("seq", "data"))
    done = rows.groupBy("turn_id").agg(F.array_sort(F.collect_list(live)).alias("tokens"), F.bool_or(F.col("event") == "error").alias("failed"), F.count_if(F.col("event") == "retry").alias("retries"))
    return done.select("turn_id", F.array_join(F.transform("tokens", lambda x: x["data"]), "").alias("answer"), "failed", "retries")


def answer_parts(events: DataFrame, most: int = R.PART_BYTES) -> DataFrame:
    """The answers of :func:`replay_answers` in parts ``(turn_id, start, part, text)`` of bounded size, for turns of any length; joined by nothing."""
    retried = events.filter("event = 'retry'").groupBy("turn_id").agg(F.max("seq").alias("retry_at"))
    tokens = events.filter("event = 'token'").join(retried, "turn_id", "left").filter("retry_at IS NULL OR seq > retry_at")
    return R.as_text_parts(tokens, F.col("data"), ["turn_id"], [F.col("seq")], "", most)


def parse_sse(bodies: DataFrame) -> DataFrame:
    """Events of raw event streams ``(stream_id, body)``: frames between blank lines; those without data drop out."""
    frames = bodies.select("stream_id", F.posexplode(F.split("body", r"\r?\n\r?\n")).alias("seq", "frame"))
    lines = F.split("frame", r"\r?\n")
    value = lambda name: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(f"{name}:"))), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    parsed = frames.select("stream_id", "seq", F.coalesce(F.get(value("event"), 0), F.lit("message")).alias("event"), F.array_join(value("data"), "\n").alias("data"))
    return parsed.filter(F.try_parse_json(F.col("data")).isNotNull())


def last_user_message(turns: DataFrame) -> DataFrame:
    """Each conversation's last message of a user; empty without one."""
    user = F.col("role").isin("user", "human")
    return turns.groupBy("conv_id").agg(F.coalesce(F.max_by(F.when(user, F.coalesce("text", F.lit(""))), F.when(user, F.col("turn"))), F.lit("")).alias("message"))


def guard_input(messages: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Messages with ``allowed``, ``category`` and ``reason``: blank and overlong ones are off topic."""
    reason = F.when(T.strip(F.col("message")) == "", "empty message").when(F.length("message") > max_chars, "message too long")
    return messages.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("category", F.when(F.col("reason") == "", "ok").otherwise("off_topic")).withColumn("allowed", F.col("reason") == "")


# Categories of a message in the order in which an answer is searched for them.
CATEGORIES = ["other_company", "investment_advice", "off_topic", "injection", "ok"]


def category_of(answers: DataFrame) -> DataFrame:
    """Answers of a guard model with the first category that they name; none means ok."""
    said = F.lower("answer")
    found = F.coalesce(*(F.when(F.contains(said, F.lit(c)), F.lit(c)) for c in CATEGORIES), F.lit("ok"))
    return answers.withColumn("category", found).withColumn("allowed", found == "ok")


def final_answers(drafts: DataFrame, fallback: str, max_retries: int = 1) -> DataFrame:
    """Drafts ``(draft, retrieved, retries)`` with ``grounded`` and what to do: answer, retry or fall back."""
    rows = drafts.withColumn("grounded", T.grounded(F.col("draft"), F.col("retrieved"))).withColumn("cited_ids", F.array_sort(T.citations(F.col("draft"))))
    step = F.when(F.col("grounded"), "answer").when(F.col("retries") < max_retries, "retry").otherwise("fallback")
    return rows.withColumn("step", step).withColumn("answer", F.when(F.col("step") == "answer", F.col("draft")).when(F.col("step") == "fallback", F.lit(fallback)))


def sessions_of(turns: DataFrame) -> DataFrame:
    """Turns ``(user, seq, ticker)`` with a session number: another ticker opens another session."""
    order = Window.partitionBy("user").orderBy("seq")
    changed = F.coalesce(F.lag("ticker").over(order) != F.col("ticker"), F.lit(True)).cast("int")
    return turns.withColumn("changed", changed).withColumn("session_no", F.sum("changed").over(order)).drop("changed")
