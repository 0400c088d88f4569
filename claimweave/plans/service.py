"""The query service: parameterised reads for one company, and the grounded chat loop around them.

A :class:`CompanyTools` is bound to one ticker when it is made; no call takes another one.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import judgement as J
from claimweave.functions import text as T
from claimweave.operators import graph as G
from claimweave.operators import search as S
from claimweave.operators.graph import Graph
from claimweave.operators.stateful import CATEGORIES, accept

NO_HITS = "No matching claims found."


class Page(list):
    """Rows of a read; ``more`` says whether rows follow, which ``after`` of the next call skips to."""

    def __init__(self, rows: list[Row], size: int, after: int):
        super().__init__(rows[:size])
        self.more, self.next = len(rows) > size, after + min(len(rows), size)


def within(spark: SparkSession, seconds: float, work: Callable[[], Any]) -> Any:
    """What ``work`` returns; after ``seconds`` its Spark jobs are cancelled and TimeoutError is raised."""
    tag, late = f"turn-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        out = work()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from error
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    if late.is_set():
        raise TimeoutError(f"stopped after {seconds} s")
    return out


def format_hits(rows: list[Row]) -> str:
    """Search hits as lines for a model."""
    tag = {True: "SYNTHETIC DEMO DATA", False: "real filing"}
    return "\n".join(f'[{r.claim_id}] {r.date} — {r.speaker} [{tag[r.source_type == "synthetic"]}] (topic: {r.topic}): "{r.quote_span}"' for r in rows) or NO_HITS


@dataclass
class CompanyTools:
    """The reads that a chat about one company may use; results are a page of rows, not tables."""

    graph: Graph
    ticker: str
    embed: Callable[[str], list[float]] | None = None
    vectors: DataFrame | None = None
    page: int = 50

    def _own(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("ticker") == self.ticker)

    def _page(self, df: DataFrame, after: int) -> Page:
        return Page((df.offset(after) if after else df).limit(self.page + 1).collect(), self.page, after)

    def list_topics(self, after: int = 0) -> Page:
        return self._page(self._own(G.topic_counts(self.graph)), after)

    def get_claim_timeline(self, topic: str, after: int = 0) -> Page:
        return self._page(self._own(G.claim_timeline(self.graph)).filter(F.col("topic") == topic), after)

    def get_contradictions(self, min_severity: str = "low", after: int = 0) -> Page:
        return self._page(self._own(G.contradictions(self.graph, J.severities_at_least(min_severity))), after)

    def list_speakers(self, after: int = 0) -> Page:
        return self._page(self._own(G.speaker_counts(self.graph)), after)

    def owns(self, claim_id: str) -> bool:
        return not self._own(G.claims_of_companies(self.graph)).filter(F.col("claim_id") == claim_id).isEmpty()

    def semantic_search(self, query: str, limit: int = 8) -> tuple[list[Row], bool]:
        """Hits, and whether they come from the keyword search because the vector search failed."""
        try:
            if self.embed is None or self.vectors is None:
                raise LookupError("no vector index")
            spark = self.vectors.sparkSession
            asked = spark.createDataFrame([(0, self.ticker, self.embed(query))], "query_id int, ticker string, q_vector array<float>")
            return S.vector_topk(self.vectors, asked, limit).orderBy("rank").collect(), False
        except (LookupError, OSError, PySparkException):  # no index, or one that doesn't answer: keywords still work
            terms = self.graph.claims.sparkSession.range(1).select(T.keywords(F.lit(query)).alias("k")).first().k
            return self._own(G.keyword_search(self.graph, terms, limit)).orderBy("nth").collect(), True


@dataclass
class Session:
    """What a chat keeps: its company, its accepted turns and its messages."""

    ticker: str
    recent: list[float] = field(default_factory=list)
    messages: list[tuple[str, str]] = field(default_factory=list)

    def record_turn(self, now: float, limit: int = 20, window: float = 60.0) -> bool:
        allowed, self.recent = accept([now], limit, window, self.recent)
        return allowed[0]


@dataclass
class Sessions:
    """Sessions by id; a known id with another company opens a new session."""

    held: dict[str, Session] = field(default_factory=dict)

    def get_or_create(self, session_id: str | None, ticker: str) -> tuple[str, Session]:
        known = self.held.get(session_id or "")
        if known is not None and known.ticker == ticker:
            return session_id, known
        fresh = f"s{len(self.held):06d}"
        self.held[fresh] = Session(ticker)
        return fresh, self.held[fresh]


REFUSALS = {"off_topic": "I can only answer questions about this company's documents."}


def refusal(category: str, messages: dict[str, str] | None = None) -> str:
    known = messages or REFUSALS
    return known.get(category) or known.get("off_topic", REFUSALS["off_topic"])


def category_of(answer: str) -> str:
    """The first category that a guard model's answer names; none means ok."""
    return next((c for c in CATEGORIES if c in answer.lower()), "ok")


def check_grounding(spark: SparkSession, draft: str, retrieved: list[str]) -> tuple[bool, list[str]]:
    """Whether a draft cites retrieved claims only, and which it cites."""
    row = spark.createDataFrame([(draft, retrieved)], "draft string, retrieved array<string>").select(T.grounded(F.col("draft"), F.col("retrieved")).alias("ok"), F.array_sort(T.citations(F.col("draft"))).alias("ids")).first()
    return row.ok, row.ids


def answer_turn(tools: CompanyTools, question: str, guard: Callable[[str], str], synthesise: Callable[[str, list[Row]], str], fallback: str = "I could not ground an answer in the documents.", retries: int = 1) -> Iterator[tuple[str, object]]:
    """Events of one chat turn: guard, retrieval, draft, grounding check, at most one retry, fallback."""
    verdict = tools.graph.claims.sparkSession.createDataFrame([(question,)], "message string")
    from claimweave.operators.stateful import guard_input

    state = guard_input(verdict).first()
    category = category_of(guard(question)) if state.allowed else state.category
    if category != "ok":
        yield "refused", {"category": category, "answer": refusal(category)}
        return
    hits, degraded = tools.semantic_search(question)
    yield "retrieved", {"claims": [h.claim_id for h in hits], "degraded": degraded}
    for attempt in range(retries + 1):
        draft = synthesise(question, hits)
        grounded, cited = check_grounding(tools.graph.claims.sparkSession, draft, [h.claim_id for h in hits])
        if grounded:
            yield "answer", {"answer": draft, "cited_ids": cited}
            return
        if attempt < retries:
            yield "retry", {"cited_ids": cited}
    yield "answer", {"answer": fallback, "cited_ids": []}


def _timed(spark: SparkSession, events: Iterator[tuple[str, object]], seconds: float) -> Iterator[tuple[str, object]]:
    """The events, then ``done``; when ``seconds`` have passed since the first was asked for, ``error`` in place of what is left.

    What is under way then is cancelled with its Spark jobs; time that the reader takes between events counts, too.
    """
    end = time.monotonic() + seconds
    try:
        while (event := within(spark, max(0.01, end - time.monotonic()), lambda: next(events, None))) is not None:
            yield event
    except TimeoutError:
        yield "error", {"message": f"stopped after {seconds:g} s"}
    except Exception as error:  # noqa: BLE001 - a reader of events gets an end in every case
        yield "error", {"message": f"{type(error).__name__}: {error}"[:300]}
    yield "done", {}


def turn_events(tools: CompanyTools, question: str, guard: Callable[[str], str], synthesise: Callable[[str, list[Row]], str], seconds: float = 150.0, **options: Any) -> Iterator[tuple[str, object]]:
    """The events of :func:`answer_turn` under a time limit: ``error`` after it, and ``done`` at the end in every case."""
    return _timed(tools.graph.claims.sparkSession, answer_turn(tools, question, guard, synthesise, **options), seconds)


def _summary(graph: Graph, ticker: str, synthesise: Callable[[str], Iterator[str]]) -> Iterator[tuple[str, object]]:
    row = G.company_summaries(graph).filter(F.col("ticker") == ticker).first()
    if row is None:
        yield "error", {"message": "no claims of this company"}
        return
    said = []
    for token in synthesise(row.context):
        said.append(token)
        yield "token", {"text": token}
    _, cited = check_grounding(graph.claims.sparkSession, "".join(said), [])
    for claim_id in cited:
        yield "citation", {"claim_id": claim_id}


def summary_events(graph: Graph, ticker: str, synthesise: Callable[[str], Iterator[str]], seconds: float = 150.0) -> Iterator[tuple[str, object]]:
    """A company's summary as a stream: tokens of what ``synthesise`` makes of its context, the claims it cites, then ``done``."""
    return _timed(graph.claims.sparkSession, _summary(graph, ticker, synthesise), seconds)


def as_rows(turn_id: str, events: Iterator[tuple[str, object]]) -> Iterator[tuple[str, int, str, str]]:
    """Events as rows ``(turn_id, seq, event, data)`` of the log that can be replayed; ``data`` is a token's text, else JSON."""
    for seq, (event, data) in enumerate(events):
        yield turn_id, seq, event, data["text"] if event == "token" else json.dumps(data)
