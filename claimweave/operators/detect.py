"""Contradiction detection: candidate pairs, their order, verdicts, and the edges that follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.judgement import judgement, severity_order
from claimweave.operators.graph import Graph, claims_of_companies, spoken_rows
from claimweave.operators.inference import Client, infer

_SIDE = ["id", "date", "speaker", "source", "doctype", "period", "quote", "stance", "value"]


def _side(g: Graph, side: str) -> DataFrame:
    """Claims with their company, topic, document and speaker, named for one side of a pair."""
    own = ["date", "source_type", "doc_type", "quote_span", "stance", "value_numeric"]
    if g.owned is not None:
        rows = spoken_rows(g, [*own, "period"])
    else:
        rows = spoken_rows(g, own).join(g.documents.select("document_id", "period"), "document_id")
    named = ["claim_id", "date", "speaker", "source_type", "doc_type", "period", "quote_span", "stance", "value_numeric"]
    return rows.select("ticker", "topic", F.col("document_id").alias(f"{side}_document"), *(F.col(c).alias(f"{side}_{n}") for c, n in zip(named, _SIDE)))


def candidate_pairs(g: Graph) -> DataFrame:
    """Pairs of claims of one company and topic from different documents, each pair once (a_id < b_id).

    An equi-join on (ticker, topic) with the inequality as its residual condition. Pairs are quadratic
    in a group's size by nature, since each pair is an answer; skewed groups are split by AQE.
    """
    pairs = _side(g, "a").join(_side(g, "b"), ["ticker", "topic"]).filter("a_id < b_id AND a_document <> b_document")
    return pairs.drop("a_document", "b_document")


def leading_claims(rows: DataFrame, most: int) -> DataFrame:
    """Of ``(ticker, topic, source, document, id)``: all rows that can stand in the first ``most`` pairs of their company and topic.

    Pairs are claims ``a < b`` of different documents, in the order of (a, b), as far as their two sources suit (any symmetric
    rule). In a (source, document) the first ``2 * most`` ids are enough, since of the claims up to the last ``a`` wanted those with a
    partner are ``most`` at most and come first. Of the rest, those of one source up to that ``a`` either have a partner
    (``most`` ids), or stand in one document (``2 * most``), or have its id; and ``most`` follow. So ``4 * most + 1`` ids of a source are enough.
    Spark takes both ranks in the tasks before it shuffles (below spark.sql.optimizer.windowGroupLimitThreshold, 1000).
    """
    in_document = F.dense_rank().over(Window.partitionBy("ticker", "topic", "source", "document").orderBy("id"))
    in_source = F.dense_rank().over(Window.partitionBy("ticker", "topic", "source").orderBy("id"))
    few = rows.withColumn("nth", in_document).filter(F.col("nth") <= 2 * most).drop("nth")
    return few.withColumn("nth", in_source).filter(F.col("nth") <= 4 * most + 1).drop("nth")


def leading_pairs(g: Graph, most: int) -> DataFrame:
    """Pairs as those of :func:`candidate_pairs`, among them the first ``most`` of each company, topic and kind of sources.

    Their number grows with ``most`` and the number of sources, not with a group's claims. They carry ids, documents,
    speakers and sources only; :func:`with_texts` adds the rest.
    """
    rows = _side(g, "c").select("ticker", "topic", F.col("c_source").alias("source"), F.col("c_document").alias("document"), F.col("c_id").alias("id"), F.col("c_speaker").alias("speaker"))
    few = leading_claims(rows, most).distinct()  # a row stands for all that are equal to it
    side = lambda s: few.select("ticker", "topic", *(F.col(c).alias(f"{s}_{c}") for c in ("document", "id", "speaker", "source")))
    return side("a").join(side("b"), ["ticker", "topic"]).filter("a_id < b_id AND a_document <> b_document")


def with_texts(pairs: DataFrame, g: Graph) -> DataFrame:
    """Ranked pairs ``(ticker, nth)`` of :func:`leading_pairs` with the columns of :func:`candidate_pairs`."""
    named = pairs.drop("a_source", "b_source")
    for s in "ab":
        named = named.join(_side(g, s), ["ticker", "topic", f"{s}_document", f"{s}_id", f"{s}_speaker"])
    columns = ["ticker", "topic", *(f"{s}_{c}" for s in "ab" for c in _SIDE), "nth"]
    return named.dropDuplicates(["ticker", "nth"]).select(columns)


def _order(pairs: DataFrame) -> list[str]:
    return ["topic", "a_id", "b_id", "a_speaker", "b_speaker", *(c for c in ("a_document", "b_document") if c in pairs.columns)]


def prioritise(pairs: DataFrame, max_pairs: int = 40, cross_source_only: bool = True) -> DataFrame:
    """The first ``max_pairs`` pairs of each company: cross-source ones first, then by topic."""
    cross = F.col("a_source") != F.col("b_source")
    if cross_source_only:
        pairs = pairs.filter(cross)
    order = Window.partitionBy("ticker").orderBy(F.when(cross, 0).otherwise(1), *_order(pairs))
    return pairs.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max_pairs)


def prioritise_auto(pairs: DataFrame, max_pairs: int = 15) -> DataFrame:
    """As :func:`prioritise`, cross-source only for companies that have a synthetic claim in a pair."""
    cross = F.coalesce(F.col("a_source") != F.col("b_source"), F.lit(False))
    synthetic = F.coalesce((F.col("a_source") == "synthetic") | (F.col("b_source") == "synthetic"), F.lit(False))
    # the first of each of four kinds are enough, and show whether a company has a synthetic claim in a pair; the pairs are made once
    kinds = pairs.withColumns({"cross_": cross, "synthetic_": synthetic})
    kind = Window.partitionBy("ticker", "cross_", "synthetic_").orderBy(*_order(pairs))
    few = kinds.withColumn("nth", F.row_number().over(kind)).filter(F.col("nth") <= max_pairs).drop("nth")
    kept = few.withColumn("has_", F.bool_or("synthetic_").over(Window.partitionBy("ticker"))).filter("NOT has_ OR cross_")
    return prioritise(kept.drop("cross_", "synthetic_", "has_"), max_pairs, cross_source_only=False)


def first_pairs(g: Graph, max_pairs: int = 40, cross_source_only: bool = True) -> DataFrame:
    """:func:`prioritise` of all pairs, without making them all."""
    return with_texts(prioritise(leading_pairs(g, max_pairs), max_pairs, cross_source_only), g)


def first_pairs_auto(g: Graph, max_pairs: int = 15) -> DataFrame:
    """:func:`prioritise_auto` of all pairs, without making them all."""
    return with_texts(prioritise_auto(leading_pairs(g, max_pairs), max_pairs), g)


def rule_judgement() -> Column:
    """A model's stand-in: stances that differ contradict, gravely if the values differ widely. ``(contradicts, severity, reasoning)``, as :func:`judgement` reads them."""
    gap = F.abs(F.col("a_value") - F.col("b_value"))
    differ = F.coalesce(F.col("a_stance") != F.col("b_stance"), F.lit(False))
    severity = F.when(~differ, "none").when(gap >= 40000, "high").when(gap >= 15000, "medium").otherwise("low")
    reasoning = F.coalesce(F.concat(F.col("a_stance"), F.lit(" against "), F.col("b_stance")), F.lit(""))
    return F.struct(differ.alias("contradicts"), severity.alias("severity"), reasoning.alias("reasoning"))


def judge_pairs(pairs: DataFrame, call: Callable[[dict], str] | Client | None = None, **calls) -> DataFrame:
    """Pairs with ``contradicts``, ``severity`` and ``reasoning``; by rule, or by a model's ``call``. A call that fails confirms nothing.

    The rule's verdict is columns from the start; only a model's answer is JSON that has to be read.
    """
    if call is None:
        return pairs.withColumn("verdict", rule_judgement()).select(*pairs.columns, "verdict.*")
    answered = infer(pairs, call, "string", **calls).withColumn("answer", F.coalesce("answer", F.concat(F.lit("error: "), "error")))
    return answered.withColumn("verdict", judgement(F.col("answer"))).select(*pairs.columns, "verdict.*")


def confirmed_rows(judged: DataFrame, least: str = "low") -> DataFrame:
    """Contradictions of ``least`` severity or graver, in no order."""
    return judged.filter(F.col("contradicts") & (severity_order(F.col("severity")) >= {"low": 1, "medium": 2, "high": 3}[least]))


def confirmed(judged: DataFrame, least: str = "low") -> DataFrame:
    """Contradictions of ``least`` severity or graver, the gravest first in each company."""
    return confirmed_rows(judged, least).orderBy("ticker", F.desc(severity_order(F.col("severity"))), "a_id", "b_id")


def replace_for_companies(edges: DataFrame, new: DataFrame, g: Graph, tickers: DataFrame) -> DataFrame:
    """All edges after the given companies' edges are replaced by ``new``.

    An edge belongs to the company of its a claim. New edges need both claims; of edges with the same
    ends one stays, the new one.
    """
    scope = claims_of_companies(g).join(tickers, "ticker", "left_semi").select(F.col("claim_id").alias("a_id")).distinct()
    known = g.claims.select("claim_id")
    sound = new.join(known.withColumnRenamed("claim_id", "a_id"), "a_id", "left_semi").join(known.withColumnRenamed("claim_id", "b_id"), "b_id", "left_semi")
    sound = sound.dropDuplicates(["a_id", "b_id"]).select(edges.columns)
    kept = edges.join(scope, "a_id", "left_anti").join(sound.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    return kept.select(edges.columns).unionByName(sound)


def replace_for_owners(linked: DataFrame, new: DataFrame, tickers: DataFrame) -> DataFrame:
    """:func:`replace_for_companies` over a graph's ``linked`` table, by its ``ticker``, where ``new`` are pairs of those companies' own claims.

    Such edges have both claims, and none has the ends of an edge that stays, as a claim has one company.
    """
    kept = linked.join(tickers, "ticker", "left_anti").select(new.columns)
    return kept.unionByName(new.dropDuplicates(["a_id", "b_id"]))
