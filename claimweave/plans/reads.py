"""The service's reads as SQL over the graph's tables, with bound parameters: values never become part of the text."""

from __future__ import annotations

from dataclasses import fields
from typing import Any

from pyspark.sql import DataFrame

from claimweave.operators.graph import Graph

_OF_COMPANY = "{filed_by} f JOIN {appears_in} d ON d.document_id = f.document_id JOIN {claims} c ON c.claim_id = d.claim_id"
_ABOUT = "JOIN {about} ab ON ab.claim_id = c.claim_id JOIN {topics} t ON t.id = ab.topic_id"
_SPOKEN = "JOIN {made} m ON m.claim_id = c.claim_id JOIN {speakers} s ON s.speaker_id = m.speaker_id"
_GRAVITY = "CASE e.severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"

#: Reads by name; ``{table}`` is a table of the graph, ``:name`` a parameter.
READS = {
    "topics": f"""
        SELECT t.id AS topic, t.name, t.description, count(*) AS claims, count_if(c.source_type = 'synthetic') AS synthetic
        FROM {_OF_COMPANY} {_ABOUT} WHERE f.ticker = :ticker GROUP BY t.id, t.name, t.description ORDER BY claims DESC, topic""",
    "timeline": f"""
        SELECT c.date, s.name AS speaker, s.role, c.source_type AS source, c.doc_type, c.stance, c.claim_text, c.quote_span AS quote, c.claim_id
        FROM {_OF_COMPANY} JOIN {{about}} ab ON ab.claim_id = c.claim_id {_SPOKEN} WHERE f.ticker = :ticker AND ab.topic_id = :topic
        ORDER BY c.date NULLS LAST, c.claim_id, speaker""",
    "speakers": f"""
        SELECT s.name AS speaker, s.role, count(*) AS claims FROM {_OF_COMPANY} {_SPOKEN} WHERE f.ticker = :ticker
        GROUP BY s.name, s.role ORDER BY claims DESC, speaker, s.role""",
    "contradictions": f"""
        SELECT t.id AS topic, t.name AS topic_name, e.severity, e.reasoning, e.judged_at, e.a_id, e.b_id, a.quote_span AS a_quote, b.quote_span AS b_quote
        FROM {{contradictions}} e JOIN {{claims}} a ON a.claim_id = e.a_id JOIN {{claims}} b ON b.claim_id = e.b_id
        JOIN {{appears_in}} d ON d.claim_id = e.a_id JOIN {{filed_by}} f ON f.document_id = d.document_id
        JOIN {{about}} ab ON ab.claim_id = e.b_id JOIN {{topics}} t ON t.id = ab.topic_id
        WHERE f.ticker = :ticker AND array_contains(:severities, e.severity) ORDER BY {_GRAVITY}, topic, e.a_id, e.b_id""",
    "keyword": f"""
        SELECT c.claim_id, c.date, s.name AS speaker, c.source_type, t.id AS topic, c.quote_span,
               size(filter(:terms, w -> contains(lower(c.quote_span), w) OR contains(lower(c.claim_text), w) OR contains(lower(t.name), w))) AS score
        FROM {_OF_COMPANY} {_ABOUT} {_SPOKEN} WHERE f.ticker = :ticker
        AND exists(:terms, w -> contains(lower(c.quote_span), w) OR contains(lower(c.claim_text), w) OR contains(lower(t.name), w))
        ORDER BY score DESC, c.date DESC NULLS FIRST, c.claim_id, speaker LIMIT :limit""",
    "owns": f"SELECT count(*) > 0 AS owns FROM {_OF_COMPANY} WHERE f.ticker = :ticker AND c.claim_id = :claim_id",
}


def read(graph: Graph, name: str, **values: Any) -> DataFrame:
    """The rows of a read for the given parameters."""
    sql = READS[name]
    tables = {f.name: getattr(graph, f.name) for f in fields(graph) if f"{{{f.name}}}" in sql}
    return graph.claims.sparkSession.sql(sql, args=values, **tables)
