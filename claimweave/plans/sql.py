"""DuckDB SQL of the query catalogue: the graph and text relations as common table expressions."""

from __future__ import annotations

GRAPH = r"""
claims AS (SELECT left(sha1(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'))), 16) AS claim_id, l_orderkey::VARCHAR AS document_id, p_brand AS topic, l_suppkey::VARCHAR AS speaker_id, p_name || ' at ' || l_quantity::BIGINT::VARCHAR AS claim_text, p_type || ' ' || l_returnflag AS quote_span, l_returnflag AS stance, l_extendedprice AS value_numeric, strftime(l_shipdate, '%Y-%m-%d') AS date, CASE WHEN l_linestatus = 'O' THEN 'synthetic' ELSE 'real' END AS source_type, 'line ' || l_linenumber AS doc_type FROM lineitem JOIN part ON p_partkey = l_partkey),
docs AS (SELECT o_orderkey::VARCHAR AS document_id, CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '10-Q' END AS doc_type, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Q' || quarter(o_orderdate) || ' FY' || year(o_orderdate) AS period, CASE WHEN o_orderpriority LIKE '1%' THEN 'synthetic' ELSE 'real' END AS source_type, o_custkey::VARCHAR AS ticker FROM orders),
topics AS (SELECT p_brand AS topic, 'Brand ' || p_brand AS name, min(p_type) AS description FROM part GROUP BY p_brand),
speakers AS (SELECT s_suppkey::VARCHAR AS speaker_id, s_name AS speaker, 'nation ' || s_nationkey AS role FROM supplier),
owned AS (SELECT c.*, d.ticker, d.period FROM claims c JOIN docs d USING (document_id)),
spoken AS (SELECT o.*, s.speaker, s.role FROM owned o JOIN speakers s USING (speaker_id)),
named AS (SELECT s.*, t.name, t.description FROM spoken s JOIN topics t USING (topic)),
leads AS (SELECT *, lead(claim_id) OVER w AS n_id, lead(stance) OVER w AS n_stance, lead(value_numeric) OVER w AS n_value, lead(document_id) OVER w AS n_document FROM owned WINDOW w AS (PARTITION BY ticker, topic ORDER BY date, claim_id)),
edges AS (SELECT least(claim_id, n_id) AS a_id, greatest(claim_id, n_id) AS b_id, CASE WHEN abs(value_numeric - n_value) >= 40000 THEN 'high' WHEN abs(value_numeric - n_value) >= 15000 THEN 'medium' ELSE 'low' END AS severity, stance || ' against ' || n_stance AS reasoning, date AS judged_at, 'rule' AS judged_by FROM leads WHERE n_id IS NOT NULL AND n_stance <> stance AND n_document <> document_id),
topic_counts AS (SELECT ticker, topic, name, description, count(*) AS claims, sum(CASE WHEN source_type = 'synthetic' THEN 1 ELSE 0 END)::BIGINT AS synthetic FROM named GROUP BY ALL),
contra AS (SELECT a.ticker, b.topic, b.name AS topic_name, e.severity, e.reasoning, e.judged_at, a.claim_id AS a_id, a.date AS a_date, a.speaker AS a_speaker, a.source_type AS a_source, a.quote_span AS a_quote, b.claim_id AS b_id, b.date AS b_date, b.speaker AS b_speaker, b.source_type AS b_source, b.quote_span AS b_quote FROM edges e JOIN named a ON a.claim_id = e.a_id JOIN named b ON b.claim_id = e.b_id),
pairs AS (SELECT a.ticker, a.topic, a.claim_id AS a_id, a.date AS a_date, a.speaker AS a_speaker, a.source_type AS a_source, a.doc_type AS a_doctype, a.period AS a_period, a.quote_span AS a_quote, a.stance AS a_stance, a.value_numeric AS a_value, b.claim_id AS b_id, b.date AS b_date, b.speaker AS b_speaker, b.source_type AS b_source, b.doc_type AS b_doctype, b.period AS b_period, b.quote_span AS b_quote, b.stance AS b_stance, b.value_numeric AS b_value FROM spoken a JOIN spoken b ON a.ticker = b.ticker AND a.topic = b.topic AND a.claim_id < b.claim_id AND a.document_id <> b.document_id),
both_ways AS (SELECT a_id AS claim_id, b_id AS partner, severity FROM edges UNION ALL SELECT b_id, a_id, severity FROM edges)
"""

_SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{b}]+"
_PLAIN = rf"trim(regexp_replace(translate(line, '’‘“”–—', '''''\"\"--'), '{_SPACES}', ' ', 'g'))".replace('\\"', '"')

TEXT = rf"""
lines AS (SELECT doc_id::VARCHAR AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
blocks AS (SELECT document_id, pos, line, contains(line, ' | ') AS is_table, length(line) - length(replace(line, ' ', '')) <= 2 AND NOT contains(line, ',') AS short, {_PLAIN} AS plain FROM lines),
typed AS (SELECT document_id, pos, CASE WHEN is_table THEN line ELSE plain END AS text, is_table, NOT is_table AND (short OR regexp_matches(plain, '^\s*(item\s+[0-9]+[a-z]?\.|part\s+[ivx]+\b)', 'i')) AS is_heading FROM blocks WHERE CASE WHEN is_table THEN line ELSE plain END <> ''),
opened AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY document_id ORDER BY pos) - first_value(is_heading::INT) OVER (PARTITION BY document_id ORDER BY pos) AS ordinal FROM typed),
chunks AS (SELECT document_id || '#s' || lpad(ordinal::INT::VARCHAR, 3, '0') || '#p' || (row_number() OVER w - 1) AS chunk_id, document_id, 's' || lpad(ordinal::INT::VARCHAR, 3, '0') AS section_id, ordinal::INT AS ordinal, coalesce(first_value(CASE WHEN is_heading THEN text END) OVER w, '') AS heading, (row_number() OVER w - 1)::INT AS paragraph_index, text, CASE WHEN is_table THEN 'table' WHEN is_heading THEN 'heading' ELSE 'paragraph' END AS chunk_type, is_heading, length(text)::INT AS char_len FROM opened WINDOW w AS (PARTITION BY document_id, ordinal ORDER BY pos)),
tdocs AS (SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'synthetic' ELSE 'real' END AS source_type, CASE WHEN doc_id % 3 = 0 THEN '10-K' ELSE '10-Q' END AS doc_type, '2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-01' AS date, source AS ticker, lang FROM documents)
"""


def graph_sql(select: str, more: str = "") -> str:
    return f"WITH {GRAPH}{', ' + more if more else ''} {select}"


def text_sql(select: str, more: str = "") -> str:
    return f"WITH {TEXT}{', ' + more if more else ''} {select}"
