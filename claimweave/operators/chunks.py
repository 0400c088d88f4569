"""Chunks: blocks of documents in sections, their selection by topic, claims and their quotes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import judgement as J
from claimweave.functions import text as T
from claimweave.operators.inference import Client, infer, opened


def segment(blocks: DataFrame) -> DataFrame:
    """Chunks of blocks ``(document_id, pos, kind, tag, text)`` in document order.

    A heading opens a section; what comes before the first one is section 0 without a heading. Empty
    blocks don't count.
    """
    text = F.when(F.col("kind") == "table", F.col("text")).otherwise(T.normalise(F.col("text")))
    rows = blocks.withColumn("text", text).filter("text <> ''")
    rows = rows.withColumn("is_heading", (F.col("kind") != "table") & T.is_heading(F.col("tag"), F.col("text")))
    order = Window.partitionBy("document_id").orderBy("pos")
    rows = rows.withColumn("opened", F.sum(F.col("is_heading").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("front", F.first("is_heading").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("ordinal", (F.col("opened") - F.col("front").cast("int")).cast("int"))
    inside = Window.partitionBy("document_id", "ordinal").orderBy("pos")
    rows = rows.withColumn("paragraph_index", (F.row_number().over(inside) - 1).cast("int")).withColumn("section_id", T.section_id(F.col("ordinal")))
    heading = F.first(F.when(F.col("is_heading"), F.col("text"))).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kind = F.when(F.col("kind") == "table", "table").when(F.col("is_heading"), "heading").otherwise("paragraph")
    return rows.select(
        T.chunk_id(F.col("document_id"), F.col("section_id"), F.col("paragraph_index")).alias("chunk_id"), "document_id", "section_id", "ordinal",
        F.coalesce(heading, F.lit("")).alias("heading"), "paragraph_index", "text", kind.alias("chunk_type"), "is_heading", F.length("text").alias("char_len"),
    )


def speaker_turns(lines: DataFrame) -> DataFrame:
    """Turns of lines ``(document_id, pos, page, bold, x0, y0, x1, y1, text)``.

    A bold line "Name, Role" without a final full stop opens a turn; lines before the first and turns
    without lines are dropped. A turn has the first page and the box of all its lines.
    """
    rows = lines.withColumn("text", T.collapse(F.col("text"))).filter("text <> ''")
    name, role = (F.trim(F.regexp_extract("text", T.SPEAKER_PATTERN, i)) for i in (1, 2))
    opens = F.col("bold") & F.col("text").rlike(T.SPEAKER_PATTERN) & ~F.col("text").endswith(".")
    order = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("opens", opens).withColumn("turn", F.sum(F.col("opens").cast("int")).over(order)).filter("turn > 0")
    body = F.filter(F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("pos", "text", "page")))), lambda x: x.isNotNull())
    sides = [f(F.when(~F.col("opens"), F.col(c))).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    turns = rows.groupBy("document_id", "turn").agg(F.max(F.when(F.col("opens"), name)).alias("speaker"), F.max(F.when(F.col("opens"), role)).alias("role"), body.alias("body"), *sides).filter(F.size("body") > 0)
    numbered = turns.withColumn("ordinal", (F.row_number().over(Window.partitionBy("document_id").orderBy("turn")) - 1).cast("int"))
    return numbered.select("document_id", "ordinal", "speaker", "role", T.collapse(F.array_join(F.transform("body", lambda x: x["text"]), " ")).alias("text"), F.get("body", 0)["page"].alias("page"), F.array("x0", "y0", "x1", "y1").alias("bbox"))


def select_chunks(chunks: DataFrame, documents: DataFrame, terms: list[str], min_len: int = 80, tables: bool = False, max_chunks: int | None = None) -> DataFrame:
    """Chunks worth extracting from: long enough and on a topic; of synthetic documents all paragraphs.

    ``max_chunks`` counts in document order; none or 0 means all.
    """
    allowed = ["paragraph", "table"] if tables else ["paragraph"]
    relevant = F.col("text").rlike(T.topic_pattern(terms))
    real = F.col("chunk_type").isin(allowed) & ~F.col("is_heading") & (F.col("char_len") >= min_len) & relevant
    typed = chunks.join(documents.select("document_id", "source_type"), "document_id")
    kept = typed.filter(F.when(F.col("source_type") == "synthetic", F.col("chunk_type") == "paragraph").otherwise(real))
    if max_chunks:
        order = Window.partitionBy("document_id").orderBy("ordinal", "paragraph_index")
        kept = kept.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max_chunks).drop("nth")
    return kept


def with_phrase(chunks: DataFrame, phrases: list[str]) -> DataFrame:
    """Paragraphs and tables that contain one of the phrases, in any case."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(F.lower("text"), F.lit(p.lower()))
    return chunks.filter(F.col("chunk_type").isin("paragraph", "table") & found)


def validate_quotes(claims: DataFrame) -> DataFrame:
    """Claims ``(…, text, quote_span)`` with the span made verbatim, and ``valid``."""
    span = T.verbatim_span(F.col("text"), F.col("quote_span"))
    return claims.withColumn("found", span).withColumn("valid", F.col("found").isNotNull()).withColumn("quote_span", F.coalesce("found", "quote_span")).drop("found")


def last_of_each(claims: DataFrame) -> DataFrame:
    """Of raw claims with equal (chunk_id, topic, quote_span) the last attempt's, at the first one's place."""
    key = Window.partitionBy("chunk_id", "topic", "quote_span")
    rows = claims.withColumn("place", F.min("seq").over(key)).withColumn("nth", F.row_number().over(key.orderBy(F.desc("seq"))))
    return rows.filter("nth = 1").drop("nth")


def verbatim_piece(text: str, quote: str) -> str | None:
    """The piece of ``text`` that a quote stands for: itself, or its words with other white space between."""
    words, plain = quote.split(), quote.strip()
    if not words or plain in text:
        return plain or None
    tokens = [m.span() for m in re.finditer(r"\S+", text)]
    for i in range(len(tokens) - len(words) + 1):
        (a, b), (y, z) = tokens[i], tokens[i + len(words) - 1]
        if text[:b].endswith(words[0], a) and text.startswith(words[-1], y) and all(text[p:q] == w for (p, q), w in zip(tokens[i + 1 :], words[1:-1])):
            return text[b - len(words[0]) : y + len(words[-1])]
    return None


def canonical_claim(raw: dict) -> dict:
    """A model's claim under its canonical keys: of several keys for a field the first that isn't empty counts."""
    value = raw.get("value_numeric")
    named = {field: next((str(raw[k]) for k in keys if raw.get(k)), "") for field, keys in (("topic", J.TOPIC_KEYS), ("quote_span", J.QUOTE_KEYS), ("claim_text", J.CLAIM_KEYS))}
    return named | {k: raw.get(k) or "" for k in ("stance", "speaker", "role")} | {"value_numeric": float(value) if isinstance(value, (int, float)) else None}


def claims_of(text: str, call: Callable[[str, int], list[dict]], topics: list[str], retries: int = 2) -> list[dict]:
    """A model's claims about a text, asked for again while quotes fail, ``retries`` + 1 times at most.

    ``call`` takes the text and the attempt. Claims of unknown topics or without a quote don't count. Quotes are made verbatim
    (:func:`verbatim_piece`); claims whose quote the text doesn't hold are dropped, of equal ones the last stays.
    """
    kept: dict[tuple, dict] = {}
    for attempt in range(retries + 1):
        asked = [c for c in map(canonical_claim, call(text, attempt)) if c["topic"] in topics and c["quote_span"]]
        good = [c | {"quote_span": piece} for c in asked if (piece := verbatim_piece(text, c["quote_span"]))]
        kept |= {(c["topic"], c["quote_span"]): c for c in good}
        if len(good) == len(asked):
            break
    return [c | {"attempts": attempt + 1} for c in kept.values()]


def extracted(chunks: DataFrame, call: Callable[[str, int], list[dict]] | Client, topics: list[str], retries: int = 2, **calls) -> DataFrame:
    """``(chunk_id, document_id, answer, error)``: the claims of each chunk, or why there are none (:func:`~.inference.infer`)."""

    def make() -> Callable[[dict], list[dict]]:
        client = opened(call)
        return lambda row: claims_of(row["text"], client, topics, retries)

    return infer(chunks.select("chunk_id", "document_id", "text"), Client(make), CLAIM_LIST, **calls).drop("text")


def claims_in(answers: DataFrame) -> DataFrame:
    """The claims of :func:`extracted` as rows; chunks whose call failed have none."""
    one = answers.filter("error IS NULL").select("chunk_id", "document_id", F.explode("answer").alias("claim"))
    return one.select(*(f"claim.{c}" if c not in ("chunk_id", "document_id") else c for c in (f.split()[0] for f in EXTRACTED.split(", "))))


CLAIM_LIST = "array<struct<attempts:int,topic:string,quote_span:string,claim_text:string,stance:string,speaker:string,role:string,value_numeric:double>>"
EXTRACTED = "chunk_id string, document_id string, attempts int, topic string, quote_span string, claim_text string, stance string, speaker string, role string, value_numeric double"


def manifest(chunks: DataFrame) -> DataFrame:
    """Sections and chunks of each document, by type."""
    paragraphs = F.count_if(F.col("chunk_type") == "paragraph")
    return chunks.groupBy("document_id").agg(F.countDistinct("section_id").alias("n_sections"), F.count(F.lit(1)).alias("n_chunks"), paragraphs.alias("n_paragraphs"), F.count_if(F.col("chunk_type") == "table").alias("n_tables"))


def flatten_documents(documents: DataFrame) -> DataFrame:
    """Chunks of stored documents (``schemas.DOCUMENT_JSON``) with their section's ordinal and heading."""
    sections = documents.select("document_id", F.posexplode("sections").alias("s_pos", "s"))
    rows = sections.select("s.ordinal", "s.heading", "s_pos", F.posexplode("s.chunks").alias("c_pos", "c"))
    return rows.select("c.*", "ordinal", "heading", "s_pos", "c_pos")


def pick_documents(documents: DataFrame, everything: bool = False, synthetic_only: bool = False) -> DataFrame:
    """Synthetic documents and the newest 10-K of each company; or all; or synthetic ones only."""
    if everything:
        return documents
    synthetic = documents.filter("source_type = 'synthetic'")
    if synthetic_only:
        return synthetic
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"), "document_id")
    annual = documents.filter("source_type <> 'synthetic' AND doc_type = '10-K'").withColumn("nth", F.row_number().over(newest)).filter("nth = 1").drop("nth")
    return synthetic.unionByName(annual)
