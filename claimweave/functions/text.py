"""Text expressions: normalisation, ids, citations, keywords, verbatim spans.

Java's ``\\s`` is ASCII only, so patterns that are to see all white space say ``(?U)``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a keyword search.
STOPWORDS = """
a about all also an and any anything are as at be been but by can did do does everything for from had has have how
i if in into is it its me my no not of on or our say said says she so some something than that the their them then
there these they this was we were what when where which who why will with would you your
""".split()

# What marks a section heading, and a cited claim id.
HEADING_PATTERN = r"(?iU)^\s*(item\s+\d+[a-z]?\.|part\s+[ivx]+\b)"
CITATION_PATTERN = r"\[([0-9a-f]{16})\b"
SPEAKER_PATTERN = r"^([^,]{2,60}),(?U:\s+)(.{2,80})$"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends (no-break spaces count, marks stay)."""
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalise(text: Column) -> Column:
    """:func:`collapse`, with typographic quotes and dashes made plain."""
    return collapse(F.translate(text, "\u2019\u2018\u201c\u201d\u2013\u2014", "''\"\"--"))


def is_heading(tag: Column, text: Column) -> Column:
    """Whether a block is a heading: h1 to h6, or text like "Item 1A." or "Part II"."""
    return F.coalesce(tag.rlike("^h[1-6]$"), F.lit(False)) | text.rlike(HEADING_PATTERN)


def claim_id(chunk_id: Column, topic: Column, quote: Column) -> Column:
    """First 16 hex digits of the SHA-1 of chunk, topic and quote."""
    return F.substring(F.sha1(F.concat_ws("|", chunk_id, topic, quote).cast("binary")), 1, 16)


def speaker_id(ticker: Column, name: Column) -> Column:
    return F.concat(ticker, F.lit("::"), name)


def section_id(ordinal: Column) -> Column:
    return F.format_string("s%03d", ordinal)


def chunk_id(document_id: Column, section: Column, index: Column) -> Column:
    return F.concat(document_id, F.lit("#"), section, F.lit("#p"), index.cast("string"))


def safe_name(name: Column) -> Column:
    """A document id as a file name."""
    return F.translate(name, "/:", "__")


def base_name(path: Column) -> Column:
    """Last part of a path written on any system."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def source_tag(source_type: Column) -> Column:
    return F.when(source_type == "synthetic", "SYNTHETIC DEMO DATA").otherwise("real filing")


def citations(text: Column) -> Column:
    """Distinct cited claim ids in the order of their first appearance; full-width brackets count."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\u3010\u3011\uff3b\uff3d", "[][]")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(CITATION_PATTERN), 1))


def grounded(text: Column, retrieved: Column) -> Column:
    """Whether an answer is not blank and cites nothing that was not retrieved."""
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    return ~blank & (F.size(F.array_except(citations(text), F.coalesce(retrieved, F.array().cast("array<string>")))) == 0)


def keywords(query: Column) -> Column:
    """Lower-case content words of a query, repeats included."""
    words = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9']+"), 0)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def matched_terms(terms: Column, *texts: Column) -> Column:
    """The terms that one of the texts contains, case-folded."""

    def hit(w: Column) -> Column:
        found = F.lit(False)
        for t in texts:
            found = found | F.contains(F.lower(t), w)
        return found

    return F.filter(terms, hit)


def topic_pattern(terms: list[str]) -> str:
    """One pattern for all terms as whole words, in any case."""
    quoted = "|".join(re.sub(r"([^\w\s])", r"\\\1", t.lower()) for t in sorted({t for t in terms if t}))
    return rf"(?iU)\b(?:{quoted})\b" if quoted else "(?!)"


def verbatim_span(source: Column, span: Column) -> Column:
    """The piece of ``source`` that a quoted span stands for, or null.

    The span itself if it occurs; else the first place where its words follow each other with any
    white space between.
    """
    plain = strip(F.coalesce(span, F.lit("")))
    quoted = F.transform(F.split(plain, r"(?U)[\s\x1c-\x1f]+"), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    loose = F.call_function("regexp_extract", source, F.array_join(quoted, r"(?U:[\s\x1c-\x1f]+)"), F.lit(0))
    return F.when((plain == "") | source.isNull(), None).when(F.contains(source, plain), plain).otherwise(F.when(loose != "", loose))


def quote_parts(text: Column, quote: Column) -> Column:
    """``(before, mark, after)`` of a quote inside a text; without the quote all is ``before``."""
    at = F.instr(text, quote)
    found = (at > 0) & (quote != "")
    return F.struct(
        F.when(found, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("before"),
        F.when(found, quote).otherwise("").alias("mark"),
        F.when(found, F.substring(text, at + F.length(quote), F.length(text))).otherwise("").alias("after"),
    )


def pretty_date(date: Column) -> Column:
    """An ISO date as ``May 4, 2026``; anything else as it is."""
    return F.coalesce(F.date_format(F.try_to_date(date), "MMM d, yyyy"), date)
