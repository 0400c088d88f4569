"""Rows as lines of text for a model, and the prompts around them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from claimweave.functions.text import source_tag, strip


# The formats of the lines below are fixed values: readers and models know them.


def or_na(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("n/a"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def topic_line() -> Column:
    more = F.when(F.col("synthetic") > 0, F.concat(F.lit(", "), F.col("synthetic"), F.lit(" synthetic"))).otherwise("")
    return F.concat(F.lit("- "), _text("topic"), F.lit(" ("), _text("name"), F.lit("): "), F.col("claims"), F.lit(" claims"), more)


def speaker_line() -> Column:
    return F.concat(F.lit("- "), _text("speaker"), F.lit(" ("), or_na(F.col("role")), F.lit("): "), F.col("claims"), F.lit(" claims"))


def timeline_line() -> Column:
    return F.format_string('[%s] %s \u2014 %s (%s), %s [%s]: "%s" (stance: %s)', "claim_id", _text("date"), _text("speaker"), or_na(F.col("role")), _text("doc_type"), source_tag(F.col("source")), _text("quote"), _text("stance"))


def contradiction_text() -> Column:
    side = lambda s: F.format_string(f'  {s.upper()} [%s] (%s, %s, %s): "%s"', f"{s}_id", _text(f"{s}_date"), _text(f"{s}_speaker"), source_tag(F.col(f"{s}_source")), _text(f"{s}_quote"))
    head = F.format_string("%s \u2014 severity %s: %s", _text("topic_name"), _text("severity"), _text("reasoning"))
    return F.concat_ws("\n", head, side("a"), side("b"))


def as_text(rows: DataFrame, line: Column, by: list[str], order: list[Column], separator: str = "\n") -> DataFrame:
    """One text of all lines of each group, in the order given."""
    named = rows.select(*by, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), line.alias("line")).alias("l"))
    return named.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), separator).alias("text"))


#: Bytes of a part of a long text, at most.
PART_BYTES = 1 << 20
#: Characters of a line that count in its order, where the order given leaves ties.
TIE_CHARS = 64


def _part_batches(by: list[str], separator: str, most: int):
    """Rows come sorted by (by, start, line): the lines of a group, put together while they fit."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, group, start, lines, size, nth = len(separator.encode()), None, None, [], 0, 0
        out, schema, waiting = [], None, 0

        def put() -> None:
            nonlocal waiting
            if lines:
                out.append((*group, start, nth, separator.join(lines)))
                waiting += size

        def batch_of_parts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            kept = [batch.schema.field(c) for c in (*by, "start")]
            schema = pa.schema([*kept, pa.field("part", pa.int32()), pa.field("text", pa.string())])
            for *key, first, line in zip(*(batch.column(c).to_pylist() for c in (*by, "start", "line"))):
                n = len(line.encode("utf-8", "surrogatepass"))
                if tuple(key) != group or size + joint + n > most:
                    put()
                    nth = nth + 1 if tuple(key) == group else 0
                    group, start, lines, size = tuple(key), first, [line], n
                else:
                    lines.append(line)
                    size += joint + n
                if waiting >= 8 * most:
                    yield batch_of_parts()
                    out, waiting = [], 0
        put()
        if out:
            yield batch_of_parts()

    return parts


def as_text_parts(rows: DataFrame, line: Column, by: list[str], order: list[Column], separator: str = "\n", most: int = PART_BYTES) -> DataFrame:
    """:func:`as_text` in parts ``(by, start, part, text)`` of at most ``most`` bytes; a longer line is a part of its own.

    Lines are dealt by ranges of (by, order), so a group of any size is spread over tasks, and no task holds more
    than a few parts. A group's parts in the order of (start, part), joined by the separator, are its whole
    text: ``start`` is the order of a part's first line, ``part`` numbers those that follow it in its task. Null lines drop out, ties go by the line.
    """
    keys = [o.alias(f"o{i}") for i, o in enumerate(order)]
    named = rows.select(*by, *keys, line.alias("line")).filter("line IS NOT NULL").withColumn("tie", F.left("line", F.lit(TIE_CHARS)))
    places = [*by, *(f"o{i}" for i in range(len(order))), "tie"]
    dealt = named.repartitionByRange(*places).sortWithinPartitions(*places, "line")
    marked = dealt.select(*by, F.struct(*places[len(by) :]).alias("start"), "line")
    schema = marked.drop("line").schema.add("part", IntegerType()).add("text", StringType())
    return marked.mapInArrow(_part_batches(by, separator, most), schema)


def whole_texts(parts: DataFrame, by: list[str], separator: str = "\n") -> DataFrame:
    """The texts of :func:`as_text_parts` put together again, where they are known to be short."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "part", "text")))
    return parts.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), separator).alias("text"))


def period_suffix(period: Column) -> Column:
    return F.when(F.coalesce(period, F.lit("")) != "", F.concat(F.lit(", reporting period: "), period)).otherwise("")


def judge_prompt() -> Column:
    """What a model is asked about a candidate pair."""

    def side(s: str) -> Column:
        head = F.format_string(f"STATEMENT {s.upper()} [%s %s %s%s, speaker: %s]:", _text(f"{s}_source"), _text(f"{s}_doctype"), _text(f"{s}_date"), period_suffix(F.col(f"{s}_period")), _text(f"{s}_speaker"))
        return F.concat(head, F.lit('\n"'), _text(f"{s}_quote"), F.lit('"'))

    return F.concat_ws("\n\n", F.concat(F.lit("TOPIC: "), F.col("topic")), side("a"), side("b"), F.lit("Can both statements be true? A call and a report of one fiscal year speak of the same year."))


def extraction_prompt() -> Column:
    """What a model is asked about a chunk ``(ticker, doc_type, date, speaker, text)``."""
    hint = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("SPEAKER: "), F.col("speaker")))
    return F.concat_ws("\n", F.concat_ws(" ", F.lit("DOCUMENT:"), "ticker", "doc_type", "date"), hint, F.lit("\nQuote verbatim from the text between the fences.\n<<<"), "text", F.lit(">>>"))


def question_lines(answer: Column, n: int) -> Column:
    """The first ``n`` usable lines of a model's answer: without bullets and quotes, 3 to 120 characters."""
    lines = F.transform(F.split(answer, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, "^[ \\-*\t\"']+|[ \\-*\t\"']+$", ""))
    return F.slice(F.filter(lines, lambda x: F.length(x).between(3, 120)), 1, n)


def passes_safety(answer: Column) -> Column:
    """A safety model's answer lets a draft pass unless it says unsafe; no answer passes."""
    return ~F.contains(F.lower(strip(F.coalesce(answer, F.lit("")))), F.lit("unsafe"))


def citation_labels(cited: Column) -> Column:
    """Cited ids with their ordinals from 1, in the order of first appearance."""
    distinct = F.array_distinct(cited)
    return F.transform(distinct, lambda x: F.struct(x.alias("id"), F.array_position(distinct, x).alias("label")))


def circle_layout(position: Column, count: Column, radius: float = 1.0) -> Column:
    """Place of the ``position``-th of ``count`` nodes on a circle."""
    angle = F.lit(2 * 3.141592653589793) * position / count
    return F.struct((F.lit(radius) * F.cos(angle)).alias("x"), (F.lit(radius) * F.sin(angle)).alias("y"))
