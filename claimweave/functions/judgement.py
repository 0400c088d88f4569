"""Model answers in JSON, read tolerantly, and the meaning of severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions.vectors import let
from claimweave.schemas import JUDGMENT

# Fixed values, from weakest to strongest.
SEVERITIES = ["none", "low", "medium", "high"]
#: Keys under which models give the same thing, best first.
TOPIC_KEYS = ["topic", "topic_id", "topicId", "topic_name"]
QUOTE_KEYS = ["quote_span", "quote", "span", "source_quote"]
CLAIM_KEYS = ["claim_text", "claim", "text"]


def severities_at_least(least: str) -> list[str]:
    """Severities of an edge from ``least`` up; an unknown name means all."""
    edge = SEVERITIES[1:]
    return edge[edge.index(least) :] if least in edge else edge


def severity_rank(severity: Column) -> Column:
    """For sorting: high 0, medium 1, anything else 2."""
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def severity_order(severity: Column) -> Column:
    """For comparing: low 1, medium 2, high 3, else 0."""
    return F.coalesce(F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity) - 1, F.lit(0)).cast("int")


def json_part(answer: Column) -> Column:
    """The JSON in an answer: without code fences, or else from the first brace to the last."""
    whole = lambda text: F.try_parse_json(text).isNotNull()
    bare = lambda t: F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^`+[^\n`]*\n?|`+$", ""), r"(?U)^\s+|\s+$", "")).otherwise(t)
    braces = lambda b: let(F.regexp_extract(b, r"(?s)\{.*\}", 0), lambda x: F.when(whole(x), x))
    trimmed = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    return let(let(trimmed, bare), lambda b: F.when(whole(b), b).otherwise(braces(b)))


def _truth(x: Column) -> Column:
    # text is taken by its meaning, so "false" is false
    return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(~F.lower(F.trim(x)).isin("", "false", "0", "no", "null"))


def judgement(answer: Column) -> Column:
    """``(contradicts, severity, reasoning)`` of an answer; no JSON means no contradiction."""
    return let(F.from_json(json_part(answer), JUDGMENT), _read)  # parsed once, not for each use of a field


def _read(raw: Column) -> Column:
    yes = F.coalesce(_truth(raw["contradicts"]), F.coalesce(_truth(raw["is_contradiction"]), F.lit(False)) | F.coalesce(_truth(raw["contradiction"]), F.lit(False)))
    said = F.lower(F.trim(F.coalesce(raw["severity"], F.lit("none"))))
    severity = F.when(~yes, "none").when(said.isin(SEVERITIES[1:]), said).otherwise("medium")
    reasoning = F.coalesce(F.nullif(raw["reasoning"], F.lit("")), raw["explanation"], F.lit(""))
    return F.struct(yes.alias("contradicts"), severity.alias("severity"), reasoning.alias("reasoning"))


def first_text(claim: Column, keys: list[str]) -> Column:
    """The first value under ``keys`` of a VARIANT object that isn't empty, or empty."""
    return F.coalesce(*(F.nullif(F.try_variant_get(claim, f"$.{k}", "string"), F.lit("")) for k in keys), F.lit(""))


def raw_claims(answer: Column) -> Column:
    """Array of claims in an answer: under ``claims``, or the answer itself if it is a list."""
    bare = json_part(F.regexp_replace(answer, r"(?s)^\s*(\[.*\])\s*$", '{"claims":$1}'))
    return F.coalesce(F.try_variant_get(F.try_parse_json(bare), "$.claims", "array<variant>"), F.array().cast("array<variant>"))


def claim_fields(claim: Column) -> Column:
    """The claim's canonical fields; only numbers (and booleans, as 0 and 1) are numeric values."""
    kind = F.schema_of_variant(F.try_variant_get(claim, "$.value_numeric", "variant"))
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(claim, "$.value_numeric", "double")).when(kind == "BOOLEAN", F.try_variant_get(claim, "$.value_numeric", "boolean").cast("int").cast("double"))
    plain = [F.coalesce(F.try_variant_get(claim, f"$.{k}", "string"), F.lit("")).alias(k) for k in ("stance", "speaker", "role")]
    return F.struct(first_text(claim, TOPIC_KEYS).alias("topic"), first_text(claim, QUOTE_KEYS).alias("quote_span"), first_text(claim, CLAIM_KEYS).alias("claim_text"), *plain, number.alias("value_numeric"))


def total_tokens(read: Column, written: Column) -> Column:
    """Tokens of a call: missing parts count as none, but all missing is unknown."""
    return F.when(read.isNull() & written.isNull(), None).otherwise(F.coalesce(read, F.lit(0)) + F.coalesce(written, F.lit(0)))
