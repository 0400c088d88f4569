"""Readers of the engine's files: stored documents, raw pages, company lists, transcripts, claims."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave import schemas


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one JSON file each; the manifest beside them has no sections and drops out."""
    return spark.read.schema(schemas.DOCUMENT_JSON).option("multiLine", True).json(path).filter("sections IS NOT NULL")


def document_rows(documents: DataFrame) -> DataFrame:
    """Document nodes of stored documents, with the company's fields; a missing ticker is empty."""
    return documents.select("document_id", "doc_type", "date", F.col("period_of_report").alias("period"), "source_url", "source_type", "raw_ref", F.coalesce("company.ticker", F.lit("")).alias("ticker"), F.coalesce("company.name", F.lit("")).alias("company_name"), F.col("company.cik").alias("cik"))


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(path, html)`` of cached pages, a file each; Spark passes over empty files, which hold no page."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("html"))


def company_universe(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, ticker, name, cik)`` of a company list: a JSON array, or an object of numbered records."""
    raw = spark.read.text(path, wholetext=True)
    variant = F.try_parse_json("value")
    rows = F.coalesce(F.try_variant_get(variant, "$", "array<variant>"), F.map_values(F.try_variant_get(variant, "$", "map<string,variant>")))
    one = raw.select(F.posexplode(rows).alias("pos", "v"))
    name = F.coalesce(F.try_variant_get("v", "$.title", "string"), F.try_variant_get("v", "$.name", "string"), F.lit(""))
    cik = F.coalesce(F.try_variant_get("v", "$.cik_str", "long"), F.try_variant_get("v", "$.cik", "long"))
    return one.select("pos", F.upper(F.try_variant_get("v", "$.ticker", "string")).alias("ticker"), name.alias("name"), cik.alias("cik")).filter("ticker IS NOT NULL")


def recent_cache(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the cache of recent filers in their order."""
    schema = "ts double, items array<struct<ticker:string,name:string,cik:bigint,form:string,date:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("items").alias("pos", "item")).select("pos", "item.*")


TRANSCRIPT = "document_id string, doc_type string, date string, quarter string, ticker string, company_name string, title string, turn int, speaker string, role string, text string, planted string"


def turns_of(body: str | None) -> list[list]:
    """Rows of TRANSCRIPT of one transcript in YAML."""
    import yaml

    doc = yaml.safe_load(body or "") or {}
    company = doc.get("company") or {}
    head = [str(doc[k]) if doc.get(k) is not None else None for k in ("document_id", "doc_type", "date", "quarter")]
    return [[*head, company.get("ticker"), company.get("name"), doc.get("title"), i, t.get("speaker"), t.get("role"), t.get("text"), t.get("planted")] for i, t in enumerate(doc.get("turns") or ())]


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Turns of transcript YAML files, a document each."""

    def turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TRANSCRIPT.split(", ")]
        for frame in frames:
            yield pd.DataFrame([t for body in frame["value"] for t in turns_of(body)], columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(turns, TRANSCRIPT)


def claims(spark: SparkSession, path: str) -> DataFrame:
    """Stored claims: a JSON object of claims by id."""
    raw = spark.read.text(path, wholetext=True)
    by_id = F.from_json("value", f"map<string, struct<{','.join(f.replace(' ', ':', 1) for f in schemas.CLAIMS.split(', '))}>>")
    return raw.select(F.explode(by_id).alias("id", "claim")).select("claim.*")
