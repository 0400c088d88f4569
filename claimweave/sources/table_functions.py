"""Readers as table functions of SQL: ``SELECT * FROM page_blocks(TABLE(pages))``.

They take a table argument, so Spark prunes, filters and partitions it as any other relation, and a row that cannot be read
gives no rows instead of an error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from claimweave.sources.files import TRANSCRIPT, turns_of
from claimweave.sources.html import BLOCK_SCHEMA, blocks_of


class PageBlocks:
    """Blocks of pages ``(document_id, html)``, in whatever order their columns come."""

    def eval(self, page: Row) -> Iterator[tuple]:
        for block in blocks_of(page["html"]):
            yield page["document_id"], *block


class TranscriptTurns:
    """Turns of transcripts ``(value)`` in YAML; a text that isn't a transcript has none."""

    def eval(self, transcript: Row) -> Iterator[tuple]:
        import yaml

        try:
            turns = turns_of(transcript["value"])
        except (yaml.YAMLError, AttributeError):
            return
        for turn in turns:
            yield tuple(turn)


FUNCTIONS = {"page_blocks": (PageBlocks, BLOCK_SCHEMA), "transcript_turns": (TranscriptTurns, TRANSCRIPT)}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    for name, (reader, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(reader, returnType=schema))
