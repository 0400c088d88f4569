"""Incremental ingestion: new files of pages become chunks, claims, edges and vectors, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from claimweave.operators.upsert import write_delta
from claimweave.plans.store import GraphStore, process_pages


def source_of(batch: DataFrame) -> str:
    """The id of the streaming query that a batch belongs to: its checkpoint keeps it over restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def upsert_batch(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds a batch as a delta named by (query id, batch id), at the batch's cost.

    A repeated batch changes nothing. :func:`~claimweave.operators.upsert.merged_deltas` reads the table,
    :func:`~claimweave.operators.upsert.compact_deltas` folds deltas together now and then.
    """
    return lambda batch, batch_id: write_delta(spark, batch, path, source_of(batch), batch_id)


def new_files(spark: SparkSession, source: str, schema: str, files: int = 100) -> DataFrame:
    """The JSON files of a folder as a stream, ``files`` a micro-batch."""
    return spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", files).json(source)


def without_repeats(stream: DataFrame, key: list[str], event_time: str, late: str) -> DataFrame:
    """The first of the rows with equal ``key`` that come within ``late`` of each other, by ``event_time`` (a timestamp).

    State is kept for that long and no longer. A row that comes later than that behind the newest is dropped as late.
    """
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key)


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Run over the JSON files of ``source`` that no earlier run took, then stop."""
    return _run(transform(new_files(spark, source, schema, files)), upsert_batch(spark, target), checkpoint)


def ingest_pages(
    pages: DataFrame,
    store: GraphStore,
    topics: DataFrame,
    call: Callable[[str, int], list[dict]],
    checkpoint: str,
    judge: Callable[[dict], str] | None = None,
    event_time: str | None = None,
    late: str = "7 days",
    **options,
) -> StreamingQuery:
    """Run a stream of pages through all stages, chunks to contradictions, then stop.

    With ``event_time``, a column beside those of :func:`~claimweave.plans.store.process_pages`, a page that comes again with the
    same text within ``late`` is dropped before any stage; a new text of a document goes on. All stages merge
    by key within the batch's companies, so a batch that is run again after a failure changes nothing.
    """
    if event_time:
        pages = without_repeats(pages, ["document_id", "html"], event_time, late).drop(event_time)

    def each(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # every stage reads it
        try:
            if not held.isEmpty():
                process_pages(store, held, topics, call, judge, **options)
        finally:
            held.unpersist()

    return _run(pages, each, checkpoint)


def job_states(events: DataFrame) -> DataFrame:
    """Streamed job events as the newest state of each job (output mode update or complete)."""
    from claimweave.operators.stateful import latest_jobs

    return latest_jobs(events)
