"""Shared helpers: work tables in the cluster's shared folder, bounded Arrow slices, word rules."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Text bytes handled at once inside a Python task, however large the Arrow batch is.
SLICE_BYTES = 4 << 20

#: Words of 64 bits of a filter of ids, 4 MB whatever the number of ids, and bits of each id.
FILTER_WORDS, FILTER_BITS = 1 << 19, 4

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and its master is local (tests) a temporary folder is made; a
    cluster without a shared folder is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="claimweave-")
    return "file://" + _LOCAL_DIRS[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver process ends."""
    path = f"{shared_dir(spark)}/claimweave/{name}-{uuid.uuid4().hex}"
    atexit.register(delete_path, spark, path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a work path through Hadoop's file system; a stopped session is no error."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - at exit the JVM may already be gone
        pass


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _filter_bits(ids: np.ndarray) -> np.ndarray:
    """Numbers of the bits of each id, a row an id."""
    h = ids.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, FILTER_BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(FILTER_WORDS * 64)).astype(np.int64)


def _filter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = np.zeros(FILTER_WORDS, dtype=np.uint64)
    for batch in batches:
        bits = _filter_bits(batch.column(0).to_numpy(zero_copy_only=False)).ravel()
        np.bitwise_or.at(words, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
    at = np.nonzero(words)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at].view(np.int64))], names=["word", "bits"])


def maybe_among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` is among ``ids`` (one column), and some others.

    Both hold longs without nulls. A Bloom filter of fixed size is broadcast, so that a join with ``ids`` moves few rows in vain: 0.2 % of
    the others up to 2 million ids, all of them when ids are far more.
    """
    found = ids.toDF("id").mapInArrow(_filter_batches, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, dtype=np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    held = rows.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def among(values: pd.Series) -> pd.Series:
        bits = _filter_bits(values.to_numpy())
        return pd.Series(((held.value[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1))

    return rows.filter(among(column))
