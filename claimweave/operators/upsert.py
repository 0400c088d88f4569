"""Upserts by key: plain Parquet has no MERGE, so the new table is the kept rows and the new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_wins(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys; of new ones the last counts."""
    latest = Window.partitionBy(*key).orderBy(F.desc(order))
    rows = new.withColumn("nth", F.row_number().over(latest)).filter("nth = 1").select(old.columns)
    return old.join(rows.select(key), key, "left_anti").select(old.columns).unionByName(rows)


def first_wins(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``old`` with rows of new keys added; of several the first counts."""
    first = Window.partitionBy(*key).orderBy(order)
    rows = new.join(old.select(key), key, "left_anti").withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return old.unionByName(rows.select(old.columns))


def add_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges as a set: those of both tables, each once."""
    return old.unionByName(new.select(old.columns)).distinct()


def delete_scoped(rows: DataFrame, scope: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't in ``scope``."""
    return rows.join(scope.select(key).distinct(), key, "left_anti")


def duplicate_keys(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: empty for a sound table."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.mkdirs(where)


def _numbered(spark: SparkSession, path: str, prefix: str) -> dict[int, bool]:
    """Numbers of the folders ``<path>/<prefix><number>``, and whether each is committed."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return {int(n[len(prefix) :]): fs.exists(_files(spark, f"{path}/{n}/_COMMITTED")[1]) for n in names if n.startswith(prefix)}


def _commit(spark: SparkSession, path: str) -> None:
    fs, mark = _files(spark, f"{path}/_COMMITTED")
    fs.create(mark, True).close()


def swap_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a table by ``df``, which may read it: a new version, committed by one empty file.

    Versions are folders ``version-<number>`` below ``path``; nothing is renamed, so this holds on object stores
    too. A reader (:func:`current_table`) sees the newest committed one. The one before stays for readers that
    have begun; older and unfinished ones are deleted. There is one writer at a time.
    """
    known = _numbered(spark, path, "version-")
    number = max(known, default=0) + 1
    fresh = f"{path}/version-{number:09d}"
    df.write.mode("overwrite").parquet(fresh)
    _commit(spark, fresh)
    before = max((n for n, done in known.items() if done), default=0)
    for n in known:
        if n != before:
            fs, old = _files(spark, f"{path}/version-{n:09d}")
            fs.delete(old, True)


def current_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The newest committed version of a table; None if there is none."""
    done = [n for n, committed in _numbered(spark, path, "version-").items() if committed]
    if not done:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/version-{max(done):09d}")


def _deltas(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Committed deltas as (source, batch)."""
    fs, where = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    found = [n.removeprefix("delta-").rsplit("-", 1) for n in names if n.startswith("delta-")]
    return sorted((source, int(n)) for source, n in found if fs.exists(_files(spark, f"{path}/delta-{source}-{n}/_COMMITTED")[1]))


def _folded(spark: SparkSession, path: str, base: int) -> dict[str, int]:
    """Of each source the last batch that a base holds; all before it are in it, too."""
    rows = spark.read.schema("source string, batch long").json(f"{path}/base-{base:09d}/_folded").collect()
    return {r.source: r.batch for r in rows}


def _fresh(spark: SparkSession, path: str) -> tuple[int, dict[str, int], list[tuple[str, int]]]:
    """The newest base (-1: none), what it folded, and the deltas that it doesn't hold."""
    base = max((n for n, done in _numbered(spark, path, "base-").items() if done), default=-1)
    folded = _folded(spark, path, base) if base >= 0 else {}
    return base, folded, [(s, n) for s, n in _deltas(spark, path) if n > folded.get(s, -1)]


def write_delta(spark: SparkSession, df: DataFrame, path: str, source: str, batch: int) -> None:
    """Add the rows of one batch of one source (a streaming query's id) to a table of deltas.

    A batch that is committed already is passed over, an unfinished one is written anew. Sources
    don't touch each other's deltas, so several queries may write into one table, and a query whose
    checkpoint was lost is a source of its own. Batches of a source are numbered upwards from 0.
    """
    fresh = f"{path}/delta-{source}-{batch:09d}"
    fs, mark = _files(spark, f"{fresh}/_COMMITTED")
    if fs.exists(mark):
        return
    df.write.mode("overwrite").parquet(fresh)
    _commit(spark, fresh)


def merged_deltas(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame | None:
    """The rows of the newest base and of the deltas that it doesn't hold: of each key the last by ``order``.

    Of rows equal in key and order the later batch's counts (a base is before all batches), then the larger source, then the larger values.
    """
    base, _, deltas = _fresh(spark, path)
    folders = [f"{path}/base-{base:09d}"] * (base >= 0) + [f"{path}/delta-{s}-{n:09d}" for s, n in deltas]
    if not folders:
        return None
    rows = spark.read.parquet(*folders)
    columns = rows.columns
    place = F.regexp_extract(F.input_file_name(), r"/delta-([^/]*)-(\d+)/[^/]*$", 2)
    source = F.regexp_extract(F.input_file_name(), r"/delta-([^/]*)-(\d+)/[^/]*$", 1)
    named = rows.withColumn("batch_no", F.coalesce(F.when(place != "", place.cast("long")), F.lit(-1))).withColumn("source_id", source)
    last = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("batch_no"), F.desc("source_id"), *(F.desc(c) for c in columns))
    return named.withColumn("nth", F.row_number().over(last)).filter("nth = 1").select(columns)


def compact_deltas(spark: SparkSession, path: str, key: list[str], order: str) -> None:
    """Write base and deltas as a new base with a list of what it holds; what it replaces goes with the next compaction.

    There is one compaction at a time; sources may go on writing meanwhile.
    """
    base, folded, deltas = _fresh(spark, path)
    if not deltas:
        return
    fresh = f"{path}/base-{base + 1:09d}"
    merged_deltas(spark, path, key, order).write.mode("overwrite").parquet(fresh)
    now = folded | {s: n for s, n in deltas}  # sorted: the last batch of each source stays
    spark.createDataFrame(sorted(now.items()), "source string, batch long").coalesce(1).write.mode("overwrite").json(f"{fresh}/_folded")
    _commit(spark, fresh)
    fs, _ = _files(spark, path)
    old = [f"base-{n:09d}" for n in _numbered(spark, path, "base-") if n < base]
    for name in old + [f"delta-{s}-{n:09d}" for s, n in _deltas(spark, path) if n <= folded.get(s, -1)]:
        fs.delete(_files(spark, f"{path}/{name}")[1], True)
