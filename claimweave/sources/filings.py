"""Company filings over HTTP: a data source of their lists, and a fetch of the documents behind a cache.

    spark.dataSource.register(FilingsSource)
    spark.read.format("filings").option("ciks", "1045810,320193").option("forms", "10-K:1,10-Q:2").option("user_agent", "name mail").load()

A form may name how many of its newest filings count; without a number all do. Each company is a partition
of its own, so fetching spreads over executors and a failed fetch is repeated alone. With the option
``document_url`` the rows also carry the documents' bodies.
"""

from __future__ import annotations

import errno
import json
import random
import socket
import time
import urllib.request
from collections.abc import Callable, Iterator
from http.client import IncompleteRead, RemoteDisconnected
from typing import Any
from urllib.error import HTTPError, URLError

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: HTTP answers after which the same request may succeed.
BUSY = frozenset({408, 425, 429, 500, 502, 503, 504, 529})
#: Failures of a connection that had been possible; a refused one or an unknown host is a wrong setting.
BROKEN = frozenset({errno.EPIPE, errno.ECONNRESET, errno.ECONNABORTED, errno.ETIMEDOUT, errno.ENETRESET, errno.EAGAIN})


def pause_after(error: BaseException) -> float | None:
    """Seconds to wait before the same request is worth another try; None if it isn't, 0 if nobody says."""
    if isinstance(error, HTTPError):
        asked = (error.headers or {}).get("Retry-After", "")
        return (float(asked) if asked.isdigit() else 0.0) if error.code in BUSY else None
    cause = error.reason if isinstance(error, URLError) else error
    if isinstance(cause, socket.gaierror):
        return 0.0 if cause.errno == socket.EAI_AGAIN else None
    if isinstance(cause, (TimeoutError, IncompleteRead, RemoteDisconnected, EOFError)):
        return 0.0
    return 0.0 if isinstance(cause, OSError) and cause.errno in BROKEN else None


def fetch(url: str, user_agent: str, tries: int = 4, longest: float = 20.0, timeout: float = 60.0, wait: Callable[[float], Any] = time.sleep) -> bytes:
    """The body at ``url``. Between tries it waits as long as the server asks, else a random, doubling time."""
    request = urllib.request.Request(url, headers={"User-Agent": user_agent})
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.read()
        except Exception as error:
            pause = pause_after(error)
            if pause is None or not left:
                raise
            wait(min(longest, pause or random.uniform(1, 2) * 2 ** (tries - 1 - left)))
    raise ValueError("at least one try is needed")


def wanted_forms(option: str) -> dict[str, int | None]:
    """``10-K:1,10-Q`` as forms with the number of newest filings that count (None: all)."""
    out: dict[str, int | None] = {}
    for part in (p.strip() for p in option.split(",")):
        form, _, n = part.partition(":")
        if form:
            out[form.strip()] = int(n) if n else None
    return out


class _Company(InputPartition):
    def __init__(self, cik: str):
        self.cik = cik


_LIST = "cik long, ticker string, name string, form string, date string, accession string, primary_document string"


class FilingsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("user_agent"):
            raise ValueError("the option user_agent must name who asks")
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Company(c.strip()) for c in self.options.get("ciks", "").split(",") if c.strip()]

    def read(self, partition: _Company) -> Iterator[tuple]:
        cik, who = int(partition.cik), self.options["user_agent"]
        found = json.loads(fetch(self.options.get("base_url", "https://data.sec.gov/submissions/CIK{cik:010d}.json").format(cik=cik), who))
        recent, forms = found.get("filings", {}).get("recent", {}), wanted_forms(self.options.get("forms", ""))
        ticker, bodies = (found.get("tickers") or [""])[0], self.options.get("document_url")
        rows = list(zip(*(recent.get(k, []) for k in ("form", "filingDate", "accessionNumber", "primaryDocument"))))
        seen: dict[str, int] = {}
        for form, date, accession, name in sorted(rows, key=lambda r: (r[1], r[2]), reverse=True):
            seen[form] = seen.get(form, 0) + 1
            if forms and (form not in forms or (forms[form] is not None and seen[form] > forms[form])):
                continue
            row = (cik, ticker, found.get("name"), form, date, accession, name)
            if bodies:
                row += (fetch(bodies.format(cik=cik, accession=accession, plain=accession.replace("-", ""), name=name), who).decode("utf-8", "replace"),)
            yield row


class FilingsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return _LIST + (", html string" if self.options.get("document_url") else "")

    def reader(self, schema) -> FilingsReader:
        return FilingsReader(self.options)


def fetch_missing(listed: DataFrame, cache: str, user_agent: str, url: str, get: Callable[[str, str], bytes] = fetch) -> DataFrame:
    """The documents of ``listed`` (:class:`FilingsSource` rows) with ``html``, each fetched once ever.

    ``cache`` is a Parquet folder of raw pages ``(accession, cik, html)``, partitioned by cik: what an anti-join
    does not find there is fetched in tasks and appended, then all is read from it. ``url`` is a template of
    ``cik``, ``accession``, ``plain`` and ``name``.
    """
    spark: SparkSession = listed.sparkSession
    asked = listed.select("cik", "accession", "primary_document").dropDuplicates(["accession"])
    held = read_raw_pages(spark, cache)
    missing = asked.join(held.select("accession"), "accession", "left_anti") if held is not None else asked

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where = url.format(cik=row["cik"], accession=row["accession"], plain=row["accession"].replace("-", ""), name=row["primary_document"])
                body = get(where, user_agent).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([row["accession"]]), pa.array([row["cik"]], pa.int64()), pa.array([body])], names=["accession", "cik", "html"])

    save_raw_pages(missing.select("accession", "cik", "primary_document").mapInArrow(load, "accession string, cik long, html string"), cache)
    held = read_raw_pages(spark, cache)
    return listed.join(held.drop("cik"), "accession")


def save_raw_pages(pages: DataFrame, cache: str) -> None:
    """Append raw pages ``(accession, cik, html)`` to the cache."""
    pages.select("accession", "html", "cik").write.mode("append").partitionBy("cik").parquet(cache)


def read_raw_pages(spark: SparkSession, cache: str) -> DataFrame | None:
    """Raw pages of the cache, each accession once; None if there is no cache yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("accession string, html string, cik long").parquet(cache).groupBy("accession").agg(F.min("html").alias("html"), F.min("cik").alias("cik"))
