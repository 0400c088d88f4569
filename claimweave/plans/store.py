"""The stored graph: its tables as Parquet, merged by key, and the stages that fill them.

    raw pages -> chunks -> selected chunks -> claims -> nodes, edges, vectors -> pairs -> contradictions
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimweave import schemas
from claimweave.functions import text as T
from claimweave.functions.vectors import hash_embedding
from claimweave.operators import chunks as C
from claimweave.operators import detect as D
from claimweave.operators import upsert as U
from claimweave.operators.graph import Graph
from claimweave.operators.inference import Client
from claimweave.sources.html import page_blocks

#: Stored claims hold the extractor's fields; the graph's claims are a projection of them.
TABLES = {"companies": schemas.COMPANIES, "documents": schemas.DOCUMENTS, "topics": schemas.TOPICS, "speakers": schemas.SPEAKERS, "claims": schemas.CLAIMS, "made": schemas.MADE, "appears_in": schemas.APPEARS_IN, "about": schemas.ABOUT, "filed_by": schemas.FILED_BY, "contradictions": schemas.CONTRADICTIONS, "chunks": schemas.CHUNKS, "sections": schemas.SECTIONS, "claim_vectors": schemas.CLAIM_VECTORS}
#: Tables with a row a topic or a company: small, kept as one versioned table each.
SMALL = ("companies", "topics")
#: What the other tables are bucketed by within a company: joins on it need no exchange.
BUCKETED = {"documents": "document_id", "filed_by": "document_id", "chunks": "document_id", "sections": "document_id", "speakers": "speaker_id", "claims": "claim_id", "made": "claim_id", "appears_in": "claim_id", "about": "claim_id", "claim_vectors": "claim_id", "contradictions": "a_id"}
STORED_KEYS = schemas.KEYS | {"chunks": ["chunk_id"], "sections": ["document_id", "section_id"]}
#: The partition column: a copy of the company's ticker.
COMPANY = "of_company"
_NAMESPACE = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")


@F.pandas_udf(StringType())
def point_id(claim_id: pd.Series) -> pd.Series:
    """The vector point of a claim: a version 5 UUID of its id."""
    return claim_id.map(lambda c: str(uuid.uuid5(_NAMESPACE, c)))


def _arrival(rows: DataFrame) -> Column:
    """What decides between rows that repeat a key: the column ``arrived`` if there is one, else all their values."""
    return F.col("arrived") if "arrived" in rows.columns else F.to_json(F.struct(*rows.columns))


def _escaped(ticker: str) -> str:
    """A ticker as the name of its partition's folder."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in ticker)


class GraphStore:
    """Tables below one path: partitioned by company and bucketed by key, so that a merge rewrites its companies only.

    They are tables of the session's catalogue, in a database named after the path. A merge reads the partitions of its
    companies and overwrites them dynamically: files are staged and moved when the job is done, and a job that finds a
    repeated key fails before that. A writer that is lost in between leaves some companies old and some new; running the
    merge again completes it. There is one writer at a time. ``buckets`` holds for a company: its largest bucket should
    fit a task, while companies of few rows get as many small files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.database = "graph_" + sha256(self.path.encode()).hexdigest()[:16]
        # Spark 4.1 may leave out the exchange above a union of bucketed scans and then read these scans without their buckets
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        for name in BUCKETED:
            self._open(name)

    def _open(self, name: str) -> None:
        """Make a table known to the session, with the partitions that an earlier session wrote."""
        place = f"{self.path}/{name}"
        U.make_folder(self.spark, place)
        literal = place.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.database}.{name} ({TABLES[name]}, {COMPANY} string) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
            f"PARTITIONED BY ({COMPANY}) CLUSTERED BY ({BUCKETED[name]}) INTO {self.buckets} BUCKETS LOCATION '{literal}'"
        )
        self.spark.sql(f"MSCK REPAIR TABLE {self.database}.{name}")

    def _empty(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self.database}.{name}")
        U.delete_folder(self.spark, f"{self.path}/{name}")
        self._open(name)

    def stored(self, name: str, scope: list[str] | None = None) -> DataFrame:
        """A partitioned table with its column ``of_company``; with a ``scope`` only these companies' files are read."""
        rows = self.spark.table(f"{self.database}.{name}")
        return rows if scope is None else rows.filter(F.col(COMPANY).isin(scope))

    def table(self, name: str, scope: list[str] | None = None) -> DataFrame:
        if name not in SMALL:
            return self.stored(name, scope).drop(COMPANY)
        found = U.current_table(self.spark, f"{self.path}/{name}", TABLES[name])
        return self.spark.createDataFrame([], TABLES[name]) if found is None else found

    def graph(self, scope: list[str] | None = None) -> Graph:
        """The whole graph, or that of some companies."""
        speakers = self.table("speakers", scope).select("speaker_id", "name", "role")
        return Graph(**{n: self.table(n, scope) for n in ("companies", "documents", "topics", "claims", "made", "appears_in", "about", "filed_by", "contradictions")}, speakers=speakers)

    def put_small(self, name: str, df: DataFrame) -> None:
        old = self.table(name)
        U.swap_table(self.spark, df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema)), f"{self.path}/{name}")

    def put(self, name: str, df: DataFrame, scope: list[str], count: str | None = None) -> int:
        """Replace the rows of the companies in ``scope`` by ``df``, which may read them; how many of its rows have ``count`` true."""
        full, key = f"{self.database}.{name}", STORED_KEYS[name]
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.table(full).schema]
        once = F.count(F.lit(1)).over(Window.partitionBy(*key)) == 1
        sound = F.when(once, F.col(COMPANY)).otherwise(F.raise_error(F.lit(f"a key of {name} occurs twice")))
        seen = Observation()
        met = [F.collect_set(F.col(COMPANY)).alias("companies"), F.count_if(F.col(count) if count else F.lit(False)).alias("n")]
        dealt = df.repartition(self.buckets, BUCKETED[name]).withColumn(COMPANY, sound).observe(seen, *met)
        dealt.select(columns).write.insertInto(full, overwrite=True)
        held = {r[COMPANY] for r in self.spark.sql(f"SHOW PARTITIONS {full}").select(F.regexp_extract("partition", "=(.*)", 1).alias(COMPANY)).collect()}
        written = {_escaped(t) for t in seen.get["companies"]}
        for ticker in scope:
            if _escaped(ticker) in held - written:  # nothing is left of it
                literal = ticker.replace("\\", "\\\\").replace("'", "\\'")
                self.spark.sql(f"ALTER TABLE {full} DROP IF EXISTS PARTITION ({COMPANY} = '{literal}')")
                U.delete_folder(self.spark, f"{self.path}/{name}/{COMPANY}={_escaped(ticker)}")
        return seen.get["n"]

    def reset(self) -> None:
        """Empty every table."""
        for name in TABLES:
            if name in SMALL:
                self.put_small(name, self.spark.createDataFrame([], TABLES[name]))
            else:
                self._empty(name)

    def clear_contradictions(self) -> None:
        """Drop the contradictions of all companies."""
        self._empty("contradictions")

    def scope_of(self, docs: DataFrame) -> list[str]:
        """The companies that a merge of documents touches: theirs, and those under which the same documents are stored.

        One ticker a company comes to the driver.
        """
        own = docs.select(F.col("ticker").alias(COMPANY))
        earlier = self.stored("documents").join(docs.select("document_id").distinct(), "document_id", "left_semi").select(COMPANY)
        return sorted(r[COMPANY] for r in own.unionByName(earlier).distinct().collect() if r[COMPANY] is not None)

    def merge_topics(self, topics: DataFrame) -> None:
        rows = topics.select("id", "name", F.coalesce("description", F.lit("")).alias("description"), "aliases", _arrival(topics).alias("seq"))
        held = self.table("topics")
        if not rows.select(held.columns).exceptAll(held).isEmpty():
            self.put_small("topics", U.last_wins(held, rows, ["id"], "seq"))

    def merge_documents(self, docs: DataFrame, scope: list[str]) -> int:
        """Documents (the last wins), their companies (the first by document id wins) and FILED_BY; the number of documents."""
        companies = docs.select("ticker", F.col("company_name").alias("name"), "cik", "document_id")
        held = self.table("companies")
        if not companies.join(held, "ticker", "left_anti").isEmpty():
            self.put_small("companies", U.first_wins(held, companies, ["ticker"], "document_id"))
        n = self._last("documents", docs.withColumn(COMPANY, F.col("ticker")).withColumn("seq", _arrival(docs)), scope)
        self._edges("filed_by", docs.select("document_id", "ticker", F.col("ticker").alias(COMPANY)), scope)
        return n

    def _last(self, name: str, new: DataFrame, scope: list[str]) -> int:
        """Merge rows with ``seq``, by which the last of a key wins; their number."""
        old = self.stored(name, scope).withColumn("fresh", F.lit(False))
        return self.put(name, U.last_wins(old, new.withColumn("fresh", F.lit(True)), STORED_KEYS[name], "seq"), scope, "fresh")

    def _edges(self, name: str, new: DataFrame, scope: list[str]) -> None:
        """Add edges, each of which stays with the company that it came with first."""
        self.put(name, U.first_wins(self.stored(name, scope), new, STORED_KEYS[name], COMPANY), scope)

    def merge_chunks(self, chunks: DataFrame, documents: DataFrame, scope: list[str]) -> None:
        """Chunks and sections, in place of all those of the same documents."""
        placed = chunks.join(documents.select("document_id", F.col("ticker").alias(COMPANY)).dropDuplicates(["document_id"]), "document_id")
        new = chunks.select("document_id").distinct()
        for name, rows in (("chunks", placed), ("sections", placed.select("document_id", "section_id", "ordinal", "heading", COMPANY).distinct())):
            old = self.stored(name, scope)
            full = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema))
            self.put(name, old.join(new, "document_id", "left_anti").select(old.columns).unionByName(full), scope)

    def merge_claims(self, claims: DataFrame, scope: list[str]) -> int:
        """Claims (the last wins), their speakers (the first wins), topics by id alone, and three edges; the number of claims."""
        rows = claims.withColumn(COMPANY, F.col("company_ticker"))
        n = self._last("claims", rows.withColumn("seq", F.struct("extracted_at", _arrival(claims))), scope)
        who = T.speaker_id(F.col("company_ticker"), F.coalesce("speaker", F.lit("")))
        speakers = rows.select(who.alias("speaker_id"), F.coalesce("speaker", F.lit("")).alias("name"), "role", "company_ticker", "claim_id", COMPANY)
        self.put("speakers", U.first_wins(self.stored("speakers", scope), speakers, ["speaker_id"], "claim_id"), scope)
        bare = claims.select(F.col("topic").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("aliases"))
        held = self.table("topics")
        if not bare.join(held, "id", "left_anti").isEmpty():
            self.put_small("topics", U.first_wins(held, bare, ["id"], "id"))
        for name, edges in (("made", speakers.select("speaker_id", "claim_id", COMPANY)), ("appears_in", rows.select("claim_id", "document_id", COMPANY)), ("about", rows.select("claim_id", F.col("topic").alias("topic_id"), COMPANY))):
            self._edges(name, edges, scope)
        return n

    def index_claims(self, embed: Callable[[Column], Column] = hash_embedding, scope: list[str] | None = None) -> int:
        """Vectors of the claims' text and quote; only claims that are new or say something else are embedded. Their number."""
        text = T.strip(F.concat_ws(" ", "claim_text", "quote_span"))
        if scope is None:
            scope = [r[COMPANY] for r in self.stored("claims").select(COMPANY).distinct().collect()]
        held = self.stored("claim_vectors", scope)
        claims = self.stored("claims", scope).withColumn("ticker", F.col("company_ticker"))
        same = [F.col("c.claim_id") == F.col("v.claim_id"), *(F.col(f"c.{c}").eqNullSafe(F.col(f"v.{c}")) for c in ("claim_text", "quote_span"))]
        new = claims.alias("c").join(held.alias("v"), same, "left_anti")
        if new.isEmpty():
            return 0
        return self._last("claim_vectors", new.withColumn("point_id", point_id("claim_id")).withColumn("vector", embed(text)).withColumn("seq", F.lit(0)), scope)

    def detect(self, scope: list[str], call: Callable[[dict], str] | None = None, max_pairs: int = 15, now: str = "") -> int:
        """Judge the companies' candidate pairs and replace their contradictions by the confirmed ones; the number of these."""
        pairs = D.first_pairs_auto(self.graph(scope), max_pairs).drop("nth")
        found = D.confirmed_rows(D.judge_pairs(pairs, call))
        one = Window.partitionBy("a_id", "b_id").orderBy(F.desc("ticker"))  # of a pair that two companies filed, each edge counts once
        found = found.withColumn("nth", F.row_number().over(one)).filter("nth = 1")
        new = found.select("a_id", "b_id", "severity", "reasoning", F.lit(now).alias("judged_at"), F.lit("rule" if call is None else "model").alias("judged_by"), F.col("ticker").alias(COMPANY), F.lit(True).alias("fresh"))
        return self.put("contradictions", new, scope, "fresh")


def extract_claims(answers: DataFrame, chunks: DataFrame, documents: DataFrame, by: str, now: str) -> DataFrame:
    """Stored claims of the answers about chunks; quotes are verbatim, ids follow from chunk, topic and quote."""
    raw = C.claims_in(answers)
    place = chunks.select("chunk_id", "section_id", "paragraph_index")
    doc = documents.select("document_id", "date", "source_type", "doc_type", F.col("ticker").alias("company_ticker"))
    rows = raw.join(place, "chunk_id").join(doc, "document_id")
    rows = rows.withColumn("claim_id", T.claim_id(F.col("chunk_id"), F.col("topic"), F.col("quote_span"))).withColumn("page", F.lit(None).cast("int")).withColumn("bbox", F.lit(None).cast("array<double>"))
    return rows.withColumn("extracted_by", F.lit(by)).withColumn("extracted_at", F.lit(now)).select([c.split()[0] for c in schemas.CLAIMS.split(", ")])


def process_pages(store: GraphStore, pages: DataFrame, topics: DataFrame, call: Callable[[str, int], list[dict]] | Client, judge: Callable[[dict], str] | Client | None = None, max_chunks: int = 10, by: str = "rule", now: str = "") -> dict[str, int]:
    """All stages for new pages ``(document_id, html, doc_type, date, period, source_url, source_type, raw_ref, ticker, company_name, cik)``.

    Running it again changes nothing. Only documents with a claim enter the graph. Returns how many documents,
    claims and contradictions were written and how many claims embedded, as the writing jobs counted them, and for how many
    chunks the model's call ``failed``: these have no claims, all else goes on.
    """
    known = [(r.id, [r.name, *(r.aliases or [])]) for r in topics.collect()]  # the topic list is configuration
    scope = store.scope_of(pages)
    store.merge_topics(topics)
    chunks = C.segment(page_blocks(pages))
    store.merge_chunks(chunks, pages, scope)
    selected = C.select_chunks(chunks, pages, [t for _, terms in known for t in terms if t], max_chunks=max_chunks)
    answers = C.extracted(selected, call, [i for i, _ in known]).persist()  # the model is asked once; several tables follow from it
    n_failed = answers.filter("error IS NOT NULL").count()
    n_claims = store.merge_claims(extract_claims(answers, selected, pages, by, now), scope)
    answers.unpersist()
    with_claims = store.table("claims", scope).select("document_id").distinct()
    n_documents = store.merge_documents(pages.drop("html").join(with_claims, "document_id", "left_semi"), scope)
    return {"documents": n_documents, "claims": n_claims, "failed": n_failed, "indexed": store.index_claims(scope=scope), "contradictions": store.detect(scope, judge, now=now)}
