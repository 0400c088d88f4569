"""Vector search with graph enrichment, and company search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.vector_grid import grid_topk
from claimweave.operators.vector_index import VectorIndex


#: Stated queries, or rows of a form's limits, that are broadcast at most.
BROADCAST_QUERIES = 10_000


def few_broadcast(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has at most BROADCAST_QUERIES rows."""
    return F.broadcast(df) if df.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else df


def vector_topk(points: DataFrame, queries: DataFrame, k: int = 10, key: str = "claim_id", index: VectorIndex | None = None) -> DataFrame:
    """The ``k`` points nearest to each query ``(query_id, q_vector[, ticker])`` by cosine, exactly. Ties go to the smaller key.

    With a ``ticker`` in both tables only points of the query's company count. A stored block index is searched where one
    is given (few queries over many points); without one all queries meet all points in a grid of bounded cells.
    """
    if index is not None and "ticker" not in queries.columns:
        return index.search(queries, k)
    return grid_topk(points, queries, k, key, ["ticker"] if "ticker" in queries.columns else [])


def with_conflicts(hits: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Hits with the array ``contradictions`` of their claim, empty where there are none."""
    empty = F.array().cast("array<struct<partner:string,severity:string>>")
    return hits.join(conflicts, "claim_id", "left").withColumn("contradictions", F.coalesce("contradictions", empty))


def search_score(ticker: Column, name: Column, query: Column) -> Column:
    """0 the ticker itself, 1 its beginning, 2 part of the name, 3 part of the ticker, else null."""
    q, t, n = F.lower(F.trim(query)), F.lower(ticker), F.lower(name)
    return F.when(q == "", None).when(t == q, 0).when(F.startswith(t, q), 1).when(F.contains(n, q), 2).when(F.contains(t, q), 3)


def _grams(text: Column, size: Column | int) -> Column:
    """The different substrings of a length."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def company_grams(universe: DataFrame) -> DataFrame:
    """The search index of companies: ``(gram, pos)`` for all parts of one to three characters of tickers and names."""
    texts = [F.lower(F.coalesce(c, F.lit(""))) for c in ("ticker", "name")]
    parts = F.array_distinct(F.flatten(F.array(*(_grams(t, n) for t in texts for n in (1, 2, 3)))))
    return universe.select(F.explode(parts).alias("gram"), "pos")


def company_search(universe: DataFrame, queries: DataFrame, processed: DataFrame, limit: int = 15, grams: DataFrame | None = None) -> DataFrame:
    """The best companies ``(pos, ticker, name, cik)`` for each query ``(query)``, ``processed`` or not.

    A query's rarest part of three characters (or itself, if it is shorter) names the companies that can match, by the stored index
    ``grams`` or one that is built here; these are scored. Equal queries count once, blank ones find nothing.
    """
    index = company_grams(universe) if grams is None else grams
    text = F.lower(F.trim("query"))
    wanted = queries.select("query").distinct().select("query", F.explode(_grams(text, F.greatest(F.lit(1), F.least(F.length(text), F.lit(3))))).alias("gram"))
    known = index.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(known, "gram").groupBy("query").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    found = rarest.join(index, "gram").select("query", "pos").join(universe, "pos")
    scored = found.withColumn("score", search_score(F.col("ticker"), F.col("name"), F.col("query"))).filter("score IS NOT NULL")
    order = Window.partitionBy("query").orderBy("score", F.length("ticker"), "pos")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return flag_processed(top, processed).select("query", "rank", "ticker", "name", "cik", "score", "processed")


def flag_processed(companies: DataFrame, processed: DataFrame) -> DataFrame:
    """Companies with ``processed``: whether their ticker is in the other table."""
    flags = processed.select("ticker").distinct().withColumn("processed", F.lit(True))
    return companies.join(flags, "ticker", "left").withColumn("processed", F.coalesce("processed", F.lit(False)))


def resolve_tickers(universe: DataFrame, asked: DataFrame, processed: DataFrame) -> DataFrame:
    """Companies of the asked tickers ``(pos, ticker)`` in any case, in the asked order; unknown ones drop out."""
    wanted = asked.select(F.col("pos").alias("place"), F.upper("ticker").alias("ticker"))
    return flag_processed(wanted.join(universe, "ticker"), processed).select("place", "ticker", "name", "cik", "processed").orderBy("place")


def recent_filers(filings: DataFrame, universe: DataFrame, limit: int = 12) -> DataFrame:
    """The newest filers: of the filings ``(pos, cik, form, date)`` each ticker's first, ``limit`` of them.

    A cik that several tickers share means the last of them in the universe's order.
    """
    by_cik = universe.groupBy("cik").agg(F.max_by("ticker", "pos").alias("ticker"), F.max_by("name", "pos").alias("name"))
    newest = filings.groupBy("cik").agg(F.min(F.struct("pos", "form", "date")).alias("filing"))
    first = newest.join(by_cik, "cik").groupBy("ticker").agg(F.min(F.struct("filing", "name", "cik")).alias("f"))
    rows = first.select("f.filing.pos", "ticker", "f.name", "f.cik", "f.filing.form", "f.filing.date")
    return rows.orderBy("pos").limit(limit)


def latest_filings(filings: DataFrame, limits: DataFrame) -> DataFrame:
    """The newest filings ``(ticker, form, date, accession)`` of each company, as many as the form's limit."""
    order = Window.partitionBy("ticker", "form").orderBy(F.desc("date"), F.desc("accession"))
    ranked = filings.withColumn("nth", F.row_number().over(order))
    return ranked.join(few_broadcast(limits.select("form", "limit")), "form").filter(F.col("nth") <= F.col("limit")).drop("limit")
