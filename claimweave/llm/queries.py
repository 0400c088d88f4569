"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, mil_quality, mixing, packing, perplexity, pii, resharding, runs, simhash, token_files, warc, whitening
from .common import table, work_path


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back, segments reassembled."""
    path = work_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_digests(warc.read_archives(spark, path))


OP1_SQL = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
"""


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of each document."""
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents moved from 32 shards to 40 of equal bytes, written, and read back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    written = resharding.reshard(docs, work_path(spark, "shards"), old_shards=32, new_shards=40)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return written.select("doc_id", resharding.row_size().alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, first-fit decreasing into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("row_key")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = mil_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = mil_quality.score_documents(docs, model)
    score = F.col("quality_score")
    return scored.select("doc_id", mil_quality.held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each row whose vec_id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted strings."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(own.unionByName(odd)))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c),
e AS (SELECT *, before IS NULL OR before <> role AS opens,
      length(text) + (length(text) - length(replace(text, '\', ''))) + length(regexp_extract_all(text, '\[/?INST\]|</?s>|<sep>|<</?SYS>>|<</?ROLE>>')) AS chars FROM w)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + CASE WHEN NOT opens THEN 5 WHEN role = 'user' THEN 22 WHEN role = 'system' THEN 22 WHEN role = 'assistant' THEN 7 ELSE 24 + length(role) END)::BIGINT AS formatted_chars,
       count(*) FILTER (opens) AS n_blocks
FROM e GROUP BY conv_id
"""


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands of all documents."""
    judged = perplexity.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower", "upper", "lang")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated so that the sources have equal shares of as many rows as there are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix_sources(docs).drop("mix_order")  # the rows keep that order


OP9_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n)::DOUBLE / (SELECT count(*) FROM n)::DOUBLE / n AS mix_rate FROM n),
m AS (SELECT source, mix_rate, greatest(1, ceil(mix_rate / {mixing.MAX_MEAN})::INT) AS draws FROM r),
b AS (SELECT source, mix_rate, draws, 0 AS k, exp(-mix_rate / draws) AS p, exp(-mix_rate / draws) AS c FROM m
      UNION ALL SELECT source, mix_rate, draws, k + 1, p * (mix_rate / draws) / (k + 1), c + p * (mix_rate / draws) / (k + 1) FROM b WHERE k < {mixing.MAX_COUNT - 1}),
s AS (SELECT source, mix_rate, draws, list(c ORDER BY k) AS bounds FROM b GROUP BY ALL),
d AS (SELECT doc_id, text, lang, n_chars, s.*, unnest(range(1, draws + 1)) AS i FROM documents JOIN s USING (source)),
u AS (SELECT *, ('0x' || left(md5('{mixing.SEED}|' || doc_id || '|' || i), 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d),
t AS (SELECT doc_id, text, lang, source, n_chars, mix_rate, sum(len(list_filter(bounds, lambda x: x <= u))) AS copies FROM u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, mix_rate, unnest(range(0, copies::BIGINT))::INT AS mix_copy FROM t
"""


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pii.pseudonymise(docs)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound embeddings on the 16 leading components of their codes, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in seekable files and read back."""
    path = work_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by its checksum, repeats some of its words from a place on to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))
    placed = words.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    dealt = placed.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    index = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    again = F.transform(index, lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return dealt.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, with the planted ones."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return runs.periodic_runs(_with_planted_runs(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_simhash_groups": op2_simhash_groups,
        "op3_resharding": op3_resharding,
        "op4_packing": op4_packing,
        "op5_quality": op5_quality,
        "op6_nearest": op6_nearest,
        "op7_chat": op7_chat,
        "op8_rules": op8_rules,
        "op9_mixing": op9_mixing,
        "op10_surrogates": op10_surrogates,
        "op11_whitening": op11_whitening,
        "op12_token_files": op12_token_files,
        "op13_runs": op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op7_chat": OP7_SQL,
        "op9_mixing": OP9_SQL,
    }
