import glob
import io
import struct
import tempfile
from zlib import crc32

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimweave.llm import token_files as T
from claimweave.llm.queries import op12_token_files
from claimweave.llm.tokens import Encoder, tokenizer_file

SCHEMA = "doc_id long, text string"


def ids_of(text):
    found = Tokenizer.from_file(tokenizer_file()).encode(text or "", add_special_tokens=False).ids
    return np.array([*found, T.END_ID], dtype="<u4").tobytes()


def folder():
    return tempfile.mkdtemp(prefix="tokens-") + "/out"


def test_query_against_the_library(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(map(tuple, op12_token_files(spark, sf).collect()))
    at, expected = 0, []
    for doc_id, text in rows:
        ids = ids_of(text)
        expected.append((doc_id, at, len(ids) // 4, crc32(ids)))
        at += len(ids) // 4
    assert got == expected


ODD = ["", " ", "a", "  a  b ", "a\n\nb\nc d\n", "x\t y", "It's\r\nok", "a<|endoftext|> b <|endoftext|>", "日本 語", "a b c", "\x1c a\x85b", "é ​ z", "1 2 3", " \n \n", "😀 😀"]


def test_encoder_on_odd_texts():
    rng = np.random.default_rng(11)
    pool = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "a", "foo", "It's", "<|endoftext|>", "<|", "日本", "é", "1234", "...", "᠎", "​", "\x1c", "😀", "\x00"]
    texts = ODD + ["".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(0, 25))) for _ in range(3000)]
    own, library = Encoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want and own.encode(texts[::-1]) == want[::-1]  # the second time from the table


def test_files_are_plain_zstandard_and_open_few_frames(spark):
    texts = [(i, " ".join(f"w{(i * 7919 + k) % 5003}" for k in range(i * 40))) for i in range(300)]
    path = folder()
    T.write_token_files(spark.createDataFrame(texts, SCHEMA), path)
    whole = b""
    for name in sorted(glob.glob(f"{path}/part-*")):
        content = open(name, "rb").read()
        assert struct.unpack("<I", content[-4:])[0] == T.FOOTER_MAGIC
        whole += zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        held = T.TokenFile.of_bytes(content)
        last = len(held.doc_ids) - 1
        assert held.ids(last) == ids_of(dict(texts)[held.doc_ids[last]]) and held.opened <= 2 < len(held.entries)
    assert whole == b"".join(ids_of(t) for _, t in texts)


def test_requested_documents_only(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 50)) for i in range(500)] + [(7, "another seven")], SCHEMA)
    path = folder()
    T.write_token_files(docs, path)
    found = T.read_documents(spark, path)
    got = T.read_requested(spark, path, found, spark.createDataFrame([(7,), (499,), (10**6,)], "doc_id long")).collect()
    assert sorted((r.doc_id, np.array(r.ids, dtype="<u4").tobytes()) for r in got) == sorted([(7, ids_of("text number 7 " * 7)), (7, ids_of("another seven")), (499, ids_of("text number 499 " * 49))])


def test_damage_is_noticed(spark):
    path = folder()
    T.write_token_files(spark.createDataFrame([(1, "some words " * 100)], SCHEMA).coalesce(1), path)
    content = bytearray(max((open(n, "rb").read() for n in glob.glob(f"{path}/part-*")), key=len))
    content[20] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        T.TokenFile.of_bytes(bytes(content)).ids(0)


def test_odd_rows(spark):
    rows = [(None, "no id"), (3, None), (3, "b"), (3, "b"), (-5, ""), (9, "x" * 200_000), (2, "y\n" * 100_000), (1, " " * 1_000_000)] + [(20 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("start", F.lit("clash")).withColumn("salt", F.lit(1))
    path = folder()
    T.write_token_files(df, path)
    got = T.read_documents(spark, path).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d is not None, d or 0, len(ids_of(t)) // 4, crc32(ids_of(t))) for d, t in rows)
    assert [r.doc_id for r in got] == [None, *sorted(d for d, _ in rows if d is not None)]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_empty_table(spark):
    path = folder()
    T.write_token_files(spark.createDataFrame([], SCHEMA), path)
    assert T.read_documents(spark, path).count() == 0
