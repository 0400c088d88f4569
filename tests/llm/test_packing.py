from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimweave.llm import packing
from claimweave.llm.packing import END_ID, pack_documents, token_ids

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

SCHEMA = "doc_id long, text string, start int, ids string"


def test_pieces_and_sequences(spark):
    texts = [None, "", "a", "<|endoftext|> x", "a <|endoftext|><|endoftext|>\n<|endoftext| > b", "word " * 3000, "é𝄞\n\n  x\t" * 500, "z" * 70000] + [f"text {i} " * (i % 90) for i in range(300)]
    rows = [(i, t, 0, "clash") for i, t in enumerate(texts)] + [(2, "a", 0, "clash"), (None, "null id", 0, "clash")]
    docs = spark.createDataFrame(rows, SCHEMA)
    packed = packing.pack_documents(docs, group=64).cache()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            piece = np.array(ids[at : at + 2048], dtype="<u4")
            want.append((str(doc_id), at, len(piece), crc32(piece.tobytes()), len(ids)))
    got = packed.collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    by_sequence = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == by_sequence.get(r.sequence_id, 0)
        by_sequence[r.sequence_id] = r.offset + r.length
    assert max(by_sequence.values()) <= 2048
    sequences = {r.sequence_id: r.ids for r in packing.sequence_tokens(docs, packed).collect()}
    assert {k: len(v) for k, v in sequences.items()} == by_sequence
    for r in got:
        piece = np.array(sequences[r.sequence_id][r.offset : r.offset + r.length], dtype="<u4")
        assert crc32(piece.tobytes()) == r.ids_crc32


def test_first_fit_decreasing_matches_a_plain_search():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 37, 500):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room, want = [], {}
        for i in np.argsort(-lengths, kind="stable").tolist():
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            room += [100] * (k == len(room))
            want[i] = (k, 100 - room[k])
            room[k] -= lengths[i]
        assert {i: (bins[i], offsets[i]) for i in range(n)} == want


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("space", [" ", "\n", "\t", " ", "\r\n"])
def test_a_million_spaces(space):
    for text in (space * 10**6, "a" + space * 1_200_000 + "b c"):
        assert token_ids(text).tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, END_ID]


def test_ten_million_spaces():
    text = "a" + " " * 10**7 + "b"
    assert token_ids(text).tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, END_ID]


def test_random_code_points():
    rng = np.random.default_rng(8)
    pool = [*" \t\n\r 　 ", "  ", "\n\n", "ab", "'s", "1", "é", "́", "<|endoftext|>", "\U0001f600", "日"]
    for _ in range(2000):
        odd = "".join(chr(c) for c in rng.integers(0, 0xD800, 8).tolist())
        text = "".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(0, 20))) + odd
        assert token_ids(text).tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, END_ID], repr(text)


def test_documents_and_pages(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    for text, want in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert token_ids(text).tolist() == [*want.ids, END_ID]


def test_packing_runs_over_such_texts(spark):
    rows = [(1, " " * 1_000_000), (2, "a b c"), (3, None)]
    packed = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {d: len(token_ids(t)) for d, t in rows}
