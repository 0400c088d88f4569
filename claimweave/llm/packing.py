"""Packing of documents into training sequences: first-fit decreasing over a tournament tree.

A document's tokens fill whole sequences as far as they reach; only what is left over, shorter than a
sequence, has to share one. Left-over pieces are dealt at random (a seeded hash, even among equal rows) into
groups of about ``GROUP`` pieces, and each group is packed on its own: pieces by falling length, each
into the first open sequence with room for it, found in a tournament tree over the sequences' free
room. The groups' bounded size bounds memory and time of a task, and a lost task repeats one group.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_or_empty, work_table
from .tokens import encoder

LENGTH = 2048
#: Left-over pieces of a group, on average.
GROUP = 8192
END_ID = 1
SEED = "packing-1"


def vocabulary_file() -> str:
    """The ranks of the public byte-level BPE of 50k ids (``byte_bpe_50k``)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of ``byte_bpe_50k.json`` from its file of ranks: the same ids, four times as fast.

    The tokens that the vocabulary adds to its ranks come from the .json file beside that of the ranks.
    """
    import public_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    with open(f"{path.removesuffix('.tiktoken')}.json", encoding="utf-8") as whole:
        added = {token["content"]: token["id"] for token in json.load(whole)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str | None, path: str | None = None) -> np.ndarray:
    """The ids of one text, then the end id. The string of an added token is that token's id, as in ``tokenizers``.

    What ``tiktoken`` cannot split (runs of some million white spaces overflow its pattern's stack) ``tokenizers`` encodes.
    """
    ranks = path or vocabulary_file()
    try:
        found = _encoding(ranks).encode(text or "", allowed_special="all")
    except ValueError:
        found = np.frombuffer(encoder(f"{ranks.removesuffix('.tiktoken')}.json").encode([text])[0], dtype="<u4")
    return np.array([*found, END_ID], dtype="<u4")


def _piece_batches(path: str | None, length: int, keep_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[tuple] = []
                for doc_id, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))):
                    ids = token_ids(text, path)
                    for at in range(0, len(ids), length):
                        piece = ids[at : at + length]
                        out.append((doc_id, key, at, len(piece), crc32(piece.tobytes()), len(ids)) + ((piece.tolist(),) if keep_ids else ()))
                cols = list(zip(*out)) if out else [()] * len(names)
                arrays = [pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[6:]]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pieces


def token_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Each document's tokens in pieces of ``length``, the last one shorter, with CRC-32 of the ids.

    ``path`` names the file of ranks (by default each executor's own copy of the public one).
    ``row_key`` tells rows apart that repeat a doc_id. With ``keep_ids`` the ids themselves come too.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), text_or_empty().alias("text"))
    schema = "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    return named.mapInArrow(_piece_batches(path, length, keep_ids), schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each length: longest first, each into the first bin that has room.

    The tournament tree holds in each inner node the larger free room of its two children, so the
    first bin with room is found by going left wherever the left side has enough.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable").tolist():
        need, node = int(lengths[i]), 1
        if need > capacity:
            raise ValueError(f"a piece of {need} is longer than a sequence of {capacity}")
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def _pack_group(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "row_key", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(bin=bins, offset=offsets)

    return pack


_PIECE = ["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens"]


def pack_pieces(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to each piece of a written table.

    Shared sequences have even ids (group number and bin), whole ones odd ids.
    """
    rest = pieces.filter(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.select(*_PIECE, F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)).alias("pack_group"))
    schema = ", ".join(f"{c} long" for c in [*_PIECE, "pack_group", "bin", "offset"])
    packed = dealt.groupBy("pack_group").applyInPandas(_pack_group(length), schema)
    shared = packed.select(*_PIECE, ((F.col("pack_group") * (1 << 24) + F.col("bin")) * 2).alias("sequence_id"), "offset")
    whole = pieces.filter(F.col("length") == length)
    alone = whole.select(*_PIECE, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(shared)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``length`` tokens.

    Each row of ``docs`` is tokenized once (ids of ``byte_bpe_50k``, then id 1; null text counts as
    empty and so is the end id alone). Each id lies in exactly one piece. Rows that repeat a doc_id
    are documents of their own; a null doc_id stays null. No rows give no pieces.
    """
    return pack_pieces(work_table(token_pieces(docs, path, length), "pieces"), length, group)


def sequence_tokens(docs: DataFrame, packed: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """``(sequence_id, ids)``: the tokens of each packed sequence, not padded.

    Pieces of rows that are equal in doc_id and text are alike, so it doesn't matter which is which.
    """
    key = ["doc_id", "row_key", "start"]
    nth = Window.partitionBy(*key).orderBy(F.lit(0))
    ids = token_pieces(docs, path, length, keep_ids=True).withColumn("nth", F.row_number().over(nth)).select(*key, "nth", "ids")
    placed = packed.withColumn("nth", F.row_number().over(nth)).select(*key, "nth", "sequence_id", "offset")
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*key, "nth"]]
    joined = placed.alias("p").join(ids.alias("i"), same).select("sequence_id", "offset", "ids")
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
