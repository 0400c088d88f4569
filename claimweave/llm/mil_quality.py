"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of about PASSAGE bytes each, as many as it takes to cover it wholly. A passage
is encoded from its bytes alone: how often each pair of neighbouring byte classes occurs, how often the
words of each of BUCKETS hashed buckets occur, and some ratios of its words. A gated attention network
(tanh and sigmoid gates) weighs the encoded passages, learned from the documents' labels only; the weighted
sum is the document's representation, of which a logistic unit makes the score. Attention over any number
of passages is accumulated with a running maximum and sums, so a long text needs no more memory than others.

The model is fitted on the driver to at most MAX_TRAINING documents, chosen by a hash of doc_id among
the labelled rows of the training folds, and of each to at most TRAINING_PASSAGES passages at equal
distances (MAX_TRAINING * TRAINING_PASSAGES * FEATURES * 4 bytes, 163 MB, at most); scoring covers all
passages of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices, text_or_empty

PASSAGE = 1024
#: Documents to which the model is fitted at most, and passages of each.
MAX_TRAINING, TRAINING_PASSAGES = 4096, 16
#: Passages that are scored at once.
BLOCK = 1024
HIDDEN, GATE = 16, 8
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-3

#: Byte classes: other ASCII controls and symbols, lower, upper, digit, space, line feed, sentence marks,
#: bars, exclamation, non-ASCII.
_CLASSES = 10
_CLASS = np.zeros(256, dtype=np.int64)
for _members, _k in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:'\"-?()", 6), (b"|", 7), (b"!", 8), (range(128, 256), 9)):
    _CLASS[list(_members)] = _k
BUCKETS = 512
FEATURES = _CLASSES * _CLASSES + BUCKETS + 6
_PAIRS, _RATIOS = slice(0, _CLASSES * _CLASSES), _CLASSES * _CLASSES + BUCKETS
#: Letters in lower case, marks as spaces.
_PLAIN = bytes(ord(" ") if chr(i) in "\t\n\x0b\x0c\r.,;:!?\"()" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def passages(data: bytes) -> Iterator[bytes]:
    """The bytes of a text in passages of equal length, one at least."""
    n = max(1, round(len(data) / PASSAGE))
    for i in range(n):
        yield data[len(data) * i // n : len(data) * (i + 1) // n]


def encode(data: bytes) -> np.ndarray:
    """Features of one passage."""
    out = np.zeros(FEATURES, dtype=np.float32)
    if data:
        c = _CLASS[np.frombuffer(data, dtype=np.uint8)]
        if len(c) > 1:
            out[_PAIRS] = np.sqrt(np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES) / (len(c) - 1))
        words = data.split()
        lines = [x for x in data.split(b"\n") if x]
        plain = data.translate(_PLAIN).split()
        if plain:
            out[_PAIRS.stop : _RATIOS] = np.sqrt(np.bincount([crc32(w) % BUCKETS for w in plain], minlength=BUCKETS) / len(plain))
        out[_RATIOS] = len(set(words)) / len(words) if words else 0
        out[_RATIOS + 1] = min(4.0, len(data) / (len(words) + 1) / 8)
        out[_RATIOS + 2] = len(set(lines)) / len(lines) if lines else 0
        out[_RATIOS + 3] = min(1.0, len(data) / PASSAGE)
        out[_RATIOS + 4] = sum(w[-1] in b".?!:" for w in words) / len(words) if words else 0
    else:
        out[_RATIOS + 5] = 1
    return out


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def training_bag(text: str | None, limit: int = TRAINING_PASSAGES) -> np.ndarray:
    """Features of a text's passages, one row each; of more than ``limit`` those at equal distances."""
    own = list(passages(text_bytes(text)))
    chosen = own if len(own) <= limit else [own[i * len(own) // limit] for i in range(limit)]
    return np.stack([encode(p) for p in chosen])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights of the network and the features' scaling."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags that begin at rows ``starts`` of ``x``, and what the gradient needs."""
        w = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["we"] + w["be"])
        t, s = np.tanh(h @ w["wt"]), _sigmoid(h @ w["ws"])
        e = (t * s) @ w["wa"]
        bag = np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "y": _sigmoid(z @ w["wo"] + w["bo"])}

    def gradient(self, f: dict[str, np.ndarray], labels: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss."""
        w, bag = self.weights, f["bag"]
        d = (f["y"] - labels) / len(labels)
        dz = d[:, None] * w["wo"][None, :]
        da = (dz[bag] * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[bag])
        dg = de[:, None] * w["wa"][None, :]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz[bag] + dt @ w["wt"].T + ds @ w["ws"].T) * (1 - f["h"] ** 2)
        return {"wo": f["z"].T @ d, "bo": d.sum(keepdims=True), "wa": (f["t"] * f["s"]).T @ de, "wt": f["h"].T @ dt, "ws": f["h"].T @ ds, "we": f["x"].T @ dh, "be": dh.sum(axis=0)}

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts. Passages are encoded and weighed BLOCK at a time."""
        w = self.weights
        top, weight, z = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros((len(texts), HIDDEN))
        rows: list[np.ndarray] = []
        of: list[int] = []

        def add() -> None:
            h = np.tanh((np.stack(rows) - self.mean) / self.scale @ w["we"] + w["be"])
            e = (np.tanh(h @ w["wt"]) * _sigmoid(h @ w["ws"])) @ w["wa"]
            docs, starts = np.unique(of, return_index=True)
            high = np.maximum(top[docs], np.maximum.reduceat(e, starts))
            a = np.exp(e - np.repeat(high, np.diff([*starts, len(of)])))
            before = np.exp(top[docs] - high)  # 0 for a text that begins here
            weight[docs] = weight[docs] * before + np.add.reduceat(a, starts)
            z[docs] = z[docs] * before[:, None] + np.add.reduceat(a[:, None] * h, starts, axis=0)
            top[docs] = high
            rows.clear()
            of.clear()

        for i, text in enumerate(texts):
            for p in passages(text_bytes(text)):
                rows.append(encode(p))
                of.append(i)
                if len(rows) == BLOCK:
                    add()
        if rows:
            add()
        return _sigmoid((z / np.maximum(weight, 1e-300)[:, None]) @ w["wo"] + w["bo"])


def fit(bags: list[np.ndarray], labels: list[int], seed: int = 1) -> Model:
    """Fit by Adam on mini-batches of bags. Without labels of both kinds the score is their share."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
    y = np.array(labels, dtype=np.float64)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"we": init(FEATURES, HIDDEN), "be": np.zeros(HIDDEN), "wt": init(HIDDEN, GATE), "ws": init(HIDDEN, GATE), "wa": init(GATE), "wo": init(HIDDEN), "bo": np.zeros(1)}
    model = Model(x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 0.05, w)
    del x
    if not len(y) or y.min() == y.max():
        w["wo"][:] = 0
        w["bo"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0
        return model
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            own = [bags[i] for i in chosen]
            starts = np.cumsum([0, *(len(b) for b in own[:-1])])
            grad = model.gradient(model.forward(np.concatenate(own).astype(np.float64), starts), y[chosen], starts)
            step += 1
            for k, g in grad.items():
                g = g + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is in the fold that no label is learned from: crc32 of the id's text mod 3 is 1 (null ids: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            bags = [training_bag(t).ravel() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(bags, pa.list_(pa.float32()))], names=["doc_id", "quality", "bag"])


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING) -> Model:
    """Fit to at most ``limit`` labelled documents outside the held-out fold.

    Rows with a null label or id don't count, nor do ids whose labels disagree. Of documents that repeat
    a doc_id the one with the least text counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out())
    agreed = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # at most `limit` ids are broadcast, and as many bags of at most TRAINING_PASSAGES passages collected
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = once.mapInArrow(_encode_batches, "doc_id long, quality int, bag array<float>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable").tolist()
    quality, bags = found.column("quality").to_pylist(), found.column("bag")
    return fit([bags[i].values.to_numpy().reshape(-1, FEATURES) for i in order], [quality[i] for i in order])


def _score_batches(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = model.score(part.column("text").to_pylist())
                keep = [c for c in part.schema.names if c != "quality_score"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, "quality_score"])

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``quality_score`` from 0 to 1 for each row; null texts count as empty texts.

    Rows pass through as they are, repeated ones and those with null ids too. A column of the new name
    is replaced.
    """
    kept = docs.drop("quality_score")
    schema = StructType([*kept.schema, StructField("quality_score", DoubleType())])
    return kept.mapInArrow(_score_batches(model), schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least ``threshold``."""
    return score_documents(docs, train(docs, labels)).filter(F.col("quality_score") >= threshold).drop("quality_score")
