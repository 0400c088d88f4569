"""Quality rules: base counts of a text, and bands of its perplexity under a Kneser-Ney model.

The model reads a text as words. A word whose share of all words, or of its language's in due proportion, is
VOCABULARY_SHARE or more is an event of its own; all others are one event, the rare word, and are spelled out besides. Word events are predicted
from the word before (a bigram model), characters of rare words from the ORDER - 1 before them inside the
word (UTF-16 units; marks before and after the word are white space, which no word holds). Both models are
interpolated, with the three modified Kneser-Ney discounts of each language and order, and keep every
n-gram of the corpus, so they grow with their input. The texts that are scored are those that were counted:
an n-gram that occurs once is the text's own, and counts as unseen there (what it is discounted by stays).

Counting: tasks count the n-grams of their texts, Spark sums the counts of all documents by (language,
n-gram); lower orders are continuation counts of the same table. Storing: each n-gram's log probability goes
under a 64-bit hash of (model, language, n-gram) into sorted hash arrays. The HOT_ENTRIES most frequent ones
at most are broadcast and answer nearly all occurrences where the texts are. The rest lies in parts of about
PART_ENTRIES entries by hash; what the broadcast part leaves open goes there as (row, hash, times), a task
holds the arrays of one part at a time, and only sums come back. Precision and results are the same however
the entries are divided, and no task's memory grows with the model.

The perplexity of a text is per word, so that words in an unusual order, unusual words, and long or unusual
spellings all raise it. For each language the quartiles of the
documents' log perplexity give a lower and an upper bound, wider for short texts; a document outside them
is rejected. Documents that fail the base rules neither set the bounds nor stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty, work_table

#: Characters of an n-gram inside a word.
ORDER = 4
#: Share of all words from which on a word is an event of its own; with L languages, L times this share of its language's
#: words does as well. Each of the two rules holds for 1 / VOCABULARY_SHARE words at most.
VOCABULARY_SHARE = 1e-4
#: Entries of the model that are broadcast at most, and about so many in a part of the rest.
HOT_ENTRIES, PART_ENTRIES = 1 << 20, 1 << 21
#: Band: the median minus and plus so many interquartile ranges, which count as MIN_RANGE at least.
LOWER, UPPER, MIN_RANGE = 4.0, 4.0, 0.1
#: The mean over a short text strays more: a band widens by sqrt(1 + WIDEN / words).
WIDEN = 30.0
#: Languages whose bands are broadcast at most.
BROADCAST_LANGUAGES = 10_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

#: Marks before and after a word: white space, which words don't hold.
_BEFORE, _AFTER = 0x20, 0x0A
_MARKS = chr(_BEFORE) * (ORDER - 1)
#: The two kinds of n-grams, and the bits of one unit of each.
_SPELLING, _WORDS = 0, 1
_BITS = {_SPELLING: 16, _WORDS: 32}
#: Word events: a rare word, the beginning of a text, and from _FIRST on the vocabulary.
_RARE, _START, _FIRST = 0, 1, 2
#: Distinct n-grams a task holds before it hands them on.
_HELD = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STRIP = b" \t\n\x0b\x0c\r"


class Words:
    """The words of a slice of texts: per document counts, and each word's number in a dictionary."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = raw
        data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)  # a space ends each document
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        ends = np.cumsum(sizes + 1)
        begins = ends - sizes - 1
        ink = ~_SPACE[data]
        start = ink.copy()
        start[1:] &= ~ink[:-1]
        total = lambda mask: np.add.reduceat(mask.astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
        self.n_words = total(start)
        self.word_chars = total(ink & ((data & 0xC0) != 0x80))
        self.n_symbols = total(_SYMBOL[data])
        self.doc = np.repeat(np.arange(len(raw)), self.n_words)
        packed = data[ink]
        at = np.nonzero(start)[0]
        offsets = np.concatenate([np.cumsum(ink)[at] - 1, [len(packed)]]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
        coded = words.dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.dictionary = coded.dictionary.to_pylist()

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the dictionary's words."""
        return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in self.dictionary), dtype=np.uint64, count=len(self.dictionary))

    def duplicate_lines(self) -> list[int]:
        """Lines with a word that equal an earlier line, by document."""
        out = []
        for r in self.raw:
            lines = [x for x in r.split(b"\n") if x.strip(_STRIP)]
            out.append(len(lines) - len(set(lines)))
        return out

    def repeated_words(self) -> np.ndarray:
        """Words that lie in a WINDOW-word window found twice or more in their document, by document."""
        ids, doc = self.ids, self.doc
        count = np.zeros(len(self.raw), dtype=np.int64)
        n = len(ids) - WINDOW + 1
        if n <= 0:
            return count
        whole = np.nonzero(doc[:n] == doc[WINDOW - 1 :])[0]
        h = doc[whole].astype(np.uint64)
        for k in range(WINDOW):
            h = (h ^ (ids[whole + k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(order) + 1, dtype=bool)
        same[1:-1] = h[order][1:] == h[order][:-1]
        suspects = np.sort(order[same[1:] | same[:-1]])
        seen: dict[tuple, int] = {}
        covered = np.zeros(len(ids) + 1, dtype=np.int64)
        windows = [(int(doc[i]), *ids[i : i + WINDOW].tolist()) for i in whole[suspects]]  # the hash only chose whom to compare
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        for i, w in zip(whole[suspects].tolist(), windows):
            if seen[w] > 1:
                covered[i] += 1
                covered[i + WINDOW] -= 1
        inside = np.cumsum(covered)[:-1] > 0
        return np.bincount(doc[inside], minlength=len(self.raw)).astype(np.int64)


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ORDER-grams of words, packed 16 bits a unit, and the number of each gram's word."""
    text = "".join(f"{_MARKS}{w.decode('utf-8', 'replace')}{chr(_AFTER)}" for w in words)
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint64)
    first = (units == _BEFORE).astype(np.int64)
    first[1:] &= units[:-1] != _BEFORE
    word = np.cumsum(first) - 1
    at = np.nonzero(units != _BEFORE)[0]
    code = units[at].copy()
    for k in range(1, ORDER):
        code |= units[at - k] << np.uint64(16 * k)
    return code, word[at]


def _lang_codes(langs: list[str | None]) -> tuple[np.ndarray, list[str]]:
    names = sorted({x or "" for x in langs})
    number = {x: i for i, x in enumerate(names)}
    return np.array([number[x or ""] for x in langs], dtype=np.int64), names


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    code, n = (np.concatenate(x) for x in zip(*parts))
    unique, inverse = np.unique(code, return_inverse=True)
    return unique, np.bincount(inverse, weights=n, minlength=len(unique)).astype(np.int64)


class _Held:
    """Counts that a task gathers by (kind, language) until they are many."""

    def __init__(self):
        self.parts: dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, kind: int, lang: str, code: np.ndarray, n: np.ndarray) -> None:
        self.parts.setdefault((kind, lang), []).append(_summed([(code, n)]))

    def _size(self) -> int:
        return sum(len(c) for parts in self.parts.values() for c, _ in parts)

    def full(self) -> bool:
        if self._size() <= _HELD:
            return False
        self.parts = {k: [_summed(parts)] for k, parts in self.parts.items()}
        return self._size() > _HELD // 2

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (kind, lang), parts in self.parts.items():
            code, n = _summed(parts)
            for at in range(0, len(code), 1 << 17):
                c, m = code[at : at + (1 << 17)], n[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, dtype=np.int32)), pa.array([lang] * len(c)), pa.array(c.view(np.int64)), pa.array(m)], names=["kind", "lang", "gram", "n"])
        self.parts = {}


_COUNTED = "kind int, lang string, gram long, n long"


def _by_lang(w: Words, lang: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[str, slice]]]:
    """Distinct (language, word) numbers, the number of each token's, and each language's run of them."""
    size = max(1, len(w.dictionary))
    seen, inverse = np.unique(lang[w.doc] * size + w.ids, return_inverse=True)
    cuts = np.searchsorted(seen, np.arange(len(names) + 1) * size)
    return seen % size, inverse, [(name, slice(a, b)) for name, a, b in zip(names, cuts, cuts[1:]) if b > a]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spelling n-grams of all words, and words by their hashes."""
    held = _Held()
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(part.column("text").to_pylist())
            word, inverse, runs = _by_lang(w, *_lang_codes(part.column("lang").to_pylist()))
            times, hashes = np.bincount(inverse, minlength=len(word)), w.hashes()
            for name, run in runs:
                code, of = _grams([w.dictionary[i] for i in word[run].tolist()])
                held.add(_SPELLING, name, code, times[run][of])
                held.add(_WORDS, name, hashes[word[run]], times[run])
            if held.full():
                yield from held.flush()
    yield from held.flush()


class Vocabulary:
    """The words that are events of their own: by language sorted hashes, numbered from _FIRST."""

    def __init__(self, words: list[tuple[str, int]]):
        by: dict[str, list[tuple[int, int]]] = {}
        for k, (lang, code) in enumerate(sorted(words)):
            by.setdefault(lang, []).append((code % (1 << 64), k + _FIRST))
        self.by = {lang: tuple(np.array(x, dtype=np.uint64) for x in zip(*sorted(own))) for lang, own in by.items()}

    def events(self, lang: str, hashes: np.ndarray) -> np.ndarray:
        """The word event of each hash."""
        if lang not in self.by:
            return np.full(len(hashes), _RARE, dtype=np.uint64)
        keys, numbers = self.by[lang]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, numbers[at], np.uint64(_RARE))


def _word_events(w: Words, word: np.ndarray, runs: list[tuple[str, slice]], vocabulary: Vocabulary) -> np.ndarray:
    """The event of each distinct (language, word)."""
    hashes, event = w.hashes(), np.zeros(len(word), dtype=np.uint64)
    for name, run in runs:
        event[run] = vocabulary.events(name, hashes[word[run]])
    return event


def _word_codes(w: Words, event: np.ndarray) -> np.ndarray:
    """Each token's bigram: the event before it and its own."""
    before = np.full(len(event), _START, dtype=np.uint64)
    before[1:] = np.where(w.doc[1:] == w.doc[:-1], event[:-1], np.uint64(_START))
    return (before << np.uint64(32)) | event


def _pair_batches(vocabulary):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text").to_pylist())
                lang, names = _lang_codes(part.column("lang").to_pylist())
                word, inverse, runs = _by_lang(w, lang, names)
                code = _word_codes(w, _word_events(w, word, runs, vocabulary.value)[inverse]) if len(word) else np.zeros(0, np.uint64)
                of = lang[w.doc]
                for k, name in enumerate(names):
                    own = code[of == k]
                    if len(own):
                        held.add(_WORDS, name, own, np.ones(len(own)))
                if held.full():
                    yield from held.flush()
        yield from held.flush()

    return pairs


def _level_probabilities(counts: DataFrame, lower: DataFrame | None, order: int, bits: int) -> DataFrame:
    """Interpolated ``(lang, gram, n, p)`` of one order.

    ``counts`` holds the (continuation) counts of this order, ``lower`` the order below. A count of one
    is the scored text's own and gives no probability by itself.
    """
    number = lambda k: F.sum((F.col("n") == k).cast("long")).alias(f"n{k}")
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        plain = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        # counts of counts of a tiny corpus may be zero; half of the count is then as good
        return F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.1), F.least(plain, F.lit(k - 0.05)))).otherwise(F.lit(k / 2)).alias(f"d{k}")

    of_lang = counts.groupBy("lang").agg(*(number(k) for k in (1, 2, 3, 4)), F.count(F.lit(1)).alias("kinds"))
    of_lang = of_lang.select("lang", "kinds", *(discount(k) for k in (1, 2, 3)))
    by_context = counts.withColumn("context", F.shiftrightunsigned("gram", bits) if order > 1 else F.lit(0).cast("long"))
    sums = by_context.groupBy("lang", "context").agg(F.sum("n").alias("all"), number(1), number(2), F.count(F.lit(1)).alias("kinds_here"))
    left = F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * (F.col("kinds_here") - F.col("n1") - F.col("n2"))
    weights = sums.join(of_lang, "lang").select("lang", "context", "all", (left / F.col("all")).alias("g"), "kinds", "d1", "d2", "d3")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    own = by_context.join(weights, ["lang", "context"]).withColumn("own", F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.col("n") - d) / F.col("all")).otherwise(F.lit(0.0)))
    if lower is None:
        p = own.withColumn("p", F.col("own") + F.col("g") / (F.col("kinds") + 1))
    else:
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (bits * (order - 1))) - 1))
        p = own.withColumn("suffix", suffix).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"]).withColumn("p", F.col("own") + F.col("g") * F.col("below"))
    return p.select("lang", "gram", "n", "p")


def probabilities(top: DataFrame, order: int, bits: int) -> DataFrame:
    """``(lang, gram, n, p)`` of all n-grams of ``top``, which holds their counts."""
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (bits * k)) - 1))
        counts[k] = work_table(counts[k + 1].select("lang", suffix.alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), f"counts{k}")
    below = None
    for k in range(1, order + 1):
        below = _level_probabilities(counts[k], below, k, bits)
        if k < order:
            below = work_table(below, f"p{k}")
    return below


def _hash(kind: int, lang: str, code: np.ndarray) -> np.ndarray:
    """Signed 64-bit hash of (kind, language, code), one to one for each (kind, language)."""
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), kind))
    h = (code ^ seed) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, code = batch.column("kind").to_numpy(), batch.column("gram").to_numpy().view(np.uint64)
        lang, names = _lang_codes(batch.column("lang").to_pylist())
        hashed = np.zeros(len(code), dtype=np.int64)
        for k, name in enumerate(names):
            for one in np.unique(kind):
                own = (lang == k) & (kind == one)
                hashed[own] = _hash(int(one), name, code[own])
        yield pa.RecordBatch.from_arrays([pa.array(hashed), batch.column("n"), batch.column("value")], names=["hash", "n", "value"])


class HashArrays:
    """Log probabilities under their sorted hashes."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray, values: np.ndarray):
        order = np.lexsort((-n, hashes))  # of two n-grams with one hash the more frequent one counts
        hashes, values = hashes[order], values[order]
        first = np.ones(len(hashes), dtype=bool)
        first[1:] = hashes[1:] != hashes[:-1]
        self.keys, self.values = hashes[first], values[first]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The values of hashes; NaN where there is none."""
        if not len(self.keys):
            return np.full(len(hashes), np.nan)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.values[at], np.nan)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_or_empty().alias("text"))


def model_table(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """The model of all documents, ``(hash, n, value)``, and its vocabulary."""
    texts = _named(docs).select("lang", "text")
    sums = lambda found: found.groupBy("kind", "lang", "gram").agg(F.sum("n").alias("n"))
    counts = work_table(sums(texts.mapInArrow(_count_batches, _COUNTED)), "counts")
    words = counts.filter(F.col("kind") == _WORDS)
    of_lang = work_table(words.groupBy("lang").agg(F.sum("n").alias("of_lang")), "languages")
    total, langs = of_lang.agg(F.coalesce(F.sum("of_lang"), F.lit(0)), F.count(F.lit(1))).first()
    enough = F.least(F.lit(total * VOCABULARY_SHARE), F.col("of_lang") * F.lit(langs * VOCABULARY_SHARE))
    frequent = words.join(of_lang, "lang").filter(F.col("n") >= enough).select("lang", "gram").collect()  # 2 / VOCABULARY_SHARE rows at most
    vocabulary = Vocabulary([(r.lang, r.gram) for r in frequent])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    pairs = work_table(sums(texts.mapInArrow(_pair_batches(shared), _COUNTED)), "pairs")
    models = {_SPELLING: probabilities(counts.filter(F.col("kind") == _SPELLING).drop("kind"), ORDER, _BITS[_SPELLING]), _WORDS: probabilities(pairs.drop("kind"), 2, _BITS[_WORDS])}
    rows = [p.select(F.lit(kind).alias("kind"), "lang", "gram", "n", F.log("p").alias("value")) for kind, p in models.items()]
    return work_table(rows[0].unionByName(rows[1]).mapInArrow(_hash_batches, "hash long, n long, value double"), "model"), vocabulary


def divide(model: DataFrame, limit: int) -> tuple[HashArrays, DataFrame, int]:
    """The most frequent entries, ``limit`` of them at most, as arrays; the rest, and how many those are."""
    bucket = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = {r.b: r["count"] for r in model.groupBy(bucket.alias("b")).count().collect()}  # 63 rows at most
    hot, cut = 0, 0
    for b in sorted(sizes, reverse=True):
        if hot + sizes[b] > limit:
            cut = b + 1
            break
        hot += sizes[b]
    found = model.filter(F.col("n") >= (1 << cut)).toArrow() if hot else model.limit(0).toArrow()
    arrays = HashArrays(*(found.column(c).to_numpy() for c in ("hash", "n", "value")))
    return arrays, model.filter(F.col("n") < (1 << cut)), sum(sizes.values()) - hot


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURED = f"doc_id long, lang string, {', '.join(f'{c} long' for c in _COUNTS)}, logs double, open_hash array<long>, open_times array<int>"


class _Open:
    """Occurrences ``(document, hash)`` that the broadcast arrays don't hold."""

    def __init__(self):
        self.docs, self.hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, docs: np.ndarray, hashes: np.ndarray) -> None:
        self.docs.append(docs)
        self.hashes.append(hashes)

    def lists(self, n: int) -> tuple[pa.Array, pa.Array]:
        """For each of ``n`` documents its distinct hashes, and how often each occurs."""
        doc, h = np.concatenate(self.docs), np.concatenate(self.hashes)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        fresh = np.ones(len(doc), dtype=bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        at = np.nonzero(fresh)[0]
        times = np.diff([*at, len(doc)]).astype(np.int32)
        offsets = pa.array(np.searchsorted(doc[at], np.arange(n + 1)), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(h[at])), pa.ListArray.from_arrays(offsets, pa.array(times))


def _log_sums(w: Words, langs: list[str | None], arrays: HashArrays, vocabulary: Vocabulary, left: _Open) -> np.ndarray:
    """For each document the log probability of its events in ``arrays``; the other ones go to ``left``."""
    sums = np.zeros(len(w.raw))
    if not len(w.ids):
        return sums
    lang, names = _lang_codes(langs)
    word, inverse, runs = _by_lang(w, lang, names)
    event = _word_events(w, word, runs, vocabulary)
    code, of = _word_codes(w, event[inverse]), lang[w.doc]
    for k, name in enumerate(names):
        own = np.nonzero(of == k)[0]
        unique, back = np.unique(code[own], return_inverse=True)
        hashes = _hash(_WORDS, name, unique)
        found = arrays.find(hashes)
        known = ~np.isnan(found)
        sums += np.bincount(w.doc[own], weights=np.where(known, found, 0)[back], minlength=len(sums))
        if not known.all():
            missing = np.nonzero(~known[back])[0]
            left.add(w.doc[own[missing]], hashes[back[missing]])
    spelled = np.zeros(len(word))
    tokens: np.ndarray | None = None
    for name, run in runs:
        rare = np.nonzero(event[run] == _RARE)[0] + run.start
        if not len(rare):
            continue
        grams, at = _grams([w.dictionary[i] for i in word[rare].tolist()])
        unique, back = np.unique(grams, return_inverse=True)
        hashes = _hash(_SPELLING, name, unique)
        found = arrays.find(hashes)
        known = ~np.isnan(found)
        spelled[rare] = np.bincount(at, weights=np.where(known, found, 0)[back], minlength=len(rare))
        if not known.all():
            missing = np.nonzero(~known[back])[0]
            if tokens is None:  # tokens by the number of their word
                tokens = np.argsort(inverse, kind="stable")
                starts = np.searchsorted(inverse[tokens], np.arange(len(word) + 1))
            owner = rare[at[missing]]
            n = starts[owner + 1] - starts[owner]
            places = np.repeat(starts[owner] - np.cumsum(n) + n, n) + np.arange(n.sum())
            left.add(w.doc[tokens[places]], np.repeat(hashes[back[missing]], n))
    return sums + np.bincount(w.doc, weights=spelled[inverse], minlength=len(sums))


def _rule_batches(shared):
    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, vocabulary = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                w, left = Words(part.column("text").to_pylist()), _Open()
                sums = _log_sums(w, part.column("lang").to_pylist(), arrays, vocabulary, left)
                counts = [w.n_words, w.word_chars, w.n_symbols, np.array(w.duplicate_lines(), dtype=np.int64), w.repeated_words()]
                columns = [part.column("doc_id"), part.column("lang"), *(pa.array(a, pa.int64()) for a in counts), pa.array(sums), *left.lists(part.num_rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", *_COUNTS, "logs", "open_hash", "open_times"])

    return rules


def _answer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (part, is_asked): a part's entries, then what is asked of it."""
    held, parts, arrays = None, [], None
    for batch in batches:
        part, asked = batch.column("part").to_numpy(), batch.column("is_asked").to_numpy(zero_copy_only=False).astype(bool)
        hashes, n, value, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "n", "value", "row_no"))
        cuts = np.concatenate([[0], np.nonzero((np.diff(part) != 0) | (np.diff(asked.astype(int)) != 0))[0] + 1, [len(part)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if part[lo] != held:
                held, parts, arrays = part[lo], [], None
            if not asked[lo]:
                parts.append((hashes[lo:hi].copy(), n[lo:hi].copy(), value[lo:hi].copy()))
                continue
            arrays = arrays or HashArrays(*(np.concatenate(x) for x in zip(*parts)))
            rows, back = np.unique(row[lo:hi], return_inverse=True)
            logs = np.bincount(back, weights=n[lo:hi] * arrays.find(hashes[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), pa.array(logs)], names=["row_no", "rest"])


def rest_sums(rows: DataFrame, rest: DataFrame, n_rest: int, part_entries: int) -> DataFrame:
    """``(row_no, rest)``: what the entries outside the broadcast arrays add to a row's log probability."""
    parts = -(-n_rest // part_entries)
    entries = rest.select("hash", "n", "value", F.lit(-1).cast("long").alias("row_no"), F.lit(False).alias("is_asked"))
    listed = rows.select("row_no", F.explode(F.arrays_zip("open_hash", "open_times")).alias("o"))
    asked = listed.select(F.col("o.open_hash").alias("hash"), F.col("o.open_times").cast("long").alias("n"), F.lit(0.0).alias("value"), "row_no", F.lit(True).alias("is_asked"))
    placed = entries.unionByName(asked).withColumn("part", F.pmod("hash", F.lit(parts)))
    answered = placed.repartition("part").sortWithinPartitions("part", "is_asked").mapInArrow(_answer_batches, "row_no long, rest double")
    return answered.groupBy("row_no").agg(F.sum("rest").alias("rest"))


def measure(docs: DataFrame, model: DataFrame, vocabulary: Vocabulary, hot_entries: int | None = None, part_entries: int | None = None) -> DataFrame:
    """Base counts and log perplexity (null without words) of each row; null texts have none.

    ``model`` and ``vocabulary`` are those of ``docs`` (:func:`model_table`): each event has an entry.
    """
    arrays, rest, n_rest = divide(model, HOT_ENTRIES if hot_entries is None else hot_entries)
    shared = docs.sparkSession.sparkContext.broadcast((arrays, vocabulary))
    rows = _named(docs).mapInArrow(_rule_batches(shared), _MEASURED)
    if n_rest:
        rows = work_table(rows.withColumn("row_no", F.monotonically_increasing_id()), "scored")
        sums = rest_sums(rows, rest, n_rest, part_entries or PART_ENTRIES)
        rows = rows.join(sums, "row_no", "left").withColumn("logs", F.col("logs") + F.coalesce("rest", F.lit(0.0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    mean = F.when(F.col("n_words") > 0, -F.col("logs") / F.col("n_words"))
    return rows.select("doc_id", "lang", *_COUNTS, mean.alias("log_perplexity"), failed.alias("base_failed"))


def bands(measured: DataFrame) -> DataFrame:
    """``(lang, middle, width)``: median and range of log perplexity of the rows that pass the base rules."""
    q = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000)
    quartiles = measured.filter("NOT base_failed").groupBy("lang").agg(q.alias("q"))
    width = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(MIN_RANGE))
    return quartiles.select("lang", F.col("q")[1].alias("middle"), width.alias("width"))


def judge_documents(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, ``log_perplexity``, its band and ``kept`` of each row of ``docs``.

    Repeated rows and null ids pass through; a null language is a language of its own. Tables without
    rows give none.
    """
    measured = work_table(measure(docs, *model_table(docs)), "measured")
    found = work_table(bands(measured), "bands")
    few = found.count() <= BROADCAST_LANGUAGES  # beyond that an ordinary join, whose skew AQE splits
    judged = measured.join(F.broadcast(found) if few else found, "lang", "left")
    widened = F.col("width") * F.sqrt(1 + F.lit(WIDEN) / F.greatest(F.lit(1), F.col("n_words")))
    judged = judged.withColumn("lower", F.col("middle") - LOWER * widened).withColumn("upper", F.col("middle") + UPPER * widened)
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
