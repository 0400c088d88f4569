"""Vector expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a length is zero."""
    pair = F.struct(a.alias("a"), b.alias("b"))
    return let(pair, lambda p: dot(p["a"], p["b"]) / F.nullif(F.sqrt(dot(p["a"], p["a"])) * F.sqrt(dot(p["b"], p["b"])), F.lit(0.0)))


def word_slots(text: Column, dim: int = 64) -> Column:
    """The component of each word of a text: its hash modulo ``dim``."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))


def _occurrences(slots: Column, slot: Column) -> Column:
    # without a lambda, which would be evaluated for each word
    return F.size(slots) - F.size(F.array_remove(slots, slot))


def slot_counts(slots: Column, dim: int = 64) -> Column:
    """The vector of word slots: component i counts those that are i."""
    count = lambda i: F.when(F.array_contains(slots, i), _occurrences(slots, i)).when(slots.isNotNull(), 0)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: count(i).cast("float"))


def slot_cosine(a: Column, b: Column) -> Column:
    """:func:`cosine` of the vectors of two arrays of word slots, without making them; all sums are whole numbers and exact."""
    product = lambda x, y: F.aggregate(x, F.lit(0.0), lambda s, slot: s + _occurrences(y, slot))
    return product(a, b) / F.nullif(F.sqrt(product(a, a)) * F.sqrt(product(b, b)), F.lit(0.0))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A bag of hashed words: component i counts the words whose hash is i modulo ``dim``."""
    return let(word_slots(text, dim), lambda own: slot_counts(own, dim))
