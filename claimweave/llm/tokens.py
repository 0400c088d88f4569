"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once in a while.

The byte-level BPE never joins characters across a single space between two other characters, nor across a
single line feed between two such: its pre-tokens end there. A text is therefore cut at these places, every
distinct piece of a batch is encoded once by the library, and results are kept in a bounded table. All else
(runs of white space, tabs, pieces that begin or end in white space) goes to the library uncut together
with its neighbours. Ids are those of the whole text; the tests compare the two. With 1.25 MB a second and core
for whole texts the library alone would be the slowest step of every operator on tokens.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np

#: Encoded pieces that a worker keeps; of a fuller table only the last batch's stay. Longer pieces are not kept.
KEPT, KEPT_CHARS = 3 << 18, 48
#: Characters that the library takes at once when distinct pieces are encoded.
AT_ONCE = 1 << 11
#: White space of Python, and what counts as such in some Unicode version or engine.
_EDGES = "".join(c for c in map(chr, range(0x10000)) if c.isspace()) + "\u180e\u200b\u200e\u200f\ufeff"

#: Punctuation behind words, and the last letter of blocks that all Unicode versions in use agree on.
_MARKS, _SETTLED = ".,;:!?)\"", "\u04ff"


def tokenizer_file() -> str:
    """The public byte-level BPE of 50k ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Shown(dict):
    """The characters that stand for a character's bytes in the vocabulary, by code point."""

    def __missing__(self, code: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        self[code] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]
        return self[code]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._added = [token.content for token in self._library.get_added_tokens_decoder().values()]
        self._line_feed = self._whole("\n")
        self._line_feed_id = np.frombuffer(self._line_feed, dtype="<u4")[0]
        self._shown = _Shown()
        self._marks: dict[str, bytes] = {}
        self._bare: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        found = self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(found, dtype="<u4").tobytes()

    def _learn(self, table: dict[str, bytes], pieces: list[str], before: str) -> None:
        """Encode distinct plain pieces without line feeds, many in one text with line feeds between them."""
        single = {p for p in pieces if any(token in p for token in self._added)}  # these cut the text they stand in
        table.update((p, self._whole(before + p)) for p in single)
        pieces = [p for p in pieces if p not in single] if single else pieces
        joint, start, held = "\n" + before, 0, 0
        for i, piece in enumerate(pieces):
            held += len(piece) + 1
            if held > AT_ONCE or i == len(pieces) - 1:
                group, start, held = pieces[start : i + 1], i + 1, 0
                ids = np.frombuffer(self._whole(before + joint.join(group)), dtype="<u4")
                cuts = 4 * np.nonzero(ids == self._line_feed_id)[0]
                raw, at = ids.tobytes(), 0
                for p, end in zip(group, [*cuts.tolist(), len(raw)], strict=True):
                    table[p] = raw[at:end]
                    at = end + 4

    def _words(self, table: dict[str, bytes], pieces: list[str], before: str) -> list[str]:
        """Encode pieces that are a word of letters and perhaps punctuation behind it; return the others.

        The word is one pre-token, which goes straight to the library's model, and the punctuation is another.
        """
        rest, marked = [], []
        tokenize, shown, head = self._library.model.tokenize, self._shown, before.translate(self._shown)
        for p in pieces:
            word = p.rstrip(_MARKS)
            plain = word.isascii()
            if not (word.isalpha() and (plain or max(word) <= _SETTLED)):
                rest.append(p)
                continue
            if word not in table:
                ids = [t.id for t in tokenize(head + (word if plain else word.translate(shown)))]
                table[word] = pack(f"<{len(ids)}I", *ids)
            if word != p:
                marked.append((p, word, p[len(word) :]))
        for p, word, marks in marked:
            if marks not in self._marks:
                self._marks[marks] = self._whole(marks)
            table[p] = table[word] + self._marks[marks]
        return rest

    def _fill(self, table: dict[str, bytes], pieces: set[str], before: str) -> None:
        """Add the pieces that stand behind ``before`` to a table, as far as they can be cut out."""
        single = self._words(table, [p for p in pieces if "\n" not in p], before)
        self._learn(table, [p for p in single if p.strip(_EDGES) == p != ""], before)
        feed = self._line_feed
        lines = {p: q for p in pieces if "\n" in p and all(q := [x if x.strip(_EDGES) == x else "" for x in p.split("\n")])}
        self._learn(table, self._words(table, list({q[0] for q in lines.values()} - table.keys()), before), before)
        self._learn(self._bare, self._words(self._bare, list({x for q in lines.values() for x in q[1:]} - self._bare.keys()), ""), "")
        for p, q in lines.items():
            table[p] = feed.join([table[q[0]], *map(self._bare.__getitem__, q[1:])])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [text.split(" ") for text in texts]
        # the first piece of a text stands bare, all others behind the space they were cut at
        heads, wanted = {c[0] for c in cut}, set(chain.from_iterable(cut))
        for name, own in (("_bare", heads), ("_spaced", wanted)):
            if len(getattr(self, name)) > KEPT:  # what this batch holds stays
                setattr(self, name, {p: ids for p, ids in getattr(self, name).items() if p in own})
        new_heads, new = heads.difference(self._bare), wanted.difference(self._spaced)
        self._fill(self._bare, new_heads, "")
        self._fill(self._spaced, new, " ")
        out, find = [], self._spaced.__getitem__
        for pieces in cut:
            try:
                found = list(map(find, pieces))
                found[0] = self._bare[pieces[0]]
                out.append(b"".join(found))
            except KeyError:
                out.append(self._around(pieces))
        for own, table in ((new_heads, self._bare), (new, self._spaced)):
            for p in own:
                if len(p) > KEPT_CHARS:
                    table.pop(p, None)
        return out

    def _around(self, pieces: list[str]) -> bytes:
        """A text with pieces that can't be cut out: each goes to the library together with what it touches."""
        out: list[bytes] = []
        start, plain = 0, [p.strip(_EDGES) == p != "" for p in pieces]
        for i in range(1, len(pieces) + 1):
            if i == len(pieces) or (plain[i - 1] and plain[i]):
                alone = (self._spaced if start else self._bare).get(pieces[start]) if i == start + 1 else None
                out.append(self._whole((" " if start else "") + " ".join(pieces[start:i])) if alone is None else alone)
                start = i
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder of a tokenizer file (by default each executor's own copy of the public one)."""
    return Encoder(path or tokenizer_file())
