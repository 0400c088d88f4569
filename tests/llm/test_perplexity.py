import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimweave.llm import perplexity as P

SCHEMA = "doc_id long, text string, lang string, n_words string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def units(word):
    return "".join(map(chr, np.frombuffer(word.encode("utf-16-le"), dtype="<u2")))


def modified_kneser_ney(top):
    """Probability of an n-gram (a tuple) by a plain modified Kneser-Ney model with counts ``top``, as dictionaries."""
    order = len(next(iter(top)))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else None
        d = {j: min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.1), j - 0.05) if n[j] and n[1] else j / 2 for j in (1, 2, 3)}
        total, left = defaultdict(int), defaultdict(float)
        for g, x in c.items():
            total[g[:-1]] += x
            left[g[:-1]] += d[min(x, 3)]
        tables[k] = (c, d, total, left, len(c))

    def p(g):
        c, d, total, left, kinds = tables[len(g)]
        below = p(g[1:]) if len(g) > 1 else 1 / (kinds + 1)
        if g[:-1] not in total:
            return below
        own = max(0, c[g] - d[min(c[g], 3)]) if c[g] > 1 else 0  # one is the text's own
        return (own + left[g[:-1]] * below) / total[g[:-1]]

    return p


def scorer(texts, vocabulary):
    """Log perplexity a word under the model of ``texts``: words of the vocabulary, spelled rare words."""

    def events(t):
        seq = ["<start>", *(w if w in vocabulary else "<rare>" for w in WORD.findall(t))]
        return list(zip(seq, seq[1:]))

    def grams(w):
        s = [None] * (P.ORDER - 1) + list(units(w)) + ["<end>"]
        return [tuple(s[i : i + P.ORDER]) for i in range(len(s) - P.ORDER + 1)]

    spelling, words = Counter(g for t in texts for w in WORD.findall(t) for g in grams(w)), Counter(e for t in texts for e in events(t))
    if not words:
        return None
    ps, pw = modified_kneser_ney(spelling), modified_kneser_ney(words)

    def score(text):
        logs = sum(math.log(pw(e)) for e in events(text)) + sum(math.log(ps(g)) for w in WORD.findall(text) if w not in vocabulary for g in grams(w))
        return -logs / len(WORD.findall(text))

    return score


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1, None, "en"), (-2, "", None), (-3, " \n\t", "en"), (-4, "one two three four five " * 40, "en"), (-5, "é \x0b𝄞 a b\n\na\nb\na", "xx"), (None, rows[0][1], rows[0][2]), (rows[1][0], rows[1][1], rows[1][2]), (-6, "w" * 200_000, "en")]
    return rows


def judged(spark, rows, monkeypatch, hot=None, part=None):
    if hot is not None:
        monkeypatch.setattr(P, "HOT_ENTRIES", hot)
        monkeypatch.setattr(P, "PART_ENTRIES", part)
    return P.judge_documents(spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)).collect()


def test_rules_and_scores_match_brute_force(spark, corpus, monkeypatch):
    got = judged(spark, corpus, monkeypatch)
    assert len(got) == len(corpus)
    want = Counter((str(i), *base(t)) for i, t, _ in corpus)
    assert Counter((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got) and all(r.kept is not None for r in got)
    by_lang, words = defaultdict(list), Counter()
    for _, t, lang in corpus:
        by_lang[lang or ""].append(t or "")
        words.update((lang or "", w) for w in WORD.findall(t or ""))
    of_lang = Counter()
    for (g, _), n in words.items():
        of_lang[g] += n
    share = P.VOCABULARY_SHARE
    frequent = {(g, w) for (g, w), n in words.items() if n >= min(words.total() * share, of_lang[g] * (len(of_lang) * share))}
    checked = 0
    for lang, texts in by_lang.items():
        score = scorer(texts, {w for g, w in frequent if g == lang})
        for r in got:
            if r.lang == lang and r.n_words:
                text = next(t for i, t, g in corpus if i == r.doc_id and (g or "") == lang)
                if len(text) < 3000:  # the plain model is slow
                    assert abs(score(text) - r.log_perplexity) < 1e-8
                    checked += 1
    assert checked > 50


@pytest.mark.parametrize("hot, part", [(0, 700), (3000, 1 << 30)], ids=["64 parts, nothing broadcast", "one part, some broadcast"])
def test_scores_are_the_same_however_the_entries_are_divided(spark, corpus, monkeypatch, hot, part):
    key = lambda r: (str(r.doc_id), r.lang, r.n_words)
    with monkeypatch.context() as own:
        want = sorted(judged(spark, corpus, own), key=key)
    got = sorted(judged(spark, corpus, monkeypatch, hot, part), key=key)
    assert [(key(r), r.kept) for r in got] == [(key(r), r.kept) for r in want]
    assert all(a.log_perplexity == b.log_perplexity or math.isclose(a.log_perplexity, b.log_perplexity, rel_tol=1e-11) for a, b in zip(got, want))


def test_words_in_another_order_are_less_likely(spark, monkeypatch):
    rng = random.Random(3)
    follow = {w: rng.sample(range(60), 4) for w in range(60)}

    def text():
        w, out = rng.randrange(60), []
        for _ in range(120):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        return out

    rows = [(i, text(), "en") for i in range(150)]
    mixed = [(1000 + i, rng.sample(t, len(t)), g) for i, t, g in rows[:10]]
    got = {r.doc_id: r for r in judged(spark, [(i, " ".join(t), g) for i, t, g in rows + mixed], monkeypatch)}
    assert all(got[1000 + i].log_perplexity > 1.2 * got[i].log_perplexity for i in range(10))
    assert all(got[i].kept for i in range(150)) and not any(got[1000 + i].kept for i in range(10))


def test_a_small_language_has_its_own_word_events(spark):
    rng = random.Random(5)
    large = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(5000)), "large") for i in range(100)]
    small = [(1000, "alpha beta gamma alpha beta delta alpha beta gamma epsilon " * 5, "small")]  # 1e-4 of all words
    _, vocabulary = P.model_table(spark.createDataFrame(large + small, "doc_id long, text string, lang string"))
    assert len(vocabulary.by["small"][0]) == 5 and len(vocabulary.by["large"][0]) == 300


def test_any_character_may_stand_in_a_word(spark, monkeypatch):
    odd = ["hello a\ufffeb world", "\ufffe", "\uffff \uffff\ufffe", "a\x00b \x00", "\U0010ffff\u2028 x\x85y \xa0"]
    rows = [(i, t, "en") for i, t in enumerate(odd)] + [(9, "plain words of a text " * 3, "en")]
    texts = [t for _, t, _ in rows]
    score = scorer(texts, {w for t in texts for w in WORD.findall(t)})
    with monkeypatch.context() as own:
        own.setattr(P, "VOCABULARY_SHARE", 2.0)
        spelled = judged(spark, rows, own)
    spell = scorer(texts, set())
    for r, s in zip(sorted(judged(spark, rows, monkeypatch)), sorted(spelled)):
        assert abs(r.log_perplexity - score(texts[min(r.doc_id, 5)])) < 1e-9
        assert abs(s.log_perplexity - spell(texts[min(s.doc_id, 5)])) < 1e-9


def test_a_strange_text_leaves_the_band(spark, corpus):
    strange = (-9, " ".join("".join(chr(0x4E00 + 97 * i % 500 + k) for k in range(7)) for i in range(60)), "en")
    got = {r.doc_id: r for r in P.judge_documents(spark.createDataFrame([(*r, "c", 1) for r in [*corpus, strange]], SCHEMA)).collect()}
    assert not got[-9].base_failed and not got[-9].kept
    fine = [r for r in got.values() if not r.base_failed and r.doc_id is not None and r.doc_id >= 0]
    assert np.mean([r.kept for r in fine]) > 0.95


@pytest.mark.parametrize("hot", [None, 0])
def test_empty_table(spark, monkeypatch, hot):
    assert judged(spark, [], monkeypatch, hot, 10) == []
    assert [r.log_perplexity for r in judged(spark, [(1, "", "en"), (2, None, None)], monkeypatch, hot, 10)] == [None, None]
