"""op11 against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest

from hypolith.llm import op11_phrases as op11
from hypolith.llm.op11_phrases import Cutter, _mined, _packed, _unique, _unpacked, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top):
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    f = {x: a for x, a in f.items() if a >= least}
    covered = {}
    for (lang, g), a in f.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                covered[lang, g[i : i + k]] = max(a, covered.get((lang, g[i : i + k]), 0))
    found = []
    for (lang, g), a in f.items():
        if len(g) > 1 and 100 * covered.get((lang, g), 0) < 100 * a:
            score, k = min((1000 * a * total[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            found.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    out, at = [], Counter()
    for lang, score, a, g, l, r in sorted(found):
        at[lang] += 1
        if at[lang] <= top:
            out.append((lang, at[lang], g.decode(), -a, l, r, total[lang], -score))
    return out


def made(seed, n, langs=("en", None, "de")):
    r = np.random.default_rng(seed)
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", ";", "\x1c "]
    docs = []
    for _ in range(n):
        words = [f"W{i}" if r.random() < 0.2 else f"w{i}" for i in r.zipf(1.4, int(r.integers(0, 80))) % 40]
        docs.append(("".join(w + ends[int(r.integers(0, len(ends)))] for w in words), langs[int(r.integers(0, len(langs)))]))
    return docs


def got(spark, docs, **k):
    df = spark.createDataFrame([(i, *x, "clash", 1) for i, x in enumerate(docs)], "doc_id long, text string, lang string, phrase string, n long")
    return sorted(tuple(r) for r in phrases(df, **k).collect())


SPECIAL = [(None, "en"), ("", None), ("Ärger ärger Ärger ärger", "de"), ("a a a a a a a a", "en"), ("one", "x"), ("日本 語 日本 語", ""), ("a b a b a b. a b", "en")]


@pytest.mark.parametrize("how", [{}, {"words": 0}, {"split": 20}, {"words": 0, "split": 20}])
def test_phrases_against_plain_python(spark, how):
    docs = made(1, 250) + SPECIAL * 3
    for least, top in ((4, 2000), (2, 7)):
        assert got(spark, docs, least=least, top=top, **how) == plain(docs, least, top)


def test_phrases_in_long_texts_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(op11, "BLOCK", 1000)
    r = np.random.default_rng(4)
    long = " ".join(f"v{i}" for i in r.zipf(1.5, 60_000) % 25)  # one piece without an end
    docs = [(long, "en"), (long, "en")] + [("the very same passage of some words here", "fr")] * 700 + [(f"x{i} y{i} " * 5, "tie") for i in range(30)]
    for how in ({}, {"words": 0}, {"split": 500}):
        assert got(spark, docs, least=5, top=20, **how) == plain(docs, 5, 20)


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string")
    for words in (10, 0):
        assert phrases(none, words=words).count() == 0
        assert phrases(spark.createDataFrame([(None, None), ("", "en"), (" . ", "en"), ("a b", "en")], "text string, lang string"), words=words).count() == 0


def test_phrases_handed_on_in_parts(spark, monkeypatch):
    docs = made(9, 80)
    monkeypatch.setattr(op11, "HELD", 7)
    monkeypatch.setattr(op11, "CHUNK", 50)
    assert got(spark, docs, least=3, top=50) == plain(docs, 3, 50)


def test_every_occurrence_lies_in_one_fragment():
    """Counting the phrases around the pivots of all fragments gives each occurrence once."""
    r = np.random.default_rng(2)
    ids = (r.zipf(1.3, 3000) % 30).astype(np.int32) - 1
    cutter = Cutter(7, lambda x: np.where(x < 3, 2, 1))
    found = Counter()
    for _, data in [*cutter.add(ids), *cutter.end()]:
        for grams, count in _mined(*_unpacked(data), 1):
            for g, n in zip(map(tuple, grams.tolist()), count.tolist(), strict=True):
                found[g] += n
    want = Counter(tuple(x) for k in range(2, 6) for i in range(len(ids) - k + 1) if min(x := ids[i : i + k].tolist()) >= 0)
    assert found == want


def test_rows_of_equal_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(op11, "mixed", lambda h: h * np.uint64(0))
    cells = np.array([[1, 2], [3, 4], [1, 2], [1, 2], [5, 6]] * 3)
    rows, count, _ = _unique(cells, np.ones(len(cells), np.int64))
    back = Counter()
    for x, n in zip(map(tuple, rows.tolist()), count.tolist(), strict=True):
        back[x] += n
    assert back == {(1, 2): 9, (3, 4): 3, (5, 6): 3}


def test_fragments_there_and_back():
    cells = np.full((3, 9), -1, np.int64)
    cells[0, 3:6], cells[1, 4:9], cells[2, 4] = (5, 9, 1 << 40), (7, 6, 5, 4, 3), 2
    a, n = _unpacked(_packed(cells, np.array([1, 1 << 33, 3])))
    assert (a == cells).all() and n.tolist() == [1, 1 << 33, 3]
