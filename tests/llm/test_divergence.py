"""op13 against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from hypolith.llm import op13_divergence as op13
from hypolith.llm.op13_divergence import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, least, top):
    """All chances of all terms in all groups, and every value from them."""
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = Counter(TERM.findall((text or "").translate(LOWER)))
        groups[lang or "", source or ""].update(terms)
        seen[lang or ""].update(list(terms))
    out = []
    for lang in {a for a, _ in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = sum((c for (a, _), c in groups.items() if a == lang), Counter())
        p = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        q, mine = p(whole), {s: p(c) for (a, s), c in groups.items() if a == lang}
        for s, x in mine.items():
            pairs = [(-sum(abs(x[t] - y[t]) for t in kept), o.encode(), o) for o, y in mine.items() if o != s]
            terms = [(q[t] - x[t], t.encode(), t) for t in kept if groups[lang, s][t] and x[t] > q[t]]
            for part, found, n in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[:n])]
    return sorted(out)


def made(seed, n, words, sources, langs):
    r = np.random.default_rng(seed)
    docs = []
    for _ in range(n):
        s = int(r.integers(0, sources))
        text = " ".join(words[int(i)] for i in (r.zipf(1.3, int(r.integers(0, 60))) + s * int(r.integers(0, 3))) % len(words))
        docs.append((text, langs[int(r.integers(0, len(langs)))], f"s{s}"))
    return docs


def got(spark, docs, least, top):
    df = spark.createDataFrame([(i, *x, "clash", 0) for i, x in enumerate(docs)], "doc_id long, text string, lang string, source string, item string, n long")
    return sorted(tuple(r) for r in divergence(df, least, top).collect())


def test_divergence_against_plain_python(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Ärger", "ÄRGER", "naïve", "日本", "Mixed", "mIXED"]
    docs = made(1, 300, words, 7, ["en", "de"]) + [("only digits 1 2 3", "fr", "s1"), (None, "fr", None), ("x", None, "s2"), (None, None, None), ("", "en", "empty")]
    for least, top in ((3, 5), (30, 50), (1, 1)):
        assert got(spark, docs, least, top) == plain(docs, least, top)


def test_divergence_ties_repeats_and_long_texts(spark):
    docs = [("same words here", "en", s) for s in ("a", "b", "c") for _ in range(4)]  # every value ties at 0
    docs += [("alpha beta gamma delta " * 3, "de", "a")] * 5 + [("zeta eta theta iota", "de", "b")] * 5  # terms tie in one bucket
    docs += [("long word " * 300_000, "es", "a"), ("word", "es", "b")] + [("hot", "fr", "one")] * 500 + [("cold", "fr", "two")]
    for top in (2, 50):
        assert got(spark, docs, 1, top) == plain(docs, 1, top)


def test_divergence_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence(none).count() == 0
    one = spark.createDataFrame([("a b", "en", "s")], "text string, lang string, source string")
    assert divergence(one, least=1).count() == 0  # no other source, and p equals q
    assert divergence(one.union(one.withColumn("source", F.lit("t")))).select("value").distinct().collect()[0][0] == 0


def test_divergence_reads_no_bucket_below_the_kth_value(spark, monkeypatch):
    """Of many buckets only those come into the search whose bound may still pass the k-th value."""
    tables = {}
    keep = op13.written
    monkeypatch.setattr(op13, "written", lambda df, name, **k: tables.setdefault(name, keep(df, name, **k)))
    docs = [("rare" * (k % 2) + " " + " ".join(f"t{chr(97 + i)}" for i in range(20) for _ in range(1 << (i % 10) if k % 2 else 1)), "en", f"s{k % 2}") for k in range(20)]
    assert got(spark, docs, 1, 1) == plain(docs, 1, 1)
    assert tables["rest"].count() + tables["bounds"].filter("first").count() < tables["bounds"].count()


def test_divergence_handed_on_in_parts(spark, monkeypatch):
    docs = made(3, 60, [f"q{chr(97 + i)}" for i in range(26)], 3, ["en"])
    want = plain(docs, 2, 5)
    monkeypatch.setattr(op13, "HELD", 5)
    assert got(spark, docs, 2, 5) == want
