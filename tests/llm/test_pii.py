"""op12: plain spans against plain patterns, the tagger's gradient, its accuracy on texts it wasn't fitted to, and edge cases."""

import hashlib
import re
import time

import numpy as np
import pytest

from hypolith.llm import tagger as tagging
from hypolith.llm.op12_pii import _holds, _zones, base, fitted, found, luhn, made, op12_pii, personal
from hypolith.llm.tagger import ALLOWED, CLASSES, KINDS, TAGS, WINDOW, Tagger, best, classes, spans
from tests.conftest import SF

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


def test_luhn():
    assert luhn("4111111111111111") and luhn("79927398713") and not luhn("79927398714") and not luhn("4111111111111112")


def test_plain_spans_against_plain_patterns():
    r = np.random.default_rng(3)
    parts = ["a@b.c", "@", ".", "x.y@mail-1.example.com", "é", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (017) 555-7713", "+49", "(", ")", " ", "-", "12", "+", "٣", "Ⅷ", "%+_", "a", "\n", "4111111111111111 1", "+1((((2", "\U0001f600"]
    for _ in range(6000):
        text = "".join(parts[int(i)] for i in r.integers(0, len(parts), int(r.integers(1, 14))))
        assert base(text) == plain(text), text


def test_plain_spans_take_time_in_proportion():
    for unit in ("a", "1", "1.", "@", "a@", "+1", "+1(", "1 ", "a.b@c"):
        began = time.process_time()
        base(unit * (600_000 // len(unit)))
        assert time.process_time() - began < 5, unit


def test_gradient():
    t = Tagger(3, cells=4)
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    r = np.random.default_rng(0)
    codes, tags = r.integers(0, CLASSES, (4, 12)), np.array([[0, 1, 2, 2, 0, 3, 4, 0, 5, 6, 7, 8]] * 4)
    _, g = t.loss(codes, tags)
    for k, w in t.w.items():
        for _ in range(3):
            i = tuple(int(r.integers(0, n)) for n in w.shape)
            if k == "next" and not ALLOWED[i]:
                continue
            old, e = w[i], 1e-3
            w[i] = old + e
            up = t.loss(codes, tags)[0]
            w[i] = old - e
            down = t.loss(codes, tags)[0]
            w[i] = old
            assert abs((up - down) / 2 / e - g[k][i]) < 1e-4 + 1e-2 * abs(g[k][i]), k


def test_chain_against_all_sequences():
    """Chances and the sum over all sequences, of three places, by writing all of them out."""
    t = Tagger(1)
    r = np.random.default_rng(1)
    emit = r.standard_normal((3, 1, TAGS)).astype(np.float32)
    chance, _, log = t._chain(emit)
    score = {(a, b, c): emit[0, 0, a] + emit[1, 0, b] + emit[2, 0, c] + t.w["next"][a, b] + t.w["next"][b, c] for a in range(TAGS) for b in range(TAGS) for c in range(TAGS) if ALLOWED[a, b] and ALLOWED[b, c]}
    total = sum(np.exp(s) for s in score.values())
    assert abs(np.log(total) - log[0]) < 1e-4
    for place in range(3):
        want = np.zeros(TAGS)
        for x, s in score.items():
            want[x[place]] += np.exp(s) / total
        assert np.allclose(chance[place, 0], want, atol=1e-5)
    # The best sequence, by all of them too.
    p = np.exp(emit[:, 0] / 1)
    p /= p.sum(1, keepdims=True)
    allowed = [x for x in score if ALLOWED[0, x[0]]]
    assert tuple(best([p])[0]) == max(allowed, key=lambda x: np.log(p[[0, 1, 2], list(x)]).sum())


def test_tagger_on_other_texts():
    """Of 300 made-up texts with another seed, at least 95 % of what is marked is right and at least 90 % of each kind is found."""
    model, right, marked, there = fitted(), dict.fromkeys(KINDS, 0), 0, dict.fromkeys(KINDS, 0)
    texts = made(300, 77)
    for (text, want), tags in zip(texts, best(model.chances([classes(t) for t, _ in texts])), strict=True):
        got = {s for s in spans(tags) if _holds(s[0], text[s[1] : s[2]])}
        marked += len(got)
        for kind, *_ in want:
            there[kind] += 1
        for s in got & set(want):
            right[s[0]] += 1
    assert sum(right.values()) >= 0.95 * marked
    for k in KINDS:
        assert right[k] >= 0.9 * there[k], k


def test_windows_are_reconciled(monkeypatch):
    """A stretch of many windows gives the marks that each part gives alone, and none is cut where windows meet."""
    model, text, want = fitted(), "", []
    for k in range(40):
        text += "der thaln ingor " * (k % 5)
        want.append(("phone", len(text), len(text) + 14))
        text += "(415) 555-2671, "
    got = [s for s in spans(best(model.chances([classes(text)]))[0]) if _holds(s[0], text[s[1] : s[2]])]
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    few = found(model, [text, "x", text])
    monkeypatch.setattr("hypolith.llm.op12_pii.AT_ONCE", 10)
    assert found(model, [text, "x", text]) == few and few[0] == few[2]


def test_zones_cover_every_anchor():
    text = "x" * 500 + "7" + "y" * 300 + "@" + "z" * 10 + "5"
    zones = _zones(text)
    assert zones == [(500 - WINDOW, 501 + WINDOW), (801 - WINDOW, len(text))] and _zones("no such thing") == []


@pytest.fixture(scope="module")
def whole(spark):
    return op12_pii(spark, SF).collect()


def test_personal_data_on_whole_table(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: r for r in whole}
    assert len(whole) == len(docs)
    for d in docs:
        want, r = plain(d.text), rows[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in KINDS]
        assert r.base_sha256 == digest(want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))
        assert len(r.spans.split(",")) - (not r.spans) == len(want) + r.n_tagged


def test_spans_that_no_pattern_has(spark):
    texts = ["write to anna.berg at example dot com for more", "call (415) 555-2671 or 415-555-2671 now", "card 4111.1111.1111.1111 ok", "host 10[.]20[.]30[.]40 is down", "a clean text about 20 apples and 1.5 pears", "+1 (826) 555-4081 190.137.223.20"]
    rows = [x.asDict() for x in personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    rows = {x["doc_id"]: [s.split(":")[0] for s in x["spans"].split(",") if s] for x in rows}
    assert "email" in rows[0] and rows[1].count("phone") == 2 and "card" in rows[2] and "ip" in rows[3] and rows[4] == [] and set(rows[5]) == {"ip", "phone"}


def test_personal_data_edge_cases(spark):
    texts = [None, "", "\U0001f600 a@b.cd é@x.de", "1" * 50_000, "@" * 20_000, "a" * 100_000 + "@b.de", "4111 1111 1111 1111 " * 300]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "a@b.cd", "x", 1), (None, None, "x", 1), (0, "a@b.cd", "x", 1)], "doc_id long, text string, spans string, n_ip int")
    rows = personal(df).collect()
    assert len(rows) == len(texts) + 3 and sum(r.doc_id is None for r in rows) == 2
    want = {i: digest(plain(t)) for i, t in enumerate(texts) if i not in (0, 5)}
    assert all(r.base_sha256 == want[r.doc_id] for r in rows if r.doc_id in want)
    assert personal(df.limit(0)).count() == 0


def test_tags():
    assert tagging.TAGS == 9 and not ALLOWED[0, 2] and ALLOWED[1, 2] and not ALLOWED[1, 4] and ALLOWED[2, 1]
    assert spans(np.array([0, 1, 2, 2, 1, 0, 7, 8])) == [("email", 1, 4), ("email", 4, 5), ("phone", 6, 8)]
