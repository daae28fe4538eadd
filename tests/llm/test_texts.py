"""op2, op3, op5, op8, op9, op10 against plain versions, exact round trips and held-out accuracy."""

import random
import re
import time
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hypolith.llm.op2_quality import META, SHRINK, TEXT, TOLD_ROWS, Rows, Told, Viewer, _told, classified
from hypolith.llm.op3_html import _Maker, choose, extracted, features, main_text, trained
from hypolith.llm.dom import Dom
from hypolith.llm.op5_templates import UNITS, Templater, contaminated
from hypolith.llm.op8_packing import END, RUN, Encoder, Packer, packed, public_files
from hypolith.llm.op9_lm import FREQUENT, GROUPS, INPUTS, MEMBERS, PRIOR, SIDE, Counts, Network, scored
from hypolith.llm.op9_lm import trained as lm_trained
from hypolith.llm.op10_quotes import normal, parsed, threaded
from hypolith.llm.queries import QUERIES
from hypolith.llm.shingles import Shingler
from tests.conftest import SF

CLASH = "doc_id long, text string, lang string, source string, n_chars long, quality string, kept string"


# op2


def made(n, seed, junk=0.3):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad, toxic = r.random() < junk, r.random() < 0.2
        words = [f"w{r.integers(300)}" for _ in range(r.integers(20, 80))]
        if bad:
            words = [w + "###" for w in words]
        if toxic:
            words += [f"vile{r.integers(5)}" for _ in range(3)]
        rows.append((i + 1000 * seed, " ".join(words), "en", f"src{r.integers(3)}", None, int(not bad), int(toxic)))
    return rows


def test_quality_on_held_out_documents(spark):
    rows = made(1500, 1)
    docs = spark.createDataFrame([(*r[:5], "clash", "clash") for r in rows], CLASH)
    labels = spark.createDataFrame([(r[0], r[5], r[6]) for r in rows[:1000]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality for r in classified(docs, labels).collect()}
    assert len(got) == 1500
    rest = rows[1000:]
    assert np.mean([got[r[0]].kept == (r[5] == 1 and r[6] == 0) for r in rest]) > 0.95
    assert all(0 <= x <= 1 for q in got.values() for x in (q.text_score, q.meta_score, q.quality_score, q.toxic_score))


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, None, None), (1, "", "en", "s", 0, "x", "y"), (None, "a " * 200_000, "en", "s", 7, "x", "y")], CLASH)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = classified(docs, none).collect()
    assert len(rows) == 3 and all(r.quality.kept and r.quality.quality_score == 0.5 for r in rows)
    assert classified(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (99, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert classified(docs, one).count() == 3


def test_quality_views_are_apart_and_ties_kept(spark):
    v = Viewer()
    assert np.array_equal(v.meta("en", "s", 5), Viewer().meta("en", "s", 5.0)) and not np.array_equal(v.meta("en", "s", 5), v.meta("en", "s", None))
    docs = spark.createDataFrame([(i, "same text", "en", "s", 9, "x", "y") for i in range(20)], CLASH)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    rows = classified(docs, labels, name="found").collect()
    assert len({r.found for r in rows}) == 1 and rows[0].quality == "x" and rows[0].kept == "y"


def test_one_round_of_co_training_against_plain_python(spark):
    r = np.random.default_rng(0)
    rows = [(bool(r.random() < 0.2), sorted(r.choice(50, 6, replace=False).tolist()), sorted(r.choice(9, 2, replace=False).tolist())) for _ in range(300)]
    weights = {h: ([r.normal(0, 1, TEXT + 1), r.normal(0, 1, META + 1)], [np.array([1.5, 0.1]), np.array([2.0, -0.2])], np.ones(3)) for h in ("quality", "toxic")}
    df = spark.createDataFrame(rows, "known boolean, text_at array<int>, meta_at array<int>")
    got = defaultdict(int)
    for x in df.repartition(5).mapInArrow(_told(weights, 0.8), TOLD_ROWS).collect():
        for k, c in enumerate("abcd"):
            got[x.view, x.feature, k] += x[c]
    want = defaultdict(int)
    for known, text, meta in rows:
        views = (text, meta)
        for h, (w, scale, _) in enumerate(weights.values()):
            for me in (0, 1):
                p = 1 / (1 + np.exp(-(scale[me][0] * (sum(np.float32(w[me][f]) for f in views[me]) + np.float32(w[me][-1])) + scale[me][1])))
                if not known and (p >= 0.8 or p <= 0.2):
                    for f in [*views[1 - me], -1]:
                        want[1 - me, f, 2 * h + int(p >= 0.8)] += 1
    assert {k: v for k, v in got.items() if v} == dict(want)
    # The contrast of labelled rows and told documents together.
    m, told, y = Rows([np.array(t, np.int32) for _, t, _ in rows], 50), Told(50), r.integers(0, 2, 300).astype(float)
    told.n[:], told.active[:] = [40, 20], r.integers(0, 15, (2, 50))
    y[[7 in t for _, t, _ in rows]] = 1.0  # two features that tell
    y[[8 in t for _, t, _ in rows]] = 0.0
    n = [sum(y == k) + 0.3 * told.n[k] for k in (0, 1)]
    got, often = m.contrast(y, np.ones(300), told), 0
    counts = [[sum(f in t for (_, t, _), z in zip(rows, y, strict=True) if z == k) + 0.3 * told.active[k][f] for k in (0, 1)] for f in range(50)]
    often = sum(sum(c) >= 3 for c in counts)
    xlog = lambda x, p: x * np.log(x / p) if x > 0 else 0.0
    for f, c in enumerate(counts):
        share = [(c[k] + n[k] / sum(n)) / n[k] for k in (0, 1)]
        # Shrunk by how far the likelihood ratio of two shares against one passes what chance alone reaches.
        ratio = 2 * sum(xlog(c[k], sum(c) * n[k] / sum(n)) + xlog(n[k] - c[k], (sum(n) - sum(c)) * n[k] / sum(n)) for k in (0, 1))
        assert abs(got[f] - np.log(share[1] / share[0]) * max(0, 1 - 2 * np.log(often) / max(ratio, 1e-9)) ** SHRINK) < 1e-9
    assert np.count_nonzero(got) > 0


def test_quality_views_teach_each_other(spark):
    """With 40 labels the text view knows few of the words that tell; the sources tell nearly everything. After two rounds of
    labels from each other the text view alone is right far more often than without, and both together are no worse."""
    r, rows = np.random.default_rng(0), []
    for i in range(2000):
        y = int(r.random() < 0.5)
        source = 2 * (y if r.random() < 0.97 else 1 - y) + int(r.integers(0, 2))
        words = [f"w{k}" for k in r.integers(0, 400, 30)] + [f"{k}x{'good' if y else 'evil'}" for k in r.integers(0, 150, 3)]
        r.shuffle(words)
        rows.append((i, " ".join(words), "en", f"s{source}", 100, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, y int")
    labels = spark.createDataFrame([(x[0], x[5], 0) for x in rows[:40]], "doc_id long, quality int, toxic int")
    right = {}
    for rounds in (0, 2):
        hit = lambda c: F.avg(((F.col(f"quality.{c}") >= 0.5) == (F.col("y") == 1)).cast("double"))
        right[rounds] = classified(docs, labels, rounds=rounds).filter("doc_id >= 40").agg(hit("text_score"), hit("quality_score")).first()
    assert right[2][0] > right[0][0] + 0.15 and right[2][0] > 0.7 and right[2][1] > right[0][1] - 0.01


def test_quality_rejects_rare_toxic_words_with_few_labels(spark):
    """400 labels, one in nine toxic, of which each has some of twelve words among hundreds that say nothing."""
    r, rows = np.random.default_rng(3), []
    for i in range(1500):
        toxic = bool(r.random() < 0.11)
        words = [f"w{k}" for k in r.zipf(1.3, 150) % 4000] + ([f"vile{k}" for k in r.integers(0, 12, 4)] if toxic else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), "en", f"s{i % 7}", 100, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, t boolean")
    labels = spark.createDataFrame([(x[0], int(x[0] % 9 > 0), int(x[5])) for x in rows[:400]], "doc_id long, quality int, toxic int")
    got = classified(docs, labels).filter("doc_id >= 400").groupBy("t").agg(F.avg((F.col("quality.toxic_score") > 0.5).cast("double")).alias("x")).collect()
    found = {x.t: x.x for x in got}
    assert found[True] > 0.9 and found[False] < 0.02


def test_quality_keeps_clean_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op2_quality"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    clean = [got[x.doc_id].kept for x in labels if x.quality == 1 and x.toxic == 0]
    assert np.mean(clean) > 0.95


# op3


@pytest.fixture(scope="module")
def trees():
    return trained()


def test_html_on_unseen_made_pages(trees):
    maker, memory, hit, want, got = _Maker(999), {}, 0, 0, 0
    for _ in range(100):
        dom = Dom(maker.page())
        y = np.array(["data-y" in a for a in dom.attrs])
        y[0] = True
        dom.attrs = [a.replace("data-y", "") for a in dom.attrs]
        a, b = (set(main_text(dom, k).split("\n")) for k in (y, choose(dom.parent, trees.scores(features(dom, memory)))))
        hit, want, got = hit + len(a & b), want + len(a), got + len(b)
    assert hit / want > 0.97 and hit / got > 0.97


def test_html_choice_has_no_contradiction(trees):
    r = np.random.default_rng(3)
    parent = [-1, *(int(r.integers(0, i)) for i in range(1, 300))]
    kept = choose(parent, r.normal(0, 3, 300))
    assert all(kept[parent[i]] for i in range(1, 300) if kept[i])


def test_html_pages(spark, trees):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies, please agree.</p></div><article><h1>Head &amp; line</h1><p>One   two&nbsp;three<br>four &lt;x&gt;</p><div class="ad">Buy it</div><ul><li>First point</li><li>Second</li></ul>
    <p><b>Bold text, with more words in it.<br><p>Another one.</article><section id="comments"><div class="comment"><p>I disagree with all of it.</p></div></section><form><label>Mail</label></form><footer>&copy; Me</footer><script>var a="<p>no</p>";</script></body></html>"""
    rows = [(0, "u", page), (1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "<div" * 50), (5, "u", "</p></div><b>"), (6, "u", "<article><p>" + "word " * 100_000 + "</p></article>"), (7, "u", "<article><p>a&amp b &am c</p></article>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extracted(df.union(df), trees).collect()}
    assert extracted(df.union(df), trees).count() == 16 and extracted(df.limit(0), trees).count() == 0
    assert got[0].text == "Head & line\nOne two three four <x>\nFirst point\nSecond\nBold text, with more words in it.\nAnother one."
    assert [got[i].text for i in (1, 2, 3)] == ["", "", ""] and got[6].n_chars == 499_999 and got[7].text == "a& b &am c"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_quotes_begin_values_only_after_an_equals_sign():
    texts = lambda h: [t for _, _, t in Dom(h).texts]
    assert texts("<article><p class=it's>one</p><p>two</p></article><footer>it's foot</footer>") == ["one", "two", "it's foot"]
    assert texts("""<p 'a" b>one</p><p c = 'x>y' d="<p>">two</p><p e=>three</p><p f="open>four</p>""") == ["one", "two", "three", "four"]
    assert texts("a<br/>b<!-->c<!--->d<!-- > -->e<p g=a/>f< p>g</>h") == ["a", " ", "b", "c", "d", "e", "f< p>g</>h"]
    assert texts("<a " * 20_000 + "x") == ["<a " * 20_000 + "x"] and len(Dom("<div>" * 30_000 + "deep").texts) == 1


def test_html_unclosed_elements_lose_no_text(spark, trees):
    """An object, svg, math, noscript or template that only its parent's end closes hides nothing; a closed one hides all in it."""
    texts = lambda h: [t for _, _, t in Dom(h).texts]
    page = "<body><article><h1>Some head line</h1><p>First of all, a longer sentence stands here.</p>{}<p>Second, one more of them, as long as that.</p></article><footer>&copy; Me</footer></body>"
    rows = []
    for tag in ("object", "svg", "math", "noscript", "template"):
        rows += [f"<{tag} data=x>", f"<{tag}><g><p>not this</p></g></{tag}>", f"<{tag}><{tag}>not this</{tag}>", f"<{tag}/>"]
        assert texts(f"a<{tag}>b<i>c</i></{tag}>d") == ["a", "d"] and texts(f"<div>a<{tag}>b</div>c") == ["a", "b", "c"]
    df = spark.createDataFrame([(i, "u", page.format(x)) for i, x in enumerate(rows)], "page_id long, url string, html string")
    want = "Some head line\nFirst of all, a longer sentence stands here.\nSecond, one more of them, as long as that."
    assert {r.text for r in extracted(df, trees).collect()} == {want}


def test_html_time_grows_with_length(trees):
    for page in ("<div>" * 8000 + "</b>" * 8000, "<div>" * 100_000 + "deep" + "</div>" * 100_000, "<b>" * 20_000 + "<p></p>" * 20_000, "<div>" * 20_000 + "</html></body>" * 20_000, "<svg>" * 50_000 + "x", "<iframe>" * 20_000):
        began = time.process_time()
        dom = Dom(page)
        choose(dom.parent, np.zeros(len(dom.parent)))
        assert time.process_time() - began < 6, page[:20]


def test_html_menus_of_one_link(spark, trees):
    text = "<article><h1>A head line</h1><p>The first sentence of the page, of which more follow.</p><p>And this is the second one, quite as long.</p></article>"
    menus = ('<nav><a href="/">home</a></nav>', '<nav><a href="/x">all posts</a></nav>', '<div class="menu"><a href="/">start</a></div>')
    df = spark.createDataFrame([(i, "u", f"<body>{m}{text}</body>") for i, m in enumerate(menus)] + [(9, "u", f"<body>{text}{menus[0]}</body>")], "page_id long, url string, html string")
    assert {r.text for r in extracted(df, trees).collect()} == {"A head line\nThe first sentence of the page, of which more follow.\nAnd this is the second one, quite as long."}


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.seen = []

    def handle_data(self, data):
        self.seen.append(data)


def test_html_text_is_that_of_another_parser():
    r = random.Random(8)
    pieces = ["<p>", "</p>", "<div class=it's>", "</div>", "<b title='a>b'>", "</b>", '<i x="y" z>', "</i>", "<br>", "<br/>", "text", "it's", 'a "quote"', " ", "x = y", "<!-- no -->", "<a href=/q?a='b>", "</a>", "<em a='1'b=2>", "</em>", "5 > 3", "\n"]
    for _ in range(3000):
        page = "".join(r.choice(pieces) for _ in range(r.randint(1, 14)))
        p = _Plain()
        p.feed(page)
        p.close()
        ours = "".join(t for _, _, t in Dom(page).texts)
        assert "".join(ours.split()) == "".join("".join(p.seen).split()), page


def test_html_query_keeps_every_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in QUERIES["op3_html"](spark, SF).collect()}
    assert got.keys() == pages.keys()
    import html

    for i, page in pages.items():
        body = re.search("<article>(.*?)</article>", page, re.S)[1]
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body))
        assert got[i] == "\n".join(x for x in lines if x)


# op5


def test_template_words():
    t = Templater()
    same = lambda a, b: np.array_equal(t.named(*t.words(a))[0], t.named(*t.words(b))[0])
    assert same("he has 5 kg of Rice, today", "he has 71 lbs of Corn today")
    assert same("it was Élan there", "it was Paul there") and not same("it was élan there", "it was paul there")
    assert same("Anna went to New York City. Tom too", "Maria Lopez went to Boston. Sam too") and not same("to Boston. Tom too", "to Boston Tom too")
    assert len(t.windows("a b c d", (3,))) == 2 and [len(h) for h, _, _ in t.windows("a Bo Co d e f", (3, 4))] == [2, 1, 4, 3]
    assert same("(about) 3.5 days", "about 4 hours") and not same("3 apples", "3 pears")
    assert len(t.words(None)[0]) == len(t.words(" \n ")[0]) == len(t.words("... --")[0]) == 0


def test_contaminated_documents(spark):
    item = "if a farmer sells 12 eggs to Anna and 30 eggs to Peter then how many eggs does Anna lack"
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "short one"), (None, "x y z a b c d"), (5, "the quick brown fox jumps over the lazy dog near the river bank at night")]
    other = item.replace("12", "7").replace("30", "99").replace("Anna", "Maria").replace("Peter", "Tom")
    odd = other.replace("Maria lack", "Robert lack").replace("7", "8")  # the same name is filled in two ways
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    docs = [(10, f"{filler} {item} {filler}"), (11, f"{filler}\n{other}\n{filler}"), (12, filler), (13, None), (14, ""), (15, f"{item[:30]} {filler}"), (16, "short one"), (17, "short one more"), (18, f"{odd}"), (None, item), (19, items[-1][1].upper())]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    for screen in (1_000_000, 0):
        got = {r.doc_id: r for r in contaminated(df.union(df), bench, screen=screen).collect()}
        assert {i: list(r.item_ids) for i, r in got.items()} == {10: [1], 11: [1], 16: [4], 19: [5]}
    assert contaminated(df, bench.limit(0)).count() == 0 and contaminated(df.limit(0), bench).count() == 0


def test_contaminated_by_one_occurrence_of_several(spark):
    item = "if a farmer sells 12 eggs to Anna and 30 eggs to Peter then how many eggs does Anna lack"
    other = item.replace("12", "7").replace("30", "99").replace("Anna", "Maria").replace("Peter", "Tom")
    third = item.replace("12", "41").replace("30", "8").replace("Anna", "Lena").replace("Peter", "Max")
    longer = other.replace("then how", "then tell me now how")
    odd = other.replace("Maria lack", "Robert lack").replace("7", "8")
    sums = "add 3 and 5 and 7 and 9 and 11 and 13 and 17 and 19 to get the sum"
    numbers = "1 2 3 5 8 13 21 34 55 89"
    docs = [
        (1, f"{item} {other}"), (2, f"{other} so. {third} {item[:40]}"), (3, f"{third}\n{longer}"), (4, f"{odd} {odd.replace('8', '9')}"),
        (5, f"we {sums} of it"), (6, sums.replace("11", "12").replace("3 ", "4 ")), (7, f"{numbers} 4 7 1 9 9"), (8, "4 7 1 9 9 3 2 6 6 5 1 0 4"), (9, item), (9, other),
    ]
    bench = spark.createDataFrame([(1, item), (2, sums), (3, numbers)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for screen in (1_000_000, 0):
        got = {r.doc_id: list(r.item_ids) for r in contaminated(df, bench, screen=screen).collect()}
        assert got == {1: [1], 2: [1], 3: [1], 5: [2], 6: [2], 7: [3], 9: [1]}


def test_contaminated_by_short_items_and_long_parts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    filler = lambda n: " ".join(word() for _ in range(n))
    long = [word() for _ in range(100)]
    items = [(1, "Name four Baltic rivers"), (2, "What is 7"), (3, "two words"), (4, " ".join(long)), (5, "one"), (5, "Spell it out loud")]
    docs = [(1, f"{filler(40)} name four baltic rivers. {filler(9)}"), (2, f"{filler(9)} What is 7?"), (3, f"{filler(9)} what is 8"), (4, f"{filler(5)} two words {filler(5)}"), (5, "Two words!"), (6, " ".join(long[20:50])), (7, f"{filler(30)} {' '.join(long[50:75])} {filler(30)}"), (8, f"{' '.join(long[:12])} {filler(30)} {' '.join(long[30:42])} {filler(3)} {' '.join(long[60:72])}"), (9, "ONE"), (10, f"so {filler(2)} spell it out loud")]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for screen in (1_000_000, 0):
        assert {x.doc_id: list(x.item_ids) for x in contaminated(df, bench, screen=screen).collect()} == {1: [1], 2: [2], 5: [3], 6: [4], 7: [4], 9: [5], 10: [5]}


def word_problems(n, seed, usual=True):
    """(question, the same with other names, numbers and units) from templates with names at the begin of sentences too.
    Not usual: the things and deeds are other words, too."""
    r = random.Random(seed)
    names = ["Anna", "Maria", "Tom", "Peter", "Lena", "Max", "New York", "Boston", "Ana Maria Silva", "Paul", "Oslo", "San Jose", "Eve", "Ivan", "Ken"]
    things, verbs = ["eggs", "pears", "books", "coins", "cards", "lamps"], ["gives", "sells", "sends", "lends"]
    units = ["kg", "miles", "hours", "dollars"]
    out = []
    for _ in range(n):
        made = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(6))
        t, v, w = (r.choice(things), r.choice(verbs), made()) if usual else (made(), made(), made())
        forms = [
            f"{{a}} has {{i}} {t} from the {w} shop. {{a}} {v} {{j}} {t} to {{b}}. {{b}} already had {{k}} {t}. How many {t} can {{b}} {v} now?",
            f"The {w} road from {{a}} to {{b}} is {{i}} {{u}} long. {{c}} {v} {t} along {{j}} {{u}} of it on the first day and {{k}} {{u}} on the next. What is left?",
            f"If {{a}} pays {{i}} {{u}} for {{j}} {t} in the {w} store and {{b}} {v} {{k}} {{u}} for the same {t}, who paid less for each?",
        ]
        form = r.choice(forms)

        def fill():
            a, b, c = r.sample(names, 3)
            i, j, k = r.sample(range(2, 900), 3)
            return form.format(a=a, b=b, c=c, i=i, j=j, k=k, u=r.choice(units))

        out.append((fill(), fill()))
    return out


def test_reparameterised_questions_are_found(spark):
    pairs = word_problems(200, 6)
    r = random.Random(2)
    filler = lambda: " ".join("".join(r.choice("klmnoprst") for _ in range(5)) for _ in range(40))
    docs = [(i, f"{filler()}. {b} {filler()}") for i, (_, b) in enumerate(pairs)]
    docs += [(1000 + i, f"{filler()}. {b} {filler()}") for i, (_, b) in enumerate(word_problems(200, 77, usual=False))]  # of the same forms about other things
    docs += [(2000 + i, filler()) for i in range(100)] + [(3000 + i, f"{filler()} {a.lower()} {filler()}") for i, (a, _) in enumerate(pairs[:50])]
    bench, df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: set(x.item_ids) for x in contaminated(df, bench).collect()}
    recall = np.mean([i in got.get(i, ()) for i in range(200)])
    assert recall >= 0.95 and np.mean([1000 + i in got for i in range(200)]) <= 0.05
    assert not any(2000 + i in got for i in range(100)) and all(i in got[3000 + i] for i in range(50))


def plain_windows(text):
    """(plain, named) template windows of five words in plain Python."""
    tokens, before, ended = [], False, True
    for raw in re.findall("[^ \\t-\\r]+|\n", text or ""):
        if raw == "\n":
            ended = True
            continue
        w = "".join(c for c in raw if c.isalnum() or c in "%$" or ord(c) > 127)
        low = w.lower()
        if w:
            number, letters = any(c in "0123456789" for c in w), any(c.isalpha() or ord(c) > 127 for c in w)
            kind = "<n>" if number and not letters else "<b>" if number and w[0] in "0123456789" else "<u>" if before and low in UNITS else low
            name = not number and w[0] != low[0] and re.search("[a-z]", w)
            tokens.append((kind, low, bool(name), ended))
        before = bool(w) and number and not letters
        ended = raw[-1] in ".!?:;\""
    plain = [k for k, *_ in tokens]
    named = []
    for i, (k, _, name, ended) in enumerate(tokens):
        if not (name and i and tokens[i - 1][2] and not ended):
            named.append("<name>" if name else k)
    return [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (plain, named)]


def test_contaminated_query_against_plain_windows(spark):
    bench = {r.item_id: plain_windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (set(r.item_ids), r.coverage) for r in QUERIES["op5_templates"](spark, SF).collect()}
    for d, t in texts.items():
        mine = plain_windows(t)
        share = {i: max(len(a & b) / len(b) for a, b in zip(mine, x) if b) for i, x in bench.items()}
        want = {i for i, x in share.items() if x >= 0.8}
        assert got[d][0] <= want and {i for i, x in share.items() if x == 1} <= got[d][0], d
        if got[d][0]:
            assert abs(got[d][1] - max(share[i] for i in got[d][0])) < 1e-9


def test_contaminated_query_finds_verbatim_items(spark):
    words = lambda x: " ".join(re.sub(r"[^\w\s]", " ", x.lower()).split())
    bench = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {d: {i for i, x in bench.items() if f" {x} " in f" {t} "} for d, t in docs.items()}
    got = {r.doc_id: (r.contaminated, set(r.item_ids)) for r in QUERIES["op5_templates"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for d, ids in want.items():
        assert ids <= got[d][1] and got[d][0] == bool(got[d][1])


# op8


def check_packing(rows, texts, tokens=1024, segments=256):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert by.keys() == texts.keys()
    for d, text in texts.items():
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, END], "<u4")
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens and len(pieces) <= segments
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return padding


def test_packing_round_trip_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packing(QUERIES["op8_packing"](spark, SF).collect(), texts) == 0


def test_packing_edge_cases(spark):
    texts = {0: None, 1: "", 2: "a", 3: "x " * 5000, 4: "日本語 ɐ", 5: "<|endoftext|> b", 6: "​\xa0 \t\n", 7: "a" * 3000, 8: "İ😀"} | {100 + i: f"w{i}" for i in range(700)}
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, start string")
    assert check_packing(packed(df.coalesce(1), **public_files()).collect(), texts) < 1024
    assert packed(df.limit(0), **public_files()).count() == 0
    assert packed(df.union(df), **public_files()).selectExpr("sum(length)").first()[0] == 2 * packed(df, **public_files()).selectExpr("sum(length)").first()[0]


def test_packing_long_runs(spark):
    texts = {0: " " * 2_000_000, 1: "\n" * 2_000_000, 2: "a" + " \n" * 600_000 + "b", 3: "!" * 300_000, 4: "7" * 300_000, 5: "x" * 300_000, 6: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert check_packing(packed(df, **public_files()).collect(), texts) == 0


def test_packing_runs_just_under_the_limit():
    """Many runs of nearly RUN characters, of each kind, take seconds, and their ids are those of the tokenizers file."""
    encoder, slow = Encoder(*public_files().values()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for kind in ("a", "Qz", " ", "1", "_", "!", "\n"):
        text = ((kind * RUN)[: RUN - 1] + ("x" if len(kind) == 1 and kind != "a" else ". ")) * 70
        began = time.process_time()
        assert not encoder.runs.search(text) and encoder.runs.search("é" + kind * RUN + "é")
        ids = encoder.ids(text)
        assert time.process_time() - began < 5, kind
        assert ids.tolist() == slow.encode(text, add_special_tokens=False).ids


def test_packing_three_limits_on_spark(spark):
    """Prompts bear no loss; with many short examples all three limits bind somewhere, and none is broken."""
    r = np.random.default_rng(2)
    texts = {i: "a word " * int(r.integers(0, 60)) for i in range(1500)}
    df = spark.createDataFrame([(i, t, int(r.integers(0, 60))) for i, t in texts.items()], "doc_id long, text string, prompt long").coalesce(1)
    rows = packed(df, **public_files(), bears_col="prompt", tokens=256, segments=6, loss=120).collect()
    seq = defaultdict(list)
    for x in rows:
        seq[x.sequence_id].append(x)
    full = [(sum(x.length for x in p), len(p), sum(x.loss for x in p)) for p in seq.values()]
    assert all(a <= 256 and b <= 6 and c <= 120 for a, b, c in full)
    assert any(a == 256 for a, _, _ in full) and any(b == 6 for _, b, _ in full) and any(c == 120 for _, _, c in full)
    assert sum(x.length for x in rows) == sum(x.doc_tokens for x in rows if x.start == 0)


def test_packing_limits_of_instructions():
    p = Packer(0, tokens=64, segments=4, loss=40, pool=50)
    r = np.random.default_rng(0)
    total = 0
    for d in range(400):
        n = int(r.integers(1, 90))
        total += n
        p.add(d, np.arange(n, dtype=np.uint32), int(r.integers(0, n + 1)))
    p.end()
    seq = defaultdict(list)
    for row in p.rows:
        seq[row[5]].append(row)
    assert sum(x[2] for x in p.rows) == total
    for rows in seq.values():
        assert sum(x[2] for x in rows) <= 64 and len(rows) <= 4 and sum(x[7] for x in rows) <= 40


# op9


def lm_texts(n, seed=0):
    """Every middle word follows from its neighbours; some words are rare."""
    r = np.random.default_rng(seed)
    return [" ".join(f"a{k} b{k} c{k}" for k in r.integers(0, 12, 60)) + f" rare{seed}x{i} rare{seed}x{i % 7}" for i in range(n)]


def test_lm_learns_from_both_sides(spark):
    docs = spark.createDataFrame(list(enumerate(lm_texts(300))), "doc_id long, text string")
    counts = Counts(docs)
    net, v, hasher = lm_trained(docs.filter("doc_id < 240"), counts, rounds=4), counts.vocabulary(), Shingler(1)
    assert counts.total == 300 * 182
    own, plain = [], []
    for row in docs.filter("doc_id >= 240").collect():
        words = hasher.words(row.text)[:180]
        own.append(net.log_cells(net.around(words), v.cells(words)).mean())
        plain.append(np.log(counts.cells[v.cells(words)] / counts.total).mean())
    assert np.mean(own) > np.mean(plain) + 1.5  # of 3.6 nats by counts alone


@pytest.mark.parametrize("common", [1 << 16, 20, 0])
def test_lm_scores_against_plain_python(spark, common):
    texts = [None, "", "one two", *lm_texts(20), "one two", "w " * 5000 + "end"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    counts, net, hasher = Counts(docs, common=common), Network(), Shingler(1)
    got = {r.doc_id: r for r in scored(docs, net, counts).collect()}
    total = defaultdict(int)
    for t in texts:
        for w in hasher.words(t).tolist():
            total[w] += 1
    top = sorted(total, key=lambda w: (-total[w], np.uint64(w).view(np.int64)))[:FREQUENT] if len(counts.words) else []
    top = [w for w in top if w in set(counts.words.tolist())]
    cell = lambda w: top.index(w) % GROUPS * MEMBERS + top.index(w) // GROUPS if w in top else (w >> 24) % GROUPS * MEMBERS + 16 + (w >> 40) % 16
    n, kinds = defaultdict(int), defaultdict(int)
    for w, c in total.items():
        n[cell(w)] += c
        kinds[cell(w)] += 1
    emb, w1, b1, w2, b2, w3, b3 = (p.astype(float) for p in net.parts)
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    for i, t in enumerate(texts):
        words = hasher.words(t).tolist()
        if i == len(texts) - 1:
            assert got[i].n_words == 5001 and np.isfinite(got[i].log_likelihood)
            continue
        want = 0.0
        for j, w in enumerate(words):
            near = [(words[j + d] >> 20) % INPUTS if 0 <= j + d < len(words) else INPUTS for d in (-2, -1, 1, 2)]
            assert SIDE == 2
            a = np.maximum(np.concatenate([emb[k] for k in near]) @ w1 + b1, 0)
            g, m = divmod(cell(w), MEMBERS)
            want += soft(a @ w2 + b2)[g] + soft(a @ w3[g] + b3[g])[m] + np.log(total[w] - words.count(w) + PRIOR) - np.log(n[cell(w)] - sum(cell(x) == cell(w) for x in words) + PRIOR * kinds[cell(w)])
        assert abs(got[i].log_likelihood - want) < 1e-2 and got[i].n_words == len(words) and (got[i].per_word is None) == (not words)
    assert got[2].log_likelihood == got[len(texts) - 2].log_likelihood


def test_lm_chances_in_a_cell_add_up(spark, monkeypatch):
    """What the counts add to a text of one word: over all words of a cell the chances make 1, and a word that is its cell has 1."""
    texts = [f"a{i % 40} b{i % 3} " + "frequent " * 7 + f"r{i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts, net, hasher = Counts(docs, common=64), Network(), Shingler(1)
    # One-word texts in a corpus that holds each of them, so that leaving them out gives the corpus' own counts.
    words = sorted({w for t in texts for w in t.split()})
    once = docs.unionByName(spark.createDataFrame([(1000 + i, w) for i, w in enumerate(words)], "doc_id long, text string"))
    counts = Counts(once, common=64)
    v = counts.vocabulary()
    got = {r.doc_id - 1000: r.log_likelihood for r in scored(once, net, counts).collect() if r.doc_id >= 1000}
    hashes = np.concatenate([hasher.words(w) for w in words])
    cells = v.cells(hashes)
    alone = net.log_cells(np.concatenate([net.around(h[None] if h.ndim == 0 else h) for h in (hasher.words(w) for w in words)]), cells)
    inside = np.array([got[i] for i in range(len(words))]) - alone
    sizes = np.bincount(cells, minlength=len(counts.cells))
    n = {w: sum(t.split().count(w) for t in texts) for w in words}
    for i, w in enumerate(words):
        same = [x for x, c in zip(words, cells, strict=True) if c == cells[i]]
        # The word's own text is left out; the others of its cell keep the one text that is theirs.
        want = (n[w] + PRIOR) / (sum(n[x] + 1 for x in same) - 1 + PRIOR * len(same))
        assert abs(np.exp(inside[i]) - want) < 1e-3
        if sizes[cells[i]] == 1:
            assert abs(inside[i]) < 1e-4
    assert (sizes == 1).any() and (sizes > 1).any() and abs(inside[words.index("frequent")]) < 1e-4


def test_lm_step_follows_the_gradient():
    r = np.random.default_rng(1)
    near, cells = r.integers(0, 30, (40, 4)), r.integers(0, GROUPS * MEMBERS, 40)
    net = Network()
    before, loss = [p.astype(float).copy() for p in net.parts], lambda parts: -Network(np.concatenate([p.ravel() for p in parts])).log_cells(near, cells).mean()
    net.step(near, cells, 1e-3)
    for k in (0, 1, 2, 3, 5):
        moved = net.parts[k] - before[k]
        at = np.unravel_index(np.argmax(np.abs(moved)), moved.shape)
        up, down = [p.copy() for p in before], [p.copy() for p in before]
        up[k][at] += 3e-2
        down[k][at] -= 3e-2
        slope = loss(up) - loss(down)
        assert slope and np.sign(slope) == -np.sign(moved[at]), k


def test_lm_does_not_depend_on_the_partitions(spark):
    docs = spark.createDataFrame(list(enumerate(lm_texts(60))), "doc_id long, text string")
    flat = [lm_trained(d, Counts(d), shard=2000).flat() for d in (docs.coalesce(1), docs.repartition(7, "text"))]
    assert np.allclose(flat[0], flat[1], atol=1e-5) and not np.allclose(flat[0], lm_trained(docs, Counts(docs), shard=10**9).flat(), atol=1e-5)


def test_lm_tells_texts_that_occur_twice(spark):
    once, twice = ([f"{t} {' '.join(f'u{k}x{i}x{j}' for j in range(30))}" for i, t in enumerate(lm_texts(n, k))] for n, k in ((40, 1), (10, 2)))
    rows = scored(d := spark.createDataFrame(list(enumerate([*once, *twice, *twice])), "doc_id long, text string"), Network(), Counts(d)).collect()
    score = {r.doc_id: r.per_word for r in rows}
    assert min(score[i] for i in range(40, 60)) > max(score[i] for i in range(40))


def test_lm_edge_cases(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "one"), (None, "x y"), (2, "one"), (3, "w " * 100_000)], "doc_id long, text string")
    counts = Counts(docs)
    rows = scored(docs, lm_trained(docs, counts), counts).collect()
    assert len(rows) == 6 and all(r.per_word is None and r.log_likelihood == 0 for r in rows if r.n_words == 0)
    assert all(np.isfinite(r.log_likelihood) for r in rows)
    none = docs.limit(0)
    counts = Counts(none)
    assert scored(none, lm_trained(none, counts), counts).count() == 0
    assert np.allclose(lm_trained(none, counts).flat(), Network().flat())


# op10


def test_parsed_quotes():
    own, passages = parsed("Hi,\nAnna wrote:\n> first line\n> second\n>> older\n> > older still\n\n>third\nbye")
    assert own == "Hi,\n\nbye" and passages == [(1, ["first line", "second"]), (2, ["older", "older still"]), (1, ["third"])]
    assert parsed(None) == ("", []) and parsed("a > b") == ("a > b", []) and normal("  A,b.  C ") == "a b c"


def test_threads(spark):
    rows = [
        (1, 0, "user", "How do I open the big file?\nIt is old."), (1, 1, "assistant", "> How do I open the BIG file\nWith a tool, I think."), (1, 2, "user", "Thanks"), (1, 3, "user", "> how do i open the big file?\n> it is old\nstill not clear"),
        (2, 0, "user", "> With a tool, I think.\nWhich tool?"), (2, 1, "assistant", ">> nothing like this\nany"), (3, 0, "user", "Thanks"), (4, 0, "user", "> Thanks\nwelcome"), (5, 0, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (None, 1, "user", "> x\ny"), (6, None, "user", "z"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, thread_id string")
    got = {(r.conv_id, r.turn): r for r in threaded(df).collect()}
    assert len(got) == 12
    up = {k: (r.parent_conv, r.parent_turn, r.depth, r.thread_id, r.n_linked) for k, r in got.items()}
    assert up[1, 0] == (None, None, 0, 1, 0) and up[1, 1] == (1, 0, 1, 1, 1) and up[1, 2] == (1, 1, 2, 1, 0) and up[1, 3] == (1, 0, 1, 1, 1)
    assert up[2, 0] == (1, 1, 2, 1, 1) and up[2, 1] == (2, 0, 3, 1, 0) and up[3, 0] == (None, None, 0, 3, 0) and up[4, 0] == (1, 2, 3, 1, 1)
    assert got[1, 1].text == "With a tool, I think." and got[None, 1].text == "y" and got[None, 1].thread_id is None and got[5, 0].chat == "<|user|>\n\n"
    assert threaded(df.limit(0)).count() == 0


def test_threads_with_a_hot_line(spark):
    rows = [(i, 0, "user", "good morning to you all") for i in range(300)] + [(i, 1, "assistant", "> Good morning to you all\nindeed") for i in range(300)] + [(1000 + i, 0, "user", "> good morning to you all\nlate") for i in range(50)]
    got = threaded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all((r.parent_conv, r.parent_turn) == (r.conv_id, 0) for r in got if r.turn == 1) and all((r.parent_conv, r.thread_id) == (0, 0) for r in got if r.conv_id >= 1000)


def test_threads_by_whole_passages(spark):
    rows = [(1, 0, "A\nB\nC"), (1, 2, "A\nx"), (1, 3, "> A\n> B\nwhat"), (2, 0, "p"), (3, 0, "q"), (4, 0, "p\nq\nr"), (5, 0, "> p\n> q\nso")]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn, r.n_linked) for r in threaded(df).collect()}
    assert got[1, 3] == (1, 0, 1) and got[5, 0] == (4, 0, 1)
    # Against all pairs of passages and messages.
    rng = random.Random(5)
    some = lambda k: [rng.choice("aaaabbbccdefghij") for _ in range(rng.randint(1, k))]
    rows = [(c, t, "\n".join([f"> {x}" for x in some(4)] * (rng.random() < 0.5) + some(3))) for c in range(25) for t in range(6)]
    want, own = {}, {(c, t): set(x for x in m.split("\n") if x[0] != ">") | {" ".join(x for x in m.split("\n") if x[0] != ">")} for c, t, m in rows}
    for c, t, m in rows:
        if q := [x[2:] for x in m.split("\n") if x[0] == ">"]:
            q = {*q, " ".join(q)}
            held = [(len(q & h), d == c, u if d == c else 0, -d, -u) for (d, u), h in own.items() if (d, u) < (c, t) and 2 * len(q & h) >= len(q)]
            if held:
                want[c, t] = (-max(held)[3], -max(held)[4])
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    for hot in (0, 12, 1000):
        got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in threaded(df, hot=hot).collect() if r.n_linked}
        assert got == want


def test_threads_of_one_conversation_that_quotes_one_line_thousands_of_times(spark):
    rows = [(1, t, "user", "the same line" if t % 2 == 0 else "> the same line\nnew") for t in range(10_000)]
    got = threaded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("turn % 2 = 1").select("turn", "parent_turn").collect()
    assert len(got) == 5000 and all(r.parent_turn == r.turn - 1 for r in got)


def test_threads_of_very_long_messages(spark):
    long = "\n".join(f"line {i} of it" for i in range(20_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "short"), (2, 0, "user", "\n".join("> " + x for x in long.split("\n")) + "\nyes"), (2, 1, "user", "x" * 1_000_000)]
    got = {(r.conv_id, r.turn): r for r in threaded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[2, 0].parent_conv, got[2, 0].parent_turn, got[2, 0].text) == (1, 0, "yes") and len(got[2, 1].text) == 1_000_000


def test_threads_query_is_the_table_where_nothing_is_quoted(spark):
    c = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    rows = QUERIES["op10_quotes"](spark, SF).collect()
    assert {(r.conv_id, r.turn): r.text for r in rows if not r.n_quotes} == {k: "\n".join(v.split("\n")).strip() for k, v in c.items() if not re.search("^ {0,3}>", v, re.M)}


def test_threads_of_a_long_conversation_with_gaps(spark):
    turns = [t for t in range(0, 1500) if t % 7 and not 300 < t < 800]
    rows = threaded(spark.createDataFrame([(1, t, "user", f"m{t}") for t in turns], "conv_id long, turn long, role string, text string")).collect()
    got = {r.turn: (r.parent_turn, r.depth) for r in rows}
    assert got == {t: (turns[i - 1] if i else None, i) for i, t in enumerate(turns)}


def test_a_task_tells_its_sums_in_few_rows():
    """As many rows as there are blocks of features, however many documents and features a task has."""
    import pyarrow as pa

    from hypolith.llm import op2_quality as q

    weights = [np.full(q.TEXT + 1, 9.0), np.full(q.META + 1, 9.0)]
    run = q._listed(q._told({h: (weights, [np.array([1.0, 0.0])] * 2) for h in q.HEADS}, 0.95))
    n, rng = 300, np.random.default_rng(0)
    at = [np.unique(rng.integers(0, q.TEXT, 50)).astype(np.int32) for _ in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array([False] * n), pa.array(at, pa.list_(pa.int32())), pa.array([[1, 2]] * n, pa.list_(pa.int32()))], ["known", "text_at", "meta_at"])
    rows = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert len(rows) <= q.TEXT // (1 << 16) + 2
    told = {f: (r["a"][i], r["b"][i]) for r in rows if r["view"] == 0 for i, f in enumerate(r["feature"])}
    held = np.bincount(np.concatenate(at), minlength=q.TEXT)
    assert told.pop(-1) == (0, n) and {f: b for f, (_, b) in told.items()} == {int(f): int(held[f]) for f in np.flatnonzero(held)}


def test_packing_steps_go_over_the_pieces_that_wait():
    """The same choices as over all pieces of the pool at every step, gone ones too, with ever fewer to look at."""
    from hypolith.llm import op8_packing as q

    looked, r = [], np.random.default_rng(3)

    class Watched(q.Packer):
        def _rows(self, need):
            looked.append(len(need))
            return super()._rows(need)

    size, bears = r.integers(1, 60, 300), r.integers(0, 60, 300)
    p = Watched(0, 64, 5, 40, 1000)
    for i in range(300):
        p.add(i, np.arange(size[i], dtype=np.uint32), int(bears[i]))
    items = list(p.items)
    p.end()
    assert looked[0] == len(items) and len(looked) > 4 and all(2 * b < a for a, b in zip(looked, looked[1:], strict=False))
    left, first = p.limit.copy(), []
    need = np.array([p._demand(x) for x in items], float)
    free = np.ones(len(items), bool)
    while (fits := free & (need <= left).all(1)).any():
        i = int(np.argmax(np.where(fits, ((need / p.limit) * (left / p.limit)).sum(1), -1.0)))
        first.append(items[i][0])
        left, free[i] = left - need[i], False
    opened = [x[0] for x in p.taken() if x[5] == 0]
    assert first and opened[: len(first)] == first


def test_told_sums_are_added_before_they_are_rows(spark):
    """One row a block of features from all tasks, with each feature once and its whole sums."""
    import pyarrow as pa

    from hypolith.llm import op2_quality as q

    rng = np.random.default_rng(5)
    parts = []
    for _ in range(6):
        feature = np.append(-1, np.unique(rng.integers(0, 1 << 12, 900))).astype(np.int32)
        parts.append((feature, rng.integers(0, 9, (4, len(feature)))))
    one = lambda f, x: pa.RecordBatch.from_arrays([pa.array(np.zeros(len(f), np.int32)), pa.array(f), *map(pa.array, x)], ["view", "feature", *"abcd"])
    rows = spark.createDataFrame([(i,) for i in range(6)], "i int").repartition(6, "i")
    lists = rows.mapInArrow(lambda batches: q._listed(lambda bs: (one(*parts[i]) for b in bs for i in b.column(0).to_pylist()), 10)(batches), q.TOLD_LISTS)
    got = lists.groupBy("view", "block").applyInArrow(q._added, q.TOLD_LISTS).collect()
    assert sorted(r.block for r in got) == [0, 1, 2, 3]
    told = {f: tuple(r[c][i] for c in "abcd") for r in got for i, f in enumerate(r.feature)}
    assert sum(len(r.feature) for r in got) == len(told)
    want = {}
    for feature, x in parts:
        for f, v in zip(feature.tolist(), x.T, strict=True):
            want[f] = want.get(f, 0) + v
    assert told == {f: tuple(v.tolist()) for f, v in want.items()}


def test_units_are_looked_up_after_numbers_alone():
    from hypolith.llm.op5_templates import _NUMBER, _UNIT, Templater

    t, asked = Templater(), []
    found = t.is_unit
    t.is_unit = lambda word: asked.append(len(word)) or found(word)
    template, word, _, _ = t.words("hours of rain: 3 hours, 12 km and 7 apples in 2 ft")
    assert asked == [4] and [i for i, x in enumerate(template) if x == _UNIT] == [4, 6, 12] and sum(template == _NUMBER) == 4
    t.words("no numbers in hours")
    assert asked == [4]
