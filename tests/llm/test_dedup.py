"""op4 and op6 against all pairs in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypolith.llm.components import components
from hypolith.llm.op4_minhash import Signer, near_duplicates
from hypolith.llm.op6_fuse import Fuse, exact_duplicates
from hypolith.llm.queries import QUERIES
from tests.conftest import SF

DOC = "doc_id long, text string, n_chars string, keep_id string"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(docs):
    """{id: (size, component)} by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    by, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    both = Counter((a, b) for g in by.values() for a in g for b in g if a < b)
    for (a, b), n in both.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check_near(df, docs):
    got = {r.doc_id: r for r in df.collect()}
    for i, (n, c) in near(docs).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, c == i), i


def test_near_duplicates_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_near(QUERIES["op4_minhash"](spark, SF), docs)


def test_near_duplicates_in_a_crowd(spark):
    """Many edited copies of one text, most of them under the threshold to each other: big buckets with few links."""
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(180)]
    docs = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "One  TWO"), (1005, "one two three"), (1006, "x " * 30_000), (1007, "ÀB c d e f"), (1008, "àb c d e f")]
    for i in range(220):
        words = list(base)
        for j in r.integers(0, len(words), r.integers(0, 7)):
            words[j] = f"e{r.integers(10**9)}"
        docs.append((i, " ".join(words)))
    docs += [(2000 + i, " ".join(base)) for i in range(40)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOC)
    check_near(near_duplicates(df), docs)
    again = near_duplicates(df.union(df.limit(50)).union(spark.createDataFrame([(None, "w1 w2", None, None)], DOC)))
    assert again.count() == len(docs) + 51 and again.filter("doc_id is null and kept").count() == 1
    check_near(again.filter("doc_id is not null"), docs)
    assert near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_ids_with_two_texts(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(1, text), (1, "other words that are quite unlike"), (2, text), (3, text + " end"), (4, "other words that are quite unlike")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicates(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOC)).collect()}
    assert got == {(1, 56): 1, (1, 2): 1, (2, 56): 1, (3, 57): 3, (4, 2): 1}  # 3 is compared with the larger text of 1


def test_bands_hold_no_permutation_twice():
    s = Signer(40, 4)
    assert sorted(s.at.ravel()) == list(range(80)) and all(len(set(x % 40)) == 4 for x in s.at)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(50)] + [(300, 300), (None, 4), (130, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "low long, high long")).collect()}
    assert got == {i: 0 for i in [*range(61), *range(100, 151)]}


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    return {(i, t): (min(groups[k := re.sub("[\x20\x09-\x0d]", "", t or "")])[1], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, t in docs}


@pytest.mark.parametrize("shard", [50_000, 3])
def test_exact_duplicates(spark, shard):
    docs = [(0, None), (1, ""), (2, " \t"), (3, "a b"), (4, "ab"), (5, "a  b"), (6, "a b"), (7, "A b"), (8, "é" * 100_000), (9, "é" * 99_999 + " é"), (10, "a\n\nb"), (11, "a  b ")]
    docs += [(100 + i, f"t{i % 7} x") for i in range(60)] + [(4, "ab")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOC)
    want = exact(docs)
    got = exact_duplicates(df, shard=shard).collect()
    assert len(got) == len(docs)
    for r in got:
        t = next(t for i, t in docs if i == r.doc_id)
        assert (r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id, t] and r.kept == (r.keep_id == r.doc_id)
    assert exact_duplicates(df.limit(0)).count() == 0
    assert exact_duplicates(spark.createDataFrame([(None, "q", "", ""), (3, "q ", "", "")], DOC)).filter("keep_id = 3").count() == 2


@pytest.mark.parametrize("first", [True, False])
def test_exact_duplicates_of_a_large_batch_and_an_empty_snapshot(spark, first):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('t ', cast(id % 1000 AS string)) AS text")
    rows = exact_duplicates(df, new=F.lit(first), shard=100).collect()
    assert len(rows) == 3000 and all((r.keep_id, r.group_size) == (r.doc_id % 1000, 3) for r in rows)


def test_exact_duplicates_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: v for (i, _), v in exact(docs).items()}
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in QUERIES["op6_fuse"](spark, SF).collect()} == want


@pytest.mark.parametrize("n", [1, 2, 17, 1000, 40_000])
def test_fuse_filter(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
    f = Fuse.build(keys)
    assert f.holds(keys).all()
    others = r.integers(0, 2**63, 200_000, dtype=np.uint64)
    assert f.holds(others).mean() < 2e-4
