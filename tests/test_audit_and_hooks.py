"""Audit trails name what was altered; hooks keep what a user's function says and what it raises; windows follow from the span."""

import hashlib
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hypolith.operators import audit as A
from hypolith.operators import hooks as H
from hypolith.operators.regression import grouped, ols
from hypolith.operators.walk_forward import walk_forward, windows


def test_tree_names_the_altered_row(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 31).alias("v"), F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("s"))
    before = A.tree(df, ["id"], ["id", "v", "s"])
    assert {r.level: r["count"] for r in before.groupBy("level").count().collect()} == {0: 1000, 1: 63, 2: 4, 3: 1}
    rows = {(r.level, r.node): r.hash for r in before.collect()}
    row = lambda *v: hashlib.sha256(",".join("n" if x is None else f"{len(str(x))}:{x}" for x in v).encode()).hexdigest()
    assert all(rows[0, i] == row(i, i * 7 % 31, str(i) if i % 10 else None) for i in (0, 5, 999))
    assert all(rows[lv, n] == hashlib.sha256("".join(rows[lv - 1, c] for c in range(16 * n, 16 * n + 16) if (lv - 1, c) in rows).encode()).hexdigest() for lv, n in rows if lv)
    after = A.tree(df.withColumn("v", F.when(F.col("id") == 777, 0).otherwise(F.col("v")) + 0), ["id"], ["id", "v", "s"])
    assert sorted(tuple(r) for r in A.altered(before, after).collect()) == [(0, 777), (1, 48), (2, 3), (3, 0)]
    assert A.altered(before, before).count() == 0
    cut = A.altered(before, A.tree(df.filter("id < 990"), ["id"], ["id", "v", "s"])).filter("level = 0").count()
    assert cut == 10 and A.tree(df.limit(0), ["id"], ["v"]).count() == 0


def test_chain_breaks_where_an_entry_changes(spark):
    log = spark.createDataFrame([(r, i, f"step {i}") for r in ("a", "b") for i in range(9)], "run string, step int, what string")
    linked = A.chain(log, ["run"], "step", ["step", "what"])
    rows = {(r.run, r.step): r for r in linked.collect()}
    assert rows["a", 0].previous == "0" * 64 and all(rows["a", i].previous == rows["a", i - 1].link for i in range(1, 9)) and rows["a", 8].link == rows["b", 8].link
    assert A.broken(linked, ["run"], "step", ["step", "what"]).count() == 0
    forged = linked.withColumn("what", F.when((F.col("run") == "b") & (F.col("step") == 4), "other").otherwise(F.col("what")))
    assert [tuple(r) for r in A.broken(forged, ["run"], "step", ["step", "what"]).collect()] == [("b", 4)]
    lost = linked.filter("not (run = 'a' and step = 3)")
    assert [tuple(r) for r in A.broken(lost, ["run"], "step", ["step", "what"]).collect()] == [("a", 4)]


def test_file_hashes(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.bin").write_bytes(bytes(range(i, i + 100)))
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in A.file_hashes(spark, f"file://{tmp_path}").collect()}
    assert got == {f"f{i}.bin": (100, hashlib.sha256(bytes(range(i, i + 100))).hexdigest()) for i in range(3)}


def test_extractors_fail_and_are_tried_again(spark):
    def moody():
        calls = {}

        def extract(text):
            calls[text] = calls.get(text, 0) + 1
            if text == "" or (text == "second" and calls[text] < 2):
                raise RuntimeError(f"call {calls[text]}")
            for k, w in enumerate(text.split()):
                yield {"word": w, "place": k} if k else {"word": w}

        return extract

    df = spark.createDataFrame([(1, "a b"), (2, "second"), (3, None), (4, " ")], "id int, text string").coalesce(1)
    got = sorted(tuple(r) for r in H.extracted(df, "id", "text", moody(), "word string, place int").collect())
    assert got == [(1, 0, None, "a", None), (1, 1, None, "b", 1), (2, 0, None, "second", None), (3, 0, "RuntimeError: call 3", None, None)]
    assert H.extracted(df.limit(0), "id", "text", moody(), "word string, place int").count() == 0


def test_sizes_and_answers(spark):
    df = spark.createDataFrame([("d", t, float(v)) for t, v in zip("cab", (1, 2, 5), strict=True)] + [("e", "x", 1.0)], "date string, ticker string, signal double")
    got = {(r.date, r.ticker): r.weight for r in H.sized(df, lambda rows: pd.Series([0.5, float("inf"), 1.5][: len(rows)])).collect()}
    assert got == {("d", "a"): 0.25, ("d", "b"): 0.0, ("d", "c"): 0.75, ("e", "x"): 0.5}

    def half(t):
        return {"a": 1, "b": None}[t]

    assert {(r.ticker, r.answer, r.error) for r in H.asked(df, ["ticker"], half).collect()} == {("a", "1", None), ("b", None, None), ("c", None, "KeyError: 'c'"), ("x", None, "KeyError: 'x'")}


def test_windows_follow_from_the_span(spark):
    day = lambda k: date(2000, 1, 1) + timedelta(days=k)
    dates = spark.createDataFrame([(day(k),) for k in range(0, 1000, 2)], "date date")
    got = [(r.window, r.train_start, r.test_start, r.test_end) for r in windows(dates, 300, 200, step=100).orderBy("window").collect()]
    want = [(k, day(100 * k), day(100 * k + 300), day(100 * k + 500)) for k in range(9) if 100 * k + 500 <= 998]
    assert got == want and windows(dates.limit(251), 300, 200).count() == 0 and windows(dates.limit(0), 3, 2).count() == 0


def test_walk_forward_in_overlapping_windows(spark):
    """Each window's cohorts are those of its own test span, also where spans overlap; too few test dates end the windows."""
    r = np.random.default_rng(0)
    rows = [(t, date(2000, 1, 3) + timedelta(days=k), float(np.exp(r.normal(0, 0.02)) * (10 + t))) for t in range(12) for k in range(0, 1500)]
    prices = spark.createDataFrame(rows, "ticker int, date date, close double")
    s = prices.withColumns({"signal": F.hash("ticker", "date") % 1000, "price": F.col("close"), "adv": F.lit(1e6), "cap": F.lit(1e10), "sector": F.col("ticker") % 3})
    got = {x.window: x for x in walk_forward(s, prices, 5, train=365, test=360, step=180).collect()}
    assert sorted(got) == list(range(5)) and all(10 <= x.cohorts <= 13 and x.gross - x.net > 0 for x in got.values())
    one = {x.window: x.gross for x in walk_forward(s, prices, 5, train=365, test=360, step=360).collect()}
    assert all(one[k] == pytest.approx(got[2 * k].gross) for k in one)
    assert walk_forward(s, prices, 5, train=365, test=100).count() == 0  # three or four months hold too few dates


def test_a_thousand_regressions_in_one_plan(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1000, 40, 2))
    y = 0.5 + x @ np.array([2.0, -1.0]) + r.normal(size=(1000, 40))
    rows = [(g, date(2020, 1, 1) + timedelta(days=i), float(y[g, i]), *map(float, x[g, i])) for g in range(1000) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, date date, y double, u double, v double")
    got = {q.g: q for q in grouped(df, ["g"], "y", ["u", "v"]).collect()}
    assert len(got) == 1000
    for g in range(0, 1000, 37):
        a = np.column_stack([np.ones(40), x[g]])
        assert np.allclose(got[g].beta, np.linalg.lstsq(a, y[g], rcond=None)[0])
    o = ols(df.filter("g = 5"), "y", ["u", "v"])
    assert np.allclose(got[5].se_nw, o["se_nw"]) and np.allclose(got[5].se, o["se"]) and got[5].r2 == pytest.approx(o["r2"]) and got[5].lags == o["lags"]
