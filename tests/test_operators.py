"""Hand-made fixtures and properties: gaps, ties, weekends, first losses, dates that aren't known yet."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hypolith.functions import costs, special
from hypolith.functions import filings as G
from hypolith.functions.dates import add_business_days
from hypolith.operators import factors as X
from hypolith.operators import joins as J
from hypolith.operators import portfolio as P
from hypolith.operators import resampling as B
from hypolith.operators import statistics as S
from hypolith.operators.matching import matched
from hypolith.operators.order import placed, walked
from hypolith.operators.regression import ols
from hypolith.plans import registry
from hypolith.plans.filing_queries import removed_items
from hypolith.plans.spec import DataSource, HypothesisSpec
from hypolith.plans.verdict import evaluate
from hypolith.sources import adapters as A
from hypolith.streaming import events as E
from tests.conftest import SF

D = lambda s: date.fromisoformat(s)


def series(spark, values, start="2024-01-01"):
    return spark.createDataFrame([(D(start) + timedelta(days=i), float(v)) for i, v in enumerate(values)], "date date, ret double")


def test_business_days_agree_with_pandas(spark):
    days = [D("2024-01-01") + timedelta(days=i) for i in range(14)]
    df = spark.createDataFrame([(d, n) for d in days for n in range(15)], "d date, n int")
    for r in df.select("d", "n", add_business_days(F.col("d"), F.col("n")).alias("x")).collect():
        assert pd.Timestamp(r.x) == pd.Timestamp(r.d) + pd.offsets.BusinessDay(r.n)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 100)), min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 3), st.integers(-2, 33)), min_size=1, max_size=15))
def test_as_of_never_looks_ahead(spark, facts, points):
    day = lambda n: D("2024-03-01") + timedelta(days=n)
    f = spark.createDataFrame([(k, day(t), v) for k, t, v in facts], "key int, known date, v int")
    o = spark.createDataFrame([(k, day(t)) for k, t in set(points)], "key int, at date")
    for ahead in (False, True):
        for r in J.as_of(o, f, "key", "at", "known", ["v"], ahead=ahead).collect():
            can = [(day(t), v) for k, t, v in facts if k == r.key and (day(t) > r["at"] if ahead else day(t) <= r["at"])]
            want = (min(t for t, _ in can) if ahead else max(t for t, _ in can)) if can else None
            assert r.known == want and (want is None or r.v == max(v for t, v in can if t == want))


def test_forward_prices_need_an_exit(spark):
    prices = spark.createDataFrame([("a", D("2024-01-05"), 10.0), ("a", D("2024-01-08"), 11.0), ("a", D("2024-01-09"), 12.0), ("b", D("2024-01-08"), 5.0)], "ticker string, date date, close double")
    points = spark.createDataFrame([("a", D("2024-01-06")), ("a", D("2024-01-08")), ("b", D("2024-01-01")), ("c", D("2024-01-01"))], "ticker string, signal_date date")
    rows = J.forward_prices(points, prices, 5, False).collect()
    assert [(r.ticker, r.signal_date, r.entry_price, r.exit_price) for r in rows] == [("a", D("2024-01-06"), 11.0, 12.0)]  # the others have no price after their entry


def test_ties_at_the_top_take_the_first_ticker(spark):
    df = spark.createDataFrame([(D("2024-01-01"), t, 1.0) for t in "dcbae"], "date date, ticker string, signal double")
    assert [r.ticker for r in df.withColumn("k", P.top(["date"], "signal", 0.4)).filter("k").collect()] == ["a", "b"]
    assert df.limit(1).withColumn("k", P.top(["date"], "signal", 0.2)).filter("k").count() == 1


def test_first_loss_is_no_drawdown(spark):
    curve = S.equity(series(spark, [-0.5, 0.1, -0.2, 0.5]))
    rows = [round(r.drawdown, 6) for r in curve.orderBy("date").collect()]
    assert rows == [0.0, 0.0, -0.2, 0.0]
    assert S.drawdown_days(curve).first()[0] == 1
    assert S.drawdown_days(S.equity(series(spark, [0.1, -0.2, 0.1, -0.1]))).first()[0] == 2  # the open spell ends with the last date


def test_distribution_agrees_with_pandas(spark):
    x = np.random.default_rng(0).normal(0, 1, 60) ** 3
    row = S.distribution(series(spark, x)).first()
    s = pd.Series(x)
    assert row.skew == pytest.approx(s.skew()) and row.kurtosis == pytest.approx(s.kurt()) and row.p25 == pytest.approx(s.quantile(0.25)) and row.acf_1 == pytest.approx(s.autocorr(1))
    assert S.distribution(series(spark, x[:9])).count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1, allow_nan=False), min_size=1, max_size=25))
def test_adjusted_p_values(spark, ps):
    rows = S.adjusted(spark.createDataFrame([(f"{i:03}", p) for i, p in enumerate(ps)], "key string, p double")).orderBy("rank").collect()
    assert all(a.bh <= b.bh + 1e-12 for a, b in zip(rows, rows[1:], strict=False))
    assert all(r.p - 1e-12 <= r.bh <= r.bonferroni + 1e-12 for r in rows)


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([("x", 1, True), ("x", 1, False), ("x", 2, True), ("x", 0, False), ("y", 1, True)], "g string, v int, p boolean")
    assert {r.g: r.auc for r in S.auc(df, "v", F.col("p"), ["g"]).collect()} == {"x": 0.875, "y": None}


def test_structural_break_is_found(spark):
    r = np.random.default_rng(1)
    b = S.structural_breaks(series(spark, [*r.normal(0, 0.1, 40), *r.normal(1, 0.1, 40)]))
    assert abs(b.orderBy(F.desc(F.abs("t"))).first().i - 40) <= 1
    assert S.thinned(b, 3.0).count() <= 5


def test_costs(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()[0]
    assert one(costs.spread_bps(F.lit(None).cast("double"))) == 200 and one(costs.spread_bps(F.lit(1e6))) == 400 and one(costs.spread_bps(F.lit(1e15))) == 4
    assert one(costs.slippage_bps(F.lit(10.0), F.lit(0.0), F.lit(1e9))) == 100 and one(costs.slippage_bps(F.lit(1.0), F.lit(1e9), F.lit(1e12))) == 1
    assert one(costs.borrow_rate_daily(F.lit(1e8), F.lit(40.0))) == pytest.approx(0.5 / 252)


def test_positions_keep_their_limits(spark):
    df = spark.createDataFrame([(1, f"t{i}", i % 2, 0.2, 10.0, 1e9) for i in range(20)], "date int, ticker string, sector int, weight double, price double, adv double")
    rows = costs.constrained(df, 1e6, ["date"]).collect()
    assert max(r.weight for r in rows) <= 0.05 and sum(r.weight for r in rows if r.sector == 0) <= 0.3 + 1e-9


def test_bootstrap_repeats_and_centres(spark):
    s = series(spark, np.random.default_rng(2).normal(0.1, 1, 50))
    a, b = ({r.rep: r["mean"] for r in B.block_bootstrap(s, 40, 5).collect()} for _ in range(2))
    assert a == b and len(a) == 40
    assert B.block_length(12, 0.9) == 3 and B.block_length(100, 0.01) == 5 and B.block_length(100, 0.1) == 10 and B.block_length(30, 0.9) == 6


def test_permutation_deals_the_same_signals(spark):
    p = spark.createDataFrame([(D("2024-01-01") + timedelta(days=i % 3), f"t{i}", float(i)) for i in range(30)], "date date, ticker string, signal double")
    q = B.permuted(p, 3)
    assert q.groupBy("rep", "date").agg(F.sum("signal").alias("s")).select("date", "s").distinct().count() == 3 and q.count() == 90


def test_regression_agrees_with_numpy(spark):
    r = np.random.default_rng(3)
    x, e = r.normal(0, 1, (80, 2)), r.normal(0, 0.3, 80)
    y = 0.5 + x @ [2.0, -1.0] + e
    df = spark.createDataFrame([(D("2024-01-01") + timedelta(days=i), float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(80)], "date date, y double, a double, b double")
    got = ols(df, "y", ["a", "b"])
    z = np.column_stack([np.ones(80), x])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    u = (y - z @ beta)[:, None] * z
    meat = u.T @ u
    for k in range(1, got["lags"] + 1):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / (got["lags"] + 1)) * (g + g.T)
    inv = np.linalg.inv(z.T @ z)
    assert np.allclose(got["beta"], beta) and np.allclose(got["se_nw"], np.sqrt(np.diag(inv @ meat @ inv)))
    with pytest.raises(ValueError):
        ols(df.limit(3), "y", ["a", "b"])


def test_special_functions():
    assert special.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6) and special.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.power(0.5, 30) == pytest.approx(0.7540, abs=1e-3) and special.required_n(0.5) == 34
    assert special.noncentral_t_cdf(1.0, 8, 0.0) == pytest.approx(special.t_cdf(1.0, 8), abs=1e-9) and math.isclose(special.beta_inc(2, 3, 0.4), 0.5248)


def test_spec_and_verdict(spark):
    spec = HypothesisSpec("n", "u", data_sources=[DataSource("events", "prices", ["close"])])
    assert HypothesisSpec.from_json(spec.to_json()) == spec and not spec.validate()
    bad = HypothesisSpec("", "", holding_period_days=0, top_quantile=0.9, rebalance="yearly", start="b", end="a", direction=0)
    assert len(bad.validate()) == 6
    none = spark.createDataFrame([], "date date, ticker string, signal double")
    prices = spark.createDataFrame([], "ticker string, date date, close double")
    assert evaluate(spark, spec, none, prices).first().verdict == "UNTESTABLE" and evaluate(spark, bad, none, prices).first().verdict == "UNTESTABLE"


def test_noise_does_not_survive(spark):
    prices = A.simulated_prices(spark, 30, 200, drift=0.0).persist()
    signals = prices.select("date", "ticker", (B.draw(1, F.col("date").cast("string"), "ticker") / 2**32).alias("signal"))
    row = evaluate(spark, HypothesisSpec("noise", "u", min_sharpe=0.5), signals, prices, reps=100).first()
    assert row.verdict == "BROKEN"


def test_snapshots_are_verified(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("x"))
    assert A.save(df, f"{tmp_path}/s") == A.content_hash(df.orderBy(F.desc("id")), ["id", "x"])
    assert A.load(spark, f"{tmp_path}/s").count() == 10
    df.filter("id < 9").write.mode("overwrite").parquet(f"{tmp_path}/s/data")
    with pytest.raises(ValueError):
        A.load(spark, f"{tmp_path}/s")
    with pytest.raises(A.Untestable):
        A.acquire(spark, "fmp", SF)
    with pytest.raises(A.Untestable):
        A.acquire(spark, "events", SF, ["nothing"])


def test_streaming_plans_keep_watermarks(spark):
    e = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(f"{SF}/events.parquet*")
    assert E.deduplicated(e).isStreaming and E.windowed(e, "1 day", "12 hours").columns == ["start", "event_type", "n", "mean"]


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["b1_universe_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_retailprice)" in plan and "p_name" not in plan


def test_as_of_join_shuffles_once_and_forms_no_pairs(spark):
    p = registry.QUERIES["c1_point_in_time"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in p


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(registry.QUERIES) > 150


def test_prices_of_zero_give_no_return(spark):
    prices = spark.createDataFrame([("a", D("2024-01-01") + timedelta(days=i), float(x)) for i, x in enumerate([5, 0, 4, 0, 0, 8])], "ticker string, date date, close double").withColumn("volume", F.lit(0.0))
    for f in (X.period_return, X.reversal, X.momentum, X.amihud, X.low_volatility):
        assert f(prices).count() == 6
    got = [r.value for r in X.period_return(prices).orderBy("date").collect()]
    assert got == [None, -1.0, None, -1.0, None, None]
    assert [r.fwd for r in J.offset_return(prices, 2).orderBy("date").collect()] == [None, -1.0, None, None, None, None]
    points = prices.select("ticker", F.col("date").alias("signal_date"))
    rows = J.with_return(J.forward_prices(points, prices, 5, True)).collect()
    assert rows and all(r.entry_price > 0 for r in rows)
    flat = series(spark, [0.0] * 30)
    assert S.distribution(flat).count() == 1 and S.performance(flat).first().sharpe is None and S.gt_score(flat).first().t is None


def test_a_total_loss_is_the_worst_drawdown(spark):
    rows = S.equity(series(spark, [0.1, -1.0, 0.5])).orderBy("date").collect()
    assert [round(r.cum, 6) for r in rows] == [1.1, 0, 0] and [r.drawdown for r in rows] == [0, -1, -1]
    assert [(r.cum, r.drawdown) for r in S.equity(series(spark, [-1.5])).collect()] == [(0, -1)]


def test_ranks_with_hot_values(spark):
    """95 % of the values are equal; they are dealt to many tasks, and no task holds more than a few shares of the rows."""
    rng = np.random.default_rng(0)
    values = np.where(rng.random(4000) < 0.95, 0.05, rng.random(4000))
    rows = [(f"k{i:04}", float(v) if i % 50 else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key string, p double")
    want = {k: i + 1 for i, (v, k) in enumerate(sorted((v, k) for k, v in rows if v is not None))}
    for partitions in (1, 7, 16):
        got = S.ranked(df, "p", "key", partitions).collect()
        assert {r.key: r["rank"] for r in got} == want and {r.n for r in got} == {len(want)}
    ranges = placed(df.filter("p is not null"), "p", "key", partitions=16)[1].collect()
    assert len(ranges) > 8 and max(r.rows for r in ranges) < 4 * len(want) / 16
    # The step-up procedure over all of them at once.
    ps, n, least, bh = sorted((v, k) for k, v in rows if v is not None), len(want), 1.0, {}
    for i in range(n, 0, -1):
        least = min(least, ps[i - 1][0] * n / i)
        bh[ps[i - 1][1]] = least
    assert {r.key: round(r.bh, 9) for r in S.adjusted(df, partitions=16).collect()} == {k: round(v, 9) for k, v in bh.items()}
    assert S.ranked(df.limit(0), "p", "key").count() == 0 and S.adjusted(df.limit(0)).count() == 0


def test_walks_across_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(v) if v > 2 else None) for i, v in enumerate(rng.integers(0, 9, 300))]
    d, _ = placed(spark.createDataFrame(rows, "i int, v int"), "i", partitions=9)
    d = walked(walked(walked(walked(d, "last", F.col("v")), "next", F.col("v"), back=True), "sum", F.col("v"), "sum"), "min", F.col("v"), "min", back=True)
    for r in d.collect():
        before, after = [v for i, v in rows[: r.i] if v is not None], [v for i, v in rows[r.i + 1 :] if v is not None]
        assert r.position == r.i + 1 and r.last == (before[-1] if before else None) and r.next == (after[0] if after else None)
        assert (r["sum"] or 0) == sum(before) and r["min"] == min(after, default=None)


def test_distributions_as_columns(spark):
    """Against the series of the driver's functions, for many arguments at once; and alike in DuckDB where it runs them."""
    import duckdb

    from hypolith.functions.distributions import DUCK, MANY, SPARK

    rows = [(float(t), float(v)) for t in (-8, -3.3, -1, 0, 0.001, 1.96, 6, 30) for v in (1, 2, 3, 5, 10, 29, 400, MANY, MANY + 1, 50_000)] + [(None, 5.0), (1.0, 0.0)]
    df = spark.createDataFrame(rows, "t double, v double")
    asked = {"cdf": SPARK.normal_cdf("t"), "quantile": SPARK.normal_quantile("0.5 + t / 100"), "far": SPARK.t_two_sided("t", "v"), "upper": SPARK.t_quantile("0.975", "v"), "power": SPARK.power("abs(t) / 5", "v + 1")}
    for r in df.selectExpr("t", "v", *(f"{e} AS {k}" for k, e in asked.items())).collect():
        if r.t is None or not r.v:
            assert r.far is None and (r.t is not None or (r.cdf is None and r["quantile"] is None))
            continue
        assert r.cdf == pytest.approx(special.NORMAL.cdf(r.t), abs=1e-12) and r["quantile"] == pytest.approx(special.NORMAL.inv_cdf(0.5 + r.t / 100), abs=1e-9)
        near = 1e-9 if r.v <= MANY else 1e-6
        assert r.far == pytest.approx(special.t_two_sided(r.t, r.v), abs=near) and r.upper == pytest.approx(special.t_quantile(0.975, r.v), abs=10 * near)
        if r.v <= 400:
            assert r.power == pytest.approx(special.power(abs(r.t) / 5, int(r.v) + 1), abs=1e-6)
    ns = spark.createDataFrame([(5, 0.2), (30, 0.5), (400, 0.03), (60, 1.5), (9, 1e-4)], "n int, d double")
    for r in ns.selectExpr("n", "d", f"{SPARK.detectable('n')} AS least", f"{SPARK.required_n('d')} AS rows").collect():
        assert r.least == pytest.approx(special.detectable(r.n), abs=1e-5) and r.rows == (special.required_n(r.d) if r.d > 0.01 else None)
    held = duckdb.connect()
    held.execute("CREATE TABLE x AS SELECT unnest($1) AS t, unnest($2) AS v", [[t for t, _ in rows[:30]], [v for _, v in rows[:30]]])
    mine = {(r.t, r.v): (r.cdf, r.far) for r in df.selectExpr("t", "v", f"{asked['cdf']} AS cdf", f"{asked['far']} AS far").collect()}
    for t, v, cdf, far in held.execute(f"SELECT t, v, {DUCK.normal_cdf('t')}, {DUCK.t_two_sided('t', 'v')} FROM x").fetchall():
        assert mine[t, v] == pytest.approx((cdf, far), abs=1e-14)


def test_index_of_names_is_never_broadcast(spark):
    from hypolith.operators.names import containing

    df = spark.createDataFrame([(f"company {i}",) for i in range(20)], "needle string")
    found = containing(df, df.withColumnRenamed("needle", "haystack"))
    assert found.count() == 20 + 10  # company 1 is in company 10 to 19
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 3, plan


def test_names_against_all_pairs(spark):
    """Ranks of all names by all titles, with short names, equal ones and letters that most of them share."""
    import re

    from hypolith.operators.names import CLEANED, containing, matched_names

    def norm(x):
        x = x.strip().upper()
        for pattern, new in CLEANED:
            x = re.sub(pattern, new, x)
        return x.strip()

    rng = np.random.default_rng(3)
    parts = ["Pfizer", "Merck", "a", "ab", "Inc", "Inc.", "Labs", "The", "Onyx", "Amgen", "co", "Bio-X", "  ", "ABCDEFGHIJKL", "abcdefghij zz", ","]
    name = lambda: " ".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 5)))
    names, known = [name() for _ in range(150)] + ["", None], [(name(), int(i)) for i in rng.permutation(120)] + [(None, 1), ("x", None)]

    def rank(n, t):
        a, b, up = norm(n), norm(t), t.upper()
        if n.strip().upper() and n.strip().upper() == t.strip().upper():
            return 1
        if a and a == b:
            return 2
        if a and b and (a in b or b in a):
            return 3
        return 4 if a and (a[:10] in up or (up[:10] and up[:10] in a)) else None

    want = {}
    for n in {x for x in names if x is not None}:
        found = [(r, v) for t, v in known if t is not None and v is not None and (r := rank(n, t))]
        if found:
            want[n] = min(found)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = matched_names(df, spark.createDataFrame(known, "title string, value int")).collect()
    assert {r.name: (r["rank"], r.value) for r in got} == want and len(got) == len(want)
    some = spark.createDataFrame([("ab",), ("",), ("zzz",)], "needle string"), spark.createDataFrame([("xab",), ("ab",), ("b",)], "haystack string")
    assert sorted(tuple(r) for r in containing(*some).collect()) == [("ab", "ab"), ("ab", "xab")]


def greedy(rows):
    """The closest free pair again and again: by days, then rows between, then the first of the two."""
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    free, out = {i: r for i, r in enumerate(order)}, set()
    while {r[1] for r in free.values()} == {True, False}:
        some = sorted(free)
        near = [(i, j) for i, j in zip(some, some[1:], strict=False) if free[i][1] != free[j][1]]  # nothing lies between a closest pair
        i, j = min(near, key=lambda x: ((free[x[1]][2] - free[x[0]][2]).days, x[1] - x[0], x[0]))
        a, b = (free[i], free[j]) if free[i][1] else (free[j], free[i])
        out.add((a[0], b[0], (free[j][2] - free[i][2]).days))
        del free[i], free[j]
    return out


def pairs_of(spark, rows, partitions=5):
    return {tuple(r) for r in matched(spark.createDataFrame(rows, "id int, side boolean, at date"), "id", "side", "at", partitions).collect()}


def test_matching_is_plain_greedy(spark):
    rng = np.random.default_rng(2)
    day = lambda d: D("2020-01-01") + timedelta(days=int(d))
    for seed, spread in ((0, 400), (1, 30)):
        rows = [(i, bool(s), day(d)) for i, (s, d) in enumerate(zip(rng.integers(0, 2, 90), rng.integers(0, spread, 90), strict=True))]
        assert pairs_of(spark, rows) == greedy(rows), seed
    assert pairs_of(spark, [(1, True, day(0))]) == set() == pairs_of(spark, [(1, True, day(0)), (2, True, None), (3, None, day(1))])


def test_matching_waits_for_rows_beyond_a_short_run(spark):
    # The third row's run has no second partner in the fifth's; the last row is closer than the first two once 43-44 and 46-47 are gone.
    rows = [(d, bad, D("2020-01-01") + timedelta(days=d)) for d, bad in ((27, False), (32, False), (42, True), (43, True), (44, False), (46, True), (47, False), (48, False))]
    assert pairs_of(spark, rows) == greedy(rows) == {(43, 44, 1), (46, 47, 1), (42, 48, 6)}
    rng = np.random.default_rng(5)
    rows = [(i, bool(s), D("2020-01-01") + timedelta(days=int(d))) for i, (s, d) in enumerate(zip(rng.random(300) < 0.3, rng.integers(0, 900, 300), strict=True))]
    assert pairs_of(spark, rows) == greedy(rows)


def test_matching_of_long_runs_takes_few_rounds(spark, monkeypatch):
    """A run of many of one side beside one of the other is one round; runs of both in turn are as many as their number's log."""
    from hypolith.operators import matching as M

    rounds, keep = [], M.T.written
    monkeypatch.setattr(M.T, "written", lambda df, name: (rounds.append(name), keep(df, name))[1])
    rows = [(i, i >= 300, D("2030-01-01") + timedelta(days=i)) for i in range(600)]
    assert pairs_of(spark, rows) == {(300 + i, 299 - i, 2 * i + 1) for i in range(300)} and rounds.count("pairs") == 1
    rounds.clear()
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for k in range(24):
        for _ in range(int(rng.integers(5, 40))):
            at += int(rng.integers(0, 4))
            rows.append((len(rows), bool(k % 2), D("2000-01-01") + timedelta(days=at)))
    assert pairs_of(spark, rows) == greedy(rows) and rounds.count("pairs") <= 10


def test_filing_parts_of_hand_made_texts(spark):
    risks = "\n".join(f"({i}) We may lose money on thing number {i}, and on all that follows from it." for i in range(1, 5))
    annual = f"Table of Contents\nItem 1A. Risk Factors\nItem 7. Management's Discussion\n\nItem 1A. Risk Factors\n{risks}\nItem 1B. Unresolved\n" + "x" * 200
    one = lambda c, **texts: spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts)).select(c.alias("x")).first().x
    found = one(G.section(F.col("t"), G.SECTIONS["risk_factors"], G.NEXT_SECTION), t=annual)
    assert found.startswith("Item 1A. Risk Factors\n(1)") and found.endswith("follows from it.")
    assert one(G.section(F.col("t"), G.SECTIONS["mda"], G.NEXT_SECTION), t="no items") is None
    assert [x[:3] for x in one(G.risk_items(F.col("t")), t=found)] == ["(1)", "(2)", "(3)", "(4)"] and one(G.risk_items(F.col("t")), t="short") == []
    call = "Welcome.\nQuestions and Answers\n" + "we said so. " * 60 + "\nEND OF CALL\nrest"
    assert one(G.questions_part(F.col("t")), t=call).endswith("we said so.") and one(G.questions_part(F.col("t")), t="none") is None
    assert one(G.segments(F.col("t"))["qa"], t=call).startswith("Questions") and one(G.segments(F.col("t"))["prepared"], t="all of it") == "all of it"
    matters = "Opinion.\nCritical Audit Matters\nThe matters communicated below do not alter it.\n\nGoodwill\nCritical Audit Matter Description\n" + "level 3 inputs and more. " * 9 + "\nHow the critical audit matter was addressed\nlitigation\n/s/\nX"
    df = G.audit_matters(spark.createDataFrame([(matters,), ("nothing",), (None,)], "t string"), "t")
    rows = [r.matters for r in df.collect()]
    assert len(rows[0]) == 1 and rows[0][0].startswith("Goodwill\nCritical Audit Matter Description") and rows[1:] == [[], []]
    assert one(G.audit_topic(F.col("t")), t=rows[0][0]) == "financial_instruments" and one(G.audit_topic(F.col("t")), t="goodwill only") == "asset_valuation"
    told = lambda t: one(G.tolerant_json(F.col("t"), {"signal_value": None})["signal_value"], t=t)
    assert [told(t) for t in ('```json\n{"signal_value": 0.5}\n```', 'x {"a": {"b": "}"}, "signal_value": 2,} y', '"signal_value": -1.5, cut', "none")] == [0.5, 2.0, -1.5, None]


def long_filing(spark, folder, name):
    """Rows of a query, and of its SQL, where a document has 40,000 letters and ends with a word of its own."""
    import duckdb

    from hypolith.plans import registry

    spark.createDataFrame([(0, "alpha beta gamma. " * 2200 + "omega", "en", "s", 40_000)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    r = c.execute(registry.SQL[name])
    columns = [d[0] for d in r.description]
    return [tuple(x[k] for k in columns) for x in registry.QUERIES[name](spark, str(folder)).orderBy(columns[:2]).collect()], sorted(r.fetchall())


def test_audit_matters_part_is_whole(spark, tmp_path):
    got, told = long_filing(spark, tmp_path, "t19_audit_matters_part")
    assert got == told and got[0][1] > 2 * 39_600
    text = "Critical Audit Matters\n" + "a matter, and more. " * 2000 + "the end.\n/s/\nX"
    assert spark.createDataFrame([(text,), (text[:-6],)], "t string").select(G.audit_matters_part(F.col("t")).alias("x")).collect() == [(text[:-6],)] * 2


def test_audit_matters_are_whole(spark, tmp_path):
    got, told = long_filing(spark, tmp_path, "t20_t21_audit_matters")
    assert got == told and len(got) == 2 and all(r[2] > 39_600 for r in got)


def test_cuts_at_line_begins_against_plain_python(spark):
    """Patterns that match at the begin of a line are tried at line ends only, with the same pieces."""
    import re

    rng = np.random.default_rng(8)
    bits = ["\n", "\n", " ", "\u0001", "(1)", "2. ", "• ", "critical audit matters", "Description of the Matter\n", "Market Risks", "é", "x"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 15))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for p in (G.ITEM_START, G.SUBHEAD, G.CAM_START, G.CAM_HEADING):
        want = [re.sub(f"(?i)({p})", "\u0001\\1", t.replace("\u0001", " "), flags=re.ASCII).split("\u0001") for t in texts]
        got = df.select(G.cut(F.col("t"), p), G.before(F.col("t"), p)).collect()
        assert [tuple(r) for r in got] == [(w, w[0] if len(w) > 1 else None) for w in want] + [(None, None)]
        assert sum(len(w) > 1 for w in want) > 20


def test_patterns_are_looked_for_where_their_letters_stand(spark):
    import re

    from hypolith.functions.text import first_match, needed

    assert needed(r"fair\s+value|oil\s+(?:and|or)\s+gasses?|level\s+[123]|post.?retirement") == ["value", "gasse", "level", "retirement"]
    assert not any(needed(p) for p in ("a|", "[ab]", "(?i)abc", "a(?:b(?:c))d", "^abc", "ab{2}", r"\x41bc", "(?:ab)?"))
    assert needed("ab*cd") == ["cd"] and needed("abc?") == ["ab"] and needed("(?:ab)?cd") == ["cd"]
    rng = np.random.default_rng(9)
    words = [w for p, _ in G.CAM_TOPICS for w in re.sub("[^a-z]+", " ", re.sub(r"\\s", " ", p)).split()] + ["3", "\n", "-", "Tax"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(2000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(first_match(F.col("t"), G.CAM_TOPICS, "other").alias("x"))
    want = [next((n for p, n in G.CAM_TOPICS if re.search(p, t.lower(), re.ASCII)), "other") for t in texts]
    assert [r.x for r in got.collect()] == want and len(set(want)) > 7
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.index("goodwill)") < plan.index("goodwill|")  # the letters first


def test_removed_items_against_plain_python(spark):
    rng = np.random.default_rng(5)
    words = lambda: sorted({f"w{k}" for k in rng.integers(0, 40, rng.integers(0, 9))})
    items = [(d, i, words()) for d in range(6) for i in range(rng.integers(1, 7))]
    pairs = [(d, d + 1) for d in range(5)]
    got = {(r.old, r.new): r for r in removed_items(spark.createDataFrame(items, "doc_id long, item int, words array<string>"), spark.createDataFrame(pairs, "old long, new long")).collect()}
    for a, b in pairs:
        x, y = ([set(w) for d, _, w in items if d == k] for k in (a, b))
        sim = lambda p, q: len(p & q) / len(p | q) if p | q else 0.0
        far = [max(sim(p, q) for q in y) for p in x]
        back = [max(sim(p, q) for p in x) for q in y]
        r = got[a, b]
        assert (r.n_removed, r.n_added, r.n_unchanged) == (sum(s < 0.15 for s in far), sum(s < 0.15 for s in back), sum(s >= 0.15 for s in far))
        assert abs(r.score - r.n_removed * np.mean([1 - s for s in far])) < 1e-9


def test_removed_items_shuffle_no_words_and_cut_texts_once(spark):
    """Words move with their items, an old filing of many items is dealt to several tasks, and both sides read the items as written."""
    from hypolith.plans import registry
    from hypolith.plans.filing_queries import BLOCK
    from tests.conftest import SF

    n = 2 * BLOCK + 9
    items = spark.createDataFrame([(1, i, [f"w{i}", f"v{i}"]) for i in range(n)] + [(2, i, [f"w{i}", f"u{i}"]) for i in range(n - 9)] + [(2, n, [])], "doc_id long, item int, words array<string>")
    found = removed_items(items, spark.createDataFrame([(1, 2), (2, 3)], "old long, new long"))
    assert "explode(words" not in found._jdf.queryExecution().optimizedPlan().toString()
    r = found.collect()
    assert len(r) == 1 and tuple(r[0])[:7] == (1, 2, 9, 1, n - 9, n, n - 8) and abs(r[0].score - 9 * (9 + (n - 9) * 2 / 3) / n) < 1e-9
    assert "regexp_replace" not in registry.QUERIES["c16_t18_removed_risks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_counts_copy_keys_not_rows(spark):
    from hypolith.plans import registry

    plan = registry.QUERIES["e30_distinct_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("Expand") :], plan  # keys are made distinct below the copies


def test_legs_sort_once_and_read_prices_once(spark):
    from hypolith.plans import factor_queries as q

    rows = [("2020-01-01", t, v, f) for t, (v, f) in enumerate([(3.0, 1.0), (3.0, 2.0), (1.0, 4.0), (1.0, 8.0), (2.0, 16.0), (None, 32.0), (9.0, None)])]
    legs = q.factor_legs(spark.createDataFrame(rows, "date string, ticker int, v double, fwd double"), ("v",), 0.5)
    assert [tuple(r) for r in legs.collect()] == [("v", "2020-01-01", (1 + 2) / 2 - (4 + 8 + 16) / 3)]  # the third from above earns nothing yet
    plan = q.factor_legs(q.panel(spark, "/root/testdata/sf0.001"), q.LEGS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") and plan.count("Relation [l_orderkey") <= 3  # prices, and fundamentals twice: themselves and their spread


def test_power_is_searched_once_for_each_number_of_rows(spark):
    """However many tickers have it; and required rows where the guess by normal quantiles is off are those of the search."""
    from hypolith.functions.distributions import SPARK
    from hypolith.plans.inference_queries import _powers

    rows = [(i, 4 + i % 3, d) for i, d in enumerate((0.0, 1e-7, 0.0101, 0.03, 0.1132, 0.2, 0.31, 0.5, 0.77, 1.1, 1.6, 2.9, 8.0))]
    df = spark.createDataFrame(rows, "ticker int, n long, d double")
    found = _powers(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    searched = next(i for i, x in enumerate(plan) if "aggregate(" in x and "AS detectable" in x and "AS c" in x)
    assert "Aggregate [n" in "".join(plan[searched + 1 : searched + 3]), plan
    alone = df.selectExpr("ticker", f"round({SPARK.power('d', 'n')}, 5) AS power", f"round({SPARK.detectable('n')}, 5) AS detectable")
    held = {r.ticker: r for r in alone.collect()}
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        d = rows[r.ticker][2]
        assert (r.power, r.detectable) == (held[r.ticker].power, held[r.ticker].detectable)
        assert r.required_n == (special.required_n(d) if d > 0.01 else None)
