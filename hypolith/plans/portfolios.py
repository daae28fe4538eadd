"""Queries of top-k selection, factors, costs, sizes and back-tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hypolith.functions import costs as C
from hypolith.operators import factors as X
from hypolith.operators import joins as J
from hypolith.operators import portfolio as P
from hypolith.operators.walk_forward import walk_forward
from hypolith.plans.joins_and_dates import forward_sql
from hypolith.plans.registry import query
from hypolith.sources import tables as T

R = lambda c, n=6: F.round(c, n)
rounded = lambda df, *names: df.withColumns({c: F.round(c, 6) for c in names})


def top_sql(table: str, value: str, q: float, order: str = "DESC") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {value} {order}, ticker) AS rn, count({value}) OVER (PARTITION BY date) AS cnt FROM {table} WHERE {value} IS NOT NULL) WHERE rn <= greatest(1, floor(cnt * {q}))"


REV = "rev AS (SELECT ticker, date, -(close / nullif(lag(close, 5) OVER (PARTITION BY ticker ORDER BY date), 0) - 1) AS signal FROM px)"


def reversal(spark, sf):
    """(ticker, date, signal): minus the change over five rows."""
    w = Window.partitionBy("ticker").orderBy("date")
    return T.prices(spark, sf).select("ticker", "date", (1 - F.try_divide("close", F.lag("close", 5).over(w))).alias("signal"))


COHORT = f"pick AS (SELECT date AS signal_date, ticker, 1 AS side FROM ({top_sql('rev', 'signal', 0.2)}) WHERE dayofweek(date) = 5)"


@query("p10_weekly_reversal_backtest", f"WITH {REV}, {COHORT}, {forward_sql('px', 'pick', 5, False)} SELECT signal_date AS rebalance_date, count(*) AS n_names, round(avg(exit_price / entry_price - 1), 6) AS cohort_return FROM fwd GROUP BY 1", "px")
def p10(spark, sf):
    return rounded(P.cohorts(reversal(spark, sf), T.prices(spark, sf), 5), "cohort_return")


LS = f"pick AS (SELECT date AS signal_date, ticker, 1 AS side FROM ({top_sql('rev', 'signal', 0.2)}) UNION ALL SELECT date, ticker, -1 FROM ({top_sql('rev', 'signal', 0.2, 'ASC')}))"


@query("p10_daily_long_short", f"WITH {REV}, {LS}, p2 AS (SELECT signal_date, ticker, max(side) AS side FROM pick GROUP BY 1, 2), {forward_sql('px', 'p2', 5, False)} SELECT f.signal_date AS rebalance_date, count(*) AS n_names, round(avg(side * (exit_price / entry_price - 1)), 6) AS cohort_return FROM fwd f JOIN p2 USING (signal_date, ticker) GROUP BY 1", "px")
def p10_ls(spark, sf):
    return rounded(P.cohorts(reversal(spark, sf), T.prices(spark, sf), 5, "daily", long_only=False), "cohort_return")


SUMMARY = "SELECT count(*) AS n, round(ln(product(1 + ret)), 6) AS log_return, round(greatest(0.01, (max(date) - min(date)) / 365.25), 6) AS years, round(stddev_samp(ret) * sqrt(12), 6) AS volatility, round(avg(ret), 6) AS mean, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(pow(product(1 + ret), 1 / greatest(0.01, (max(date) - min(date)) / 365.25)) - 1, 6) AS annual_return, round(avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)), 6) AS sharpe FROM mr"


@query("e5_backtest_summary", SUMMARY, "mr")
def e5(spark, sf):
    s = P.summary(T.monthly_returns(spark, sf), 21).withColumn("total_return", F.log(1 + F.col("total_return"))).withColumnRenamed("total_return", "log_return")
    return rounded(s, "log_return", "years", "volatility", "mean", "hit_rate", "annual_return", "sharpe")


@query("e7_portfolio_return_by_date", f"WITH pt AS (SELECT ticker, date AS signal_date FROM px), {forward_sql('px', 'pt', 5, True)} SELECT signal_date, count(*) AS n, round(avg(exit_price / entry_price - 1), 6) AS ret FROM fwd GROUP BY 1", "px")
def e7(spark, sf):
    p = T.prices(spark, sf)
    f = J.with_return(J.forward_prices(p.select("ticker", F.col("date").alias("signal_date")), p, 5, True))
    return f.groupBy("signal_date").agg(F.count("*").alias("n"), R(F.avg("forward_return")).alias("ret"))


@query("h1_top_quantile", f"SELECT date, ticker, round(signal, 6) AS signal FROM ({top_sql('sig', 'signal', 0.2)})", "sig")
def h1(spark, sf):
    return rounded(T.signals(spark, sf).withColumn("k", P.top(["date"], "signal", 0.2)).filter("k").select("date", "ticker", "signal"), "signal")


@query("h2_bottom_quantile", f"SELECT date, ticker, round(signal, 6) AS signal FROM ({top_sql('sig', 'signal', 0.2, 'ASC')})", "sig")
def h2(spark, sf):
    return rounded(T.signals(spark, sf).withColumn("k", P.top(["date"], "signal", 0.2, lowest=True)).filter("k").select("date", "ticker", "signal"), "signal")


@query("h4_max_positions", "SELECT date, ticker FROM sig QUALIFY row_number() OVER (PARTITION BY date ORDER BY signal DESC, ticker) <= 3", "sig")
def h4(spark, sf):
    return T.signals(spark, sf).withColumn("k", P.top_n(["date"], "signal", 3)).filter("k").select("date", "ticker")


@query("h5_feasible_limit", "SELECT c_custkey AS ticker FROM customer ORDER BY c_custkey LIMIT (SELECT CAST(greatest(50, least(3000, floor(7200 / (count(*) / count(DISTINCT o_custkey) * 1.8)))) AS BIGINT) FROM orders)")
def h5(spark, sf):
    """As many tickers as a budget of 7,200 s allows at 1.8 s a filing, 50 to 3,000."""
    per = T.table(spark, sf, "orders").agg(F.greatest(F.lit(50), F.least(F.lit(3000), F.floor(7200 / (F.count("*") / F.count_distinct("o_custkey") * 1.8)))).alias("n")).first()["n"]
    return T.table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker")).orderBy("ticker").limit(int(per))


@query("h6_row_limit", "SELECT doc_id FROM (SELECT doc_id, length(text) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 100)")
def h6(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.char_length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(100).select("doc_id")


@query("h9_sorted_tickers", "SELECT c_name, c_custkey AS ticker FROM customer ORDER BY c_name, c_custkey")
def h9(spark, sf):
    """All tickers in order; ranges of names are sorted in tasks of their own."""
    return T.table(spark, sf, "customer").orderBy("c_name", "c_custkey").select("c_name", F.col("c_custkey").alias("ticker"))


FACTORS = {
    "f1_period_return": ("close / nullif(lag(close) OVER w, 0) - 1", X.period_return),
    "f8_momentum": ("lag(close, 21) OVER w / nullif(lag(close, 252) OVER w, 0) - 1", X.momentum),
    "f9_reversal": ("-(close / nullif(lag(close, 21) OVER w, 0) - 1)", X.reversal),
}
for _name, (_sql, _f) in FACTORS.items():
    query(_name, f"SELECT ticker, date, round({_sql}, 6) AS value FROM lp WINDOW w AS (PARTITION BY ticker ORDER BY date)", "lp")(lambda spark, sf, f=_f: rounded(f(T.long_prices(spark, sf)), "value"))

RET = "r AS (SELECT ticker, date, close, volume, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM lp)"


@query("f10_amihud", f"WITH {RET} SELECT ticker, date, round(CASE WHEN count(ret) OVER w = 21 THEN avg(abs(ret) / greatest(close * volume, 1)) OVER w END * 1e6, 6) AS value FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)", "lp")
def f10(spark, sf):
    return X.amihud(T.long_prices(spark, sf)).withColumn("value", R(F.col("value") * 1e6))


@query("f11_low_volatility", f"WITH {RET} SELECT ticker, date, round(CASE WHEN count(ret) OVER w = 252 THEN -stddev_samp(ret) OVER w END, 6) AS value FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)", "lp")
def f11(spark, sf):
    return rounded(X.low_volatility(T.long_prices(spark, sf)), "value")


@query("f12_sector_neutral", "SELECT s_suppkey AS ticker, s_nationkey AS sector, round(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS value FROM supplier")
def f12(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("sector"), F.col("s_acctbal").alias("value"))
    return s.withColumn("value", R(X.demeaned(F.col("value"), ["sector"])))


@query("f13_row_zscore", "SELECT date, ticker, round((signal - avg(signal) OVER w) / coalesce(nullif(stddev_samp(signal) OVER w, 0), 1), 6) AS z FROM sig WINDOW w AS (PARTITION BY date)", "sig")
def f13(spark, sf):
    return T.signals(spark, sf).select("date", "ticker", R(X.zscore(F.col("signal"), ["date"])).alias("z"))


@query("f16_monthly_dates", "SELECT max(date) AS date FROM lp GROUP BY date_trunc('month', date)", "lp")
def f16(spark, sf):
    return P.rebalance_dates(T.long_prices(spark, sf), "monthly")


@query("f17_latest_row", "SELECT ticker, max(date) AS date, round(max_by(close, date), 6) AS close FROM lp GROUP BY 1", "lp")
def f17(spark, sf):
    return T.long_prices(spark, sf).groupBy("ticker").agg(F.max("date").alias("date"), R(F.max_by("close", "date")).alias("close"))


def legs_sql(signal: str) -> str:
    return f"s AS (SELECT ticker, date, {signal} AS v, lead(close) OVER w / nullif(close, 0) - 1 AS fwd FROM lp WINDOW w AS (PARTITION BY ticker ORDER BY date)), hi AS (SELECT date, avg(fwd) AS up FROM ({top_sql('s', 'v', 0.3)}) WHERE fwd IS NOT NULL GROUP BY 1), lo AS (SELECT date, avg(fwd) AS down FROM ({top_sql('s', 'v', 0.3, 'ASC')}) x WHERE fwd IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({top_sql('s', 'v', 0.3)}) y WHERE y.date = x.date AND y.ticker = x.ticker) GROUP BY 1) SELECT date, round(up - down, 6) AS ret FROM hi JOIN lo USING (date)"


def _factor(spark, sf, signal):
    p = T.long_prices(spark, sf)
    w = Window.partitionBy("ticker").orderBy("date")
    fwd = p.select("ticker", "date", (F.try_divide(F.lead("close").over(w), "close") - 1).alias("fwd"))
    return rounded(P.leg_returns(P.legs(signal(p), "value"), fwd), "ret")


query("h3_momentum_factor", f"WITH {legs_sql('lag(close, 21) OVER w / nullif(lag(close, 252) OVER w, 0) - 1')}", "lp")(lambda spark, sf: _factor(spark, sf, X.momentum))
query("h3_reversal_factor", f"WITH {legs_sql('-(close / nullif(lag(close, 21) OVER w, 0) - 1)')}", "lp")(lambda spark, sf: _factor(spark, sf, X.reversal))


@query("size_value_signals", "SELECT c_custkey AS ticker, round(-ln(greatest(c_acctbal, 1e6)), 6) AS size, round(n.n / nullif(c_acctbal, 0), 6) AS value FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS n FROM orders GROUP BY 1) n ON o_custkey = c_custkey")
def size_value(spark, sf):
    book = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("n"))
    c = T.table(spark, sf, "customer").join(book, "c_custkey")
    return c.select(F.col("c_custkey").alias("ticker"), R(-F.log(F.greatest("c_acctbal", F.lit(1e6)))).alias("size"), R(F.col("n") / F.nullif("c_acctbal", F.lit(0.0))).alias("value"))


TR = "tr AS (SELECT o_orderkey, c_acctbal * 1e7 AS cap, o_totalprice AS price, CAST(o_orderkey % 500 AS DOUBLE) AS shares, o_totalprice * 1000 AS adv, o_orderkey % 2 = 0 AS short, CAST(o_orderkey % 60 AS DOUBLE) AS si FROM orders JOIN customer ON c_custkey = o_custkey)"
SPREAD = "CASE WHEN cap IS NULL OR cap <= 0 THEN 200.0 ELSE 2 * greatest(2.0, 200 * exp(-0.55 * log10(greatest(cap / 1e6, 1.0)))) END"
SLIP = "CASE WHEN adv IS NULL OR adv <= 0 THEN 100.0 ELSE greatest(1.0, (CASE WHEN shares * price / adv * 100 <= 1 THEN 2.0 WHEN shares * price / adv * 100 <= 5 THEN 5.0 ELSE 25.0 END) * (shares * price / adv * 100) * greatest(1.0, 3 - 0.3 * log10(greatest(cap, 1e6)))) END"
BORROW = "(CASE WHEN cap >= 200e9 THEN 0.0025 WHEN cap >= 2e9 THEN 0.01 WHEN si > 30 THEN 0.5 ELSE 0.05 END) / 252"


def _trades(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") * 1e7).alias("cap"))
    o = T.table(spark, sf, "orders").join(c, "o_custkey")
    return o.select("o_orderkey", "cap", F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 500).cast("double").alias("shares"), (F.col("o_totalprice") * 1000).alias("adv"), (F.col("o_orderkey") % 2 == 0).alias("short"), (F.col("o_orderkey") % 60).cast("double").alias("si"))


@query("p1_p3_cost_rates", f"WITH {TR} SELECT o_orderkey, round({SPREAD}, 6) AS spread, round({SLIP}, 6) AS slippage, round({BORROW}, 9) AS borrow FROM tr")
def p1(spark, sf):
    v = F.col("shares") * F.col("price")
    return _trades(spark, sf).select("o_orderkey", R(C.spread_bps(F.col("cap"))).alias("spread"), R(C.slippage_bps(v, F.col("adv"), F.col("cap"))).alias("slippage"), R(C.borrow_rate_daily(F.col("cap"), F.col("si")), 9).alias("borrow"))


COST = f"c AS (SELECT o_orderkey, shares * price AS v, least(greatest(0.005 * shares, 0.35), 0.01 * shares * price) AS commission, shares * price * ({SPREAD}) / 1e4 / 2 AS spread, shares * price * ({SLIP}) / 1e4 AS slippage, CASE WHEN short THEN shares * price * ({BORROW}) * 5 ELSE 0.0 END AS borrow FROM tr)"


PARTS = ("commission", "spread", "slippage", "borrow")


@query("p4_trade_cost", f"WITH {TR}, {COST} SELECT o_orderkey, {', '.join(f'round({n} / nullif(v, 0) * 1e4, 4) AS {n}' for n in PARTS)}, round(CASE WHEN v > 0 THEN (commission + spread + slippage + borrow) / v * 1e4 END, 4) AS bps FROM c")
def p4(spark, sf):
    """Each part of a trade's cost in basis points of its value."""
    value = F.nullif(F.col("shares") * F.col("price"), F.lit(0.0))
    return _cost(spark, sf).select("o_orderkey", *(R(F.col(f"c.{n}") / value * 1e4, 4).alias(n) for n in PARTS), R("c.bps", 4).alias("bps"))


def _cost(spark, sf):
    return _trades(spark, sf).withColumn("c", C.trade_cost(*(F.col(x) for x in ("shares", "price", "adv", "cap", "short")), 5, F.col("si")))


@query("e6_cost_by_group", f"WITH {TR}, {COST} SELECT coalesce(CAST(o_orderkey % 7 AS VARCHAR), 'all') AS grp, round(sum(commission), 2) AS commission, round(sum(spread), 2) AS spread, round(sum(commission + spread + slippage + borrow), 2) AS total FROM c GROUP BY ROLLUP (o_orderkey % 7)")
def e6(spark, sf):
    c = _cost(spark, sf).withColumn("g", (F.col("o_orderkey") % 7).cast("string")).rollup("g")
    return c.agg(*(F.round(F.sum(f"c.{n}"), 2).alias(n) for n in ("commission", "spread", "total"))).select(F.coalesce("g", F.lit("all")).alias("grp"), "commission", "spread", "total")


POS = "pos AS (SELECT date, ticker, signal, vol, adv, price, sector FROM (SELECT date, ticker, signal, 0.02 + (ticker % 7) * 0.03 AS vol, 500.0 * (1 + ticker % 11) AS adv, 20.0 + ticker % 90 AS price, ticker % 4 AS sector FROM sig) QUALIFY row_number() OVER (PARTITION BY date ORDER BY signal DESC, ticker) <= 50)"


def _positions(spark, sf):
    s = T.signals(spark, sf).withColumn("k", P.top_n(["date"], "signal", 50)).filter("k").drop("k")
    return s.withColumns({"vol": 0.02 + (F.col("ticker") % 7) * 0.03, "adv": 500.0 * (1 + F.col("ticker") % 11), "price": 20.0 + F.col("ticker") % 90, "sector": F.col("ticker") % 4})


@query("p5_p8_sizing", f"WITH {POS} SELECT date, ticker, round(1.0 / least(count(*) OVER w, 50), 6) AS equal_weight, round(abs(signal) / nullif(sum(abs(signal)) OVER w, 0) * 0.05, 6) AS proportional, round(least((1 / greatest(vol, 0.05)) / sum(1 / greatest(vol, 0.05)) OVER w, 0.05), 6) AS risk_parity, round(least(abs(0.25 * signal / (vol * vol)) / nullif(sum(abs(0.25 * signal / (vol * vol))) OVER w, 0), 0.05), 6) AS kelly FROM pos WINDOW w AS (PARTITION BY date)", "sig")
def p5(spark, sf):
    by = ["date"]
    return _positions(spark, sf).select("date", "ticker", R(C.equal_weight(by)).alias("equal_weight"), R(C.proportional_weight(F.col("signal"), by)).alias("proportional"), R(C.risk_parity_weight(F.col("vol"), by)).alias("risk_parity"), R(C.kelly_weight(F.col("signal"), F.col("vol"), by)).alias("kelly"))


@query("p9_constraints", f"WITH {POS}, w1 AS (SELECT *, least(1.0 / least(count(*) OVER (PARTITION BY date), 50), 0.05, 0.05 * adv * price / 1e6) AS w FROM pos), w2 AS (SELECT *, w * least(1.0, 0.3 / nullif(sum(w) OVER (PARTITION BY date, sector), 0)) AS weight FROM w1) SELECT date, ticker, sector, round(weight, 6) AS weight, CAST(floor(1e6 * weight / price) AS BIGINT) AS shares FROM w2", "sig")
def p9(spark, sf):
    df = C.constrained(_positions(spark, sf).withColumn("weight", C.equal_weight(["date"])), 1e6, ["date"])
    return df.select("date", "ticker", "sector", R("weight").alias("weight"), "shares")


EVENTS = "pt AS (SELECT ticker, date AS signal_date FROM px)"


@query("p11_event_study", f"WITH {EVENTS}, {forward_sql('px', 'pt', 5, False)}, r AS (SELECT ticker, signal_date, exit_price / entry_price - 1 AS ret FROM fwd), x AS (SELECT *, ret - (sum(ret) OVER w - ret) / nullif(count(*) OVER w - 1, 0) AS excess FROM r WINDOW w AS (PARTITION BY signal_date)) SELECT signal_date, count(excess) AS n, round(avg(excess), 6) AS mean_excess, round(avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(2 * (50.0 * 100 * {SPREAD.replace('cap', '1e10')} / 1e4 / 2), 6) AS spread_cost FROM x GROUP BY 1", "px")
def p11(spark, sf):
    """Excess of each event over the mean of the other names of its window; entry and exit costs at the fixed price of 50."""
    p = T.prices(spark, sf)
    r = J.with_return(J.forward_prices(p.select("ticker", F.col("date").alias("signal_date")), p, 5, False))
    x = r.withColumn("excess", F.col("forward_return") - J.others_mean(r, "forward_return", ["signal_date"]))
    cost = 2 * (50.0 * 100 * C.spread_bps(F.lit(1e10)) / 1e4 / 2)
    return x.groupBy("signal_date").agg(F.count("excess").alias("n"), R(F.avg("excess")).alias("mean_excess"), R(F.avg(F.when(F.col("excess") > 0, 1.0).otherwise(0.0))).alias("hit_rate")).withColumn("spread_cost", R(cost))


WF = "wf AS (SELECT p.ticker, p.date, signal, price, adv, cap, sector FROM (SELECT ticker, date, 1 - close / nullif(lag(close, 21) OVER (PARTITION BY ticker ORDER BY date), 0) AS signal, close AS price, volume * 100 AS adv, ticker % 4 AS sector FROM lp) p JOIN (SELECT s_suppkey AS ticker, (abs(s_acctbal) + 1000) * 1e6 AS cap FROM supplier) USING (ticker) WHERE signal IS NOT NULL)"
WALK = (
    "sp AS (SELECT min(date) AS lo, max(date) AS hi, count(DISTINCT date) AS nd FROM wf), wi AS (SELECT CAST(k AS INTEGER) AS win, CAST(lo + CAST(k * 365 + 1095 AS INTEGER) AS DATE) AS test_start, CAST(lo + CAST(k * 365 + 1460 AS INTEGER) AS DATE) AS test_end FROM sp, range(0, 10000) r(k) WHERE nd >= 252 AND k * 365 + 1460 <= hi - lo), "
    "dt AS (SELECT d.date, wi.* FROM (SELECT max(date) AS date FROM wf GROUP BY date_trunc('month', date)) d JOIN wi ON d.date > test_start AND d.date <= test_end), "
    "ok AS (SELECT win FROM (SELECT win, min(k) OVER (ORDER BY win) AS least FROM (SELECT wi.win, count(dt.date) AS k FROM wi LEFT JOIN dt USING (win) GROUP BY 1)) WHERE least >= 10), "
    f"tp AS (SELECT * FROM ({top_sql('wf', 'signal', 0.2)}) WHERE date IN (SELECT date FROM dt) AND price > 0), w1 AS (SELECT *, least(1.0 / least(count(*) OVER (PARTITION BY date), 50), 0.05, 0.05 * adv * price / 1e6) AS w FROM tp), "
    "w2 AS (SELECT *, w * least(1.0, 0.3 / nullif(sum(w) OVER (PARTITION BY date, sector), 0)) AS weight FROM w1), pt AS (SELECT ticker, date AS signal_date, cap, price, adv * price AS adv, weight, CAST(floor(1e6 * weight / price) AS DOUBLE) AS shares FROM w2), "
    f"co AS (SELECT *, least(greatest(0.005 * shares, 0.35), 0.01 * shares * price) + shares * price * ({SPREAD}) / 1e4 / 2 + shares * price * ({SLIP}) / 1e4 AS cost FROM pt)"
)


@query("p12_walk_forward", f"WITH {WF}, {WALK}, {forward_sql('lp', 'pt', 21, False)}, ch AS (SELECT signal_date AS date, count(*) AS trades, sum(weight * (exit_price / entry_price - 1)) / nullif(sum(weight), 0) AS gross, coalesce(sum(cost) / nullif(sum(shares * price), 0), 0) * 1e4 AS cost_bps FROM fwd JOIN co USING (ticker, signal_date) GROUP BY 1), n AS (SELECT *, gross - cost_bps / 1e4 AS net FROM ch WHERE gross IS NOT NULL) SELECT win AS window, test_start, test_end, count(*) AS cohorts, CAST(sum(trades) AS BIGINT) AS trades, round(avg(gross), 6) AS gross, round(avg(cost_bps), 4) AS cost_bps, round(avg(net), 6) AS net, round(avg(net) * 12 / nullif(stddev_samp(net) * sqrt(12), 0), 5) AS net_sharpe, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(min(net), 6) AS worst FROM dt JOIN ok USING (win) JOIN n USING (date) GROUP BY 1, 2, 3", "lp")
def p12(spark, sf):
    """Test years after three years of training, as many as the data's span holds: each month's cohort with its costs, by window."""
    cap = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"), ((F.abs("s_acctbal") + 1000) * 1e6).alias("cap"))
    p = T.long_prices(spark, sf)
    w = Window.partitionBy("ticker").orderBy("date")
    s = p.select("ticker", "date", (1 - F.try_divide("close", F.lag("close", 21).over(w))).alias("signal"), F.col("close").alias("price"), (F.col("volume") * 100).alias("adv"), (F.col("ticker") % 4).alias("sector")).join(cap, "ticker")
    out = walk_forward(s, p, 21, train=1095, test=365)
    return out.withColumns({c: R(c) for c in ("gross", "net", "hit_rate", "worst")} | {"cost_bps": R("cost_bps", 4), "net_sharpe": R("net_sharpe", 5)})
