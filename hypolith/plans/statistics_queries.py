"""Queries of statistics over return series and trials."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hypolith.operators import statistics as S
from hypolith.operators.resampling import draw
from hypolith.plans.registry import query
from hypolith.sources import tables as T

R = lambda c, n=6: F.round(c, n)


def rounded(df, keep=()):
    return df.select(*(R(c).alias(c) if k == "double" and c not in keep else F.col(c) for c, k in df.dtypes))


ACF = "acf AS (SELECT " + ", ".join(f"corr(ret, l{k}) AS acf_{k}" for k in (1, 5, 21)) + " FROM (SELECT ret, " + ", ".join(f"lag(ret, {k}) OVER (ORDER BY date) AS l{k}" for k in (1, 5, 21)) + " FROM mr))"


@query("e1_distribution", f"WITH {ACF}, m AS (SELECT avg(ret) AS a FROM mr), c AS (SELECT avg((ret - a) ** 2) AS m2, avg((ret - a) ** 3) AS m3, avg((ret - a) ** 4) AS m4 FROM mr, m) SELECT count(ret) AS n, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median, round(stddev_samp(ret), 6) AS std, round(min(ret), 6) AS min, round(max(ret), 6) AS max, round(skewness(ret), 6) AS skew, round(kurtosis(ret), 6) AS kurtosis, round(count(ret) / 6 * (any_value(m3) ** 2 / any_value(m2) ** 3 + (any_value(m4) / any_value(m2) ** 2 - 3) ** 2 / 4), 6) AS jarque_bera, {', '.join(f'round(quantile_cont(ret, {p / 100}), 6) AS p{p}' for p in S.PERCENTILES)}, {', '.join(f'round(any_value(acf_{k}), 6) AS acf_{k}' for k in (1, 5, 21))} FROM mr, c, acf", "mr")
def e1(spark, sf):
    return rounded(S.distribution(T.monthly_returns(spark, sf)))


@query("e2_autocorrelation", f"WITH {ACF} SELECT round(acf_1, 6) AS acf_1, round(acf_5, 6) AS acf_5, round(acf_21, 6) AS acf_21 FROM acf", "mr")
def e2(spark, sf):
    return rounded(S.autocorrelation(T.monthly_returns(spark, sf)))


EQ = "eq AS (SELECT *, CASE WHEN max(cum) OVER (ORDER BY date) > 0 THEN cum / max(cum) OVER (ORDER BY date) - 1 ELSE -1 END AS drawdown, max(cum) OVER (ORDER BY date) AS peak FROM (SELECT date, ret, CASE WHEN max(ret <= -1) OVER (ORDER BY date) THEN 0 ELSE exp(sum(ln(CASE WHEN ret > -1 THEN 1 + ret ELSE 1 END)) OVER (ORDER BY date)) END AS cum FROM mr))"
SPELL = "sp AS (SELECT date, under, lead(date) OVER (ORDER BY date) AS e FROM (SELECT date, drawdown < 0 AS under, coalesce(lag(drawdown < 0) OVER (ORDER BY date), false) <> (drawdown < 0) AS turn FROM eq) WHERE turn), dd AS (SELECT coalesce(max(coalesce(e, (SELECT max(date) FROM mr)) - date), 0) AS max_days FROM sp WHERE under)"


@query("f2_f3_equity_and_drawdown", f"WITH {EQ} SELECT date, round(ln(cum), 6) AS log_cum, round(drawdown, 6) AS drawdown FROM eq", "mr")
def f2(spark, sf):
    return S.equity(T.monthly_returns(spark, sf)).select("date", R(F.log("cum")).alias("log_cum"), R("drawdown").alias("drawdown"))


@query("f4_drawdown_duration", f"WITH {EQ}, {SPELL} SELECT max_days FROM dd", "mr")
def f4(spark, sf):
    return S.drawdown_days(S.equity(T.monthly_returns(spark, sf)))


@query("e3_e4_performance", f"WITH {EQ}, {SPELL}, a AS (SELECT avg(ret) * 12 AS ann_return, stddev_samp(ret) * sqrt(12) AS ann_vol, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS ds, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(CASE WHEN ret > 0 THEN ret END) / nullif(-sum(CASE WHEN ret < 0 THEN ret END), 0) AS profit_factor, quantile_cont(ret, 0.95) / abs(quantile_cont(ret, 0.05)) AS tail_ratio FROM mr), w AS (SELECT min(drawdown) AS max_drawdown, avg(drawdown) AS avg_drawdown FROM eq) SELECT round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol, round(hit_rate, 6) AS hit_rate, round(profit_factor, 6) AS profit_factor, round(profit_factor, 6) AS omega, round(tail_ratio, 6) AS tail_ratio, round(max_drawdown, 6) AS max_drawdown, round(avg_drawdown, 6) AS avg_drawdown, max_days, round(ann_return / nullif(ann_vol, 0), 6) AS sharpe, round(ann_return / nullif(ds * sqrt(12), 0), 6) AS sortino, round(ann_return / nullif(abs(max_drawdown), 0), 6) AS calmar FROM a, w, dd", "mr")
def e3(spark, sf):
    return rounded(S.performance(T.monthly_returns(spark, sf)))


@query("e11_e13_gt_score", f"WITH {EQ}, c AS (SELECT least(1, greatest(0, regr_r2(cum, i))) AS r_squared FROM (SELECT cum, row_number() OVER (ORDER BY date) - 1 AS i FROM eq)), a AS (SELECT count(*) AS n, avg(ret) AS mean, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS t, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit, CASE WHEN count_if(ret < 0) >= 2 THEN sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252) ELSE 0 END AS downside FROM mr) SELECT n, round(mean, 6) AS mean, round(t, 6) AS t, round(hit, 6) AS hit, round(downside, 6) AS downside, round(r_squared, 6) AS r_squared, round(mean * 1e4 * ln(abs(t)) * CASE WHEN downside > 0 THEN least(hit / downside, 1e4) ELSE 1e4 END * r_squared, 4) AS gt_score FROM a, c", "mr")
def e13(spark, sf):
    return rounded(S.gt_score(T.monthly_returns(spark, sf)), keep=("gt_score",)).withColumn("gt_score", R("gt_score", 4))


@query("e8_e9_lag_statistics", "WITH k AS (SELECT ticker, date, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS lag_days FROM sig) SELECT ticker, round(avg(lag_days), 6) AS mean, round(median(lag_days), 6) AS median, round(quantile_cont(lag_days, 0.05), 6) AS p5, round(quantile_cont(lag_days, 0.25), 6) AS p25, round(quantile_cont(lag_days, 0.75), 6) AS p75, round(quantile_cont(lag_days, 0.95), 6) AS p95, min(lag_days) AS min, max(lag_days) AS max, count(*) AS n, count_if(lag_days IS NULL) AS missing, CASE WHEN avg(lag_days) > 90 THEN 'very stale' WHEN avg(lag_days) > 30 THEN 'stale' ELSE 'fresh' END AS flag FROM k GROUP BY 1", "sig")
def e8(spark, sf):
    k = T.signals(spark, sf).withColumn("lag_days", F.datediff("date", F.lag("date").over(Window.partitionBy("ticker").orderBy("date"))))
    q = lambda p: F.percentile("lag_days", F.lit(p / 100)).alias(f"p{p}")
    flag = F.when(F.avg("lag_days") > 90, "very stale").when(F.avg("lag_days") > 30, "stale").otherwise("fresh")
    return rounded(k.groupBy("ticker").agg(F.avg("lag_days").alias("mean"), F.percentile("lag_days", F.lit(0.5)).alias("median"), q(5), q(25), q(75), q(95), F.min("lag_days").alias("min"), F.max("lag_days").alias("max"), F.count("*").alias("n"), F.count_if(F.col("lag_days").isNull()).alias("missing"), flag.alias("flag")))


@query("e10_alignment_report", "WITH k AS (SELECT ticker, date, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS lag_days FROM sig) SELECT count_if(lag_days < 0) AS breaches, round(avg(lag_days), 6) AS mean_lag, count_if(lag_days > 90) AS stale_rows, count_if(lag_days < 0) = 0 AS is_valid FROM k", "sig")
def e10(spark, sf):
    k = T.signals(spark, sf).select(F.datediff("date", F.lag("date").over(Window.partitionBy("ticker").orderBy("date"))).alias("lag_days"))
    bad = F.count_if(F.col("lag_days") < 0)
    return k.agg(bad.alias("breaches"), R(F.avg("lag_days")).alias("mean_lag"), F.count_if(F.col("lag_days") > 90).alias("stale_rows"), (bad == 0).alias("is_valid"))


REGIME = "g AS (SELECT date, ret, month(date) <= 6 AS first_half, year(date) < 1998 AS early, month(date) IN (12, 1, 2) AS winter FROM mr)"
T2 = "(avg(CASE WHEN {s} THEN ret END) - avg(CASE WHEN NOT {s} THEN ret END)) / sqrt(((count_if({s}) - 1) * var_samp(CASE WHEN {s} THEN ret END) + (count_if(NOT {s}) - 1) * var_samp(CASE WHEN NOT {s} THEN ret END)) / (count(*) - 2) * (1 / count_if({s}) + 1 / count_if(NOT {s})))"
REGIMES = ("first_half", "early", "winter")


@query("e14_regime_performance", f"WITH {REGIME} " + " UNION ALL ".join(f"SELECT '{x}' AS regime, count_if({x}) AS n_on, count_if(NOT {x}) AS n_off, round(avg(CASE WHEN {x} THEN ret END), 6) AS mean_on, round(avg(CASE WHEN NOT {x} THEN ret END), 6) AS mean_off, round({T2.format(s=x)}, 6) AS t FROM g" for x in REGIMES), "mr")
def e14(spark, sf):
    m = T.monthly_returns(spark, sf).withColumns({"first_half": F.month("date") <= 6, "early": F.year("date") < 1998, "winter": F.month("date").isin(12, 1, 2)})
    long = m.unpivot(["ret"], list(REGIMES), "regime", "side")
    side = F.col("side")
    return rounded(long.groupBy("regime").agg(F.count_if(side).alias("n_on"), F.count_if(~side).alias("n_off"), F.avg(F.when(side, F.col("ret"))).alias("mean_on"), F.avg(F.when(~side, F.col("ret"))).alias("mean_off"), S.two_sample_t(F.col("ret"), side).alias("t")))


WF = "b AS (SELECT floor((row_number() OVER (ORDER BY date) - 1) / greatest(20, (SELECT count(*) FROM mr) // 5))::BIGINT AS block, ret, date FROM mr), wf AS (SELECT block, count(*) AS n, avg(ret) * 252 AS alpha, avg(ret) / stddev_samp(ret) AS sharpe, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS t FROM b GROUP BY 1 HAVING count(*) >= 10)"


def _windows(spark, sf):
    m = T.monthly_returns(spark, sf)
    n = F.count("*").over(Window.partitionBy())
    b = m.withColumn("block", F.floor((F.row_number().over(S.BY_DATE()) - 1) / F.greatest(F.lit(20), F.floor(n / 5))))
    return b.groupBy("block").agg(F.count("*").alias("n"), (F.avg("ret") * 252).alias("alpha"), F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe"), F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(F.count("*"))).alias("t")).filter("n >= 10")


@query("e16_window_blocks", f"WITH {WF} SELECT block, n, round(alpha, 6) AS alpha, round(sharpe, 6) AS sharpe, round(t, 6) AS t FROM wf", "mr")
def e16(spark, sf):
    return rounded(_windows(spark, sf))


@query("e15_walk_forward_consistency", f"WITH {WF} SELECT count(*) AS n, round(avg(CASE WHEN alpha > 0 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN alpha > 0 THEN 1.0 ELSE 0.0 END) >= 0.6 AS consistent FROM wf", "mr")
def e15(spark, sf):
    share = F.avg((F.col("alpha") > 0).cast("double"))
    return _windows(spark, sf).agg(F.count("*").alias("n"), R(share).alias("share"), (share >= 0.6).alias("consistent"))


@query("e17_out_of_sample", "SELECT i <= floor(n * 0.7) AS in_sample, count(*) AS n, round(avg(ret), 6) AS mean, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 6) AS t FROM (SELECT ret, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM mr) GROUP BY 1", "mr")
def e17(spark, sf):
    m = T.monthly_returns(spark, sf).select("ret", (F.row_number().over(S.BY_DATE()) <= F.floor(F.count("*").over(Window.partitionBy()) * 0.7)).alias("in_sample"))
    return rounded(m.groupBy("in_sample").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(F.count("*"))).alias("t")))


TRIALS = "tr AS (SELECT CAST(s_suppkey AS VARCHAR) AS key, (s_suppkey * 37 % 101) / 1010.0 AS p, s_acctbal AS effect FROM supplier)"


def _trials(spark, sf):
    return T.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), ((F.col("s_suppkey") * 37 % 101) / 1010.0).alias("p"), F.col("s_acctbal").alias("effect"))


@query("e18_e19_specification_curve", f"WITH {TRIALS} SELECT count(*) AS n, count_if(p < 0.05) AS n05, count_if(p < 0.01) AS n01, count_if(p < 0.001) AS n001, min(effect) AS least, round(median(effect), 6) AS median, max(effect) AS most, round(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) >= 0.5 AS robust, count_if(p < 0.05) BETWEEN 1 AND count(*) * 0.1 AS p_hack FROM tr")
def e18(spark, sf):
    p, n = F.col("p"), F.count("*")
    share = F.avg((p < 0.05).cast("double"))
    return rounded(_trials(spark, sf).agg(n.alias("n"), F.count_if(p < 0.05).alias("n05"), F.count_if(p < 0.01).alias("n01"), F.count_if(p < 0.001).alias("n001"), F.min("effect").alias("least"), F.percentile("effect", F.lit(0.5)).alias("median"), F.max("effect").alias("most"), share.alias("share"), (share >= 0.5).alias("robust"), F.count_if(p < 0.05).between(F.lit(1), n * 0.1).alias("p_hack")))


@query("f21_g13_multiple_testing", f"WITH {TRIALS}, r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, key) AS rk FROM tr) SELECT key, round(p, 6) AS p, rk AS rank, round(least(1, p * n), 6) AS bonferroni, round(least(1, min(p * n / rk) OVER (ORDER BY rk DESC)), 6) AS bh FROM r")
def g13(spark, sf):
    return rounded(S.adjusted(_trials(spark, sf).select("key", "p")).drop("n"))


@query("g14_family_context", f"WITH {TRIALS}, r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, key) AS rk FROM tr), b AS (SELECT key, p, n, rk, least(1, min(p * n / rk) OVER (ORDER BY rk DESC)) AS bh FROM r) SELECT key, rk AS rank, n AS trials, round(0.05 / n, 9) AS alpha, p < 0.05 / n AS passes_bonferroni, bh <= 0.05 AS passes_bh FROM b")
def g14(spark, sf):
    a = S.adjusted(_trials(spark, sf).select("key", "p")).withColumnRenamed("n", "trials")
    return a.select("key", "rank", "trials", R(0.05 / F.col("trials"), 9).alias("alpha"), (F.col("p") < 0.05 / F.col("trials")).alias("passes_bonferroni"), (F.col("bh") <= 0.05).alias("passes_bh"))


@query("e20_rank_auc", "WITH d AS (SELECT lang, n_chars, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), r AS (SELECT lang, pos, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM d) SELECT lang, round((sum(CASE WHEN pos THEN r END) - count_if(pos) * (count_if(pos) + 1) / 2) / nullif(count_if(pos) * count_if(NOT pos), 0), 6) AS auc FROM r GROUP BY 1")
def e20(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(T.table(spark, sf, "labels"), "doc_id")
    return rounded(S.auc(d, "n_chars", F.col("quality") == 1, ["lang"]))


@query("e21_rank_correlation", "WITH r AS (SELECT o_custkey % 10 AS g, rank() OVER (PARTITION BY o_custkey % 10 ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_custkey % 10, o_totalprice) - 1) / 2 AS a, rank() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_custkey % 10, o_orderdate) - 1) / 2 AS b FROM orders) SELECT g, count(*) AS n, round(abs(corr(a, b)), 6) AS spearman FROM r GROUP BY 1")
def e21(spark, sf):
    o = T.table(spark, sf, "orders").withColumn("g", F.col("o_custkey") % 10)
    r = o.select("g", S.mid_rank("o_totalprice", ["g"]).alias("a"), S.mid_rank("o_orderdate", ["g"]).alias("b"))
    return rounded(r.groupBy("g").agg(F.count("*").alias("n"), F.abs(F.corr("a", "b")).alias("spearman")))


@query("e22_e23_survivorship_counts", "WITH u AS (SELECT c_custkey AS ticker, c_custkey % 13 = 0 AS gone FROM customer), c AS (SELECT count(DISTINCT ticker) AS total, count(DISTINCT CASE WHEN gone THEN ticker END) AS delisted FROM u) SELECT total, delisted, total - delisted AS active, round(delisted / total, 6) AS share, CASE WHEN delisted / total < 0.01 THEN 'HIGH' WHEN delisted / total < 0.05 THEN 'MEDIUM' WHEN delisted / total < 0.1 THEN 'LOW' ELSE 'MINIMAL' END AS bias FROM c")
def e22(spark, sf):
    u = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), (F.col("c_custkey") % 13 == 0).alias("gone"))
    c = u.agg(F.count_distinct("ticker").alias("total"), F.count_distinct(F.when(F.col("gone"), F.col("ticker"))).alias("delisted"))
    share = F.col("delisted") / F.col("total")
    return c.select("total", "delisted", (F.col("total") - F.col("delisted")).alias("active"), R(share).alias("share"), F.when(share < 0.01, "HIGH").when(share < 0.05, "MEDIUM").when(share < 0.1, "LOW").otherwise("MINIMAL").alias("bias"))


@query("e24_bias_impact", "WITH q AS (SELECT signal, row_number() OVER (ORDER BY signal DESC, ticker, date) AS hi, row_number() OVER (ORDER BY signal, ticker, date) AS lo, count(*) OVER () AS n FROM sig), s AS (SELECT avg(CASE WHEN hi <= greatest(1, n // 5) THEN signal END) - avg(CASE WHEN lo <= greatest(1, n // 5) THEN signal END) AS spread FROM q), d AS (SELECT sum(0.3) AS lost FROM customer WHERE c_custkey % 13 = 0), t AS (SELECT count(*) AS n FROM customer) SELECT round(spread, 4) AS spread, round(spread * 10 * 252 - lost * 1e4 / n, 2) AS bias_bps FROM s, d, t", "sig")
def e24(spark, sf):
    """The spread of the top and bottom fifth of all signals, by ranks within buckets of values and not by one sort of all rows."""
    q = S.ranked(T.signals(spark, sf), "signal", "ticker").withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    spread = q.agg((F.avg(F.when(F.col("rank") > F.col("n") - F.col("k"), F.col("signal"))) - F.avg(F.when(F.col("rank") <= F.col("k"), F.col("signal")))).alias("spread"))
    c = T.table(spark, sf, "customer").agg((F.count_if(F.col("c_custkey") % 13 == 0) * 0.3).alias("lost"), F.count("*").alias("n"))
    return spread.crossJoin(c).select(R("spread", 4).alias("spread"), R(F.col("spread") * 10 * 252 - F.col("lost") * 1e4 / F.col("n"), 2).alias("bias_bps"))


@query("e25_e27_trial_summary", "SELECT coalesce(o_orderpriority, 'all') AS family, count(*) AS trials, count_if(o_orderstatus = 'O') AS survived, count_if(o_orderstatus = 'F') AS broken, count_if(o_orderstatus = 'P') AS untestable, round(0.05 / count(*), 9) AS alpha, round(100 * count_if(o_orderstatus = 'O') / count(*), 6) AS rate FROM orders GROUP BY ROLLUP (o_orderpriority)")
def e25(spark, sf):
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    o = T.table(spark, sf, "orders").rollup("o_orderpriority").agg(F.count("*").alias("trials"), of("O").alias("survived"), of("F").alias("broken"), of("P").alias("untestable"), R(0.05 / F.count("*"), 9).alias("alpha"), R(100 * of("O") / F.count("*")).alias("rate"))
    return o.withColumn("family", F.coalesce("o_orderpriority", F.lit("all"))).drop("o_orderpriority")


@query("e26_memorisation_probe", "WITH f AS (SELECT date, close AS actual, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS guess FROM lp) SELECT round(avg(CASE WHEN date < DATE '1998-01-01' THEN abs(guess - actual) / nullif(actual, 0) END), 6) AS before, round(avg(CASE WHEN date >= DATE '1998-01-01' THEN abs(guess - actual) / nullif(actual, 0) END), 6) AS after, avg(CASE WHEN date < DATE '1998-01-01' THEN abs(guess - actual) / nullif(actual, 0) END) - avg(CASE WHEN date >= DATE '1998-01-01' THEN abs(guess - actual) / nullif(actual, 0) END) < -0.15 AS flagged FROM f WHERE guess IS NOT NULL", "lp")
def e26(spark, sf):
    f = T.long_prices(spark, sf).withColumn("guess", F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))).filter("guess is not null")
    off = F.try_divide(F.abs(F.col("guess") - F.col("close")), "close")
    a, b = F.avg(F.when(F.col("date") < "1998-01-01", off)), F.avg(F.when(F.col("date") >= "1998-01-01", off))
    return f.agg(R(a).alias("before"), R(b).alias("after"), (a - b < -0.15).alias("flagged"))


@query("e28_composite_score", "WITH s AS (SELECT c_custkey AS key, 0.25 * (c_custkey % 10) + 0.25 * (c_custkey % 9) + 0.15 * (c_custkey % 8) + 0.10 * (c_custkey % 7) + 0.10 * (c_custkey % 6) + 0.15 * (c_custkey % 5) AS score FROM customer) SELECT key, round(score, 6) AS score, rank() OVER (PARTITION BY key % 50 ORDER BY round(score, 6) DESC) AS rank FROM s")
def e28(spark, sf):
    k = F.col("key")
    score = sum(w * (k % m) for w, m in ((0.25, 10), (0.25, 9), (0.15, 8), (0.10, 7), (0.10, 6), (0.15, 5)))
    s = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("key")).withColumn("score", R(score))
    return s.withColumn("rank", F.rank().over(Window.partitionBy(k % 50).orderBy(F.desc("score"))).cast("long"))


@query("e30_distinct_counts", "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def e30(spark, sf):
    """Each group's keys are made distinct before the cube copies them, so that it copies keys and not the table's rows."""
    by = ["l_returnflag", "l_linestatus"]
    keys = F.explode(F.array(F.struct(F.lit(True).alias("s"), F.col("l_suppkey").cast("long").alias("k")), F.struct(F.lit(False).alias("s"), F.col("l_partkey").cast("long").alias("k"))))
    d = T.table(spark, sf, "lineitem").select(*by, keys.alias("x")).select(*by, "x.s", "x.k").distinct()
    return d.cube(*by).agg(F.count_distinct(F.when(F.col("s"), F.col("k"))).alias("suppliers"), F.count_distinct(F.when(~F.col("s"), F.col("k"))).alias("parts"))


@query("f5_f6_regimes", "WITH r AS (SELECT ticker, date, close, CASE WHEN count(close) OVER w200 = 200 THEN avg(close) OVER w200 END AS ma, close - lag(close, 126) OVER w AS change FROM lp WINDOW w AS (PARTITION BY ticker ORDER BY date), w200 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)), m AS (SELECT ticker, median(change) AS mid FROM r GROUP BY 1) SELECT r.ticker, r.date, r.close > r.ma AS bull, round(r.change, 6) AS change, r.change > m.mid AS high FROM r JOIN m USING (ticker)", "lp")
def f5(spark, sf):
    w = Window.partitionBy("ticker").orderBy("date")
    ma = F.when(F.count("close").over(w.rowsBetween(-199, 0)) == 200, F.avg("close").over(w.rowsBetween(-199, 0)))
    r = T.long_prices(spark, sf).select("ticker", "date", "close", ma.alias("ma"), (F.col("close") - F.lag("close", 126).over(w)).alias("change"))
    m = r.groupBy("ticker").agg(F.percentile("change", F.lit(0.5)).alias("mid"))
    return r.join(m, "ticker").select("ticker", "date", (F.col("close") > F.col("ma")).alias("bull"), R("change").alias("change"), (F.col("change") > F.col("mid")).alias("high"))


DR = "dr AS (SELECT date, avg(ret) AS ret FROM (SELECT date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM lp) WHERE ret IS NOT NULL GROUP BY 1)"
ROLL = "roll AS (SELECT date, rn, n, avg(ret) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND 755 FOLLOWING) * 252 AS alpha FROM (SELECT date, ret, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM dr)), pts AS (SELECT date, alpha, row_number() OVER (ORDER BY date) - 1 AS i FROM roll WHERE (rn - 1) % 63 = 0 AND rn - 1 < n - 756)"


def daily_returns(spark, sf):
    p = T.long_prices(spark, sf).withColumn("ret", F.try_divide("close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))) - 1)
    return p.filter("ret is not null").groupBy("date").agg(F.avg("ret").alias("ret"))


def rolling_alpha(series, rows=756, step=63):
    """(date, alpha, i): the mean of each window of rows from a date on, times 252, every `step` rows."""
    w = S.BY_DATE()
    r = series.select("date", (F.avg("ret").over(w.rowsBetween(0, rows - 1)) * 252).alias("alpha"), F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy()).alias("n"))
    r = r.filter(((F.col("rn") - 1) % step == 0) & (F.col("rn") - 1 < F.col("n") - rows))
    return r.select("date", "alpha", (F.row_number().over(w) - 1).alias("i"))


@query("f7_rolling_alpha", f"WITH {DR}, {ROLL} SELECT date, round(alpha, 6) AS alpha FROM pts", "lp")
def f7(spark, sf):
    return rolling_alpha(daily_returns(spark, sf)).select("date", R("alpha").alias("alpha"))


@query("g20_edge_decay", f"WITH {DR}, {ROLL}, l AS (SELECT regr_slope(alpha, i) AS b1, regr_intercept(alpha, i) AS b0 FROM pts) SELECT round(b0, 6) AS intercept, round(b1, 6) AS slope, b1 < 0 AS decaying, round(CASE WHEN b1 < 0 AND b0 > 0 THEN ln(2) * b0 / abs(b1) * 63 END, 4) AS half_life FROM l", "lp")
def g20(spark, sf):
    l = rolling_alpha(daily_returns(spark, sf)).agg(F.regr_slope("alpha", "i").alias("b1"), F.regr_intercept("alpha", "i").alias("b0"))
    return l.select(R("b0").alias("intercept"), R("b1").alias("slope"), (F.col("b1") < 0).alias("decaying"), R(_half_life(), 4).alias("half_life"))


def _half_life():
    return F.when((F.col("b1") < 0) & (F.col("b0") > 0), F.log(F.lit(2.0)) * F.col("b0") / F.abs("b1") * 63)


@query("g20_half_life_interval", f"WITH {DR}, {ROLL}, n AS (SELECT count(*) AS n FROM pts), d AS (SELECT r.range AS rep, ('0x' || substr(md5('42-' || r.range || '-' || k.range), 1, 8))::BIGINT % n AS i FROM n, range(0, 500) r, range(0, 10000) k WHERE k.range < n), l AS (SELECT rep, regr_slope(alpha, pts.i) AS b1, regr_intercept(alpha, pts.i) AS b0 FROM d JOIN pts ON pts.i = d.i GROUP BY 1), h AS (SELECT CASE WHEN b1 < 0 AND b0 > 0 THEN ln(2) * b0 / abs(b1) * 63 END AS h FROM l) SELECT count(h) AS n, round(quantile_cont(h, 0.025), 4) AS low, round(quantile_cont(h, 0.975), 4) AS high FROM h", "lp")
def g20_interval(spark, sf):
    """The half-life over 500 resamples of the rolling points: how many decay, and the middle 95 % of those."""
    pts = rolling_alpha(daily_returns(spark, sf)).select("i", "alpha")
    n = pts.count()  # a point a quarter
    if not n:
        return pts.agg(F.count("*").alias("n"), F.max("alpha").alias("low"), F.max("alpha").alias("high"))
    d = spark.range(500).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select("rep", (draw(42, "rep", "k") % n).alias("i"))
    l = d.join(F.broadcast(pts), "i").groupBy("rep").agg(F.regr_slope("alpha", "i").alias("b1"), F.regr_intercept("alpha", "i").alias("b0"))
    h = l.select(_half_life().alias("h"))
    return h.agg(F.count("h").alias("n"), R(F.percentile("h", F.lit(0.025)), 4).alias("low"), R(F.percentile("h", F.lit(0.975)), 4).alias("high"))


@query("f14_expanding_baseline", "SELECT ticker, date, round(x, 6) AS x, CASE WHEN count(*) OVER w >= 2 THEN round(quantile_cont(x, 0.1) OVER w, 6) END AS p10 FROM (SELECT ticker, date, CAST(signal AS DOUBLE) AS x FROM sig) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "sig")
def f14(spark, sf):
    """Each percentile looks at a ticker's earlier rows, one a date, so its cost is bounded by the calendar."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return T.signals(spark, sf).select("ticker", "date", R("signal").alias("x"), F.when(F.count("*").over(w) >= 2, R(F.percentile("signal", F.lit(0.1)).over(w))).alias("p10"))


@query("f15_document_pairs", "SELECT doc_id, lag(doc_id) OVER w AS previous, length(text) - lag(length(text)) OVER w AS grown FROM fil WHERE length(text) > 500 WINDOW w AS (PARTITION BY ticker ORDER BY date, doc_id)", "fil")
def f15(spark, sf):
    f = T.filings(spark, sf).select("doc_id", "ticker", "date", F.char_length("text").cast("long").alias("n")).filter("n > 500")
    return f.withColumn("p", F.lag(F.struct("doc_id", "n")).over(Window.partitionBy("ticker").orderBy("date", "doc_id"))).select("doc_id", F.col("p.doc_id").alias("previous"), (F.col("n") - F.col("p.n")).alias("grown"))


@query("f18_entity_runs", "WITH e AS (SELECT user_id AS ticker, ts, event_type AS entity, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) <> event_type, true) AS turn FROM events), r AS (SELECT *, sum(CASE WHEN turn THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts) AS run FROM e) SELECT ticker, CAST(run AS BIGINT) AS run, any_value(entity) AS entity, count(*) AS n FROM r GROUP BY 1, 2")
def f18(spark, sf):
    w = Window.partitionBy("ticker").orderBy("ts")
    e = T.table(spark, sf, "events").select(F.col("user_id").alias("ticker"), "ts", F.col("event_type").alias("entity"))
    e = e.withColumn("turn", F.coalesce(F.lag("entity").over(w) != F.col("entity"), F.lit(True)))
    return e.withColumn("run", F.sum(F.col("turn").cast("long")).over(w)).groupBy("ticker", "run").agg(F.any_value("entity").alias("entity"), F.count("*").alias("n"))


BREAK = "k AS (SELECT date, row_number() OVER w - 1 AS i, count(*) OVER () AS n, sum(ret) OVER v AS s, sum(ret * ret) OVER v AS q, sum(ret) OVER () AS sa, sum(ret * ret) OVER () AS qa FROM mr WINDOW w AS (ORDER BY date), v AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), b AS (SELECT date, i, ((sa - s) / (n - i) - s / i) / sqrt((q - s * s / i + (qa - q) - (sa - s) ** 2 / (n - i)) / (n - 2) * (1 / i + 1 / (n - i))) AS t FROM k WHERE i >= 10 AND i < n - 10)"


@query("f19_structural_breaks", f"WITH {BREAK} SELECT date, CAST(i AS INTEGER) AS i, round(t, 6) AS t FROM b", "mr")
def f19(spark, sf):
    return rounded(S.structural_breaks(T.monthly_returns(spark, sf)))


@query("f19_thinned_breaks", f"WITH {BREAK} SELECT CAST(unnest(list_slice(list_reduce(list_transform(list_sort(list(i)), lambda v: [v]), lambda a, v: CASE WHEN v[1] - a[len(a)] > 5 THEN list_concat(a, v) ELSE a END), 1, 5)) AS INTEGER) AS i FROM b WHERE abs(t) > 1", "mr")
def f19_thin(spark, sf):
    return S.thinned(S.structural_breaks(T.monthly_returns(spark, sf)), 1.0)


@query("g15_outliers", "WITH r AS (SELECT ret, row_number() OVER (ORDER BY ret, date) AS i, count(*) OVER () AS n FROM mr), " + ", ".join(f"w{k} AS (SELECT avg(greatest(lo, least(hi, ret))) AS m FROM r, (SELECT min(ret) AS lo, max(ret) AS hi FROM r WHERE i > floor(n * {s}) AND i <= n - floor(n * {s})))" for k, s in ((1, 0.01), (2, 0.025))) + ", " + ", ".join(f"t{k} AS (SELECT avg(ret) AS m FROM r WHERE i > floor(n * {s}) AND i <= n - floor(n * {s}))" for k, s in ((1, 0.05), (2, 0.1))) + ", z AS (SELECT count_if(abs(ret - a) > 3 * s) AS over3, count_if(abs(ret - a) > 5 * s) AS over5 FROM mr, (SELECT avg(ret) AS a, stddev_samp(ret) AS s FROM mr)) SELECT round(w1.m, 6) AS winsor_1, round(w2.m, 6) AS winsor_25, round(t1.m, 6) AS trim_5, round(t2.m, 6) AS trim_10, over3, over5 FROM w1, w2, t1, t2, z", "mr")
def g15(spark, sf):
    m = T.monthly_returns(spark, sf)
    one = lambda d, name: d.agg(R(F.avg("ret")).alias(name))
    z = F.abs(F.try_divide(F.col("ret") - F.avg("ret").over(Window.partitionBy()), F.stddev_samp("ret").over(Window.partitionBy())))
    far = m.select(z.alias("z")).agg(F.count_if(F.col("z") > 3).alias("over3"), F.count_if(F.col("z") > 5).alias("over5"))
    out = far
    for d, name in ((S.winsorised(m, 0.01), "winsor_1"), (S.winsorised(m, 0.025), "winsor_25"), (S.trimmed(m, 0.05), "trim_5"), (S.trimmed(m, 0.1), "trim_10")):
        out = out.crossJoin(one(d, name))  # one row each
    return out


@query("h7_influence_rows", "SELECT date, round(z, 6) AS z FROM (SELECT date, (ret - avg(ret) OVER ()) / stddev_samp(ret) OVER () AS z FROM mr) WHERE abs(z) > 1.5 ORDER BY date LIMIT 10", "mr")
def h7(spark, sf):
    w = Window.partitionBy()
    z = T.monthly_returns(spark, sf).select("date", F.try_divide(F.col("ret") - F.avg("ret").over(w), F.stddev_samp("ret").over(w)).alias("z"))
    return z.filter(F.abs("z") > 1.5).orderBy("date").limit(10).select("date", R("z").alias("z"))
