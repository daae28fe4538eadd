"""Queries of resampling, regression, power and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hypolith.functions import special as D
from hypolith.functions.distributions import DUCK, SPARK
from hypolith.operators import joins as J
from hypolith.operators import portfolio as P
from hypolith.operators import resampling as B
from hypolith.operators import statistics as S
from hypolith.plans.portfolios import legs_sql
from hypolith.plans.registry import query
from hypolith.plans.statistics_queries import ACF, DR, T2, daily_returns, rounded
from hypolith.sources import tables as T

R = lambda c, n=6: F.round(c, n)
REPS = 200


def draw_sql(*keys: str) -> str:
    return "('0x' || substr(md5(" + " || '-' || ".join(keys) + "), 1, 8))::BIGINT"


LEN = "(SELECT CASE WHEN n < 20 THEN greatest(1, n // 4) ELSE least(CASE WHEN abs(acf_1) < 0.05 THEN 5 WHEN abs(acf_1) < 0.2 THEN 10 ELSE 21 END, greatest(2, n // 5)) END FROM acf, (SELECT count(*) AS n FROM mr))"
BOOT = f"{ACF}, s AS (SELECT ret, row_number() OVER (ORDER BY date) - 1 AS pos FROM mr), k AS (SELECT count(*) AS n, {LEN} AS len FROM mr), st AS (SELECT rep.range AS rep, b.range AS block, {draw_sql('42', 'rep.range', 'b.range')} % (n - len + 1) AS start, n, len FROM k, range(0, {REPS}) rep, range(0, 100) b WHERE b.range < (n + len - 1) // len), boot AS (SELECT rep, avg(ret) AS mean FROM st, range(0, 21) i JOIN s ON s.pos = start + i.range WHERE i.range < len AND block * len + i.range < n GROUP BY 1)"


def _boot(spark, sf, reps=REPS):
    m = T.monthly_returns(spark, sf)
    acf = S.autocorrelation(m, (1,)).first()["acf_1"]
    return m, B.block_bootstrap(m, reps, B.block_length(m.count(), acf))


@query("g1_block_bootstrap", f"WITH {BOOT} SELECT rep, round(mean, 6) AS mean FROM boot", "mr")
def g1(spark, sf):
    return rounded(_boot(spark, sf)[1])


@query("g2_intervals", f"WITH {BOOT}, o AS (SELECT avg(ret) AS m FROM mr), q AS (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, count(*) AS reps FROM boot) SELECT round(lo, 6) AS low, round(hi, 6) AS high, round(2 * m - hi, 6) AS basic_low, round(2 * m - lo, 6) AS basic_high, reps FROM o, q", "mr")
def g2(spark, sf):
    m, boot = _boot(spark, sf)
    return rounded(B.interval(boot, F.lit(m.agg(F.avg("ret")).first()[0])))


@query("g3_bca_pieces", f"WITH {BOOT}, o AS (SELECT avg(ret) AS m FROM mr), j AS (SELECT avg(m) OVER () - m AS d FROM (SELECT (sum(ret) OVER () - ret) / (count(*) OVER () - 1) AS m FROM mr)) SELECT round((SELECT avg(CASE WHEN mean < m THEN 1.0 ELSE 0.0 END) FROM boot, o), 6) AS below, round(sum(d ** 3) / (6 * sum(d * d) ** 1.5), 6) AS acceleration FROM j", "mr")
def g3(spark, sf):
    """The share of resampled means below the observed one, and the jackknife acceleration."""
    return rounded(g3_pieces(*_boot(spark, sf)))


def g3_pieces(m, boot):
    mean = m.agg(F.avg("ret")).first()[0]
    return boot.agg(F.avg((F.col("mean") < mean).cast("double")).alias("below")).crossJoin(B.jackknife(m))


def bca_sql(d, level=0.95):
    """(low, high) from one row (below, acceleration, means), the means in order."""
    z0 = d.normal_quantile("least(1 - 1e-6, greatest(1e-6, below))")
    z = [repr(D.NORMAL.inv_cdf(p)) for p in ((1 - level) / 2, (1 + level) / 2)]
    pick = (lambda x, k: f"{x}[CAST({k} AS BIGINT)]") if d.duck else (lambda x, k: f"element_at({x}, CAST({k} AS INT))")
    size = "len(means)" if d.duck else "size(means)"

    def bound(z: str) -> str:
        at = d.let(z0, lambda y: d.normal_cdf(f"{y} + ({y} + {z}) / (1 - acceleration * ({y} + {z}))"))
        place = lambda q: f"{pick('means', f'floor({q}) + 1')} + ({q} - floor({q})) * ({pick('means', f'least(floor({q}) + 2, {size})')} - {pick('means', f'floor({q}) + 1')})"
        return d.let(f"{at} * ({size} - 1)", place)

    return f"round({bound(z[0])}, 6) AS low", f"round({bound(z[1])}, 6) AS high"


@query("g3_bca_interval", f"WITH {BOOT}, o AS (SELECT avg(ret) AS m FROM mr), j AS (SELECT avg(m) OVER () - m AS d FROM (SELECT (sum(ret) OVER () - ret) / (count(*) OVER () - 1) AS m FROM mr)), b AS (SELECT (SELECT avg(CASE WHEN mean < m THEN 1.0 ELSE 0.0 END) FROM boot, o) AS below, (SELECT list_sort(list(mean)) FROM boot) AS means, sum(d ** 3) / (6 * sum(d * d) ** 1.5) AS acceleration FROM j) SELECT {', '.join(bca_sql(DUCK))} FROM b", "mr")
def g3_bca(spark, sf):
    """Bias-corrected and accelerated bounds: the percentiles of the resampled means that the two pieces move."""
    m, boot = _boot(spark, sf)
    pieces = g3_pieces(m, boot).crossJoin(boot.agg(F.array_sort(F.collect_list("mean")).alias("means")))  # one row; as many means as resamples
    return pieces.selectExpr(*bca_sql(SPARK))


@query("g4_resample_p", f"WITH {BOOT}, o AS (SELECT avg(ret) AS m FROM mr) SELECT round(greatest(1.0 / ({REPS} + 1), avg(CASE WHEN abs(mean - m) >= abs(m) THEN 1.0 ELSE 0.0 END)), 6) AS two_sided, round(greatest(1.0 / ({REPS} + 1), avg(CASE WHEN mean - m >= m THEN 1.0 ELSE 0.0 END)), 6) AS greater FROM boot, o", "mr")
def g4(spark, sf):
    """Resampled means are centred on the null before they are compared with the observed one."""
    m, boot = _boot(spark, sf)
    mean = m.agg(F.avg("ret")).first()[0]
    share = lambda c: R(F.greatest(F.lit(1.0 / (REPS + 1)), F.avg(c.cast("double"))))
    off = F.col("mean") - mean
    return boot.agg(share(F.abs(off) >= abs(mean)).alias("two_sided"), share(off >= mean).alias("greater"))


PANEL = "pan AS (SELECT date, ticker, -(close / nullif(lag(close, 5) OVER w, 0) - 1) AS signal, lead(close, 5) OVER w / nullif(lead(close, 1) OVER w, 0) - 1 AS fwd FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)), val AS (SELECT * FROM pan WHERE signal IS NOT NULL AND fwd IS NOT NULL)"
TOP5 = "SELECT {by} avg(fwd) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY {part} date ORDER BY signal DESC, ticker) AS rn, count(*) OVER (PARTITION BY {part} date) AS cnt FROM {t}) WHERE cnt >= 5 AND rn <= greatest(1, floor(cnt * 0.2)) GROUP BY {by} date"


def _panel(spark, sf):
    p = T.prices(spark, sf)
    w = Window.partitionBy("ticker").orderBy("date")
    return J.offset_return(p, 5).join(p.select("ticker", "date", (1 - F.try_divide("close", F.lag("close", 5).over(w))).alias("signal")), ["ticker", "date"]).filter("signal is not null and fwd is not null")


def objective(panel, by=()):
    """The mean over dates of the top fifth's mean forward return, on dates with five names and more."""
    n = F.count("*").over(Window.partitionBy(*by, "date"))
    top = panel.withColumn("_n", n).withColumn("_top", P.top([*by, "date"], "signal", 0.2)).filter("_n >= 5 and _top")
    return top.groupBy(*by, "date").agg(F.avg("fwd").alias("ret")).groupBy(*by).agg(F.avg("ret").alias("score"))


@query("g7_objective", f"WITH {PANEL} SELECT round(avg(ret), 6) AS score FROM ({TOP5.format(by='', part='', t='val')})", "px")
def g7(spark, sf):
    return rounded(objective(_panel(spark, sf)))


PERM = f"e AS (SELECT range AS rep, date, ticker, signal, fwd FROM val, range(0, 20)), a AS (SELECT rep, date, ticker, fwd, row_number() OVER (PARTITION BY rep, date ORDER BY ticker) AS k FROM e), b AS (SELECT rep, date, signal, row_number() OVER (PARTITION BY rep, date ORDER BY {draw_sql('42', 'rep', 'CAST(date AS VARCHAR)', 'ticker')}, ticker) AS k FROM e), pm AS (SELECT a.rep, a.date, a.ticker, a.fwd, b.signal FROM a JOIN b USING (rep, date, k))"


@query("g5_permutation", f"WITH {PANEL}, {PERM} SELECT rep, round(avg(ret), 6) AS score FROM ({TOP5.format(by='rep,', part='rep,', t='pm')}) GROUP BY 1", "px")
def g5(spark, sf):
    """The objective after the signals of every date were dealt anew, twenty times."""
    p = _panel(spark, sf)
    q = B.permuted(p, 20).join(p.select("date", "ticker", "fwd"), ["date", "ticker"])
    return rounded(objective(q, ("rep",)).withColumn("rep", F.col("rep").cast("long")))


@query("g6_time_shuffle", f"WITH {DR}, s AS (SELECT ret, row_number() OVER (ORDER BY date) AS k, date FROM dr), p AS (SELECT rep.range AS rep, s.k AS was, row_number() OVER (PARTITION BY rep.range ORDER BY {draw_sql('7', 'rep.range', 's.k')}, s.k) AS k FROM s, range(0, 10) rep) SELECT rep, round(avg(CASE WHEN a.k <= 100 THEN b.ret END), 6) AS early FROM p a JOIN s b ON b.k = a.was GROUP BY 1", "lp")
def g6(spark, sf):
    """The mean of the first hundred returns after the dates were dealt anew, ten times."""
    s = daily_returns(spark, sf).select("ret", F.row_number().over(S.BY_DATE()).cast("long").alias("was"))
    e = s.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    k = F.row_number().over(Window.partitionBy("rep").orderBy(B.draw(7, "rep", "was"), "was"))
    return e.withColumn("k", k).groupBy("rep").agg(R(F.avg(F.when(F.col("k") <= 100, F.col("ret")))).alias("early"))


SHUFFLED = f"dts AS (SELECT rep.range AS rep, date, row_number() OVER (PARTITION BY rep.range ORDER BY date) AS k, row_number() OVER (PARTITION BY rep.range ORDER BY {draw_sql('11', 'rep.range', 'CAST(date AS VARCHAR)')}, date) AS j FROM (SELECT DISTINCT date FROM val), range(0, 20) rep), mv AS (SELECT a.rep, a.date, b.date AS was FROM dts a JOIN dts b ON a.rep = b.rep AND a.k = b.j), sh AS (SELECT mv.rep, v.date, v.ticker, v.fwd, s.signal FROM mv JOIN val v ON v.date = mv.date JOIN val s ON s.date = mv.was AND s.ticker = v.ticker)"


@query("g6_time_shuffle_p", f"WITH {PANEL}, {SHUFFLED}, o AS (SELECT avg(ret) AS score FROM ({TOP5.format(by='', part='', t='val')})), p AS (SELECT rep, avg(ret) AS score FROM ({TOP5.format(by='rep,', part='rep,', t='sh')}) GROUP BY 1) SELECT round(any_value(o.score), 6) AS original, count(*) AS reps, round(avg(p.score), 6) AS shuffled_mean, round(greatest(1.0 / 21, sum(CASE WHEN p.score >= o.score THEN 1 ELSE 0 END) / 20), 6) AS p_value FROM o, p", "px")
def g6_p(spark, sf):
    """The share of twenty deals of the dates' labels, signals with them, whose objective reaches the original's."""
    p = _panel(spark, sf)
    d = p.select("date").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19))))
    w = Window.partitionBy("rep")  # a row a date
    d = d.select("rep", "date", F.row_number().over(w.orderBy("date")).alias("k"), F.row_number().over(w.orderBy(B.draw(11, "rep", F.col("date").cast("string")), "date")).alias("j"))
    moves = d.select("rep", "date", "k").join(d.select("rep", F.col("date").alias("was"), F.col("j").alias("k")), ["rep", "k"]).drop("k")
    sh = moves.join(p.select("date", "ticker", "fwd"), "date").join(p.select(F.col("date").alias("was"), "ticker", "signal"), ["was", "ticker"])
    both = objective(sh, ("rep",)).crossJoin(objective(p).withColumnRenamed("score", "own"))  # twenty rows by one
    return rounded(both.agg(F.any_value("own").alias("original"), F.count("*").alias("reps"), F.avg("score").alias("shuffled_mean"), F.greatest(F.lit(1.0 / 21), F.count_if(F.col("score") >= F.col("own")) / 20).alias("p_value")))


@query("g8_one_factor", f"WITH {DR}, f AS (SELECT date, ret AS y, lag(ret) OVER (ORDER BY date) AS x FROM dr) SELECT regr_count(y, x) AS n, round(regr_slope(y, x), 6) AS beta, round(regr_intercept(y, x), 6) AS alpha, round(regr_r2(y, x), 6) AS r2, round(covar_samp(y, x), 6) AS cov FROM f", "lp")
def g8(spark, sf):
    f = daily_returns(spark, sf).select(F.col("ret").alias("y"), F.lag("ret").over(S.BY_DATE()).alias("x"))
    return rounded(f.agg(F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("r2"), F.covar_samp("y", "x").alias("cov")))


def factors(spark, sf):
    """(date, momentum, reversal, low_vol): the legs' differences, on common dates."""
    from hypolith.plans.factor_queries import KNOWN, aligned, factor_legs, panel

    return aligned(factor_legs(panel(spark, sf), KNOWN).withColumnRenamed("factor", "name"), KNOWN)


@query("g9_newey_west_mean", f"WITH {DR}, e AS (SELECT date, ret - avg(ret) OVER () AS e, count(*) OVER () AS n FROM dr), l AS (SELECT e, n, " + ", ".join(f"lag(e, {k}) OVER (ORDER BY date) AS l{k}" for k in range(1, 5)) + " FROM e) SELECT any_value(n) AS n, round(sqrt(sum(e * e) + 2 * (" + " + ".join(f"{1 - k / 5} * coalesce(sum(e * l{k}), 0)" for k in range(1, 5)) + ")) / any_value(n), 6) AS se FROM l", "lp")
def g9(spark, sf):
    """The deviation of a mean with Bartlett weights over four lags."""
    w = Window.partitionBy()
    e = daily_returns(spark, sf).select("date", (F.col("ret") - F.avg("ret").over(w)).alias("e"))
    l = e.select("e", *(F.lag("e", k).over(S.BY_DATE()).alias(f"l{k}") for k in range(1, 5)))
    both = sum(((1 - k / 5) * F.coalesce(F.sum(F.col("e") * F.col(f"l{k}")), F.lit(0.0)) for k in range(1, 5)), F.lit(0.0))
    return l.agg(F.count("*").alias("n"), R(F.sqrt(F.sum(F.col("e") ** 2) + 2 * both) / F.count("*")).alias("se"))


def _leg_sql(signal: str) -> str:
    return legs_sql(signal).replace("round(up - down, 6)", "up - down")


_LOWVOL = "-CASE WHEN count(r) OVER v = 252 THEN stddev_samp(r) OVER v END"
FACTOR_SERIES = (
    "mkt AS (SELECT date, avg(fwd) AS ret FROM (SELECT date, lead(close) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM lp) WHERE fwd IS NOT NULL GROUP BY 1), "
    f"fm AS (WITH {_leg_sql('lag(close, 21) OVER w / nullif(lag(close, 252) OVER w, 0) - 1')}), fr AS (WITH {_leg_sql('-(close / nullif(lag(close, 21) OVER w, 0) - 1)')}), "
    "fv AS (WITH " + _leg_sql(_LOWVOL).replace("FROM lp WINDOW w AS (PARTITION BY ticker ORDER BY date))", "FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM lp) WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))", 1) + "), "
    "fac AS (SELECT date, mkt.ret, fm.ret AS momentum, fr.ret AS reversal, fv.ret AS low_vol FROM mkt JOIN fm USING (date) JOIN fr USING (date) JOIN fv USING (date))"
)


@query("g11_factor_correlations", f"WITH {FACTOR_SERIES} SELECT round(corr(momentum, reversal), 6) AS momentum_reversal, round(corr(momentum, low_vol), 6) AS momentum_low_vol, round(corr(reversal, low_vol), 6) AS reversal_low_vol, count(*) AS n FROM fac WHERE momentum IS NOT NULL AND reversal IS NOT NULL AND low_vol IS NOT NULL", "lp")
def g11(spark, sf):
    f = factors(spark, sf)
    names = ["momentum", "reversal", "low_vol"]
    return f.agg(*(R(F.corr(a, b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]), F.count("*").alias("n"))


TRIM = "r AS (SELECT date, ret, row_number() OVER (ORDER BY ret, date) AS i, count(*) OVER () AS n FROM mr), t AS (SELECT ret, row_number() OVER (ORDER BY date) - 1 AS pos FROM r WHERE i > floor(n * 0.05) AND i <= n - floor(n * 0.05)), c AS (SELECT count(*) AS n, avg(ret) AS m FROM t)"


@query("g16_trimmed_bootstrap", f"WITH {TRIM}, d AS (SELECT rep.range AS rep, {draw_sql('42', 'rep.range', 'k.range')} % n AS pos, m FROM c, range(0, {REPS}) rep, range(0, 1000) k WHERE k.range < n), b AS (SELECT rep, avg(ret) AS mean, any_value(m) AS m FROM d JOIN t USING (pos) GROUP BY 1) SELECT round(avg(CASE WHEN abs(mean - m) >= abs(m) THEN 1.0 ELSE 0.0 END), 6) AS p FROM b", "mr")
def g16(spark, sf):
    """An iid bootstrap of the trimmed mean, centred on the null: blocks of one."""
    m = T.monthly_returns(spark, sf)
    r = m.select("date", "ret", F.row_number().over(Window.orderBy("ret", "date")).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    t = r.filter("i > floor(n * 0.05) and i <= n - floor(n * 0.05)").select("date", "ret")
    mean = t.agg(F.avg("ret")).first()[0]
    return B.block_bootstrap(t, REPS, 1).agg(R(F.avg((F.abs(F.col("mean") - mean) >= abs(mean)).cast("double"))).alias("p")) if mean is not None else t.select(F.lit(None).cast("double").alias("p"))


@query("g17_effect_size", "SELECT count(*) AS n, round(abs(avg(ret)) / stddev_samp(ret), 6) AS d FROM mr", "mr")
def g17(spark, sf):
    return T.monthly_returns(spark, sf).agg(F.count("*").alias("n"), R(F.try_divide(F.abs(F.avg("ret")), F.stddev_samp("ret"))).alias("d"))


@query("g17_power")
def g17_power(spark, sf):
    """For each ticker's daily returns: the power of a t test for the effect seen, the least effect that so many rows find and
    the rows that this effect takes, both with 80 % power (null where it takes over 131,072)."""
    e = _ticker_returns(spark, sf).groupBy("ticker").agg(F.count("*").alias("n"), F.try_divide(F.abs(F.avg("ret")), F.stddev_samp("ret")).alias("d")).filter("n > 1 and d is not null")
    return _powers(T.written(e, "effects"))


def _powers(e):
    """(ticker, n, d, power, detectable, required_n) of (ticker, n, d). The quantile and the least effect follow from n, which takes
    no more values than the calendar has days: they are worked out once for each. Few bytes are many seconds here, so rows are
    dealt to all cores by number."""
    tasks = 4 * e.sparkSession.sparkContext.defaultParallelism
    each = e.select("n").distinct().repartition(tasks, "n").selectExpr("n", f"{SPARK.t_quantile('0.975', 'n - 1')} AS c", f"{SPARK.detectable('n')} AS detectable")
    out = e.repartition(tasks, "ticker").join(F.broadcast(each), "n")
    out = out.selectExpr("ticker", "n", "d", f"{SPARK.t_power('c', 'n - 1', 'd * sqrt(n)')} AS power", "detectable", f"{SPARK.required_n('d')} AS required_n")
    return out.withColumns({c: R(c, 5) for c in ("d", "power", "detectable")})


@query("g18_universe_power", "SELECT ticker, count(*) AS n, round(stddev_samp(close / nullif(was, 0) - 1), 6) AS sigma, CAST(ceil(2.8 * 2.8 * var_samp(close / nullif(was, 0) - 1) / (0.01 * 0.01)) AS BIGINT) AS required_n FROM (SELECT ticker, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS was FROM lp) WHERE was IS NOT NULL GROUP BY 1", "lp")
def g18(spark, sf):
    r = T.long_prices(spark, sf).select("ticker", (F.try_divide("close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))) - 1).alias("r")).filter("r is not null")
    return r.groupBy("ticker").agg(F.count("*").alias("n"), R(F.stddev_samp("r")).alias("sigma"), F.ceil(2.8 * 2.8 * F.var_samp("r") / (0.01 * 0.01)).alias("required_n"))


@query("g19_test_statistics", f"WITH {ACF}, g AS (SELECT ret, ret > 0 AS s FROM mr) SELECT round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 6) AS t_mean, round({T2.format(s='s')}, 6) AS t_sides, round((SELECT 0.5 * ln((1 + acf_1) / (1 - acf_1)) FROM acf) * sqrt(count(*) - 3), 6) AS z_acf FROM g", "mr")
def g19(spark, sf):
    m = T.monthly_returns(spark, sf)
    acf = S.autocorrelation(m, (1,))
    t = m.agg(F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(F.count("*"))).alias("t_mean"), S.two_sample_t(F.col("ret"), F.col("ret") > 0).alias("t_sides"), F.count("*").alias("n"))
    return rounded(t.crossJoin(acf).select("t_mean", "t_sides", (0.5 * F.log((1 + F.col("acf_1")) / (1 - F.col("acf_1"))) * F.sqrt(F.col("n") - 3)).alias("z_acf")))


def _ticker_returns(spark, sf):
    """(ticker, date, ret) of each supplier's daily prices."""
    w = Window.partitionBy("ticker").orderBy("date")
    return T.long_prices(spark, sf).select("ticker", "date", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("ret")).filter("ret is not null")


TRET = "tr AS (SELECT ticker, date, ret, lag(ret) OVER (PARTITION BY ticker ORDER BY date) AS was FROM (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM lp) WHERE ret IS NOT NULL)"
_P = lambda d: (d.t_two_sided("mean", "n - 1"), d.t_two_sided("sides", "n - 2"), f"2 * {d.normal_cdf('-abs(acf)')}")
_TESTS = ("mean", "sides", "acf")


@query("g19_p_values", f"WITH {TRET}, st AS (SELECT ticker, count(*) AS n, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS mean, {T2.format(s='(ret > 0)')} AS sides, 0.5 * ln((1 + corr(ret, was)) / (1 - corr(ret, was))) * sqrt(count(*) - 3) AS acf FROM tr GROUP BY 1 HAVING count(*) > 10 AND count_if(ret > 0) > 1 AND count_if(ret <= 0) > 1) " + " UNION ALL ".join(f"SELECT ticker, '{t}' AS test, round({t}, 6) AS statistic, round({p}, 8) AS p FROM st" for t, p in zip(_TESTS, _P(DUCK), strict=True)), "lp")
def g19_p(spark, sf):
    """Each ticker's tests of the mean, of gains against losses and of the first autocorrelation, with p values as columns."""
    r = _ticker_returns(spark, sf).withColumn("was", F.lag("ret").over(Window.partitionBy("ticker").orderBy("date")))
    c = F.corr("ret", "was")
    st = r.groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(F.col("ret") > 0).alias("up"), F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(F.count("*"))).alias("mean"), S.two_sample_t(F.col("ret"), F.col("ret") > 0).alias("sides"), (0.5 * F.log((1 + c) / (1 - c)) * F.sqrt(F.count("*") - 3)).alias("acf"))
    st = st.filter("n > 10 and up > 1 and n - up > 1")
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("test"), F.round(t, 6).alias("statistic"), F.round(F.expr(p), 8).alias("p")) for t, p in zip(_TESTS, _P(SPARK), strict=True))))
    return st.select("ticker", rows.alias("x")).select("ticker", "x.*")


@query("g22_noise_injection", f"SELECT ticker, date, round(signal + 1000 * (2 * ({draw_sql('42', 'CAST(date AS VARCHAR)', 'ticker')} / 4294967296.0) - 1), 6) AS signal FROM sig", "sig")
def g22(spark, sf):
    return rounded(B.noisy(T.signals(spark, sf), 1000.0))


@query("g22_sign_reversal", "SELECT ticker, date, -signal AS signal FROM sig", "sig")
def g22_neg(spark, sf):
    return T.signals(spark, sf).withColumn("signal", -F.col("signal"))


@query("g24_seeds", "SELECT c_custkey, (42 + ('0x' || substr(sha256(c_name), 1, 8))::BIGINT) % 2147483648 AS seed FROM customer")
def g24(spark, sf):
    return T.table(spark, sf, "customer").select("c_custkey", B.seed_of(42, F.col("c_name")).alias("seed"))


@query("v7_calibration_tiers", f"WITH {PANEL}, n AS (SELECT l.range AS level, s.range AS seed FROM range(0, 3) l, range(0, 4) s), z AS (SELECT level, seed, date, ticker, fwd, signal + level * 0.5 * (2 * ({draw_sql('seed', 'CAST(date AS VARCHAR)', 'ticker')} / 4294967296.0) - 1) AS signal FROM val, n), o AS (SELECT level, seed, avg(ret) AS score FROM ({TOP5.format(by='level, seed,', part='level, seed,', t='z')}) GROUP BY 1, 2) SELECT level, count(*) AS runs, count_if(score > 0) AS survived, round(avg(score), 6) AS mean_score FROM o GROUP BY 1", "px")
def v7(spark, sf):
    """Every noise level and seed through one plan, and the survivors of each level."""
    p = _panel(spark, sf).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(3))))
    u = B.draw("seed", F.col("date").cast("string"), "ticker") / F.lit(2.0**32)
    o = objective(p.withColumn("signal", F.col("signal") + F.col("level") * 0.5 * (2 * u - 1)), ("level", "seed"))
    return o.groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("runs"), F.count_if(F.col("score") > 0).alias("survived"), R(F.avg("score")).alias("mean_score"))


LEVELS = (0, 2, 4, 8, 16)
_U = lambda *keys: f"(2 * ({draw_sql(*keys)} / 4294967296.0) - 1)"
TIERS = (
    f"sd AS (SELECT stddev_samp(fwd) AS s FROM val), td AS (SELECT 1 AS tier, 0 AS level, 0 AS seed, date, ticker, fwd, fwd AS signal FROM val UNION ALL "
    f"SELECT 2, l.l, k.range, date, ticker, fwd, fwd + l.l * s * {_U('k.range', 'CAST(date AS VARCHAR)', 'ticker')} FROM val, sd, (SELECT unnest([{', '.join(map(str, LEVELS))}]) AS l) l, range(0, 4) k UNION ALL "
    f"SELECT 3, 0, k.range, date, ticker, fwd, CASE WHEN k.range = 0 THEN -fwd ELSE {_U('100 + k.range', 'CAST(date AS VARCHAR)', 'ticker')} - fwd / s END FROM val, sd, range(0, 3) k UNION ALL "
    f"SELECT 4, 0, k.range, date, ticker, fwd, {_U('200 + k.range', 'CAST(date AS VARCHAR)', 'ticker')} FROM val, range(0, 20) k), "
    f"run AS (SELECT tier, level, seed, avg(ret) AS score, avg(ret) / nullif(stddev_samp(ret) / sqrt(count(*)), 0) AS t FROM ({TOP5.format(by='tier, level, seed,', part='tier, level, seed,', t='td')}) GROUP BY 1, 2, 3), "
    "tiers AS (SELECT tier, level, count(*) AS runs, count_if(coalesce(t, 0) > 1.645) AS survived, avg(score) AS mean_score FROM run GROUP BY 1, 2)"
)


def _tiers(spark, sf):
    """(tier, level, runs, survived, mean_score). All runs of all tiers go through one plan of the objective."""
    p = _panel(spark, sf).drop("signal")
    sd = p.agg(F.stddev_samp("fwd").alias("s"))
    u = lambda *keys: 2 * (B.draw(*keys, F.col("date").cast("string"), "ticker") / F.lit(2.0**32)) - 1
    plans = [(1, 0, 0)] + [(2, x, k) for x in LEVELS for k in range(4)] + [(3, 0, k) for k in range(3)] + [(4, 0, k) for k in range(20)]
    runs = F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), F.lit(x).alias("level"), F.lit(k).alias("seed")) for t, x, k in plans)))
    d = p.crossJoin(F.broadcast(sd)).withColumn("run", runs).select("date", "ticker", "fwd", "s", "run.*")  # one row
    noise = F.col("fwd") + F.col("level") * F.col("s") * u("seed")
    against = F.when(F.col("seed") == 0, -F.col("fwd")).otherwise(u(F.col("seed") + 100) - F.try_divide("fwd", "s"))
    d = d.withColumn("signal", F.when(F.col("tier") == 1, F.col("fwd")).when(F.col("tier") == 2, noise).when(F.col("tier") == 3, against).otherwise(u(F.col("seed") + 200)))
    by = ("tier", "level", "seed")
    n = F.count("*").over(Window.partitionBy(*by, "date"))
    top = d.withColumn("_n", n).withColumn("_top", P.top([*by, "date"], "signal", 0.2)).filter("_n >= 5 and _top").groupBy(*by, "date").agg(F.avg("fwd").alias("ret"))
    run = top.groupBy(*by).agg(F.avg("ret").alias("score"), F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(F.count("*"))).alias("t"))
    return run.groupBy("tier", "level").agg(F.count("*").alias("runs"), F.count_if(F.coalesce("t", F.lit(0.0)) > 1.645).alias("survived"), F.avg("score").alias("mean_score"))


@query("v7_four_tiers", f"WITH {PANEL}, {TIERS} SELECT tier, level, runs, survived, round(mean_score, 6) AS mean_score, CASE tier WHEN 1 THEN survived = runs WHEN 2 THEN level > 0 OR survived > 0 WHEN 3 THEN survived = 0 ELSE survived <= 0.05 * runs END AS passed FROM tiers", "px")
def v7_tiers(spark, sf):
    """Calibration: a planted effect survives, it survives less under noise, reversed signals don't survive, and random ones
    survive in at most one of twenty runs."""
    t = F.col("tier")
    ok = F.when(t == 1, F.col("survived") == F.col("runs")).when(t == 2, (F.col("level") > 0) | (F.col("survived") > 0)).when(t == 3, F.col("survived") == 0).otherwise(F.col("survived") <= 0.05 * F.col("runs"))
    return rounded(_tiers(spark, sf).withColumn("passed", ok))


_SHARE = "ln(greatest(0.5, survived) / greatest(0.5, runs - survived))"


@query("g23_power_curve", f"WITH {PANEL}, {TIERS}, c AS (SELECT regr_slope({_SHARE}, ln(1 + level)) AS slope, regr_intercept({_SHARE}, ln(1 + level)) AS intercept FROM tiers WHERE tier = 2) SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, CASE WHEN slope < 0 THEN round((ln(4) - intercept) / slope, 6) END AS log_noise_at_80 FROM c", "px")
def g23(spark, sf):
    """A logistic curve of the shares that survive in the second tier on the log of the noise, and the noise at which 80 % do."""
    share = F.log(F.greatest(F.lit(0.5), F.col("survived")) / F.greatest(F.lit(0.5), F.col("runs") - F.col("survived")))
    d = _tiers(spark, sf).filter("tier = 2").select(F.log(1 + F.col("level")).alias("x"), share.alias("y"))
    c = d.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return rounded(c.withColumn("log_noise_at_80", F.when(F.col("slope") < 0, (F.log(F.lit(4.0)) - F.col("intercept")) / F.col("slope"))))


@query("g22_random_signals", f"SELECT ticker, date, round({_U('7', 'CAST(date AS VARCHAR)', 'ticker')}, 6) AS signal FROM sig", "sig")
def g22_random(spark, sf):
    """Signals that know nothing, one a cell, the same in every run."""
    return rounded(T.signals(spark, sf).select("ticker", "date", (2 * (B.draw(7, F.col("date").cast("string"), "ticker") / F.lit(2.0**32)) - 1).alias("signal")))
