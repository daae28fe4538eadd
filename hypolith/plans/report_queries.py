"""Queries of reports: issue lists, caps, alternative specifications, verdict documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hypolith.operators import portfolio as P
from hypolith.operators import statistics as S
from hypolith.plans.control_queries import v1
from hypolith.plans.inference_queries import BOOT, _boot
from hypolith.plans.portfolios import REV, reversal, top_sql
from hypolith.plans.registry import SQL, query
from hypolith.plans.statistics_queries import rounded
from hypolith.sources import tables as T


@query("h8_issue_lists", "WITH r AS (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM lp), j AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY abs(ret) DESC, date) AS k FROM r WHERE abs(ret) > 0.5) SELECT ticker, count(*) AS n, string_agg(CASE WHEN k <= 10 THEN CAST(date AS VARCHAR) END, ',' ORDER BY k) AS worst FROM j GROUP BY 1", "lp")
def h8(spark, sf):
    """The ten largest jumps of each ticker, ranked before they are gathered."""
    w = Window.partitionBy("ticker")
    r = T.long_prices(spark, sf).select("ticker", "date", (F.try_divide("close", F.lag("close").over(w.orderBy("date"))) - 1).alias("ret")).filter(F.abs("ret") > 0.5)
    j = r.withColumn("k", F.row_number().over(w.orderBy(F.desc(F.abs("ret")), "date")))
    days = F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.struct("k", F.col("date").cast("string").alias("d")))))
    return j.groupBy("ticker").agg(F.count("*").alias("n"), F.array_join(F.transform(days, lambda x: x["d"]), ",").alias("worst"))


@query("j11_contamination_cap", "WITH s AS (SELECT o_custkey AS ticker, CASE WHEN max(o_orderdate) < TIMESTAMP '2000-01-01' THEN 'HIGH' WHEN count(*) > 10 THEN 'LOW' ELSE 'CLEAN' END AS risk, CASE WHEN o_custkey % 3 = 0 THEN 'SURVIVED' ELSE 'BROKEN' END AS verdict FROM orders GROUP BY 1) SELECT risk, CASE WHEN risk = 'HIGH' AND verdict = 'SURVIVED' THEN 'PROVISIONAL' ELSE verdict END AS verdict, count(*) AS n FROM s GROUP BY 1, 2")
def j11(spark, sf):
    """A high risk of contamination caps a surviving verdict."""
    risk = F.when(F.max("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "HIGH").when(F.count("*") > 10, "LOW").otherwise("CLEAN")
    s = T.table(spark, sf, "orders").groupBy("o_custkey").agg(risk.alias("risk")).withColumn("v", F.when(F.col("o_custkey") % 3 == 0, "SURVIVED").otherwise("BROKEN"))
    return s.groupBy("risk", F.when((F.col("risk") == "HIGH") & (F.col("v") == "SURVIVED"), "PROVISIONAL").otherwise(F.col("v")).alias("verdict")).agg(F.count("*").alias("n"))


@query("g21_statistical_report", f"WITH {BOOT}, c AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM boot), a AS (SELECT count(*) AS n, avg(ret) AS mean, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS t FROM mr) SELECT n, round(mean, 6) AS mean, round(t, 6) AS t, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS significant FROM a, c", "mr")
def g21(spark, sf):
    m, boot = _boot(spark, sf)
    a = m.agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(F.count("*"))).alias("t"))
    c = boot.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return rounded(a.crossJoin(c).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0)))  # one row each


QS = (0.1, 0.2, 0.3)
FWD = "f AS (SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM px)"


@query("u7_alternative_specifications", f"WITH {REV}, {FWD} " + " UNION ALL ".join(f"SELECT {q} AS q, s AS sign, count(*) AS n, round(s * avg(fwd), 6) AS mean FROM ({top_sql('rev', 'signal', q)}) JOIN f USING (ticker, date), (SELECT unnest([1, -1]) AS s) WHERE fwd IS NOT NULL GROUP BY s" for q in QS), "px")
def u7(spark, sf):
    """Each selection share and direction through one plan: the parameters are exploded onto the signals."""
    s = reversal(spark, sf).filter("signal is not null").withColumn("q", F.explode(F.array(*map(F.lit, QS))))
    w = Window.partitionBy("q", "date")
    s = s.withColumns({"k": F.row_number().over(w.orderBy(F.desc("signal"), "ticker")), "c": F.count("*").over(w)})
    s = s.filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("c") * F.col("q"))))
    p = T.prices(spark, sf)
    fwd = p.select("ticker", "date", (F.try_divide(F.lead("close").over(Window.partitionBy("ticker").orderBy("date")), "close") - 1).alias("fwd")).filter("fwd is not null")
    both = s.join(fwd, ["ticker", "date"]).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    return both.groupBy("q", "sign").agg(F.count("*").alias("n"), F.avg("fwd").alias("m")).select("q", "sign", "n", F.round(F.col("sign") * F.col("m"), 6).alias("mean"))


@query("v6_verdict_documents", SQL["v1_verdict_tree"].replace("SELECT k, reason, CASE", "SELECT k, sha256('{\"k\":' || k || CASE WHEN reason IS NULL THEN '' ELSE ',\"reason\":\"' || reason || '\"' END || ',\"verdict\":\"' || verdict || '\"}') AS trail FROM (SELECT k, reason, CASE").rstrip() + ")")
def v6(spark, sf):
    """Each verdict as a JSON document, and the hash that ends its trail."""
    v = v1(spark, sf)
    return v.select("k", F.sha2(F.to_json(F.struct("k", "reason", "verdict")).cast("binary"), 256).alias("trail"))


@query("f16_rebalance_calendar", "SELECT 'weekly' AS every, count(DISTINCT date) FILTER (dayofweek(date) = 5) AS dates FROM px UNION ALL SELECT 'daily', count(DISTINCT date) FROM px UNION ALL SELECT 'monthly', count(DISTINCT date_trunc('month', date)) FROM px", "px")
def f16_all(spark, sf):
    p, out = T.prices(spark, sf), None
    for every in ("weekly", "daily", "monthly"):
        one = P.rebalance_dates(p, every).agg(F.count("*").alias("dates")).select(F.lit(every).alias("every"), "dates")
        out = one if out is None else out.unionByName(one)
    return out


@query("e12_equity_r_squared", "WITH e AS (SELECT exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS cum, row_number() OVER (ORDER BY date) - 1 AS i FROM mr) SELECT count(*) AS n, round(least(1, greatest(0, regr_r2(cum, i))), 6) AS r_squared FROM e", "mr")
def e12(spark, sf):
    e = S.equity(T.monthly_returns(spark, sf)).withColumn("i", F.row_number().over(S.BY_DATE()) - 1)
    return rounded(e.agg(F.count("*").alias("n"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.regr_r2("cum", "i"))).alias("r_squared")))
