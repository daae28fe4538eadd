"""Queries of sources, plug-ins and the joins that are left."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from hypolith.functions.text import words
from hypolith.operators import joins as J
from hypolith.operators.matching import matched
from hypolith.plans.joins_and_dates import forward_sql
from hypolith.plans.registry import query
from hypolith.plans.statistics_queries import rounded
from hypolith.sources import adapters as A
from hypolith.sources import tables as T


@query("a1_adapter_contract", "SELECT 'events' AS provider, count(*) AS n FROM px UNION ALL SELECT 'lineitem', count(*) FROM lp UNION ALL SELECT 'orders', count(*) FROM sig UNION ALL SELECT 'documents', count(*) FROM fil", "px lp sig fil")
def a1(spark, sf):
    out = None
    for p in ("events", "lineitem", "orders", "documents"):
        one = A.acquire(spark, p, sf, ["ticker", "date"]).agg(F.count("*").alias("n")).select(F.lit(p).alias("provider"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a6_price_scan_by_day", "SELECT date, count(*) AS tickers, round(avg(close), 6) AS close FROM px WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' GROUP BY 1", "px")
def a6(spark, sf):
    return rounded(T.prices(spark, sf).filter("date between date'2024-01-08' and date'2024-01-12'").groupBy("date").agg(F.count("*").alias("tickers"), F.avg("close").alias("close")))


@query("a20_a21_wide_and_long", "SELECT date, ticker, round(close, 6) AS value FROM px WHERE ticker < 5", "px")
def a20(spark, sf):
    """Long prices made wide and long again."""
    p = T.prices(spark, sf).filter("ticker < 5").select("date", F.col("ticker").cast("string").alias("ticker"), F.col("close").alias("value"))
    long = A.wide_to_long(A.long_to_wide(p, [str(i) for i in range(5)]))
    return rounded(long).withColumn("ticker", F.col("ticker").cast("long"))


@query("c5_event_return", f"WITH pt AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS signal_date FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), {forward_sql('px', 'pt', 10, False)} SELECT ticker, signal_date, round(exit_price / entry_price - 1, 6) AS event_return FROM fwd", "px")
def c5(spark, sf):
    e = T.table(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("signal_date")).distinct()
    return rounded(J.with_return(J.forward_prices(e, T.prices(spark, sf), 10, False)).select("ticker", "signal_date", F.col("forward_return").alias("event_return")))


@query("c10_c11_aligned_series", "SELECT count(*) AS n, round(corr(a.v, b.v), 6) AS correlation FROM (SELECT date_trunc('month', date)::DATE AS m, avg(close) AS v FROM lp GROUP BY 1) a JOIN (SELECT date_trunc('month', date)::DATE AS m, avg(signal) AS v FROM sig GROUP BY 1) b USING (m)", "lp sig")
def c10(spark, sf):
    month = F.to_date(F.trunc("date", "month")).alias("m")
    a = T.long_prices(spark, sf).groupBy(month).agg(F.avg("close").alias("a"))
    b = T.signals(spark, sf).groupBy(month).agg(F.avg("signal").alias("b"))
    return rounded(a.join(b, "m").na.drop().agg(F.count("*").alias("n"), F.corr("a", "b").alias("correlation")))


#: The closest pairs by rounds in which nearest neighbours of two kinds ask for each other, as a recursive query.
MATCHED = """
WITH RECURSIVE o AS (SELECT doc_id AS key, quality = 0 AS side, datediff('day', DATE '2000-01-01', date) AS dy, row_number() OVER (ORDER BY date, doc_id) AS place FROM fil JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
r AS (SELECT 0 AS round, key, side, dy, place, NULL::BIGINT AS mate FROM o UNION ALL
    SELECT round, key, side, dy, place, mate FROM (WITH f AS (SELECT * FROM r WHERE mate IS NULL),
    n AS (SELECT *, last_value(CASE WHEN side THEN [dy, place] END IGNORE NULLS) OVER w AS bt, last_value(CASE WHEN NOT side THEN [dy, place] END IGNORE NULLS) OVER w AS bf,
        first_value(CASE WHEN side THEN [dy, place] END IGNORE NULLS) OVER v AS nt, first_value(CASE WHEN NOT side THEN [dy, place] END IGNORE NULLS) OVER v AS nf
        FROM f WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    m AS (SELECT *, CASE WHEN side THEN bf ELSE bt END AS b, CASE WHEN side THEN nf ELSE nt END AS a FROM n),
    g AS (SELECT *, CASE WHEN b IS NOT NULL THEN [dy - b[1], place - b[2], b[2]] END AS p, CASE WHEN a IS NOT NULL THEN [a[1] - dy, a[2] - place, place] END AS q FROM m),
    k AS (SELECT *, CASE WHEN p IS NULL THEN a[2] WHEN q IS NULL OR p < q THEN b[2] ELSE a[2] END AS want FROM g)
    SELECT x.round + 1 AS round, x.key, x.side, x.dy, x.place, y.key AS mate, count(y.key) OVER () AS found FROM k x LEFT JOIN k y ON y.place = x.want AND y.want = x.place) WHERE found > 0)
SELECT x.key AS key_a, x.mate AS key_b, CAST(abs(x.dy - y.dy) AS INTEGER) AS gap FROM r x JOIN o y ON y.key = x.mate WHERE x.side AND x.mate IS NOT NULL
"""


@query("c17_placebo_matching", MATCHED, "fil")
def c17(spark, sf):
    """Filings of good and poor quality, each matched with the nearest in time of the other kind."""
    d = T.filings(spark, sf).select("doc_id", "date").join(T.table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")
    return matched(d, "doc_id", "bad", "date")


def trimmed_mean(x: pd.Series) -> float:
    """A user's statistic over a sample, by Arrow."""
    k = int(len(x) * 0.1)
    return float(x.sort_values().iloc[k : len(x) - k].mean()) if len(x) else None


@query("u1_u3_user_statistics", "SELECT l_suppkey, round(avg(x), 4) AS trimmed FROM (SELECT l_suppkey, l_quantity AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1) GROUP BY 1")
def u1(spark, sf):
    """A statistic of the user's own by supplier: each group is one supplier's rows, some hundred at any scale."""
    return T.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.pandas_udf(trimmed_mean, "double")("l_quantity"), 4).alias("trimmed"))


@query("u4_extractor_plugins", "SELECT doc_id, length(text) AS n_chars, CAST(len(regexp_extract_all(lower(text), '[a-z]+')) AS INTEGER) AS n_words FROM documents")
def u4(spark, sf):
    return A.extractor(T.table(spark, sf, "documents"), "text", {"n_chars": lambda c: F.char_length(c).cast("long"), "n_words": lambda c: F.size(words(c))}).select("doc_id", "n_chars", "n_words")


@query("u5_calendar_connector", "SELECT CAST(range AS DATE) AS date, CAST(isodow(range) - 1 AS INTEGER) AS weekday FROM range(TIMESTAMP '2023-06-01', TIMESTAMP '2025-03-01', INTERVAL 1 DAY)")
def u5(spark, sf):
    spark.dataSource.register(A.CalendarSource)
    return spark.read.format("calendar").option("first", "2023-06-01").option("last", "2025-02-28").load()


@query("v3_checks_projection", "SELECT ticker, count(*) AS n, min(date) AS first, max(date) AS last, count(signal) >= 3 AND max(date) > min(date) AS ok FROM sig GROUP BY 1", "sig")
def v3(spark, sf):
    s = T.signals(spark, sf).groupBy("ticker").agg(F.struct(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), ((F.count("signal") >= 3) & (F.max("date") > F.min("date"))).alias("ok")).alias("c"))
    return s.select("ticker", "c.*")


@query("v8_universe_build", "SELECT c_custkey AS ticker, c_mktsegment AS sector, n.k AS filings FROM customer JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) n ON o_custkey = c_custkey WHERE c_acctbal > 0 AND n.k >= 3")
def v8(spark, sf):
    n = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("filings")).filter("filings >= 3")
    return T.table(spark, sf, "customer").filter("c_acctbal > 0").join(n, "c_custkey").select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("sector"), "filings")
