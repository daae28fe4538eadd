"""Queries of as-of joins, other joins, set operations and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hypolith.functions import dates as D
from hypolith.operators import joins as J
from hypolith.plans.registry import query
from hypolith.sources import tables as T

R = lambda c, n=6: F.round(c, n)

#: DuckDB: t1(d, n) as an expression.
BD = "CASE WHEN {n} > 0 THEN CAST({d} - CAST(greatest(0, isodow({d}) - 5) AS INTEGER) + CAST({n} + 2 * ((least(isodow({d}) - 1, 4) + {n}) // 5) AS INTEGER) AS DATE) WHEN isodow({d}) > 5 THEN CAST({d} + CAST(8 - isodow({d}) AS INTEGER) AS DATE) ELSE {d} END"


def bd(d: str, n: object) -> str:
    return BD.format(d=d, n=n)


HOLIDAY = "((month(d) = 1 AND day(d) = 1) OR (month(d) = 1 AND day(d) = 2 AND isodow(d) = 1) OR (month(d) = 6 AND day(d) = 19) OR (month(d) = 7 AND day(d) = 4) OR (month(d) = 12 AND day(d) = 25) OR (isodow(d) = 1 AND ((month(d) IN (1, 2) AND day(d) BETWEEN 15 AND 21) OR (month(d) = 5 AND day(d) >= 25) OR (month(d) = 9 AND day(d) <= 7))) OR (month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28))"
CALENDAR = f"SELECT d AS date, row_number() OVER (ORDER BY d) AS n FROM (SELECT CAST(range AS DATE) AS d FROM range(TIMESTAMP '2000-01-01', TIMESTAMP '2031-01-01', INTERVAL 1 DAY)) WHERE isodow(d) < 6 AND NOT {HOLIDAY}"


@query("t1_business_day_add", f"SELECT d AS date, n, {bd('d', 'n')} AS later FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), (SELECT CAST(range AS INTEGER) AS n FROM range(0, 12))")
def t1(spark, sf):
    d = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return d.select("date", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n")).select("date", "n", D.add_business_days(F.col("date"), F.col("n")).alias("later"))


@query("t2_market_holidays", f"SELECT d AS date, {HOLIDAY} AS holiday FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def t2(spark, sf):
    d = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return d.select("date", D.is_holiday(F.col("date")).alias("holiday"))


@query("t3_trading_calendar", CALENDAR)
def t3(spark, sf):
    return D.trading_calendar(spark)


@query("t4_trading_day_shift", f"WITH cal AS ({CALENDAR}), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate >= TIMESTAMP '2000-02-01') SELECT o.d AS date, nx.date AS next5, pv.date AS prev5 FROM o JOIN (SELECT o.d, max(cal.n) AS n FROM o JOIN cal ON cal.date <= o.d GROUP BY 1) p ON p.d = o.d LEFT JOIN cal nx ON nx.n = p.n + 5 LEFT JOIN cal pv ON pv.n = p.n - 4 - CASE WHEN EXISTS (SELECT 1 FROM cal c WHERE c.date = o.d) THEN 1 ELSE 0 END")
def t4(spark, sf):
    """The fifth trading day after and before each date: the calendar's number of the last day up to it, plus or minus."""
    o = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).filter("date >= date'2000-02-01'").distinct()  # the calendar begins in 2000
    cal = D.trading_calendar(spark).select(F.lit(1).alias("k"), F.col("date").alias("known"), "n", F.col("date").alias("day"))
    at = J.as_of(o.withColumn("k", F.lit(1)), cal, "k", "date", "known", ["n", "day"])
    c = F.broadcast(cal.select("n", F.col("day").alias("to")))  # a calendar of 31 years
    on = F.when(F.col("day") == F.col("date"), 1).otherwise(0)
    at = at.select("date", (F.col("n") + 5).alias("a"), (F.col("n") - 4 - on).alias("b"))
    x, y = c.select(F.col("n").alias("a"), F.col("to").alias("next5")), c.select(F.col("n").alias("b"), F.col("to").alias("prev5"))
    return at.join(x, "a", "left").join(y, "b", "left").select("date", "next5", "prev5")


FORMS = "CASE doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END"
SIZE = "CASE WHEN doc_id % 2 = 0 THEN 'large' ELSE 'small' END"


@query("t5_filing_date", f"SELECT doc_id, form, size, {bd('date', 'k')} AS filed FROM (SELECT doc_id, date, {FORMS} AS form, {SIZE} AS size, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 60 ELSE 90 END WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 40 ELSE 45 END ELSE 4 END AS k FROM fil)", "fil")
def t5(spark, sf):
    f = T.filings(spark, sf).select("doc_id", "date", F.expr(FORMS).alias("form"), F.expr(SIZE).alias("size"))
    return f.select("doc_id", "form", "size", D.filing_date(F.col("date"), F.col("form"), F.col("size")).alias("filed"))


@query("t6_known_date", f"SELECT doc_id, kind, CASE WHEN kind IN ('earnings', 'sec_filing') THEN {bd('date', 1)} ELSE {bd('date', 0)} END AS known_date FROM (SELECT doc_id, date, CASE doc_id % 4 WHEN 0 THEN 'earnings' WHEN 1 THEN 'sec_filing' WHEN 2 THEN 'news' ELSE 'other' END AS kind FROM fil)", "fil")
def t6(spark, sf):
    f = T.filings(spark, sf).withColumn("kind", F.expr("CASE doc_id % 4 WHEN 0 THEN 'earnings' WHEN 1 THEN 'sec_filing' WHEN 2 THEN 'news' ELSE 'other' END"))
    return f.select("doc_id", "kind", D.known_date(F.col("date"), F.col("kind")).alias("known_date"))


@query("t7_horizon_years", "SELECT ticker, round(greatest(0.5, (max(date) - min(date)) / 365.25), 6) AS years FROM sig GROUP BY 1", "sig")
def t7(spark, sf):
    return T.signals(spark, sf).groupBy("ticker").agg(R(D.horizon_years(F.min("date"), F.max("date"))).alias("years"))


@query("t8_calendar_years", "SELECT ticker, round((max(date) - min(date)) / 365.25, 6) AS years FROM lp GROUP BY 1", "lp")
def t8(spark, sf):
    return T.long_prices(spark, sf).groupBy("ticker").agg(R(F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"))


@query("t9_parse_dates", "SELECT o_orderkey, try_strptime(s, '%Y%m%d')::DATE AS day FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y%m%d') END AS s FROM orders)")
def t9(spark, sf):
    s = F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return T.table(spark, sf, "orders").select("o_orderkey", D.parsed_date(s).alias("day"))


OBS = "obs AS (SELECT ticker, d AS observation_date FROM (SELECT DISTINCT ticker FROM sig) , (SELECT DISTINCT date_trunc('month', date)::DATE AS d FROM sig))"


@query("c1_point_in_time", f"WITH {OBS}, k AS (SELECT ticker, {bd('date', 1)} AS known_date, date AS event_date, signal FROM sig) SELECT obs.ticker, obs.observation_date, k.known_date, k.event_date, k.signal, observation_date - k.known_date AS data_lag_days FROM obs LEFT JOIN (SELECT ticker, known_date, max_by(event_date, (event_date)) AS event_date, max_by(signal, event_date) AS signal FROM k GROUP BY 1, 2) k ON k.ticker = obs.ticker AND k.known_date <= obs.observation_date QUALIFY row_number() OVER (PARTITION BY obs.ticker, obs.observation_date ORDER BY k.known_date DESC NULLS LAST) = 1", "sig")
def c1(spark, sf):
    """For each month and ticker, the latest signal that was known then."""
    s = T.signals(spark, sf)
    obs = s.select("ticker").distinct().crossJoin(F.broadcast(s.select(F.to_date(F.trunc("date", "month")).alias("observation_date")).distinct()))  # months: some eighty rows
    facts = s.select("ticker", D.add_business_days(F.col("date"), 1).alias("known_date"), F.col("date").alias("event_date"), "signal")
    return J.as_of(obs, facts, "ticker", "observation_date", "known_date", ["event_date", "signal"])


@query("c2_filing_alignment", f"WITH obs AS (SELECT doc_id AS obs_id, ticker, CAST(date + 7 AS DATE) AS observation_date FROM fil), k AS (SELECT ticker, {bd('date', 1)} AS known_date, doc_id FROM fil) SELECT obs.obs_id, obs.ticker, obs.observation_date, k.known_date, k.doc_id, observation_date - k.known_date AS data_lag_days FROM obs LEFT JOIN (SELECT ticker, known_date, max(doc_id) AS doc_id FROM k GROUP BY 1, 2) k ON k.ticker = obs.ticker AND k.known_date <= obs.observation_date QUALIFY row_number() OVER (PARTITION BY obs.obs_id ORDER BY k.known_date DESC NULLS LAST) = 1", "fil")
def c2(spark, sf):
    f = T.filings(spark, sf)
    obs = f.select(F.col("doc_id").alias("obs_id"), "ticker", F.date_add("date", 7).alias("observation_date"))
    return J.as_of(obs, f.select("ticker", D.add_business_days(F.col("date"), 1).alias("known_date"), "doc_id"), "ticker", "observation_date", "known_date", ["doc_id"])


def forward_sql(prices: str, points: str, days: int, from_entry: bool) -> str:
    until = bd("e.entry_date" if from_entry else "e.signal_date", days)
    return f"e AS (SELECT s.ticker, s.signal_date, min(p.date) AS entry_date, min_by(p.close, p.date) AS entry_price FROM {points} s JOIN {prices} p ON p.ticker = s.ticker AND p.date > s.signal_date GROUP BY 1, 2), fwd AS (SELECT e.ticker, e.signal_date, e.entry_date, e.entry_price, max(p.date) AS exit_date, max_by(p.close, p.date) AS exit_price FROM e JOIN {prices} p ON p.ticker = e.ticker AND p.date > e.entry_date AND p.date <= {until} WHERE e.entry_price > 0 GROUP BY 1, 2, 3, 4)"


FWD = "SELECT ticker, signal_date, entry_date, exit_date, round(exit_price / entry_price - 1, 6) AS forward_return FROM fwd"


def _forward(df):
    return J.with_return(df).select("ticker", "signal_date", "entry_date", "exit_date", R("forward_return").alias("forward_return"))


@query("c3_forward_return_from_entry", f"WITH pt AS (SELECT ticker, date AS signal_date FROM px), {forward_sql('px', 'pt', 5, True)} {FWD}", "px")
def c3(spark, sf):
    p = T.prices(spark, sf)
    return _forward(J.forward_prices(p.select("ticker", F.col("date").alias("signal_date")), p, 5, True))


@query("c4_forward_return_from_signal", f"WITH pt AS (SELECT ticker, date AS signal_date FROM px), {forward_sql('px', 'pt', 5, False)} {FWD}", "px")
def c4(spark, sf):
    p = T.prices(spark, sf)
    return _forward(J.forward_prices(p.select("ticker", F.col("date").alias("signal_date")), p, 5, False))


EV = "pt AS (SELECT ticker, date AS signal_date FROM px WHERE close > 2 * (SELECT avg(close) FROM px))"


@query("c6_self_excluded_market", f"WITH pt AS (SELECT ticker, date AS signal_date FROM px), {forward_sql('px', 'pt', 5, False)}, r AS (SELECT ticker, signal_date, exit_price / entry_price - 1 AS ret FROM fwd) SELECT ticker, signal_date, round(ret, 6) AS ret, round((sum(ret) OVER w - ret) / nullif(count(*) OVER w - 1, 0), 6) AS others FROM r WINDOW w AS (PARTITION BY signal_date)", "px")
def c6(spark, sf):
    p = T.prices(spark, sf)
    r = J.with_return(J.forward_prices(p.select("ticker", F.col("date").alias("signal_date")), p, 5, False))
    return r.select("ticker", "signal_date", R("forward_return").alias("ret"), R(J.others_mean(r, "forward_return", ["signal_date"])).alias("others"))


@query("c7_offset_forward_return", "SELECT ticker, date, round(lead(close, 5) OVER w / nullif(lead(close, 1) OVER w, 0) - 1, 6) AS fwd FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)", "px")
def c7(spark, sf):
    return J.offset_return(T.prices(spark, sf), 5).withColumn("fwd", R("fwd"))


@query("c8_common_dates", "SELECT date, count(*) AS n FROM (SELECT DISTINCT date FROM sig) JOIN (SELECT date, ticker FROM lp) USING (date) GROUP BY 1", "sig lp")
def c8(spark, sf):
    return T.long_prices(spark, sf).join(T.signals(spark, sf).select("date").distinct(), "date").groupBy("date").agg(F.count("*").alias("n"))


@query("c9_tickers_with_prices", "SELECT ticker, date, round(signal, 6) AS signal FROM sig WHERE ticker IN (SELECT ticker FROM px)", "sig px")
def c9(spark, sf):
    return T.signals(spark, sf).join(T.prices(spark, sf), "ticker", "left_semi").withColumn("signal", R("signal"))


@query("c12_left_alignment", "SELECT mr.date, round(mr.ret, 6) AS ret, b.n FROM mr LEFT JOIN (SELECT date_trunc('month', date)::DATE AS date, count(*) AS n FROM sig GROUP BY 1) b USING (date) WHERE b.n IS NOT NULL", "mr sig")
def c12(spark, sf):
    b = T.signals(spark, sf).groupBy(F.to_date(F.trunc("date", "month")).alias("date")).agg(F.count("*").alias("n"))
    return T.monthly_returns(spark, sf).join(b, "date", "left").filter("n is not null").select("date", R("ret").alias("ret"), "n")


@query("c13_nearest_date", "WITH d AS (SELECT DISTINCT ticker AS key, date FROM px), p AS (SELECT key, CAST(min(date) + CAST(r AS INTEGER) AS DATE) AS date FROM d, (SELECT range AS r FROM range(0, 40, 3)) GROUP BY key, r) SELECT p.key, p.date, coalesce((SELECT min(d.date) FROM d WHERE d.key = p.key AND d.date >= p.date), (SELECT max(d.date) FROM d WHERE d.key = p.key AND d.date < p.date)) AS near FROM p", "px")
def c13(spark, sf):
    d = T.prices(spark, sf).select(F.col("ticker").alias("key"), "date")
    p = d.groupBy("key").agg(F.min("date").alias("first")).select("key", F.explode(F.sequence(F.lit(0), F.lit(39), F.lit(3))).alias("r"), "first").select("key", F.date_add("first", F.col("r")).alias("date"))
    return J.nearest_date(p, d)


@query("c14_universe_panel", "SELECT c.d AS date, s.s_suppkey AS ticker, n.n_name AS entity, r.r_name AS sector, s.s_acctbal AS market_cap FROM (SELECT CAST(range AS DATE) AS d FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) c, supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey WHERE isodow(c.d) < 6")
def c14(spark, sf):
    """Weekdays by tickers: each ticker is exploded over the calendar, then joined to its dimensions."""
    days = F.explode(F.filter(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date")), lambda x: F.weekday(x) < 5)).alias("date")
    s = T.table(spark, sf, "supplier").select(days, F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("n_nationkey"), F.col("s_acctbal").alias("market_cap"))
    n, r = T.table(spark, sf, "nation"), T.table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return s.join(n, "n_nationkey", "left").join(r, "n_regionkey", "left").select("date", "ticker", F.col("n_name").alias("entity"), F.col("r_name").alias("sector"), "market_cap")


@query("c15_delisting_enrichment", "SELECT p.ticker, p.date, p.date > d.last AS is_delisted, CASE WHEN p.date <= d.last THEN d.last END AS delisting_date, CASE WHEN p.date <= d.last THEN -0.5 END AS delisting_return FROM px p LEFT JOIN (SELECT ticker, CAST(min(date) + 20 AS DATE) AS last FROM px WHERE ticker % 3 = 0 GROUP BY 1) d USING (ticker)", "px")
def c15(spark, sf):
    p = T.prices(spark, sf)
    gone = p.filter("ticker % 3 = 0").groupBy("ticker").agg(F.date_add(F.min("date"), 20).alias("last"))
    to = F.col("date") <= F.col("last")
    return p.join(gone, "ticker", "left").select("ticker", "date", (F.col("date") > F.col("last")).alias("is_delisted"), F.when(to, F.col("last")).alias("delisting_date"), F.when(to, F.lit(-0.5)).alias("delisting_return"))


@query("c16_removed_items", "WITH w AS (SELECT doc_id, ticker, date, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS words, lead(doc_id) OVER (PARTITION BY ticker ORDER BY date, doc_id) AS next FROM fil) SELECT a.doc_id, b.doc_id AS next_id, round(len(list_intersect(a.words, b.words)) / greatest(1, len(list_distinct(list_concat(a.words, b.words)))), 6) AS similarity, len(list_intersect(a.words, b.words)) < 0.15 * len(list_distinct(list_concat(a.words, b.words))) AS removed FROM w a JOIN w b ON b.doc_id = a.next", "fil")
def c16(spark, sf):
    """Jaccard similarity of each filing's words with the entity's next filing, removed when under 15 %."""
    f = T.filings(spark, sf).select("doc_id", "ticker", "date", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("words"))
    n = f.select("*", F.expr("lead(struct(doc_id, words)) OVER (PARTITION BY ticker ORDER BY date, doc_id) AS nx")).filter("nx is not null")
    both, all_ = F.size(F.array_intersect("words", F.col("nx.words"))), F.size(F.array_union("words", F.col("nx.words")))
    return n.select("doc_id", F.col("nx.doc_id").alias("next_id"), R(both / F.greatest(F.lit(1), all_)).alias("similarity"), (both < 0.15 * all_).alias("removed"))


@query("c18_open_trials", "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) > (SELECT count(*) / count(DISTINCT source) FROM documents))")
def c18(spark, sf):
    """An anti join: documents of the sources that aren't over-represented."""
    d = T.table(spark, sf, "documents")
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    mean = n.agg((F.sum("n") / F.count("*")).alias("m"))
    return d.select("doc_id", "source").join(n.crossJoin(mean).filter("n > m"), "source", "left_anti").select("doc_id", "source")


@query("c19_latest_fundamental", "WITH obs AS (SELECT ticker, CAST(date AS DATE) AS date FROM px WHERE dayofweek(date) = 5) SELECT obs.ticker, obs.date, f.close AS latest, f.date AS asof FROM obs LEFT JOIN (SELECT * FROM px WHERE dayofweek(date) = 1) f ON f.ticker = obs.ticker AND f.date <= obs.date QUALIFY row_number() OVER (PARTITION BY obs.ticker, obs.date ORDER BY f.date DESC NULLS LAST) = 1", "px")
def c19(spark, sf):
    p = T.prices(spark, sf)
    obs = p.filter(F.dayofweek("date") == 6).select("ticker", "date")
    facts = p.filter(F.dayofweek("date") == 2).select("ticker", F.col("date").alias("asof"), F.col("close").alias("latest"))
    return J.as_of(obs, facts, "ticker", "date", "asof", ["latest"]).drop("data_lag_days")


@query("c20_constituents", "SELECT DISTINCT c_custkey AS ticker, c_mktsegment AS index_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate <= TIMESTAMP '1997-06-30'")
def c20(spark, sf):
    o = T.table(spark, sf, "orders").filter(F.col("o_orderdate") <= F.lit("1997-06-30").cast("timestamp_ntz"))
    return T.table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("index_name")).distinct()


@query("i1_ordered_union", "SELECT ticker, min(p) AS first_position FROM (SELECT s_suppkey AS ticker, s_suppkey AS p FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT c_custkey, 1000000 + c_custkey FROM customer) GROUP BY 1")
def i1(spark, sf):
    a = T.table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("ticker"), F.col("s_suppkey").alias("p"))
    b = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), (F.col("c_custkey") + 1_000_000).alias("p"))
    return a.unionByName(b).groupBy("ticker").agg(F.min("p").alias("first_position"))


@query("i2_intersection", "SELECT c_custkey AS ticker FROM customer INTERSECT SELECT o_custkey FROM orders")
def i2(spark, sf):
    return T.table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker")).intersect(T.table(spark, sf, "orders").select("o_custkey"))


@query("i3_difference", "SELECT c_custkey AS ticker FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def i3(spark, sf):
    return T.table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker")).subtract(T.table(spark, sf, "orders").filter("o_totalprice > 250000").select("o_custkey"))


@query("i4_concatenation", "SELECT s_suppkey AS ticker, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def i4(spark, sf):
    a = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_acctbal").alias("balance"))
    b = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("i5_union_without_override", "SELECT s_suppkey AS ticker, 'first' AS origin FROM supplier UNION ALL SELECT c_custkey, 'second' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def i5(spark, sf):
    a = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"), F.lit("first").alias("origin"))
    b = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), F.lit("second").alias("origin"))
    return a.unionByName(b.join(a, "ticker", "left_anti"))
