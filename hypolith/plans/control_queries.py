"""Queries of filters, integrity checks, verdicts, audit and universe building."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hypolith.functions.text import first_match
from hypolith.operators import statistics as S
from hypolith.plans import portfolios as PQ
from hypolith.plans import verdict as V
from hypolith.plans.registry import query
from hypolith.plans.spec import DataSource, HypothesisSpec
from hypolith.plans.statistics_queries import rounded
from hypolith.sources import tables as T

R = lambda c, n=6: F.round(c, n)


@query("b1_universe_filter", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#22') AND p_retailprice >= 950 AND p_size >= 10")
def b1(spark, sf):
    return T.table(spark, sf, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#21", "Brand#22") & (F.col("p_retailprice") >= 950) & (F.col("p_size") >= 10)).select("p_partkey", "p_brand")


@query("b2_standard_tickers", "SELECT doc_id, w AS ticker FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z.-]+'))) AS w FROM documents) WHERE length(w) <= 5 AND regexp_matches(replace(replace(w, '-', ''), '.', ''), '^[A-Za-z]+$') AND NOT regexp_matches(w, '[.-][WRUA]$')")
def b2(spark, sf):
    w = T.table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z.-]+"), 0))).alias("ticker"))
    plain = F.replace(F.replace("ticker", F.lit("-"), F.lit("")), F.lit("."), F.lit("")).rlike("^[A-Za-z]+$")
    return w.filter((F.length("ticker") <= 5) & plain & ~F.col("ticker").rlike("[.-][WRUA]$"))


SECTORS = [("automobile|machinery", "industrial"), ("building|furniture", "consumer"), ("household", "household")]


@query("b3_scope_inference", "SELECT c_custkey, CASE " + " ".join(f"WHEN regexp_matches(lower(c_mktsegment), '{p}') THEN '{n}'" for p, n in SECTORS) + " ELSE 'any' END AS sector, CASE WHEN c_acctbal > 5000 THEN 'large' WHEN c_acctbal > 0 THEN 'mid' ELSE 'small' END AS cap FROM customer")
def b3(spark, sf):
    cap = F.when(F.col("c_acctbal") > 5000, "large").when(F.col("c_acctbal") > 0, "mid").otherwise("small")
    return T.table(spark, sf, "customer").select("c_custkey", first_match(F.col("c_mktsegment"), SECTORS, "any").alias("sector"), cap.alias("cap"))


@query("b4_filing_frequency", "SELECT user_id, CASE WHEN list_contains(list(DISTINCT event_type), 'purchase') THEN 'event' WHEN count(*) > 8 THEN 'quarterly' ELSE 'annual' END AS frequency FROM events GROUP BY 1")
def b4(spark, sf):
    kinds = F.collect_set("event_type")
    f = F.when(F.exists(kinds, lambda x: x == "purchase"), "event").when(F.count("*") > 8, "quarterly").otherwise("annual")
    return T.table(spark, sf, "events").groupBy("user_id").agg(f.alias("frequency"))


ROUTES = [("econ", "pronoun_divergence"), ("medium", "risk_factor_removal"), ("promo", "topic_velocity"), ("large|small", "model")]


@query("b5_extractor_routing", "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_type), '{p}') THEN '{n}'" for p, n in ROUTES) + " ELSE 'linguistic' END AS extractor FROM part")
def b5(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", first_match(F.col("p_type"), ROUTES, "linguistic").alias("extractor"))


@query("b6_best_text", "SELECT d.doc_id, CASE WHEN length(d.text) > 1000 THEN 'text' WHEN length(b.text) > 100 THEN 'benchmark' ELSE 'none' END AS best FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def b6(spark, sf):
    b = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.char_length("text").alias("m"))
    best = F.coalesce(F.when(F.char_length("text") > 1000, "text"), F.when(F.col("m") > 100, "benchmark"), F.lit("none"))
    return T.table(spark, sf, "documents").join(b, "doc_id", "left").select("doc_id", best.alias("best"))


@query("b7_cutoff_split", "SELECT ticker, count_if(date < DATE '1998-01-01') AS before, count_if(date >= DATE '1998-01-01') AS after FROM sig GROUP BY 1", "sig")
def b7(spark, sf):
    return T.signals(spark, sf).groupBy("ticker").agg(F.count_if(F.col("date") < "1998-01-01").alias("before"), F.count_if(F.col("date") >= "1998-01-01").alias("after"))


@query("b8_event_study_detector", "WITH p AS (SELECT ticker, count(*) AS k FROM sig GROUP BY 1), s AS (SELECT count(DISTINCT date) AS d, count(*) AS c FROM sig), t AS (SELECT count(*) AS n, median(k) AS m, count_if(k > 3) AS busy FROM p) SELECT round(c / (d * n), 6) AS density, round(m, 6) AS median_events, c / (d * n) < 0.1 AND (m <= 1.5 OR busy <= 3) AS event_study FROM s, t", "sig")
def b8(spark, sf):
    return rounded(V.is_event_study(T.signals(spark, sf)))


@query("b10_custom_filter", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment <> 'BUILDING'")
def b10(spark, sf):
    return T.table(spark, sf, "customer").filter("c_acctbal between 0 and 5000 and c_mktsegment <> 'BUILDING'").select("c_custkey")


@query("b11_missing_sources", "SELECT DISTINCT source FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'src3')")
def b11(spark, sf):
    known = spark.createDataFrame([(f"src{i}",) for i in range(4)], "source string")
    return T.table(spark, sf, "documents").select("source").distinct().join(F.broadcast(known), "source", "left_anti")  # four literals


@query("j1_look_ahead", "SELECT o_orderkey, CAST(known - observed AS BIGINT) AS days_ahead FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS observed, CAST(o_orderdate + to_days(CAST(o_orderkey % 7 AS INTEGER) - 5) AS DATE) AS known FROM orders) WHERE known > observed")
def j1(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("observed"))
    o = o.withColumn("known", F.date_add("observed", (F.col("o_orderkey") % 7 - 5).cast("int")))
    return o.filter("known > observed").select("o_orderkey", F.datediff("known", "observed").cast("long").alias("days_ahead"))


@query("j2_survivorship_dates", "SELECT date, count(*) AS n FROM lp GROUP BY 1 HAVING count_if(ticker % 9 = 0) = 0", "lp")
def j2(spark, sf):
    """Dates of the panel on which no name is there that was delisted later (here: every ninth)."""
    return T.long_prices(spark, sf).groupBy("date").agg(F.count("*").alias("n"), F.count_if(F.col("ticker") % 9 == 0).alias("gone")).filter("gone = 0").drop("gone")


@query("j3_ticker_reuse", "SELECT o_custkey % 300 AS ticker, count(DISTINCT o_custkey) AS entities, min(o_custkey) AS first, max(o_custkey) AS last FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1")
def j3(spark, sf):
    return T.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 300).alias("ticker")).agg(F.count_distinct("o_custkey").alias("entities"), F.min("o_custkey").alias("first"), F.max("o_custkey").alias("last")).filter("entities > 1")


@query("j4_price_jumps", "SELECT ticker, date, round(r, 6) AS ret FROM (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM lp) WHERE abs(r) > 0.5", "lp")
def j4(spark, sf):
    r = T.long_prices(spark, sf).select("ticker", "date", (F.try_divide("close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))) - 1).alias("ret"))
    return rounded(r.filter(F.abs("ret") > 0.5))


@query("j5_missing_delisting_returns", "SELECT c_custkey AS ticker FROM customer WHERE c_custkey % 13 = 0 AND nullif(c_custkey % 2, 0) IS NULL")
def j5(spark, sf):
    c = T.table(spark, sf, "customer").filter("c_custkey % 13 = 0").select(F.col("c_custkey").alias("ticker"), F.nullif(F.col("c_custkey") % 2, F.lit(0)).alias("r"))
    return c.filter("r is null").select("ticker")


@query("j6_check_runner", "WITH a AS (SELECT count_if(abs(r) > 0.5) AS n FROM (SELECT close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM lp)), b AS (SELECT count(*) AS n FROM (SELECT o_custkey % 300 FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1)), c AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 26 = 0) SELECT 'jumps' AS check_name, n AS issues, n < 10 AS passed FROM a UNION ALL SELECT 'reuse', n, n = 0 FROM b UNION ALL SELECT 'delisting', n, n = 0 FROM c", "lp")
def j6(spark, sf):
    """The results of several checks in one table."""
    one = lambda df, name, most: df.agg(F.count("*").alias("issues")).select(F.lit(name).alias("check_name"), "issues", (F.col("issues") <= most).alias("passed"))
    return one(j4(spark, sf), "jumps", 9).unionByName(one(j3(spark, sf), "reuse", 0)).unionByName(one(j5(spark, sf), "delisting", 0))


@query("j7_completeness", "SELECT source, count(*) AS n, count(l.doc_id) AS labelled, CASE WHEN count(l.doc_id) = count(*) THEN 'FULL' WHEN count(l.doc_id) >= 0.5 * count(*) THEN 'PARTIAL' WHEN count(l.doc_id) > 0 THEN 'MINIMAL' ELSE 'NONE' END AS completeness FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def j7(spark, sf):
    l = T.table(spark, sf, "labels").select("doc_id", F.lit(1).alias("has")).distinct()
    g = T.table(spark, sf, "documents").select("doc_id", "source").join(l, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("has").alias("labelled"))
    level = F.when(F.col("labelled") == F.col("n"), "FULL").when(F.col("labelled") >= 0.5 * F.col("n"), "PARTIAL").when(F.col("labelled") > 0, "MINIMAL").otherwise("NONE")
    return g.withColumn("completeness", level)


@query("j8_contamination_risk", "WITH s AS (SELECT ticker, CASE WHEN max(date) < DATE '2000-01-01' THEN 2 ELSE 0 END + CASE WHEN count(*) > 10 THEN 1 ELSE 0 END + CASE WHEN avg(signal) > 150000 THEN 1 ELSE 0 END AS score FROM sig GROUP BY 1) SELECT ticker, score, CASE WHEN score >= 3 THEN 'HIGH' WHEN score = 2 THEN 'MEDIUM' WHEN score = 1 THEN 'LOW' ELSE 'CLEAN' END AS risk FROM s", "sig")
def j8(spark, sf):
    point = lambda c, n: F.when(c, n).otherwise(0)
    g = T.signals(spark, sf).groupBy("ticker").agg((point(F.max("date") < "2000-01-01", 2) + point(F.count("*") > 10, 1) + point(F.avg("signal") > 150_000, 1)).alias("score"))
    return g.withColumn("risk", F.when(F.col("score") >= 3, "HIGH").when(F.col("score") == 2, "MEDIUM").when(F.col("score") == 1, "LOW").otherwise("CLEAN"))


HALVES = "d AS (SELECT doc_id < (SELECT max(doc_id) // 2 FROM documents) AS early, n_chars, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), r AS (SELECT early, pos, rank() OVER (PARTITION BY early ORDER BY n_chars) + (count(*) OVER (PARTITION BY early, n_chars) - 1) / 2 AS r FROM d), a AS (SELECT early, (sum(CASE WHEN pos THEN r END) - count_if(pos) * (count_if(pos) + 1) / 2) / nullif(count_if(pos) * count_if(NOT pos), 0) AS auc FROM r GROUP BY 1)"


@query("j9_j10_cutoff_comparison", f"WITH {HALVES}, x AS (SELECT max(CASE WHEN early THEN auc END) AS before, max(CASE WHEN NOT early THEN auc END) AS after FROM a) SELECT round(before, 6) AS before, round(after, 6) AS after, round(100 * (before - after) / before, 6) AS drop_pct, CASE WHEN after >= 0.8 * before THEN 'CONSISTENT' ELSE 'DEGRADED' END AS status FROM x")
def j10(spark, sf):
    """How well length tells quality before and after a cut-off."""
    d = T.table(spark, sf, "documents").select("doc_id", "n_chars")
    mid = d.agg(F.floor(F.max("doc_id") / 2)).first()[0]
    a = S.auc(d.join(T.table(spark, sf, "labels"), "doc_id").withColumn("early", F.col("doc_id") < mid), "n_chars", F.col("quality") == 1, ["early"])
    x = a.agg(F.max(F.when(F.col("early"), F.col("auc"))).alias("before"), F.max(F.when(~F.col("early"), F.col("auc"))).alias("after"))
    return rounded(x.withColumns({"drop_pct": 100 * (F.col("before") - F.col("after")) / F.col("before"), "status": F.when(F.col("after") >= 0.8 * F.col("before"), "CONSISTENT").otherwise("DEGRADED")}))


@query("j12_refinement_cap", "SELECT o_custkey AS uuid, count(*) AS trials, least(count(*), 3) AS counted, count(*) > 3 AS stopped FROM orders GROUP BY 1")
def j12(spark, sf):
    return T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("uuid")).agg(F.count("*").alias("trials"), F.least(F.count("*"), F.lit(3)).alias("counted"), (F.count("*") > 3).alias("stopped"))


@query("j13_registry_filter", "SELECT * FROM (VALUES (3, DATE '1996-05-01', 'bankruptcy'), (7, DATE '1999-02-11', 'acquisition'), (9, DATE '2003-01-01', 'voluntary')) v(ticker, gone, reason) WHERE gone BETWEEN (SELECT min(date) FROM sig) AND (SELECT max(date) FROM sig)", "sig")
def j13(spark, sf):
    known = spark.createDataFrame([(3, "1996-05-01", "bankruptcy"), (7, "1999-02-11", "acquisition"), (9, "2003-01-01", "voluntary")], "ticker int, gone string, reason string").withColumn("gone", F.to_date("gone"))
    span = T.signals(spark, sf).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return known.crossJoin(span).filter("gone between a and b").select("ticker", "gone", "reason")  # three rows by one


@query("j15_signal_validation", "SELECT ticker, count(signal) AS cells, count(signal) >= 3 AS valid FROM sig GROUP BY 1", "sig")
def j15(spark, sf):
    return T.signals(spark, sf).groupBy("ticker").agg(F.count("signal").alias("cells"), (F.count("signal") >= 3).alias("valid"))


METRICS = "m AS (SELECT o_custkey AS k, count(*) AS n, avg(o_totalprice) / 1e4 - 10 AS low, avg(o_totalprice) / 1e4 + 10 AS high, avg(o_totalprice) / 100 AS alpha_bps, 1000.0 AS min_alpha_bps, avg(o_totalprice) / nullif(stddev_samp(o_totalprice), 0) AS sharpe, 0.5 AS min_sharpe, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) AS hit_rate, 0.3 AS min_hit_rate, -0.2 AS max_drawdown, 0.5 AS max_drawdown_allowed, (o_custkey % 10) / 100.0 AS p_value, (o_custkey % 5) / 4.0 AS consistency, (o_custkey % 4) / 3.0 AS robust_share, o_custkey % 11 = 0 AS recycling FROM orders GROUP BY o_custkey)"


@query("v1_verdict_tree", f"WITH {METRICS}, r AS (SELECT k, n, CASE " + " ".join(f"WHEN NOT coalesce({ok}, false) THEN '{name}'" for name, ok in V.GATES) + " END AS reason FROM m) SELECT k, reason, CASE WHEN n < 2 THEN 'UNTESTABLE' WHEN reason IS NULL THEN 'SURVIVED' ELSE 'BROKEN' END AS verdict FROM r")
def v1(spark, sf):
    k, mean = F.col("o_custkey"), F.avg("o_totalprice")
    m = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (mean / 1e4 - 10).alias("low"), (mean / 1e4 + 10).alias("high"), (mean / 100).alias("alpha_bps"), (mean / F.nullif(F.stddev_samp("o_totalprice"), F.lit(0.0))).alias("sharpe"), F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("hit_rate"))
    m = m.withColumns({"k": k, "min_alpha_bps": F.lit(1000.0), "min_sharpe": F.lit(0.5), "min_hit_rate": F.lit(0.3), "max_drawdown": F.lit(-0.2), "max_drawdown_allowed": F.lit(0.5), "p_value": k % 10 / 100, "consistency": k % 5 / 4, "robust_share": k % 4 / 3, "recycling": k % 11 == 0})
    return V.verdict_columns(m).select("k", "reason", "verdict")


@query("v2_end_to_end_verdict")
def v2(spark, sf):
    """One hypothesis from spec to verdict: the weekly reversal on daily prices."""
    spec = HypothesisSpec("weekly reversal", "00000000-reversal", data_sources=[DataSource("events")])
    spec = HypothesisSpec.from_json(spec.to_json())
    return V.evaluate(spark, spec, PQ.reversal(spark, sf), T.prices(spark, sf))


@query("v5_audit_hashes", "SELECT l_returnflag, count(*) AS n, sha256(concat_ws('|', l_returnflag, CAST(count(*) AS VARCHAR), CAST(sum(l_linenumber) AS VARCHAR))) AS entry_hash FROM lineitem GROUP BY 1")
def v5(spark, sf):
    g = T.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))
    return g.select("l_returnflag", "n", F.sha2(F.concat_ws("|", "l_returnflag", "n", "s").cast("binary"), 256).alias("entry_hash"))


@query("v10_trial_outcomes", "SELECT o_orderstatus AS verdict, o_orderpriority AS family, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority), ())")
def v10(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("verdict"), F.col("o_orderpriority").alias("family"))
    return o.groupingSets([["verdict"], ["verdict", "family"], []], "verdict", "family").agg(F.count("*").alias("n"))


#: What providers of universes leave out.
BIASES = (("yahoo", "no delisted names", "HIGH"), ("sec", "filers only", "LOW"), ("fmp", "current constituents", "MEDIUM"))


@query("v9_bias_catalogue", "SELECT * FROM (VALUES ('yahoo', 'no delisted names', 'HIGH'), ('sec', 'filers only', 'LOW'), ('fmp', 'current constituents', 'MEDIUM')) v(provider, bias, severity)")
def v9(spark, sf):
    return spark.createDataFrame(BIASES, "provider string, bias string, severity string")


#: Hypotheses in words, made from the parts' names: their mechanism, and the name of their signal.
IDEAS_COLUMNS = (
    "p_partkey",
    "lower(p_name) || CASE p_partkey % 9 WHEN 0 THEN ' in the tech sector, large cap' WHEN 1 THEN ' at a regional bank, by 8-k' WHEN 2 THEN ' of an oil company, 10-q and 10-k' WHEN 3 THEN ' in a drug trial before fda approval, small cap' WHEN 4 THEN ' of a restaurant chain, annual' WHEN 5 THEN ' on departure' ELSE '' END AS mechanism",
    "CASE p_partkey % 8 WHEN 0 THEN 'pronoun shift' WHEN 1 THEN 'risk_factor_removal score' WHEN 2 THEN 'cam_velocity' WHEN 3 THEN 'departure severity' WHEN 4 THEN 'sentiment_trajectory' ELSE 'hedging' END AS signal_name",
    "CASE p_partkey % 7 WHEN 0 THEN 'transcript' WHEN 1 THEN 'sec_filing' ELSE 'prices' END AS source_type",
    "CASE p_partkey % 5 WHEN 0 THEN '10-K,8-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '8-K' WHEN 3 THEN '10-K' ELSE '' END AS forms",
)
IDEAS = ", ".join(IDEAS_COLUMNS)
#: Words of a sector, in order; words of large and of small companies.
SECTOR_WORDS = [("pharma|biotech|healthcare|medical device|drug trial|fda approval", "healthcare"), ("software company|semiconductor|saas business|tech sector", "technology"), ("bank stock|insurance company|fintech|regional bank", "financial"), ("oil company|gas producer|renewable energy|utility sector", "energy"), ("retail sector|consumer goods|restaurant chain", "consumer")]
LARGE, SMALL = "large cap|mega cap|s&p 500|sp500|spx", "small cap|mid cap|russell 2000"
#: Extractors by a part of the signal's name, in order.
EXTRACTORS = [("pronoun", "pronoun_divergence"), ("risk_factor_removal|risk_factor_clean", "risk_factor_removal"), ("cam_expansion|cam_velocity", "cam_expansion"), ("departure|severity|credibility|echo|coherence|fragility|scripted|semantic|pivot|sentiment_trajectory", "llm")]


def rules_sql(x, rules, otherwise):
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for p, n in rules) + f" ELSE {otherwise} END"


def _ideas(spark, sf):
    return T.table(spark, sf, "part").selectExpr(*IDEAS_COLUMNS)


@query("b3_hypothesis_scope", f"SELECT p_partkey, {rules_sql('mechanism', SECTOR_WORDS, 'NULL')} AS sector, CASE WHEN regexp_matches(mechanism, '{SMALL}') THEN 50000000 WHEN regexp_matches(mechanism, '{LARGE}') THEN 10000000000 ELSE 300000000 END AS min_market_cap, coalesce({rules_sql('mechanism', SECTOR_WORDS, 'NULL')} || ' sector stocks', 'all US listed equities') || CASE WHEN regexp_matches(mechanism, '10-k|annual') THEN ' filing 10-Ks' ELSE '' END || CASE WHEN regexp_matches(mechanism, '8-k|departure') THEN ' filing 8-Ks' ELSE '' END || CASE WHEN regexp_matches(mechanism, '{LARGE}') THEN ', large cap' ELSE '' END || CASE WHEN regexp_matches(mechanism, '{SMALL}') THEN ', small/mid cap' ELSE '' END AS description FROM (SELECT {IDEAS} FROM part)")
def b3_scope(spark, sf):
    """Sector, least market value and description of the names that a hypothesis is about, from its words."""
    m = F.col("mechanism")
    sector = F.nullif(first_match(m, SECTOR_WORDS, "none"), F.lit("none"))
    says = lambda p, text: F.when(m.rlike(p), text).otherwise("")
    cap = F.when(m.rlike(SMALL), 50_000_000).when(m.rlike(LARGE), 10_000_000_000).otherwise(300_000_000)
    told = F.concat(F.coalesce(F.concat(sector, F.lit(" sector stocks")), F.lit("all US listed equities")), says("10-k|annual", " filing 10-Ks"), says("8-k|departure", " filing 8-Ks"), says(LARGE, ", large cap"), says(SMALL, ", small/mid cap"))
    return _ideas(spark, sf).select("p_partkey", sector.alias("sector"), cap.alias("min_market_cap"), told.alias("description"))


@query("b4_forms_and_frequency", "WITH h AS (SELECT p_partkey, CASE WHEN source_type = 'sec_filing' AND forms <> '' THEN forms WHEN regexp_matches(mechanism, '8-k|item 5.02') THEN '8-K' WHEN contains(mechanism, '10-q') THEN '10-Q' WHEN contains(mechanism, '10-k') THEN '10-K' ELSE '10-K,10-Q' END AS forms FROM (SELECT " + IDEAS + " FROM part)) SELECT p_partkey, forms, CASE WHEN regexp_matches(forms, '10-?Q') OR (regexp_matches(forms, '10-?K') AND regexp_matches(forms, '8-?K')) THEN 'quarterly' WHEN regexp_matches(forms, '8-?K') THEN 'event_driven' ELSE 'annual' END AS frequency FROM h")
def b4_forms(spark, sf):
    """The forms that a hypothesis reads, by its source's fields or its words, and how often they come."""
    m = F.col("mechanism")
    forms = F.when((F.col("source_type") == "sec_filing") & (F.col("forms") != ""), F.col("forms")).when(m.rlike("8-k|item 5.02"), "8-K").when(F.contains(m, F.lit("10-q")), "10-Q").when(F.contains(m, F.lit("10-k")), "10-K").otherwise("10-K,10-Q")
    h = _ideas(spark, sf).select("p_partkey", forms.alias("forms"))
    has = lambda p: F.col("forms").rlike(p)
    return h.withColumn("frequency", F.when(has("10-?Q") | (has("10-?K") & has("8-?K")), "quarterly").when(has("8-?K"), "event_driven").otherwise("annual"))


@query("b5_extractor_rules", f"SELECT p_partkey, {rules_sql('lower(signal_name)', EXTRACTORS, "CASE WHEN source_type = 'transcript' THEN 'llm' ELSE 'linguistic' END")} AS extractor FROM (SELECT {IDEAS} FROM part)")
def b5_rules(spark, sf):
    """The extractor by the signal's name, else by its source."""
    named = F.nullif(first_match(F.col("signal_name"), EXTRACTORS, "none"), F.lit("none"))
    return _ideas(spark, sf).select("p_partkey", F.coalesce(named, F.when(F.col("source_type") == "transcript", "llm"), F.lit("linguistic")).alias("extractor"))
