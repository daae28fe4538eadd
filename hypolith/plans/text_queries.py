"""Queries of text features, sections, transcripts, JSON and sources. Lexicons are parameters: the given prose is invented."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hypolith.functions import text as X
from hypolith.operators import names as N
from hypolith.plans.registry import query
from hypolith.sources import tables as T

R = lambda c, n=6: F.round(c, n)
#: Words of the invented prose that stand for the lexicons, so that the counts aren't all zero.
HEDGE, SURE = ("is", "be", "was", "of the"), ("the", "all", "it is")

SPACED = "(' ' || regexp_replace(regexp_replace(lower({t}), '[^a-z0-9%<=-]+', '  ', 'g'), '^ +| +$', '', 'g') || ' ')"


def count_sql(pattern: str, text: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({SPACED.format(t=text)}, ' {pattern} ')) AS BIGINT)"


def phrases_sql(phrases: tuple[str, ...], text: str = "text") -> str:
    return count_sql("(?:" + "|".join(p.replace(" ", " +") for p in phrases) + ")", text)


SENT = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', E'\\1\x01\\2', 'g'), E'\x01'), lambda s: len(regexp_split_to_array(trim(s), '\s+')) >= 3)"
WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@query("t3_t4_sentences_and_words", f"SELECT doc_id, CAST(len({SENT}) AS INTEGER) AS n_sentences, CAST(len({WORDS}) AS INTEGER) AS n_words FROM documents")
def t3(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"), F.size(X.words(F.col("text"))).alias("n_words"))


SYL = "CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(w, 'e$', ''), '[aeiouy]+'))) END"


@query("t5_t6_syllables", f"SELECT doc_id, CAST(coalesce(list_sum(list_transform({WORDS}, lambda w: {SYL})), 0) AS BIGINT) AS n_syllables, CAST(len(list_filter({WORDS}, lambda w: {SYL} >= 3)) AS INTEGER) AS n_complex FROM documents")
def t5(spark, sf):
    w = X.words(F.col("text"))
    d = T.table(spark, sf, "documents").select("doc_id", F.transform(w, X.syllables).alias("s"))
    return d.select("doc_id", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_syllables"), F.size(F.filter("s", lambda x: x >= 3)).alias("n_complex"))


@query("t7_t8_densities", f"SELECT doc_id, round({phrases_sql(HEDGE)} / greatest(1, len({SENT})), 6) AS hedge_density, round({phrases_sql(SURE)} / greatest(1, len({SENT})), 6) AS certainty_density FROM documents")
def t7(spark, sf):
    t, n = F.col("text"), F.greatest(F.lit(1), F.size(X.sentences(F.col("text"))))
    return T.table(spark, sf, "documents").select("doc_id", R(X.phrase_count(t, HEDGE) / n).alias("hedge_density"), R(X.phrase_count(t, SURE) / n).alias("certainty_density"))


PASS = " + ".join(count_sql(p.replace(r"\s+", " +")) for p in X.PASSIVES)


@query("t9_passive", f"SELECT doc_id, {PASS} AS passive, greatest(0, len({SENT}) - ({PASS})) AS active FROM documents")
def t9p(spark, sf):
    p = X.passive_count(F.col("text"))
    return T.table(spark, sf, "documents").select("doc_id", p.alias("passive"), F.greatest(F.lit(0).cast("long"), F.size(X.sentences(F.col("text"))) - p).alias("active"))


READ = f"b AS (SELECT doc_id, len({WORDS}) AS w, len({SENT}) AS s, coalesce(list_sum(list_transform({WORDS}, lambda w: {SYL})), 0) AS y FROM documents), v AS (SELECT * FROM b WHERE w > 0 AND s > 0)"


def _readable(spark, sf):
    t = F.col("text")
    b = T.table(spark, sf, "documents").select("doc_id", X.words(t).alias("w"), F.size(X.sentences(t)).alias("s"))
    return b.select("doc_id", F.size("w").alias("w"), "s", F.aggregate(F.transform("w", X.syllables), F.lit(0).cast("long"), lambda a, x: a + x).alias("y")).filter("w > 0 and s > 0")


@query("t10_readability", f"WITH {READ} SELECT doc_id, round(0.39 * w / s + 11.8 * y / w - 15.59, 6) AS flesch_kincaid, round(206.835 - 1.015 * w / s - 84.6 * y / w, 6) AS reading_ease, round(4.71 * (w / s) + 0.5 * (w / s) - 21.43, 6) AS ari FROM v")
def t10(spark, sf):
    w, s, y = F.col("w"), F.col("s"), F.col("y")
    return _readable(spark, sf).select("doc_id", R(0.39 * w / s + 11.8 * y / w - 15.59).alias("flesch_kincaid"), R(206.835 - 1.015 * w / s - 84.6 * y / w).alias("reading_ease"), R(4.71 * (w / s) + 0.5 * (w / s) - 21.43).alias("ari"))


PR = {k: phrases_sql(v) for k, v in X.PRONOUNS.items()}


@query("t11_pronouns", f"SELECT doc_id, {', '.join(f'{v} AS n_{k}' for k, v in PR.items())} FROM documents")
def t11(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", *(v.alias(f"n_{k}") for k, v in X.pronoun_counts(F.col("text")).items()))


IT = {"it": ("it",), "he": ("he",), "she": ("she", "her")}


@query("t23_pronoun_ratio", f"SELECT doc_id, CASE WHEN it + he >= 2 THEN round(it / (it + he), 6) END AS ratio FROM (SELECT doc_id, {phrases_sql(('it',))} AS it, {phrases_sql(('he',))} AS he FROM documents)")
def t23(spark, sf):
    it, he = X.phrase_count(F.col("text"), ("it",)), X.phrase_count(F.col("text"), ("he",))
    return T.table(spark, sf, "documents").select("doc_id", F.when(it + he >= 2, R(it / (it + he))).alias("ratio"))


@query("t13_composites", f"WITH f AS (SELECT doc_id, {phrases_sql(HEDGE)} AS h, {phrases_sql(SURE)} AS c, {PASS} AS p, greatest(1, len({SENT})) AS s FROM documents) SELECT doc_id, round(h / s - c / s + 0.5 * p / s, 6) AS score FROM f")
def t13(spark, sf):
    t, n = F.col("text"), F.greatest(F.lit(1), F.size(X.sentences(F.col("text"))))
    h, c, p = X.phrase_count(t, HEDGE), X.phrase_count(t, SURE), X.passive_count(t)
    return T.table(spark, sf, "documents").select("doc_id", R(h / n - c / n + 0.5 * p / n).alias("score"))


@query("t14_signal_frame", f"SELECT ticker, date_trunc('month', date)::DATE AS date, round(avg({phrases_sql(HEDGE)}), 6) AS signal FROM fil GROUP BY 1, 2", "fil")
def t14(spark, sf):
    f = T.filings(spark, sf).withColumn("h", X.phrase_count(F.col("text"), HEDGE))
    return f.groupBy("ticker", F.to_date(F.trunc("date", "month")).alias("date")).agg(R(F.avg("h")).alias("signal"))


@query("t15_last_section", "SELECT doc_id, CASE WHEN len(x) > 1 AND length(x[-1]) > 100 THEN length(x[-1]) END AS section_chars FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)")
def t15(spark, sf):
    """The section after the last heading (here: line break), kept over 100 characters."""
    x = F.split("text", "\n", -1)
    n = F.char_length(F.element_at(x, -1)).cast("long")
    return T.table(spark, sf, "documents").select("doc_id", F.when((F.size(x) > 1) & (n > 100), n).alias("section_chars"))


@query("t16_itemise", "SELECT doc_id, CAST(CASE WHEN len(a) >= 3 THEN len(a) ELSE len(b) END AS INTEGER) AS n_items, CASE WHEN len(a) >= 3 THEN 'lines' ELSE 'sentences' END AS kind FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 50) AS a, list_filter(string_split(text, '. '), lambda x: length(x) > 20) AS b FROM documents)")
def t16(spark, sf):
    a = F.filter(F.split("text", "\n", -1), lambda x: F.char_length(x) > 50)
    b = F.filter(F.split("text", r"\. ", -1), lambda x: F.char_length(x) > 20)
    some = F.size(a) >= 3
    return T.table(spark, sf, "documents").select("doc_id", F.when(some, F.size(a)).otherwise(F.size(b)).alias("n_items"), F.when(some, "lines").otherwise("sentences").alias("kind"))


LONG = "list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))"


@query("t17_t18_jaccard_with_benchmark", f"WITH b AS (SELECT item_id, {LONG} AS w FROM benchmark), d AS (SELECT doc_id, {LONG} AS w FROM documents WHERE doc_id % 50 = 0), p AS (SELECT doc_id, item_id, len(list_intersect(d.w, b.w)) AS i, len(d.w) + len(b.w) AS n FROM d, b) SELECT doc_id, max(CASE WHEN n - i > 0 THEN round(i / (n - i), 6) END) AS best FROM p WHERE i > 0 GROUP BY 1")
def t17(spark, sf):
    """The best similarity of queried documents (every fiftieth id) with benchmark items, joined on shared words."""
    w = lambda d, k: d.select(k, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("w"))
    d = w(T.table(spark, sf, "documents").filter("doc_id % 50 = 0"), "doc_id").select("doc_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    b = w(T.table(spark, sf, "benchmark"), "item_id").select("item_id", F.size("w").alias("m"), F.explode("w").alias("word"))
    both = d.join(b, "word").groupBy("doc_id", "item_id", "n", "m").agg(F.count("*").alias("i"))
    return both.groupBy("doc_id").agg(F.max(R(F.col("i") / (F.col("n") + F.col("m") - F.col("i")))).alias("best"))


@query("t19_isolated_section", "SELECT doc_id, CASE WHEN p > 0 THEN length(substr(text, p, 15000)) END AS section_chars FROM (SELECT doc_id, text, instr(text, ' the ') AS p FROM documents)")
def t19(spark, sf):
    p = F.instr("text", " the ")
    return T.table(spark, sf, "documents").select("doc_id", F.when(p > 0, F.char_length(F.substring(F.col("text"), p, F.lit(15_000))).cast("long")).alias("section_chars"))


@query("t20_paragraphs", "SELECT doc_id, i AS paragraph, length(x) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(trim(x)) > 40")
def t20(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x")).filter(F.char_length(F.trim("x")) > 40)
    return d.select("doc_id", (F.col("i") + 1).cast("long").alias("paragraph"), F.char_length("x").cast("long").alias("n_chars"))


TOPICS = [("token|secret|password", "credentials"), ("license|copyright", "legal"), ("edi|ing", "activity"), ("eau|oux", "water")]


@query("t21_topics", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for p, n in TOPICS) + " ELSE 'other' END AS topic FROM documents")
def t21(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.first_match(F.col("text"), TOPICS, "other").alias("topic"))


TSET = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for p, n in TOPICS) + "], lambda x: x IS NOT NULL)"


@query("t22_topic_velocity", f"WITH f AS (SELECT doc_id, ticker, date, {TSET} AS t FROM fil), p AS (SELECT *, lag(t) OVER (PARTITION BY ticker ORDER BY date, doc_id) AS was FROM f) SELECT doc_id, CAST(len(list_filter(t, lambda x: NOT list_contains(was, x))) + 0.5 * greatest(0, len(t) - len(was)) AS DOUBLE) AS velocity FROM p WHERE was IS NOT NULL", "fil")
def t22(spark, sf):
    t = F.array_compact(F.array(*(F.when(F.lower("text").rlike(p), n) for p, n in TOPICS)))
    f = T.filings(spark, sf).select("doc_id", "ticker", "date", t.alias("t")).withColumn("was", F.lag("t").over(Window.partitionBy("ticker").orderBy("date", "doc_id"))).filter("was is not null")
    return f.select("doc_id", (F.size(F.array_except("t", "was")) + 0.5 * F.greatest(F.lit(0), F.size("t") - F.size("was"))).alias("velocity"))


@query("t24_question_section", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN turn >= 1 THEN length(text) ELSE 0 END) AS BIGINT) AS qa_chars, sum(CASE WHEN turn >= 1 THEN length(text) ELSE 0 END) >= 500 AS has_qa FROM conversations WHERE role <> 'system' GROUP BY 1")
def t24(spark, sf):
    c = T.table(spark, sf, "conversations").filter("role <> 'system'").select("conv_id", F.char_length("text").cast("long").alias("n"), (F.col("turn") >= 1).alias("qa"))
    qa = F.sum(F.when(F.col("qa"), F.col("n")).otherwise(0))
    return c.groupBy("conv_id").agg(F.sum("n").alias("n_chars"), qa.alias("qa_chars"), (qa >= 500).alias("has_qa"))


@query("t25_detect_documents", r"SELECT page_id, regexp_matches(url, '/en/') AS is_transcript, length(regexp_extract(html, '(?s)<article>(.*?)</article>', 1)) AS body_chars FROM pages")
def t25(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", F.col("url").rlike("/en/").alias("is_transcript"), F.char_length(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)).cast("long").alias("body_chars"))


@query("t26_segment_transcript", "WITH s AS (SELECT conv_id, sum(CASE WHEN turn = 0 THEN length(text) ELSE 0 END) AS prepared, sum(CASE WHEN turn > 0 THEN length(text) ELSE 0 END) AS qa FROM conversations GROUP BY 1) SELECT conv_id, CAST(prepared AS BIGINT) AS prepared, CAST(qa AS BIGINT) AS qa FROM s WHERE NOT (prepared > 2000 AND qa < 0.1 * prepared)")
def t26(spark, sf):
    part = lambda on: F.sum(F.when(on, F.char_length("text").cast("long")).otherwise(0))
    s = T.table(spark, sf, "conversations").groupBy("conv_id").agg(part(F.col("turn") == 0).alias("prepared"), part(F.col("turn") > 0).alias("qa"))
    return s.filter("not (prepared > 2000 and qa < 0.1 * prepared)")


@query("t27_speakers", "SELECT conv_id, count(DISTINCT role) FILTER (role <> 'system') AS speakers FROM conversations GROUP BY 1")
def t27(spark, sf):
    return T.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_distinct(F.when(F.col("role") != "system", F.col("role"))).alias("speakers"))


@query("t29_tolerant_json", "SELECT event_id, CAST(coalesce(json_extract_string(CASE WHEN json_valid(j) THEN j END, '$.k'), nullif(regexp_extract(j, '\"k\"\\s*:\\s*(-?\\d+)', 1), '')) AS BIGINT) AS k FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'json ' || replace(props, '}', ',}') ELSE props END AS j FROM events)")
def t29(spark, sf):
    """The field by a JSON path where the text parses, else by a pattern."""
    j = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("json "), F.replace("props", F.lit("}"), F.lit(",}")))).otherwise(F.col("props"))
    e = T.table(spark, sf, "events").select("event_id", j.alias("j"))
    return e.select("event_id", F.coalesce(F.get_json_object("j", "$.k"), F.nullif(F.regexp_extract("j", r'"k"\s*:\s*(-?\d+)', 1), F.lit(""))).cast("long").alias("k"))


REASONS = [("acquir|merger|buyout", "acquisition"), ("bankrupt|chapter 11|chapter 7", "bankruptcy"), ("liquidat", "liquidation"), ("voluntar|going private|deregister", "voluntary"), ("exchange|nasdaq|nyse|delist", "exchange_delisting")]
#: Returns by reason where no final price is known.
REASON_RETURN = {"bankruptcy": -1.0, "liquidation": -0.8, "acquisition": 0.15, "voluntary": 0.1, "exchange_delisting": -0.3, "unknown": -0.5}
NOTES = "list_value('Acquired by a rival', 'Chapter 11 filing', 'Voluntary exit', 'NYSE rules', 'no note')[1 + c_custkey % 5]"


@query("t30_t31_delisting", f"WITH d AS (SELECT c_custkey AS ticker, CASE {' '.join(f'WHEN regexp_matches(lower({NOTES}), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{n}{chr(39)}' for p, n in REASONS)} ELSE 'unknown' END AS reason, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS final, abs(c_acctbal) + 100 AS prev FROM customer) SELECT ticker, reason, round(coalesce(final / prev - 1, CASE reason {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in REASON_RETURN.items())} END), 6) AS delisting_return FROM d")
def t30(spark, sf):
    note = F.element_at(F.array(*map(F.lit, ("Acquired by a rival", "Chapter 11 filing", "Voluntary exit", "NYSE rules", "no note"))), (1 + F.col("c_custkey") % 5).cast("int"))
    d = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), X.first_match(note, REASONS, "unknown").alias("reason"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal")).alias("final"), (F.abs("c_acctbal") + 100).alias("prev"))
    table = F.create_map(*(F.lit(x) for kv in REASON_RETURN.items() for x in kv))
    return d.select("ticker", "reason", R(F.coalesce(F.col("final") / F.col("prev") - 1, table[F.col("reason")])).alias("delisting_return"))


@query("a26_strip_html", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages")
def a26(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", X.stripped_html(F.col("html")).alias("text"))


@query("a11_links", "SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY 1, 2")
def a11(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("a2_filing_scan", "SELECT doc_id, ticker, date FROM fil WHERE doc_id % 3 < 2 AND date BETWEEN DATE '2020-01-10' AND DATE '2021-06-30' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC, doc_id) <= 6", "fil")
def a2(spark, sf):
    f = T.filings(spark, sf).select("doc_id", "ticker", "date").filter("doc_id % 3 < 2 and date between date'2020-01-10' and date'2021-06-30'")  # two of three forms
    return f.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"), "doc_id"))).filter("k <= 6").drop("k")


@query("a3_cik_lookup", "SELECT o_orderkey, coalesce(lpad(CAST(c_custkey AS VARCHAR), 10, '0'), 'none') AS cik FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def a3(spark, sf):
    c = T.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"))
    return T.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("cik", F.lit("none")).alias("cik"))


@query("a4_recent_filings", "SELECT lang AS form, doc_id FROM documents WHERE lang IN ('en', 'fr') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) <= 10")
def a4(spark, sf):
    d = T.table(spark, sf, "documents").filter(F.col("lang").isin("en", "fr")).select(F.col("lang").alias("form"), "doc_id")
    return d.withColumn("k", F.row_number().over(Window.partitionBy("form").orderBy(F.desc("doc_id")))).filter("k <= 10").drop("k")


@query("a7_price_loader", "SELECT p.ticker, p.date, round(coalesce(CASE WHEN p.ticker % 2 = 0 THEN p.close END, l.close), 6) AS close FROM px p JOIN (SELECT ticker, max_by(close, date) AS close FROM lp GROUP BY 1 HAVING count(close) > 0) l USING (ticker)", "px lp")
def a7(spark, sf):
    """An adjusted price where there is one, else the plain one; tickers without any price are left out."""
    l = T.long_prices(spark, sf).groupBy("ticker").agg(F.max_by("close", "date").alias("plain"), F.count("close").alias("n")).filter("n > 0")
    return T.prices(spark, sf).join(l, "ticker").select("ticker", "date", R(F.coalesce(F.when(F.col("ticker") % 2 == 0, F.col("close")), F.col("plain"))).alias("close"))


@query("a8_market_caps", "SELECT DISTINCT p.ticker, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal * 1e6 END, 1e10) AS cap FROM lp p LEFT JOIN supplier ON s_suppkey = p.ticker AND s_suppkey % 3 > 0", "lp")
def a8(spark, sf):
    s = T.table(spark, sf, "supplier").filter("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("ticker"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 1e6).alias("c"))
    return T.long_prices(spark, sf).select("ticker").distinct().join(s, "ticker", "left").select("ticker", F.coalesce("c", F.lit(1e10)).alias("cap"))


@query("a9_a10_applications", "SELECT ticker, event_type, event_id, k FROM (SELECT user_id AS ticker, event_type, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1 AND k IS NOT NULL")
def a9(spark, sf):
    e = T.table(spark, sf, "events").select(F.col("user_id").alias("ticker"), "event_type", "event_id", "ts", F.from_json("props", "k long")["k"].alias("k"))
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("ticker", "event_type").orderBy("ts", "event_id"))).filter("rn = 1 and k is not null").select("ticker", "event_type", "event_id", "k")


@query("a12_section_split", "SELECT doc_id, i AS first_line, CAST(len(x) AS INTEGER) AS n_lines FROM (SELECT doc_id, string_split(text, chr(10)) AS x, list_position(list_transform(string_split(text, chr(10)), lambda s: regexp_matches(s, 'ing')), true) AS i FROM documents)")
def a12(spark, sf):
    """The first line that matches a heading (null without one) and the number of lines."""
    x = F.split("text", "\n", -1)
    i = F.nullif(F.array_position(F.transform(x, lambda s: s.rlike("ing")), True), F.lit(0))
    return T.table(spark, sf, "documents").select("doc_id", i.cast("int").alias("first_line"), F.size(x).alias("n_lines"))


def _norm_sql(c: str) -> str:
    for pattern, new in N.CLEANED:
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return f"trim({c})"


#: Companies and sponsors by expressions over the given tables: each supplier writes a customer's name in one of six ways.
_CODE = "substr(md5(c_name), 1, 12)"
TITLE = f"{_CODE} || ' ' || lower(c_mktsegment) || ' Inc'"
SPONSOR = (
    f"CASE s_suppkey % 6 WHEN 0 THEN upper({_CODE}) || ' ' || c_mktsegment || ' INC ' WHEN 1 THEN 'The ' || {_CODE} || ' ' || c_mktsegment || ' Laboratories, Ltd.' "
    f"WHEN 2 THEN 'Onyx Pharms ' || {_CODE} || '  ' || c_mktsegment WHEN 3 THEN {_CODE} || ' Corp' WHEN 4 THEN substr({_CODE}, 1, 10) || 'zz gmbh' ELSE s_name END"
)
SPONSOR_RANK = (
    "CASE WHEN upper(trim(s.name)) = upper(trim(c.title)) THEN 1 WHEN s.norm = c.norm THEN 2 WHEN c.norm <> '' AND s.norm <> '' AND (contains(s.norm, c.norm) OR contains(c.norm, s.norm)) THEN 3 "
    "WHEN s.norm <> '' AND (contains(upper(c.title), left(s.norm, 10)) OR contains(s.norm, left(upper(c.title), 10))) THEN 4 END"
)


@query("a13_fuzzy_sponsor", f"WITH s AS (SELECT *, {_norm_sql('upper(trim(name))')} AS norm FROM (SELECT s_suppkey, {SPONSOR} AS name FROM supplier JOIN customer ON c_custkey = s_suppkey)), c AS (SELECT *, {_norm_sql('upper(trim(title))')} AS norm FROM (SELECT {TITLE} AS title, c_custkey AS value FROM customer)), p AS (SELECT s_suppkey, {SPONSOR_RANK} AS rank, value FROM s CROSS JOIN c) SELECT s_suppkey, CAST(rank AS INTEGER) AS rank, value AS ticker FROM p WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY rank, value) = 1")
def a13(spark, sf):
    """Each supplier's company: the same name, the same when normalised, one in the other, or alike at the begin, in this order."""
    customer = T.table(spark, sf, "customer")
    c = customer.selectExpr(f"{TITLE} AS title", "c_custkey AS value")
    s = T.table(spark, sf, "supplier").join(customer, F.col("c_custkey") == F.col("s_suppkey")).selectExpr("s_suppkey", f"{SPONSOR} AS name")
    return s.join(N.matched_names(s.select("name"), c), "name").select("s_suppkey", "rank", F.col("value").alias("ticker"))


STATUS = {"F": "APPROVED", "P": "PENDING", "O": "CRL"}


@query("a14_status_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'CRL' ELSE 'UNKNOWN' END AS decision FROM orders")
def a14(spark, sf):
    m = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return T.table(spark, sf, "orders").select("o_orderkey", F.coalesce(m[F.col("o_orderstatus")], F.lit("UNKNOWN")).alias("decision"))


@query("a15_macro_pivot", "SELECT CAST(ts AS DATE) AS date, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view FROM events GROUP BY 1")
def a15(spark, sf):
    e = T.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    return e.select("date", R("click").alias("click"), R("view").alias("view"))


@query("a17_cached_filing_scan", "SELECT doc_id, source, date FROM (SELECT doc_id, source, coalesce(try_strptime(nullif(regexp_extract(text, '(20[0-9]{2}-[01][0-9]-[0-3][0-9])', 1), ''), '%Y-%m-%d')::DATE, DATE '2020-01-01' + CAST(doc_id AS INTEGER))::DATE AS date, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE length(text) >= 1000) WHERE k <= 6")
def a17(spark, sf):
    d = T.table(spark, sf, "documents").filter(F.char_length("text") >= 1000)
    day = F.try_to_timestamp(F.nullif(F.regexp_extract("text", "(20[0-9]{2}-[01][0-9]-[0-3][0-9])", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    d = d.select("doc_id", "source", F.coalesce(day, F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int"))).alias("date"))
    return d.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("k <= 6").drop("k")


@query("a19_ticker_master", "SELECT c_custkey AS cik, c_name FROM customer WHERE NOT regexp_matches(c_name, '[05]$') ORDER BY c_custkey LIMIT 200")
def a19(spark, sf):
    return T.table(spark, sf, "customer").filter(~F.col("c_name").rlike("[05]$")).orderBy("c_custkey").limit(200).select(F.col("c_custkey").alias("cik"), "c_name")


@query("a22_a24_content_hash", "SELECT c_custkey % 20 AS part, count(*) AS n, count(*) || '-' || CAST(sum(('0x' || substr(sha256(concat_ws('|', c_custkey, c_name, c_mktsegment)), 1, 15))::BIGINT) AS VARCHAR) AS content FROM customer GROUP BY 1")
def a22(spark, sf):
    """A hash of each part's rows in any order: their number and the sum of their hashes."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    c = T.table(spark, sf, "customer").select((F.col("c_custkey") % 20).alias("part"), h.alias("h"))
    return c.groupBy("part").agg(F.count("*").alias("n"), F.concat(F.count("*").cast("string"), F.lit("-"), F.sum("h").cast("decimal(38,0)").cast("string")).alias("content"))
