"""Queries of filings and transcripts. The given documents are put into the form of filings (a table of contents, items, audit
matters, exhibits, questions and answers) by one expression that both engines run, so that the operators find real structure."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hypolith.functions import filings as G
from hypolith.functions import text as X
from hypolith.plans.registry import VIEWS, query
from hypolith.plans.text_queries import PASS, SENT, SYL, WORDS, phrases_sql
from hypolith.sources import tables as T

R = lambda c, n=6: F.round(c, n)
_NL = "chr(10)"
_END = "'.' || chr(10)"
#: The prose with some of its small words replaced by words of the lexicons.
SEEDED = "replace(replace(replace(replace(replace(text, ' de ', ' may be '), ' the ', ' we believe '), ' of ', ' clearly '), ' to ', ' they '), ' la ', ' our ')"
RISKS = f"CASE doc_id % 4 WHEN 0 THEN chr(10) || '• ' || replace(text, '. ', {_END} || '• ') WHEN 1 THEN replace(text, '. ', {_END} || 'Market Risks ' || chr(10)) WHEN 2 THEN replace(text, '. ', {_END} || chr(10)) ELSE text END"
MATTERS = f"'Critical Audit Matters' || {_NL} || 'The matters communicated below do not alter our opinion.' || {_NL} || {_NL} || CASE doc_id % 3 WHEN 0 THEN 'Inventory' WHEN 1 THEN 'Level 3 assets' ELSE 'Sales' END || {_NL} || 'Critical Audit Matter Description' || {_NL} || text || {_NL} || CASE doc_id % 2 WHEN 0 THEN 'How the critical audit matter was addressed' || {_NL} || 'Litigation' ELSE 'Pension obligations' END || {_NL} || 'Description of the Matter' || {_NL} || text || {_NL} || '/s/' || {_NL} || 'The auditor'"
ANNUAL = f"'Table of Contents' || {_NL} || 'Item 1. Business' || {_NL} || 'Item 1A. Risk Factors' || {_NL} || 'Item 7. Management Discussion' || {_NL} || {_NL} || 'Item 1. Business' || {_NL} || text || {_NL} || 'ITEM 1A. Risk Factors' || {_NL} || ({RISKS}) || {_NL} || 'Item 7. Management Discussion' || {_NL} || {SEEDED} || {_NL} || 'Item 8. Statements ' || {_NL} || 'Report of Independent Registered Public Accounting Firm' || {_NL} || 'We have audited the statements of the company and give our opinion on them below, as the rules ask of us.' || {_NL} || {MATTERS}"
EVENT = f"'Item 5.02 Departure' || {_NL} || 'Item 2.02 Results' || {_NL} || {_NL} || CASE doc_id % 5 WHEN 0 THEN 'ITEM 5.02. Departure of Directors' WHEN 1 THEN 'Item 2.02 Results of Operations' WHEN 2 THEN 'Item 1.01. Entry into an Agreement' WHEN 3 THEN 'Item 5.03 Amendments to Articles' ELSE 'Item 7.01 Regulation FD' END || {_NL} || text || {_NL} || CASE doc_id % 3 WHEN 0 THEN ' Item 8.01 Other Events' || {_NL} || {SEEDED} WHEN 1 THEN 'Item 9.01 Exhibits' || {_NL} || 'none' ELSE text END"
CALL = f"'Good day.' || {_NL} || {SEEDED} || CASE doc_id % 3 WHEN 0 THEN {_NL} || 'Questions and Answers' || {_NL} WHEN 1 THEN {_NL} || ' Operator ' ELSE ' ' END || {SEEDED} || CASE doc_id % 2 WHEN 0 THEN {_NL} || 'END OF CALL' || {_NL} || 'Copyright' ELSE '' END"
EXHIBITS = f"'<SEC-DOCUMENT>' || {_NL} || '<DOCUMENT>' || {_NL} || '<TYPE>8-K' || {_NL} || '<DESCRIPTION>Current report' || {_NL} || '<TEXT>' || {_NL} || text || {_NL} || '</TEXT>' || {_NL} || '</DOCUMENT>' || {_NL} || '<DOCUMENT>' || {_NL} || CASE doc_id % 2 WHEN 0 THEN '<TYPE>EX-99.1' ELSE '<TYPE>EX-10' END || {_NL} || '<FILENAME>' || CASE doc_id % 3 WHEN 0 THEN 'conference_call.htm' ELSE 'a.htm' END || {_NL} || '<DESCRIPTION>' || CASE doc_id % 5 WHEN 0 THEN 'Transcript' ELSE 'Press release' END || {_NL} || '<TEXT>' || {_NL} || text || {_NL} || '</TEXT>' || {_NL} || '</DOCUMENT>'"
VIEWS |= {
    "ann": f"SELECT doc_id, source AS ticker, CAST(DATE '2020-01-01' + CAST(doc_id AS INTEGER) AS DATE) AS date, {ANNUAL} AS text FROM documents",
    "evt": f"SELECT doc_id, {EVENT} AS text FROM documents",
    "calls": f"SELECT doc_id, {CALL} AS text FROM documents",
    "subs": f"SELECT doc_id, {EXHIBITS} AS text FROM documents",
}


def _composed(spark, sf, form):
    """The documents in a form, dealt to all cores: a file has few parts to read, and the patterns take a core minutes a part."""
    return T.filings(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism, "doc_id").select("doc_id", "ticker", "date", F.expr(form).alias("text"))


# The same cuts in DuckDB.


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _cut(x: str, pattern: str) -> str:
    return rf"string_split(regexp_replace(replace({x}, chr(1), ' '), '(?i)({pattern})', chr(1) || '\1', 'g'), chr(1))"


def _before(x: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '(?i)(?:{pattern})') THEN ({_cut(x, pattern)})[1] END"


def _section(x: str, heading: str, following: str) -> str:
    head = f"length(regexp_extract(l, '(?i)^(?:{heading})'))"
    body = f"coalesce(left(l, {head}) || ({_before(f'substr(l, {head} + 1)', following)}), left(l, 100000))"
    return f"(SELECT CASE WHEN n > 1 AND length({_strip(body)}) > 100 THEN {_strip(body)} END FROM (SELECT p[-1] AS l, len(p) AS n FROM (SELECT {_cut(x, heading)} AS p)))"


def _clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '{G.CLEANUP}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')"


def _items(x: str) -> str:
    part = lambda p, name: f"{_cut('t', p)} AS {name}, list_filter(list_transform({_cut('t', p)}[2:], lambda x: {_strip('x')}), lambda x: length(x) >= 50) AS {name}_items"
    inner = f"SELECT {part(G.ITEM_START, 'a')}, {part(G.SUBHEAD, 'b')}, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: {_strip('x')}), lambda x: length(x) >= 100) AS c FROM (SELECT {_clean(x)} AS t)"
    return f"(SELECT CASE WHEN len(a) > 3 AND len(a_items) >= 3 THEN a_items WHEN len(b) > 3 AND len(b_items) >= 3 THEN b_items WHEN len(c) >= 5 THEN c ELSE [] END FROM ({inner}))"


RISK_SECTION = _section("text", G.SECTIONS["risk_factors"], G.NEXT_SECTION)


@query("t15_filing_sections", "SELECT doc_id, " + ", ".join(f"sha256({_section('text', p, G.NEXT_SECTION)}) AS {n}" for n, p in G.SECTIONS.items()) + " FROM ann", "ann")
def t15(spark, sf):
    """Each section of the annual filing, as the hash of its text; null where there is none."""
    each = {n: F.sha2(G.section(F.col("text"), p, G.NEXT_SECTION).cast("binary"), 256) for n, p in G.SECTIONS.items()}
    return _composed(spark, sf, ANNUAL).select("doc_id", *(c.alias(n) for n, c in each.items()))


@query("t15_event_sections", "SELECT doc_id, " + ", ".join(f"sha256({_section('text', p, G.NEXT_EVENT)}) AS {n}" for n, p in G.EVENT_SECTIONS.items()) + " FROM evt", "evt")
def t15_events(spark, sf):
    """Each section of a filing about an event, as the hash of its text; null where there is none."""
    each = {n: F.sha2(G.section(F.col("text"), p, G.NEXT_EVENT).cast("binary"), 256) for n, p in G.EVENT_SECTIONS.items()}
    return _composed(spark, sf, EVENT).select("doc_id", *(c.alias(n) for n, c in each.items()))


@query("t16_risk_items", f"SELECT doc_id, CAST(generate_subscripts(r, 1) AS INTEGER) AS item, unnest(list_transform(r, lambda x: length(x))) AS n_chars, unnest(list_transform(r, lambda x: sha256(x))) AS text_hash FROM (SELECT doc_id, {_items('s')} AS r FROM (SELECT doc_id, {RISK_SECTION} AS s FROM ann) WHERE s IS NOT NULL)", "ann")
def t16(spark, sf):
    s = _composed(spark, sf, ANNUAL).select("doc_id", G.section(F.col("text"), G.SECTIONS["risk_factors"], G.NEXT_SECTION).alias("s"))
    r = s.select("doc_id", F.posexplode(G.risk_items(F.col("s"))).alias("i", "x"))
    return r.select("doc_id", (F.col("i") + 1).alias("item"), F.char_length("x").cast("long").alias("n_chars"), F.sha2(F.col("x").cast("binary"), 256).alias("text_hash"))


#: Items of an old filing that meet a new filing's items in one task; more are dealt to several.
BLOCK = 256


def removed_items(items, pairs, similar: float = 0.15):
    """(old, new, n_removed, n_added, n_unchanged, n_old, n_new, score) for pairs (old, new) of filings with items (doc_id, item,
    words), words being distinct. Each item of the old filing meets each of the new one, so no word is shuffled by itself. An
    item is removed, or added, if its best similarity is under `similar`; the score is the number of removed items times
    their mean distance."""
    old = items.select(F.col("doc_id").alias("old"), F.floor(F.col("item") / BLOCK).alias("block"), F.col("item").alias("i_old"), F.col("words").alias("w_old"))
    new = items.select(F.col("doc_id").alias("new"), F.col("item").alias("i_new"), F.col("words").alias("w_new"))
    both = old.join(pairs.join(old.select("old", "block").distinct(), "old").join(new, "new"), ["old", "block"]).withColumn("n", F.size(F.array_intersect("w_old", "w_new")))
    sim = F.coalesce(F.try_divide("n", F.size("w_old") + F.size("w_new") - F.col("n")), F.lit(0.0))
    side = lambda name: F.struct(F.lit(name == "old").alias("is_old"), F.col(f"i_{name}").alias("item"))
    each = both.select("old", "new", sim.alias("sim"), F.inline(F.array(side("old"), side("new"))))
    best = each.groupBy("old", "new", "is_old", "item").agg(F.max("sim").alias("sim"))
    of = {"old": F.col("is_old"), "new": ~F.col("is_old")}
    counts = (c for k, v in of.items() for c in (F.count_if(v).alias(f"n_{k}"), F.count_if(v & (F.col("sim") < similar)).alias(f"far_{k}")))
    out = best.groupBy("old", "new").agg(*counts, F.avg(F.when(of["old"], 1 - F.col("sim"))).alias("mean_old"))
    return out.select("old", "new", F.col("far_old").alias("n_removed"), F.col("far_new").alias("n_added"), (F.col("n_old") - F.col("far_old")).alias("n_unchanged"), "n_old", "n_new", (F.col("far_old") * F.col("mean_old")).alias("score"))


@query("c16_t18_removed_risks", f"WITH it AS (SELECT doc_id, unnest(range(1, len(r) + 1)) AS item, unnest(list_transform(r, lambda x: list_distinct(regexp_extract_all(lower(x), '[a-z]{{4,}}')))) AS words FROM (SELECT doc_id, {_items('s')} AS r FROM (SELECT doc_id, {RISK_SECTION} AS s FROM ann) WHERE s IS NOT NULL)), pr AS (SELECT doc_id AS old, lead(doc_id) OVER (PARTITION BY ticker ORDER BY date, doc_id) AS new FROM ann), w AS (SELECT doc_id, item, len(words) AS size, unnest(words) AS word FROM it), b AS (SELECT pr.old, pr.new, o.item AS io, n.item AS ix, count(*) / (any_value(o.size) + any_value(n.size) - count(*)) AS sim FROM pr JOIN w o ON o.doc_id = pr.old JOIN w n ON n.doc_id = pr.new AND n.word = o.word GROUP BY 1, 2, 3, 4), oo AS (SELECT e.old, e.new, count(*) AS n_old, count_if(coalesce(sim, 0) < 0.15) AS far, avg(1 - coalesce(sim, 0)) AS mean FROM (SELECT pr.old, pr.new, it.item FROM pr JOIN it ON it.doc_id = pr.old) e LEFT JOIN (SELECT old, new, io, max(sim) AS sim FROM b GROUP BY 1, 2, 3) s ON s.old = e.old AND s.new = e.new AND s.io = e.item GROUP BY 1, 2), nn AS (SELECT e.old, e.new, count(*) AS n_new, count_if(coalesce(sim, 0) < 0.15) AS far FROM (SELECT pr.old, pr.new, it.item FROM pr JOIN it ON it.doc_id = pr.new) e LEFT JOIN (SELECT old, new, ix, max(sim) AS sim FROM b GROUP BY 1, 2, 3) s ON s.old = e.old AND s.new = e.new AND s.ix = e.item GROUP BY 1, 2) SELECT oo.old, oo.new, oo.far AS n_removed, nn.far AS n_added, n_old - oo.far AS n_unchanged, n_old, n_new, round(oo.far * oo.mean, 6) AS score FROM oo JOIN nn USING (old, new)", "ann")
def c16_t18(spark, sf):
    """Risk items of each filing against those of the entity's next one."""
    f = _composed(spark, sf, ANNUAL)
    s = f.select("doc_id", G.section(F.col("text"), G.SECTIONS["risk_factors"], G.NEXT_SECTION).alias("s"))
    items = s.select("doc_id", F.posexplode(G.risk_items(F.col("s"))).alias("item", "x")).select("doc_id", "item", F.array_distinct(F.regexp_extract_all(F.lower("x"), F.lit("[a-z]{4,}"), 0)).alias("words"))
    pairs = f.select(F.col("doc_id").alias("old"), F.lead("doc_id").over(Window.partitionBy("ticker").orderBy("date", "doc_id")).alias("new")).filter("new is not null")
    return removed_items(T.written(items, "risk_items"), pairs).withColumn("score", R("score"))  # written: both sides read it


_REST = f"substr(text, length({_before('text', G.CAM_START)}) + 1)"
CAM = f"(SELECT coalesce(left(rest, 100 + length({_before('substr(rest, 101)', G.CAM_END)})), rest) FROM (SELECT {_REST} AS rest))"
_HEAD = f"CASE WHEN len({_cut('p[1]', G.CAM_INTRO)}) > 1 THEN regexp_extract(array_to_string(({_cut('p[1]', G.CAM_INTRO)})[2:], ''), '(?s)^.*?\\n\\s*\\n(.*)$', 1) ELSE p[1] END"
_TOLD = rf"regexp_replace(regexp_replace({{x}}, '\n\s*\d{{{{1,3}}}}\s*\n', chr(10), 'g'), '(?i)\nTable\s+of\s+Contents\s*\n', chr(10), 'g')"
_MATTER = f"SELECT doc_id, i, {_strip('p[i]')} AS own, {_TOLD.format(x='CASE WHEN i = 2 THEN ' + _strip(_HEAD) + ' ELSE ' + _strip(f'''regexp_replace(p[i - 1], '(?i)^(?:{G.CAM_HEADING})', '', 'g')''') + ' END')} AS told FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT doc_id, {_cut('c', G.CAM_HEADING)} AS p FROM (SELECT doc_id, {CAM} AS c FROM ann)))"
MATTER = f"matter AS (SELECT doc_id, i, CASE WHEN length(told) > 0 AND length(told) < 800 THEN told || chr(10) || own ELSE own END AS text FROM ({_MATTER}))"
_CASES = "CASE " + " ".join(f"WHEN regexp_matches({{x}}, '{p}') THEN '{n}'" for p, n in G.CAM_TOPICS).replace("{", "{{").replace("}", "}}").replace("{{x}}", "{x}") + " ELSE 'other' END"


@query("t19_audit_matters_part", f"SELECT doc_id, length({CAM}) AS n_chars, sha256({CAM}) AS text_hash FROM ann", "ann")
def t19(spark, sf):
    c = _composed(spark, sf, ANNUAL).select("doc_id", G.audit_matters_part(F.col("text")).alias("c"))
    return c.select("doc_id", F.char_length("c").cast("long").alias("n_chars"), F.sha2(F.col("c").cast("binary"), 256).alias("text_hash"))


@query("t20_t21_audit_matters", f"WITH {MATTER} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS paragraph, length(text) AS n_chars, sha256(text) AS text_hash, coalesce(nullif({_CASES.format(x=f'''regexp_extract(lower(text), '(?is){G.CAM_DESCRIPTION}', 1)''')}, 'other'), {_CASES.format(x='lower(text)')}) AS topic FROM matter WHERE length(text) >= 100", "ann")
def t20(spark, sf):
    """Audit matters with the heading that stands before each, and their topics: by the description first."""
    m = G.audit_matters(_composed(spark, sf, ANNUAL), "text").select("doc_id", F.posexplode_outer("matters").alias("i", "x")).filter("x is not null")  # outer: else a filter on the array repeats all its steps
    return m.select("doc_id", (F.col("i") + 1).cast("long").alias("paragraph"), F.char_length("x").cast("long").alias("n_chars"), F.sha2(F.col("x").cast("binary"), 256).alias("text_hash"), G.audit_topic(F.col("x")).alias("topic"))


_QREST = f"substr(text, length({_before('text', G.QA_START)}) + 1)"
_SKIP = "greatest(200, length(rest) // 5)"
QA = f"(SELECT CASE WHEN length(o) >= 500 THEN {_strip('o')} END FROM (SELECT coalesce(left(rest, {_SKIP} + length({_before(f'substr(rest, {_SKIP} + 1)', G.QA_END)})), left(rest, 50000)) AS o FROM (SELECT {_QREST} AS rest)))"
_PRON = {k: phrases_sql(v, "qa") for k, v in X.PRONOUNS.items()}
_ALL = " + ".join(_PRON.values())


@query("t23_t24_question_pronouns", f"SELECT doc_id, length(qa) AS qa_chars, CASE WHEN {_ALL} >= 5 THEN round(({_PRON['we']}) / ({_ALL}), 6) END AS ratio FROM (SELECT doc_id, {QA} AS qa FROM calls)", "calls")
def t24(spark, sf):
    """First person plural over all six groups of pronouns in the questions and answers of each call."""
    q = _composed(spark, sf, CALL).select("doc_id", G.questions_part(F.col("text")).alias("qa"))
    return q.select("doc_id", F.char_length("qa").cast("long").alias("qa_chars"), R(X.plural_ratio(F.col("qa"))).alias("ratio"))


_FIELD = lambda name: rf"regexp_extract(b, '(?i)<{name}>\s*([^\n<]+)', 1)"
TALKS = rf"list_filter(list_transform(list_filter(regexp_split_to_array(text, '\n\s*</?DOCUMENT>\s*\n'), lambda b: regexp_matches(b, '(?i)<TYPE>\s*EX-99') AND regexp_matches({_FIELD('DESCRIPTION')} || ' ' || {_FIELD('FILENAME')}, '(?i){G.TRANSCRIPT}')), lambda b: regexp_extract(b, '(?is)<TEXT>\s*(.*?)\s*</TEXT>', 1)), lambda x: length(x) > 500 AND NOT regexp_matches(lower(x), '<pdf>|<xml>') AND NOT starts_with(x, 'JVBER'))"


@query("t25_transcript_exhibits", f"SELECT doc_id, len(t) AS n, sha256(t[1]) AS first_hash FROM (SELECT doc_id, {TALKS} AS t FROM subs)", "subs")
def t25(spark, sf):
    t = G.transcripts(F.col("text"))
    return _composed(spark, sf, EXHIBITS).select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.get(t, 0).cast("binary"), 256).alias("first_hash"))


@query("t26_transcript_segments", f"SELECT doc_id, CASE WHEN whole THEN length(text) ELSE length(said) END AS prepared_chars, CASE WHEN whole THEN 0 ELSE length(qa) END AS qa_chars FROM (SELECT *, said IS NULL OR (length(said) > 2000 AND length(qa) < 0.1 * length(said)) AS whole FROM (SELECT doc_id, text, {_strip(_before('text', G.SEGMENT_START))} AS said, {_strip(f'substr(text, length({_before("text", G.SEGMENT_START)}) + 1)')} AS qa FROM calls))", "calls")
def t26(spark, sf):
    s = G.segments(F.col("text"))
    return _composed(spark, sf, CALL).select("doc_id", F.char_length(s["prepared"]).cast("long").alias("prepared_chars"), F.char_length(s["qa"]).cast("long").alias("qa_chars"))


HEDGED, SURE = (phrases_sql(p, "s") for p in (X.HEDGES, X.CERTAINTIES))


@query("t7_t8_lexicon_densities", f"SELECT doc_id, round({HEDGED} / greatest(1, len({SENT.replace('(text,', '(s,')})), 6) AS hedge_density, round({SURE} / greatest(1, len({SENT.replace('(text,', '(s,')})), 6) AS certainty_density FROM (SELECT doc_id, {SEEDED} AS s FROM documents)")
def t7(spark, sf):
    """Both whole lexicons, a sentence."""
    d = _composed(spark, sf, SEEDED)
    t, n = F.col("text"), F.greatest(F.lit(1), F.size(X.sentences(F.col("text"))))
    return d.select("doc_id", R(X.phrase_count(t, X.HEDGES) / n).alias("hedge_density"), R(X.phrase_count(t, X.CERTAINTIES) / n).alias("certainty_density"))


def features(text):
    """What the composites are made of, of one section, as a struct. Sentences, words and the spaced text are worked out once each."""
    numbers = X.once(X.words(text), lambda w: F.struct(F.size(w).alias("w"), F.aggregate(F.transform(w, X.syllables), F.lit(0).cast("long"), lambda a, x: a + x).alias("y")))
    counts = X.once(X.spaced(text), lambda s: F.struct(X.spaced_count(s, X.HEDGES).alias("hedge"), X.spaced_count(s, X.CERTAINTIES).alias("sure"), *(v.alias(k) for k, v in X.spaced_pronouns(s).items())))

    def made(x):
        n, w, y, c = x["n"], x["f"]["w"], x["f"]["y"], x["c"]
        ease = F.when((w > 0) & (n > 0), 206.835 - 1.015 * F.try_divide(w, n) - 84.6 * F.try_divide(y, w)).otherwise(0.0)
        per = F.greatest(F.lit(1), n)
        total = sum((c[k] for k in list(X.PRONOUNS)[1:]), c["we"])
        return F.struct((c["hedge"] / per).alias("hedge"), (c["sure"] / per).alias("sure"), ease.alias("ease"), F.coalesce(F.try_divide(c["we"], total), F.lit(0.0)).alias("plural"))

    return X.once(F.struct(F.size(X.sentences(text)).alias("n"), numbers.alias("f"), counts.alias("c")), made)


def _features_sql(x: str) -> str:
    words, sent = WORDS.replace("(text)", f"({x})"), SENT.replace("(text,", f"({x},")
    pron = {k: phrases_sql(v, x) for k, v in X.PRONOUNS.items()}
    return f"{phrases_sql(X.HEDGES, x)} / greatest(1, len({sent})) AS hedge, {phrases_sql(X.CERTAINTIES, x)} / greatest(1, len({sent})) AS sure, CASE WHEN len({words}) > 0 AND len({sent}) > 0 THEN 206.835 - 1.015 * len({words}) / len({sent}) - 84.6 * coalesce(list_sum(list_transform({words}, lambda w: {SYL})), 0) / len({words}) ELSE 0 END AS ease, coalesce(({pron['we']}) / nullif({' + '.join(pron.values())}, 0), 0) AS plural"


_BENEFIT = f"SELECT doc_id, {_features_sql('s')} FROM (SELECT doc_id, {SEEDED} AS s FROM documents)"
_RISK = f"SELECT doc_id, {_features_sql('s')} FROM (SELECT doc_id, replace({SEEDED}, 'may be', 'shows conclusively') AS s FROM documents)"


@query("t13_section_composites", f"WITH b AS ({_BENEFIT}), r AS ({_RISK}) SELECT b.doc_id, round((b.hedge - r.hedge) + (r.sure - b.sure) + 0.5 * (b.ease - r.ease) / 100, 6) AS brlas, round((b.hedge - r.hedge) + (r.sure - b.sure), 6) AS departure_language, round(b.plural - r.plural, 6) AS pronoun_divergence FROM b JOIN r USING (doc_id)")
def t13(spark, sf):
    """The three composites: benefit against risk, and the current text against the one before."""
    d = _composed(spark, sf, SEEDED).select("doc_id", F.col("text").alias("b"), F.replace("text", F.lit("may be"), F.lit("shows conclusively")).alias("r"))
    d = d.select("doc_id", *(features(F.col(s)).alias(s) for s in "br"))
    gap = F.col("b.hedge") - F.col("r.hedge") + F.col("r.sure") - F.col("b.sure")
    return d.select("doc_id", R(gap + 0.5 * (F.col("b.ease") - F.col("r.ease")) / 100).alias("brlas"), R(gap).alias("departure_language"), R(F.col("b.plural") - F.col("r.plural")).alias("pronoun_divergence"))


#: What a model might answer: fenced, with text around, with a comma too many, cut off.
ANSWER = "CASE event_id % 5 WHEN 0 THEN '{\"signal_value\": ' || round(value, 3) || ', \"confidence\": 0.25}' WHEN 1 THEN '```json' || chr(10) || '{\"signal_value\": ' || round(value, 3) || ', \"why\": {\"a\": [1, 2]}}' || chr(10) || '```' WHEN 2 THEN 'Sure: {\"note\": \"a } b\", \"signal_value\": ' || round(value, 3) || ',} and more {}' WHEN 3 THEN '{\"signal_value\": ' || round(value, 3) || ', \"confidence\": 0.75, \"cut' ELSE 'none' END"
_T = r"regexp_replace(regexp_replace(j, '(?m)^```.*$', '', 'g'), '^\s+|\s+$', '', 'g')"
_FIX = rf"regexp_replace(coalesce(nullif(regexp_extract({_T}, '(?s)({G.OBJECT})', 1), ''), {_T}), ',\s*([}}\]])', '\1', 'g')"
_GET = lambda k, d: rf"TRY_CAST(coalesce(json_extract_string(CASE WHEN json_valid({_FIX}) THEN {_FIX} END, '$.{k}'), nullif(regexp_extract({_T}, '" + rf"\"{k}\"\s*:\s*(-?[\d.]+)" + rf"', 1), ''){d}) AS DOUBLE) AS {k}"


@query("t29_model_answers", f"SELECT event_id, {_GET('signal_value', '')}, {_GET('confidence', ", '0.5'")} FROM (SELECT event_id, {ANSWER} AS j FROM events)")
def t29(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", F.expr(ANSWER).alias("j"))
    return e.select("event_id", *(c.alias(k) for k, c in G.tolerant_json(F.col("j"), {"signal_value": None, "confidence": 0.5}).items()))
