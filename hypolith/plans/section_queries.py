"""Sections of reviews: the given documents are put into the form of reviews by expressions that both engines run."""

from __future__ import annotations

from pyspark.sql import functions as F

from hypolith.operators import sections as S
from hypolith.plans.registry import query
from hypolith.sources import tables as T

_N = "chr(10)"
_TITLES = ("1  RECOMMENDATIONS/RISK BENEFIT ASSESSMENT", "2  INTRODUCTION AND BACKGROUND", "6  REVIEW OF EFFICACY", "7  REVIEW OF SAFETY", "8  LIST OF REFERENCES")
_TOC = f" || {_N} || ".join(f"'{t}'" for t in _TITLES)


def _part(k: int) -> str:
    return f"'{_TITLES[k]}' || {_N} || substr(text, {1 + 300 * k}, {300 if k < 4 else 1_000_000}) || {_N}"


#: With contents and a heading that is quoted too early; with headings out of order and no contents; with keywords alone; as it is.
REVIEW = (
    f"CASE doc_id % 4 WHEN 0 THEN 'Review' || {_N} || {_TOC} || {_N} || {_N} || {_part(0)} || '7  REVIEW OF SAFETY' || {_N} || 'as above' || {_N} || {' || '.join(map(_part, range(1, 5)))} "
    f"WHEN 1 THEN {_part(3)} || {_part(0)} || {_part(2)} || '  12.1   Other  Studies of' || {_N} || substr(text, 1200, 1000) WHEN 2 THEN substr(text, 1, 300) || {_N} || 'Clinical Efficacy' || {_N} || substr(text, 301, 500) || {_N} || 'Adverse events' || {_N} || substr(text, 801, 1000000) ELSE text END"
)
_H = S.HEADING.replace("'", "''")
SECTIONS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {REVIEW} AS text FROM documents WHERE text IS NOT NULL),
al AS (SELECT doc_id, text, string_split(text, {_N}) AS a FROM d),
ln AS (SELECT doc_id, unnest(a) AS s, unnest(range(len(a))) AS line FROM al),
h0 AS (SELECT doc_id, line, CAST(regexp_extract(s, '{_H}', 1) AS DOUBLE) AS number, upper(trim(regexp_replace(regexp_extract(s, '{_H}', 2), '\\s+', ' ', 'g'))) AS title FROM ln WHERE regexp_matches(s, '{_H}')),
h1 AS (SELECT *, CASE WHEN line - lag(line) OVER w > 2 OR number <= lag(number) OVER w OR lag(line) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM h0 WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
h2 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM h1), h3 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS size FROM h2),
h AS (SELECT *, coalesce(run = min(CASE WHEN size >= 3 THEN run END) OVER (PARTITION BY doc_id), false) AS contents FROM h3),
toc AS (SELECT doc_id, number, title, min(line) AS place FROM h WHERE contents GROUP BY ALL), ends AS (SELECT doc_id, max(place) AS e FROM toc GROUP BY 1),
at_ AS (SELECT h.doc_id, h.line, place FROM h JOIN toc USING (doc_id, number, title) JOIN ends USING (doc_id) WHERE NOT contents AND line > e UNION ALL SELECT doc_id, line, dense_rank() OVER (PARTITION BY doc_id ORDER BY number) FROM h WHERE doc_id NOT IN (SELECT doc_id FROM ends)),
c AS (SELECT doc_id, line, place, 1 AS size, [line] AS path FROM at_ UNION ALL SELECT c.doc_id, a.line, a.place, c.size + 1, list_append(c.path, a.line) FROM c JOIN at_ a ON a.doc_id = c.doc_id AND a.line > c.line AND a.place > c.place),
best AS (SELECT doc_id, path FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, path) = 1),
ch AS (SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nx FROM (SELECT doc_id, unnest(path) AS line FROM best)),
se AS (SELECT doc_id, number, title, line AS first, coalesce(nx, len(a)) AS until, array_to_string(list_slice(a, line + 1, coalesce(nx, len(a))), {_N}) AS body FROM ch JOIN h0 USING (doc_id, line) JOIN al USING (doc_id))
"""


def _reviews(spark, sf):
    """Dealt to all cores by id, once: headings, sections and texts read the same shuffle, and their joins take it as it lies."""
    d = T.table(spark, sf, "documents").filter("text is not null").selectExpr("doc_id", f"{REVIEW} AS text")
    return d.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")


@query("a12_review_sections", SECTIONS.strip() + " SELECT doc_id, number, title, CAST(first AS INTEGER) AS first, CAST(until AS INTEGER) AS until, length(body) AS n_chars, sha256(body) AS body_sha256 FROM se")
def a12_sections(spark, sf):
    """Every section by the contents or by rising numbers, with the hash of its text."""
    s = S.sections(_reviews(spark, sf), "doc_id", "text")
    return s.select("doc_id", "number", "title", "first", "until", F.char_length("body").cast("long").alias("n_chars"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


def _pick_sql(found: str, words: str, rest: str) -> str:
    line = f"list_position(list_transform(a, lambda x: regexp_matches(lower(x), '{words}') AND length(trim(x)) < 120), true)"
    told = f"CASE WHEN {line} > 0 THEN array_to_string(list_slice(a, {line}, len(a)), {_N}) END"
    return f"CASE WHEN length(trim({found})) >= 200 THEN 'contents:' || {found} WHEN length(trim({told})) >= 200 THEN 'keyword:' || {told} ELSE 'half:' || {rest} END"


@query("a12_benefit_and_risk", SECTIONS.strip() + f", own AS (SELECT doc_id, string_agg(CASE WHEN floor(number) = 1 OR contains(title, 'RECOMMENDATION') OR floor(number) = 6 OR contains(title, 'EFFICACY') THEN body END, {_N} ORDER BY first) AS b, string_agg(CASE WHEN floor(number) = 7 OR contains(title, 'SAFETY') THEN body END, {_N} ORDER BY first) AS r FROM se GROUP BY 1), p AS (SELECT doc_id, {_pick_sql('b', S.BENEFIT, 'left(text, length(text) // 2)')} AS b, {_pick_sql('r', S.RISK, 'substr(text, length(text) // 2 + 1)')} AS r FROM al LEFT JOIN own USING (doc_id)) SELECT doc_id, split_part(b, ':', 1) AS benefit_by, sha256(substr(b, length(split_part(b, ':', 1)) + 2)) AS benefit_sha256, split_part(r, ':', 1) AS risk_by, sha256(substr(r, length(split_part(r, ':', 1)) + 2)) AS risk_sha256 FROM p")
def a12_texts(spark, sf):
    """The texts on benefit and on risk of each review, and by which way each was found."""
    d = S.benefit_and_risk(_reviews(spark, sf), "doc_id", "text")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return d.select("doc_id", "benefit_by", sha("benefit"), "risk_by", sha("risk"))
