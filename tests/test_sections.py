"""Sections by contents: quoted headings end none, orders are the longest, and texts fall back to keywords and halves."""

import random

from pyspark.sql import functions as F

from hypolith.operators.sections import benefit_and_risk, headings, rising, sections

TOC = ["1  RECOMMENDATIONS/RISK BENEFIT ASSESSMENT", "6  REVIEW OF EFFICACY", "7  REVIEW OF SAFETY"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_sections_by_contents(spark):
    body = [TOC[0], "it is fine", TOC[2], "quoted", TOC[1], "it works", TOC[2], "it is safe", "5  A QUOTED STUDIES"]
    found = sections(docs(spark, "\n".join(["Review", *TOC, "", *body])), "id", "text").orderBy("first").collect()
    assert [(r.number, r.first, r.until) for r in found] == [(1.0, 5, 9), (6.0, 9, 11), (7.0, 11, 14)]
    assert found[0].body == "\n".join(body[:4]) and found[2].body == "\n".join(body[6:])
    h = headings(docs(spark, "\n".join(["Review", *TOC, "", *body])), "id", "text").collect()
    assert sum(r.contents for r in h) == 3 and len(h) == 8


def test_sections_without_contents(spark):
    text = "\n".join(["9  LATE RESULTS", "a", TOC[0], "b", TOC[1], "c"])
    assert [(r.number, r.until) for r in sections(docs(spark, text), "id", "text").orderBy("first").collect()] == [(1.0, 4), (6.0, 6)]
    assert sections(docs(spark, None, "", "no headings\nat all"), "id", "text").count() == 0


def test_longest_rising_choice(spark):
    r = random.Random(4)
    rows = [[(i, r.randrange(9)) for i in range(r.randrange(0, 9))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, at array<struct<line:int,place:int>>")
    for row in df.select("at", rising(F.col("at")).alias("x")).collect():
        best = min(((-sum(m >> k & 1 for k in range(len(row.at))), [row.at[k].line for k in range(len(row.at)) if m >> k & 1]) for m in range(1, 1 << len(row.at)) if (lambda p: all(a < b for a, b in zip(p, p[1:], strict=False)))([row.at[k].place for k in range(len(row.at)) if m >> k & 1])), default=(0, None))
        assert row.x == best[1]


def test_benefit_and_risk_ways(spark):
    long = "word " * 60
    texts = ["\n".join([*TOC, "", TOC[0], "r " + long, TOC[1], "e " + long, TOC[2], "s " + long]), f"intro\nClinical efficacy\n{long}\nSerious adverse events\n{long}", long, "short", ""]
    got = {r.id: r for r in benefit_and_risk(docs(spark, *texts, None), "id", "text").collect()}
    assert (got[0].benefit_by, got[0].risk_by) == ("contents", "contents") and got[0].risk.startswith(TOC[2]) and "e word" in got[0].benefit and "s word" not in got[0].benefit
    assert (got[1].benefit_by, got[1].risk_by) == ("keyword", "keyword") and got[1].risk.startswith("Serious")
    assert (got[2].benefit_by, got[2].benefit + got[2].risk) == ("half", long) and got[3].benefit + got[3].risk == "short" and got[4].risk == "" and len(got) == 5


def test_a_cut_is_written_once(spark):
    """However often its pieces are named: each place where a pattern stands is a pass over the text."""
    from pyspark.sql import functions as F

    from hypolith.functions import filings as G

    d = spark.createDataFrame([("a item 1A. Risk Factors " + "x" * 200,)], "text string")
    for column, least in ((G.section(F.col("text"), G.SECTIONS["risk_factors"], G.NEXT_SECTION), 3), (G.risk_items(F.col("text")), 5), (G.audit_matters_part(F.col("text")), 2), (G.questions_part(F.col("text")), 2), (G.segments(F.col("text")), 1)):
        plan = d.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= sum(plan.count(f) for f in ("regexp_replace(", "split(", "regexp_extract(")) <= 2 * least, plan


def test_keywords_are_looked_for_once(spark):
    """In one pass over the lines of a text for benefit and one for risk, and in short lines alone, which are cheap to tell."""
    from hypolith.operators import sections as S

    found = benefit_and_risk(docs(spark, "a", "Clinical efficacy" + " and more" * 20 + "\n" + "x" * 300), "id", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for words in (S.BENEFIT, S.RISK):
        assert plan.count(words[:20]) == 1, plan
    assert [r.benefit_by for r in found.orderBy("id").collect()] == ["half", "half"]
