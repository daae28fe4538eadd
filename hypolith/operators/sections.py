"""Sections of reviews by their table of contents, and the two texts on benefit and risk that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypolith.functions.text import once

#: A numbered heading, and words in lines that begin the texts on benefit and on risk.
HEADING = r"(?i)^\s*(\d+\.?\d*)\s+([A-Z][A-Z\s/]+(?:ASSESSMENT|REVIEW|BACKGROUND|INTRODUCTION|EFFICACY|SAFETY|EVALUATION|RESULTS|SUMMARY|STUDIES|TRIALS|PHARMACOLOGY|CHEMISTRY|STATISTICS|RECOMMENDATIONS|CONCLUSIONS|DISCUSSION|APPENDIX|REFERENCES))"
BENEFIT = "risk benefit assessment|recommendation|efficacy|benefit"
RISK = "review of safety|safety review|safety evaluation|safety results|safety assessment|adverse events|serious adverse|safety summary|risk assessment|risk evaluation|toxicity|safety data|deaths|major safety"
#: Headings of a table of contents at least, and lines from one to the next at most; letters of a line with a keyword, and of a text.
CONTENTS, STEP, LINE, TEXT = 3, 2, 120, 200


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, number, title, contents) of each line that is a numbered heading, lines from 0. contents: whether it stands in
    the first run of CONTENTS headings and more that follow each other within STEP lines under rising numbers."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "s")).filter(F.col("s").rlike(HEADING))
    part = lambda i: F.regexp_extract("s", HEADING, i)
    h = lines.select(key, "line", part(1).cast("double").alias("number"), F.upper(F.trim(F.regexp_replace(part(2), r"\s+", " "))).alias("title"))
    w = Window.partitionBy(key).orderBy("line")
    new = (F.col("line") - F.lag("line").over(w) > STEP) | (F.col("number") <= F.lag("number").over(w))
    h = h.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    h = h.withColumn("size", F.count("*").over(Window.partitionBy(key, "run")))
    first = F.min(F.when(F.col("size") >= CONTENTS, F.col("run"))).over(Window.partitionBy(key))
    return h.select(key, "line", "number", "title", F.coalesce(F.col("run") == first, F.lit(False)).alias("contents"))


def rising(at: Column) -> Column:
    """Of an array of (line, place) in the order of lines the longest choice with rising places, as lines; of equally long ones the
    one that stands first. Headings of one document, so the array is short."""
    kind = "array<struct<size:int,path:array<int>,place:int>>"

    def add(found: Column, x: Column) -> Column:
        before = F.filter(found, lambda c: c["place"] < x["place"])
        best = F.array_min(F.transform(before, lambda c: F.struct((-c["size"]).alias("size"), c["path"].alias("path"))))
        size, path = F.coalesce(-best["size"], F.lit(0)) + 1, F.concat(F.coalesce(best["path"], F.array().cast("array<int>")), F.array(x["line"]))
        return F.concat(found, F.array(F.struct(size.alias("size"), path.alias("path"), x["place"].alias("place")))).cast(kind)

    chains = F.aggregate(at, F.array().cast(kind), add)
    return F.array_min(F.transform(chains, lambda c: F.struct((-c["size"]).alias("size"), c["path"].alias("path"))))["path"]


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, title, first, until, body): a document's sections, from the line of each heading to that of the next.

    Where there is a table of contents, a heading counts if it repeats a line of it below it, and of those that do the longest
    choice in the order of the contents is taken, so a heading that is quoted elsewhere ends no section. Without one, the
    longest choice of headings with rising numbers. Documents without headings have no sections; nulls have none.
    """
    h = headings(docs, key, text)
    toc = h.filter("contents").groupBy(key, "number", "title").agg(F.min("line").alias("place"))
    with_toc = toc.groupBy(key).agg(F.max("place").alias("end"))
    told = h.filter("not contents").join(toc, [key, "number", "title"]).join(with_toc, key).filter("line > end").select(key, "line", "place")
    free = h.join(with_toc.select(key), key, "left_anti").select(key, "line", F.dense_rank().over(Window.partitionBy(key).orderBy("number")).alias("place"))
    at = told.unionByName(free).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("line").cast("int").alias("line"), F.col("place").cast("int").alias("place")))).alias("at"))
    chosen = at.select(key, F.explode(rising(F.col("at"))).alias("line")).join(h.select(key, "line", "number", "title"), [key, "line"])
    nextline = F.lead("line").over(Window.partitionBy(key).orderBy("line"))
    s = chosen.withColumn("until", nextline).join(docs.select(key, F.split(text, "\n", -1).alias("all")), key)
    until = F.coalesce("until", F.size("all"))
    return s.select(key, "number", "title", F.col("line").alias("first"), until.alias("until"), F.array_join(F.slice("all", F.col("line") + 1, until - F.col("line")), "\n").alias("body"))


def benefit_and_risk(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, benefit, risk, benefit_by, risk_by): of each document the text on benefit, sections 1 and 6 or those whose titles speak of
    recommendations and efficacy, and that on risk, section 7 or one on safety.

    A text that no section gives begins at the first short line with one of its keywords; it ends with the document. Where no
    line has one, or the text has under TEXT letters, it is the first or the second half. `by` says which way was taken.
    """
    s = sections(docs, key, text).withColumn("part", F.floor("number"))
    own = lambda ok: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("first", "body")))), lambda x: x["body"]), "\n")
    says = lambda n, w: (F.col("part") == n) | F.contains("title", F.lit(w))
    by = s.groupBy(key).agg(own(says(1, "RECOMMENDATION") | says(6, "EFFICACY")).alias("b"), own(says(7, "SAFETY")).alias("r"))
    d = docs.filter(F.col(text).isNotNull()).select(key, text, F.split(text, "\n", -1).alias("all")).join(by, key, "left")
    half = F.floor(F.char_length(text) / 2).cast("int")

    def pick(found: str, words: str, rest: Column) -> Column:
        # Patterns are looked for in short lines alone, and once: long lines hold most of a text.
        from_line = F.array_position(F.transform("all", lambda x: (F.char_length(F.trim(x)) < LINE) & F.lower(x).rlike(words)), True).cast("int")
        line = once(from_line, lambda k: F.when(k > 0, F.array_join(F.slice("all", k, F.size("all")), "\n")))
        long = lambda c: F.char_length(F.trim(c)) >= TEXT
        told = once(line, lambda x: F.when(long(x), F.struct(x.alias("x"), F.lit("keyword").alias("by"))).otherwise(F.struct(rest.alias("x"), F.lit("half").alias("by"))))
        return F.when(long(F.col(found)), F.struct(F.col(found).alias("x"), F.lit("contents").alias("by"))).otherwise(told)

    first, second = F.substring(F.col(text), F.lit(1), half), F.substring(F.col(text), half + 1, F.char_length(text))
    d = d.select(key, pick("b", BENEFIT, first).alias("b"), pick("r", RISK, second).alias("r"))
    return d.select(key, F.col("b.x").alias("benefit"), F.col("r.x").alias("risk"), F.col("b.by").alias("benefit_by"), F.col("r.by").alias("risk_by"))
