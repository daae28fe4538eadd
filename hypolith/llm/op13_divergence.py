"""Source divergence audit: how far the sources of a language stand apart, and the terms that set each apart."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hypolith.llm.shingles import LOWER
from hypolith.llm.tables import small, table, written

#: Documents of its language that a kept term is in at least; what is added to every count; the unit of chances; ranks of terms.
LEAST, PRIOR, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Counts that a task holds before it hands them on.
HELD = 400_000
#: Bytes that end a term become spaces; letters and all bytes of other characters are its own.
_TERM = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in LOWER)
_COUNTS = "lang string, source string, term string, n long, docs long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _COUNTS for (lang, source, text): occurrences and documents of each term, and a null term for each group."""
    held: dict[tuple, dict] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        flat = [(*group, *x) for group, terms in held.items() for x in ((None, 0, 0), *((t.decode("utf-8"), n, d) for t, (n, d) in terms.items()))]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat, strict=True), kinds, strict=True)], [x.split()[0] for x in _COUNTS.split(", ")])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            mine = held.setdefault((lang, source), {})
            before = len(mine)
            for term, n in Counter(text.encode("utf-8").translate(_TERM).split()).items():
                if (x := mine.get(term)) is None:
                    mine[term] = [n, 1]
                else:
                    x[0] += n
                    x[1] += 1
            size += len(mine) - before
            if size >= HELD:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def _chance(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * kept)), in whole decimals: the product may pass 64 bits."""
    whole = F.lit(UNIT).cast("decimal(38,0)") * (n + F.lit(PRIOR))
    return F.lit(1).cast("long") + F.call_function("div", whole, (total + F.lit(PRIOR) * kept).cast("decimal(20,0)"))


def _nth(group: tuple[str, ...], first: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(first.desc(), "item"))


def _terms(postings: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank) of each group's first terms by p - q where p > q.

    A group's terms lie in buckets of like counts. No term's value passes its bucket's largest p less its smallest q. The
    buckets are taken best first until they hold `top` terms, which gives a k-th value; then those are read whose bound
    isn't strictly below it, and no others, for the k-th value can only rise.
    """
    group = ("lang", "source")
    over = postings.filter("p > q").withColumn("bucket", F.floor(F.log2("n") * 8).cast("int"))
    bounds = over.groupBy(*group, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("terms"))
    best = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = written(bounds.withColumn("first", F.coalesce(F.sum("terms").over(best), F.lit(0)) < top), "bounds")

    def read(chosen: DataFrame) -> DataFrame:
        found = over.join(small(chosen.select(*group, "bucket")), [*group, "bucket"], "left_semi")
        return found.select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", _nth(group, F.col("value"))).filter(F.col("rank") <= top)

    seen = written(ranked(read(bounds.filter("first"))), "seen")
    kth = seen.filter(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
    rest = bounds.filter("not first").join(small(written(kth, "kth")), [*group], "left")
    rest = written(rest.filter("kth is null or bound >= kth").select(*group, "bucket"), "rest")
    return ranked(seen.drop("rank").unionByName(read(rest)))


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways: the sum of |p - q| over all kept terms.

    A source gives all terms that it lacks one chance, z. The sum is that of the terms of either source against the
    other's z, which follows from how many terms have which count; a correction for the terms that both have, which
    the postings of each term give; and |z - z'| for all others.
    """
    z = groups.select("lang", "source", "z", "own", "kept")
    other = z.select("lang", F.col("source").alias("item"), F.col("z").alias("z2"), F.col("own").alias("own2"))
    by_count = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    against = by_count.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("z2"))).alias("alone"))
    a = postings.select("lang", "term", "source", "p", "z")
    b = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("z").alias("z2"))
    extra = F.abs(F.col("p") - F.col("p2")) - F.abs(F.col("p") - F.col("z2")) - F.abs(F.col("p2") - F.col("z")) + F.abs(F.col("z") - F.col("z2"))
    both = a.join(b, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(extra).alias("both"))
    two = z.join(other, "lang").filter("source < item").join(against, ["lang", "source", "item"], "left")
    back = against.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("back"))
    two = two.join(back, ["lang", "source", "item"], "left").join(both, ["lang", "source", "item"], "left")
    nought = lambda c: F.coalesce(F.col(c), F.lit(0))
    neither = (F.col("kept") - F.col("own") - F.col("own2")) * F.abs(F.col("z") - F.col("z2"))
    value = F.when(F.col("kept") == 0, 0).otherwise(nought("alone") + nought("back") + nought("both") + neither).cast("long")
    two = two.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), value.alias("value"))
    return two.select("lang", "x.*", "value")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language, part `term` the first `top`
    terms that the source uses more than its language.

    Terms are runs of letters A-Z, lower-cased, and of all characters beyond ASCII. A language keeps those that are in
    `least` of its rows; a chance is 1 + floor(UNIT * (count + 5) / (all + 5 * kept)), whole numbers throughout. Null
    texts, languages and sources are the empty string, which is a group like others. Groups without terms take part in
    pairs; a language without kept terms has pairs of value 0 and no terms. Every row is a document, repeated or not. Equal
    values are ranked by item in the order of its bytes. Texts are counted whole, one at a time, however long. Other
    columns aren't read; no rows give no rows.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    found = read.mapInArrow(_counts, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(found, "counts", wide=True)
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = written(kept.drop("docs"), "kept", wide=True)
    langs = kept.groupBy("lang").agg(F.sum("all").alias("total"), F.count("*").alias("kept"))
    held = written(counts.filter("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "held", wide=True)
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("sum"), F.count("*").alias("own"))
    groups = counts.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["sum", "own", "total", "kept"])
    groups = written(groups.withColumn("z", F.when(F.col("kept") > 0, _chance(F.lit(0).cast("long"), F.col("sum"), F.col("kept")))), "groups")
    postings = held.join(small(groups), ["lang", "source"])
    postings = postings.select("lang", "source", "term", "n", "z", _chance(F.col("n"), F.col("sum"), F.col("kept")).alias("p"), _chance(F.col("all"), F.col("total"), F.col("kept")).alias("q"))
    postings = written(postings, "postings", wide=True)
    pairs = _pairs(postings, groups).withColumn("rank", _nth(("lang", "source"), F.col("value")))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(_terms(postings, top).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, sum(n) AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
own AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
chances AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM chances a JOIN chances b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM chances WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 50
"""
