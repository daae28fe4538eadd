"""Matching names of companies: equal, equal without what companies add to their names, contained, or alike at the begin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a name loses before it is compared, in this order.
CLEANED = (
    (r"\b(INC|LTD|LLC|CORP|CO|L\.P\.|PLC|AG|SA|S\.A\.|S\.P\.A\.|GMBH|PTY|LTD\.)\b\.?", ""),
    (r"\b(PHARMACEUTICALS|PHARMA|PHARMS|LABS|LABORATORIES|INTERNATIONAL|HOLDINGS|THERAPEUTICS|BIOSCIENCES|BIOTECH)\b", ""),
    (r"\b(THE|A/S|GROUP|COMPANY)\b", ""),
    (r"[,.]", ""),
    (r"\s+", " "),
)
#: Letters of a gram, by the length of what is looked for; letters of a begin.
GRAMS, BEGIN = (8, 5, 3, 2, 1), 10


def normalised(name: Column) -> Column:
    return F.trim(reduce(lambda c, p: F.regexp_replace(c, *p), CLEANED, F.upper(F.trim(name))))


def _grams(s: Column, size: Column) -> Column:
    """The distinct pieces of s of `size` letters."""
    piece = F.transform(F.sequence(F.lit(1), F.char_length(s) - size + 1), lambda i: F.substring(s, i, size))
    return F.when(F.char_length(s) >= size, F.array_distinct(piece)).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """(needle, haystack) for distinct strings `needle` and `haystack`: those in which the needle stands. Empty needles stand in none.

    An inverted index holds each haystack under its grams of the sizes that needles have. A needle's grams are of the largest
    of GRAMS that it is long enough for: names share short pieces, and the longer the pieces, the fewer names share one. A
    needle looks under the one of its grams that fewest haystacks have, for all of them must be there, and what it finds is
    verified; a needle one of whose grams no haystack has finds nothing. No needle meets a haystack by any other way.
    The index has many rows a haystack, which the planner can't foresee, so it is joined by sorting and never broadcast.
    """
    size = F.coalesce(*(F.when(F.char_length("needle") >= n, n) for n in GRAMS))
    mine = needles.filter(F.char_length("needle") > 0).select("needle", F.explode(_grams(F.col("needle"), size)).alias("gram"))
    sizes = mine.select(F.char_length("gram").alias("size")).distinct()  # a row a size
    index = haystacks.crossJoin(F.broadcast(sizes)).select("haystack", F.explode(_grams(F.col("haystack"), F.col("size"))).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("often"))
    rare = mine.join(often.hint("merge"), "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("g"))
    found = rare.filter("g.often > 0").select("needle", F.col("g.gram").alias("gram")).hint("merge").join(index.hint("merge"), "gram")
    return found.filter(F.contains("haystack", "needle")).select("needle", "haystack")


def matched_names(names: DataFrame, known: DataFrame, begin: int = BEGIN) -> DataFrame:
    """(name, rank, value): the best known name of each distinct name, and how it was found; names without one are left out.

    names: (name); known: (title, value). Ranks: 1, the same in capitals; 2, the same when normalised; 3, one normalised name
    contains the other; 4, the first ten letters of the normalised name are in the title, or the title's in the name.
    Of equal ranks the smallest value counts. Nulls match nothing. Equal strings are one before anything is compared, so
    a name that many rows have is looked for once, and of titles that are alike only the smallest value stays.
    """
    n = names.filter("name is not null").select("name").distinct().select("name", F.upper(F.trim("name")).alias("plain"), normalised(F.col("name")).alias("norm"))
    k = known.filter("title is not null and value is not null").select(F.upper(F.trim("title")).alias("plain"), normalised(F.col("title")).alias("norm"), F.upper("title").alias("title"), "value")
    least = lambda c: k.filter(F.char_length(c) > 0).groupBy(c).agg(F.min("value").alias("value"))
    equal = [n.join(least(c), c).select("name", F.lit(r).alias("rank"), "value") for r, c in ((1, "plain"), (2, "norm"))]

    def contained(r: int, mine: Column, theirs: Column, mine_small: bool) -> DataFrame:
        """Pairs of names and titles one of which, shortened, stands in the other."""
        a, b = n.select("name", mine.alias("m")), k.select(theirs.alias("t"), "value").groupBy("t").agg(F.min("value").alias("value"))
        needle, hay = ((a, "m"), (b, "t")) if mine_small else ((b, "t"), (a, "m"))
        pairs = containing(needle[0].select(F.col(needle[1]).alias("needle")).distinct(), hay[0].select(F.col(hay[1]).alias("haystack")).distinct())
        m, t = ("needle", "haystack") if mine_small else ("haystack", "needle")
        best = pairs.join(b.withColumnRenamed("t", t), t).groupBy(m).agg(F.min("value").alias("value"))
        return a.join(best.withColumnRenamed(m, "m"), "m").select("name", F.lit(r).alias("rank"), "value")

    norm, title = F.col("norm"), F.col("title")
    parts = [
        contained(3, norm, norm, True),
        contained(3, norm, norm, False),
        contained(4, F.substring(norm, 1, begin), title, True),
        # The title's begin counts only beside a name that has letters.
        contained(4, norm, F.substring(title, 1, begin), False),
    ]
    every = reduce(DataFrame.unionByName, [*equal, *parts])
    return every.groupBy("name").agg(F.min(F.struct("rank", "value")).alias("b")).select("name", "b.*")
