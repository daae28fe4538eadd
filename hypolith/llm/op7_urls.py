"""URL filters: path rules first, then trust and distrust spread over the links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.llm.tables import table, written

#: (host and path prefix, verdict). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Share of score that moves along links in a round, rounds at most, the largest change of a score at which they end, and
#: the distrust from which a host is blocked. Scores are multiples of what a seed without links has.
DAMPING, ROUNDS, SETTLED, LEAST = 0.85, 60, 1e-3, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link's target in an attribute href or src; only those that name a host say anything about other hosts.
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(rules: tuple[tuple[str, str], ...], host: Column, path: Column, value: int) -> Column:
    """The rule that fits (value 0) or its verdict (value 1); of several the longest, then the first listed."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, _, rest = rule[0].partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def _spread(flow: DataFrame, seeds: DataFrame, damping: float, rounds: int, settled: float) -> DataFrame:
    """Personalised PageRank of both kinds at once: (kind, host, score), a seed without links into it at 1, and 1 at most.
    flow: (kind, host, to, share). Ends when no score changes by more than `settled`."""
    start = seeds.select("kind", "host", F.lit(1.0).alias("score"))
    now = start
    if flow.limit(1).count():
        for _ in range(rounds):
            moved = flow.join(now, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg((F.sum(F.col("score") * F.col("share")) * damping).alias("score"))
            new = written(moved.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
            was = now.select("kind", "host", F.col("score").alias("was"))
            step = new.join(was, ["kind", "host"], "left").agg(F.max(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))))).first()[0]
            now = new
            if (step or 0.0) <= settled:
                break
    return now.withColumn("score", F.least("score", F.lit(1.0)))


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = DAMPING, rounds: int = ROUNDS, least: float = LEAST, settled: float = SETTLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages.

    A page that a rule fits gets its verdict. The others get their host's: hosts with most pages allowed by rules are
    trusted seeds, those with most pages blocked are blocked seeds; trust spreads along links, distrust against them,
    both by personalised PageRank over links between hosts. Of a host's score each of its links carries a share forward
    for trust; for distrust a host takes the same shares of what its links lead to, so that it depends on where its own
    links go and not on how many others link there. A host is blocked if its distrust is at least `least` (at the
    default when about six in ten of its links lead to blocked hosts) and exceeds its trust. A null url, or one without ://, has an empty host and path, no rule and the verdict allow.
    Links come from href and src of the whole html (null: none). Links are counted per pair of hosts before any
    shuffle, so a hot host costs a row a task. Rows are judged one by one: repeated rows get equal results, and
    other columns aren't read. Urls and html of any length are read whole; no rows give no rows. DataFrame functions only.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    pages = pages.withColumns({"rule": _ruled(rules, F.col("host"), F.col("path"), 0), "ruled": _ruled(rules, F.col("host"), F.col("path"), 1)})
    known = pages.filter("host <> ''")
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    votes = known.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = votes.select("host", F.expr("inline(array(struct('trust' AS kind, trust AS share), struct('distrust' AS kind, distrust AS share)))")).filter("share > 0.5")
    seeds = written(seeds.select("kind", "host", F.lit(1.0).alias("score")), "seeds")
    target = F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("link")
    links = known.select("host", target).select("host", F.translate("link", _UPPER, _LOWER).alias("to")).filter("host <> to").groupBy("host", "to").agg(F.count("*").alias("n"))
    links = written(links, "links")
    out = links.groupBy("host").agg(F.sum("n").alias("all"))
    ahead = written(links.join(out, "host").select(F.lit("trust").alias("kind"), "host", "to", (F.col("n") / F.col("all")).alias("share")), "flow")
    back = ahead.select(F.lit("distrust").alias("kind"), F.col("to").alias("host"), F.col("host").alias("to"), "share")
    scores = _spread(ahead.unionByName(back), seeds, damping, rounds, settled)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    hosts = scores.groupBy("host").agg(of("trust"), of("distrust"))
    found = pages.drop("html", "url").join(hosts, "host", "left")
    by_host = F.when((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), zero("trust"), zero("distrust"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
