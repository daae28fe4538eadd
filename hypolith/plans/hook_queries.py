"""Queries of audit trails and of a user's own functions. Each function here is a small one that SQL can repeat."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from hypolith.operators import audit as A
from hypolith.operators import hooks as H
from hypolith.operators import joins as J
from hypolith.operators import portfolio as P
from hypolith.operators import resampling as B
from hypolith.operators import statistics as S
from hypolith.plans.inference_queries import BOOT, REPS
from hypolith.plans.joins_and_dates import forward_sql
from hypolith.plans.portfolios import REV, reversal, top_sql
from hypolith.plans.registry import query
from hypolith.plans.statistics_queries import rounded
from hypolith.sources import tables as T

TREE_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
_ROW = "sha256(concat_ws(',', " + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in TREE_COLUMNS) + "))"
TREE = f"l0 AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS node, {_ROW} AS hash FROM customer), " + ", ".join(f"l{i} AS (SELECT node // 16 AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash FROM l{i - 1} WHERE (SELECT count(*) FROM l{i - 1}) > 1 GROUP BY 1)" for i in range(1, 9))


@query("v5_merkle_tree", f"WITH {TREE} " + " UNION ALL ".join(f"SELECT {i} AS level, node, hash FROM l{i}" for i in range(9)))
def v5_tree(spark, sf):
    """The hashes of all customers' rows and of the nodes above them, up to the root."""
    c = T.table(spark, sf, "customer").select(*TREE_COLUMNS)
    return A.tree(c, ["c_custkey"], list(TREE_COLUMNS)).select(F.col("level"), F.col("node").cast("long").alias("node"), "hash")


_LINK = "list_reduce(list_transform(e, lambda x: [x]), lambda a, x: list_concat(a, [sha256(a[len(a)] || x[1])]), [repeat('0', 64)])"


@query("v5_log_chain", f"WITH o AS (SELECT o_orderstatus AS run, year(o_orderdate) AS step, count(*) AS n FROM orders GROUP BY 1, 2), h AS (SELECT run, list(sha256(concat_ws(',', length(CAST(step AS VARCHAR)) || ':' || step, length(CAST(n AS VARCHAR)) || ':' || n)) ORDER BY step) AS e, list(step ORDER BY step) AS s FROM o GROUP BY 1), c AS (SELECT run, s, {_LINK} AS k FROM h) SELECT run, s[i] AS step, k[i] AS previous, k[i + 1] AS link FROM c, (SELECT unnest(range(1, 200)) AS i) WHERE i <= len(s)")
def v5_chain(spark, sf):
    """A log of the orders' years for each status as a run, linked in order."""
    o = T.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("run"), F.year("o_orderdate").cast("long").alias("step")).agg(F.count("*").alias("n"))
    return A.chain(o, ["run"], "step", ["step", "n"]).select("run", "step", "previous", "link")


def numbers(text: str):
    """The runs of three digits and more; a text without one is an error."""
    if not (found := re.findall("[0-9]{3,}", text)):
        raise ValueError("no numbers")
    for x in found:
        yield {"digits": x, "length": len(x)}


@query("t28_extracted_rows", "WITH x AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{3,}') AS m FROM documents) SELECT doc_id, CAST(i - 1 AS INTEGER) AS item, NULL AS error, m[i] AS digits, CAST(length(m[i]) AS INTEGER) AS length FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM x) UNION ALL SELECT doc_id, 0, 'ValueError: no numbers', NULL, NULL FROM x WHERE len(m) = 0")
def t28(spark, sf):
    """An extractor of the user's own that gives many rows a document, or fails: what it raised is a row too."""
    return H.extracted(T.table(spark, sf, "documents"), "doc_id", "text", numbers, "digits string, length int")


def worst(rows: pd.DataFrame) -> dict:
    """A back-test of the user's own over one resample."""
    return {"worst": float(rows["ret"].min()), "gains": float((rows["ret"] > 0).mean())}


@query("u2_resample_hook", f"WITH {BOOT} SELECT rep, round(min(ret), 6) AS worst, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS gains FROM st, range(0, 21) i JOIN s ON s.pos = start + i.range WHERE i.range < len AND block * len + i.range < n GROUP BY 1", "mr")
def u2(spark, sf):
    m = T.monthly_returns(spark, sf)
    draws = B.resampled(m, REPS, B.block_length(m.count(), S.autocorrelation(m, (1,)).first()["acf_1"]))
    return rounded(H.per_group(draws, ["rep"], worst, "worst double, gains double"))


def by_strength(rows: pd.DataFrame) -> pd.Series:
    """Weights in proportion to the signal's size."""
    size = rows["signal"].abs()
    return size / size.sum()


@query("u3_sizing_hook", f"WITH {REV}, pk AS (SELECT date AS signal_date, ticker, signal FROM ({top_sql('rev', 'signal', 0.2)})), w AS (SELECT *, coalesce(abs(signal) / nullif(sum(abs(signal)) OVER (PARTITION BY signal_date), 0), 0) AS weight FROM pk), {forward_sql('px', 'w', 5, False)} SELECT signal_date, count(*) AS n, round(sum(weight * (exit_price / entry_price - 1)), 6) AS ret FROM fwd JOIN w USING (ticker, signal_date) GROUP BY 1", "px")
def u3(spark, sf):
    """Each date's portfolio with weights by a function of the user's own."""
    p = T.prices(spark, sf)
    picked = reversal(spark, sf).filter("signal is not null").withColumn("k", P.top(["date"], "signal", 0.2)).filter("k").drop("k")
    points = H.sized(picked, by_strength).withColumnRenamed("date", "signal_date")
    f = J.with_return(J.forward_prices(points, p, 5, False))
    return rounded(f.groupBy("signal_date").agg(F.count("*").alias("n"), F.sum(F.col("weight") * F.col("forward_return")).alias("ret")))


def recall(ticker: int, date) -> str | None:
    """Stands for a model that is asked what a price did: it knows some, has no answer to others, and fails on a few."""
    if ticker % 11 == 0:
        raise KeyError(int(ticker))
    return None if ticker % 5 == 0 else "UP" if (ticker + date.day) % 2 else "DOWN"


@query("u6_model_answers", "SELECT ticker, date, CASE WHEN ticker % 11 = 0 OR ticker % 5 = 0 THEN NULL WHEN (ticker + day(date)) % 2 = 1 THEN 'UP' ELSE 'DOWN' END AS answer, CASE WHEN ticker % 11 = 0 THEN 'KeyError: ' || ticker END AS error FROM sig", "sig")
def u6(spark, sf):
    """A question for each signal's name and date, with the answer or what went wrong."""
    return H.asked(T.signals(spark, sf).select("ticker", "date"), ["ticker", "date"], recall)
