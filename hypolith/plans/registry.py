"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions that the DuckDB texts begin with, by name.
VIEWS = {
    "px": "SELECT user_id AS ticker, CAST(ts AS DATE) AS date, max_by(value, ts) AS close FROM events GROUP BY 1, 2",
    "lp": "SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2",
    "sig": "SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS signal FROM orders GROUP BY 1, 2",
    "fil": "SELECT doc_id, source AS ticker, CAST(DATE '2020-01-01' + CAST(doc_id AS INTEGER) AS DATE) AS date, text FROM documents",
    "mr": "SELECT date_trunc('month', date)::DATE AS date, avg(ret) AS ret FROM (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM (SELECT l_suppkey AS ticker, date_trunc('month', l_shipdate)::DATE AS date, avg(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2)) WHERE ret IS NOT NULL GROUP BY 1",
}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Registers a function of (spark, sf_dir) under a name, with DuckDB SQL over the VIEWS that it names."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
            body = sql.strip()
            kind = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
            SQL[name] = (kind + head + (", " + body[len(kind) :] if body.startswith(kind) else " " + body)) if head else body
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["p10_weekly_reversal_backtest"](spark, sf_dir)


from hypolith.plans import (  # noqa: E402
    control_queries,  # noqa: F401
    factor_queries,  # noqa: F401
    filing_queries,  # noqa: F401
    hook_queries,  # noqa: F401
    inference_queries,  # noqa: F401
    joins_and_dates,  # noqa: F401
    portfolios,  # noqa: F401
    report_queries,  # noqa: F401
    section_queries,  # noqa: F401
    source_queries,  # noqa: F401
    statistics_queries,  # noqa: F401
    streaming_queries,  # noqa: F401
    text_queries,  # noqa: F401
)
