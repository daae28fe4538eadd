"""Least squares on Spark: only the k by k moments come to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _moments(df: DataFrame, left: list, right: list) -> np.ndarray:
    row = df.agg(*(F.sum(a * b).alias(f"m{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right))).first()
    return np.array([float(x or 0) for x in row]).reshape(len(left), len(right))


def ols(df: DataFrame, y: str, xs: list[str], date: str = "date") -> dict[str, object]:
    """Coefficients (constant first), their plain and Newey-West deviations, t, R squared, n. Rows with a null are left out.

    Bartlett weights over max(1, int(4 (n / 100)^(2 / 9))) lags, without a small-sample factor. Scores are lagged by a
    window over dates, so the driver sees k by k sums a lag and nothing else.
    """
    df = df.select(date, y, *xs).na.drop().persist()  # a row a date, read once for each sum
    one = [F.lit(1.0), *(F.col(x) for x in xs)]
    n = df.count()
    k = len(one)
    if n <= k:
        raise ValueError(f"{n} rows for {k} coefficients")
    xx, xy = _moments(df, one, one), _moments(df, one, [F.col(y)])[:, 0]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    fit = sum((float(b) * c for b, c in zip(beta[1:], one[1:], strict=True)), F.lit(float(beta[0])))
    scored = df.withColumn("e", F.col(y) - fit)
    scored = scored.select(date, "e", F.col(y).alias("_y"), *((F.col("e") * c).alias(f"s{i}") for i, c in enumerate(one)))
    row = scored.agg(F.sum(F.col("e") ** 2), F.var_pop("_y") * F.count("*")).first()
    sse, sst = float(row[0]), float(row[1])
    s = [F.col(f"s{i}") for i in range(k)]
    meat = _moments(scored, s, s)
    lags = max(1, int(4 * (n / 100) ** (2 / 9)))
    w = Window.orderBy(date)
    for lag in range(1, lags + 1):
        gamma = _moments(scored.select(*s, *(F.lag(x, lag).over(w).alias(f"l{i}") for i, x in enumerate(s))), s, [F.col(f"l{i}") for i in range(k)])
        meat += (1 - lag / (lags + 1)) * (gamma + gamma.T)
    df.unpersist()
    plain = np.sqrt(np.maximum(0, np.diag(inverse) * sse / (n - k)))
    robust = np.sqrt(np.maximum(0, np.diag(inverse @ meat @ inverse)))
    r2 = 1 - sse / sst if sst > 0 else 0.0
    return {"n": n, "beta": beta, "se": plain, "se_nw": robust, "t": beta / np.where(robust > 0, robust, np.nan), "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "lags": lags}


def _root(x: Column) -> Column:
    return F.when(x.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), x)))


def _cleared(m: DataFrame, j: int) -> DataFrame:
    """m with its matrix after one step of elimination: row j over its pivot, and as much of it off each other row."""
    m = m.withColumn("p", F.transform(F.col("m")[j], lambda v: F.try_divide(v, F.col("m")[j][j])))

    def row(r: Column, i: Column) -> Column:
        return F.when(i == j, F.col("p")).otherwise(F.zip_with(r, F.col("p"), lambda a, b: a - r[j] * b))

    return m.withColumn("m", F.transform("m", row))


def grouped(df: DataFrame, by: list[str], y: str, xs: list[str], date: str = "date", lags: int | None = None) -> DataFrame:
    """The regression of `ols` for each group at once, as columns: (by, n, lags, terms, beta, se, se_nw, t, r2, adj_r2).

    terms, beta, se, se_nw and t are arrays, the constant first. One pass sums X'X and X'y by group, elimination on that
    small matrix is an expression, and a second pass sums the lagged products of scores, which a window over each group's dates
    gives. Nothing comes to the driver but the number of lags that the longest group needs. Rows with a null are left out; a
    group with too few rows or with regressors that depend on each other has nulls.
    """
    k = len(xs) + 1
    df = df.select(*by, date, y, *xs).na.drop(subset=[y, *xs])
    one = [F.lit(1.0), *(F.col(x) for x in xs)]
    matrix = F.array(*(F.array(*(F.sum(a * b) for b in one), F.sum(a * F.col(y)), *(F.lit(float(i == j)) for j in range(k))) for i, a in enumerate(one)))
    m = df.groupBy(*by).agg(F.count("*").alias("n"), matrix.alias("m"), F.avg(y).alias("_mean"))
    # Each step clears one column of (X'X | X'y | 1); the numbers are steps' results, so no expression is written out twice.
    for j in range(k):
        m = _cleared(m, j)
    m = m.withColumn("lags", F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int")) if lags is None else F.lit(lags))
    m = m.select(*by, "n", "lags", "_mean", F.when(F.col("n") > k, F.transform("m", lambda row: row[k])).alias("beta"), F.transform("m", lambda row: F.slice(row, k + 2, k)).alias("inverse"))
    most = lags if lags is not None else m.agg(F.max("lags")).first()[0] or 1
    fit = sum((F.col("beta")[i] * x for i, x in enumerate(one)), F.lit(0.0))
    e = df.join(m.select(*by, "beta", "lags", "_mean"), by).withColumn("e", F.col(y) - fit)
    e = e.select(*by, date, "lags", "e", (F.col(y) - F.col("_mean")).alias("c"), *((F.col("e") * x).alias(f"s{i}") for i, x in enumerate(one)))
    w = Window.partitionBy(*by).orderBy(date)
    weight = lambda lag: F.greatest(F.lit(0.0), 1 - lag / (F.col("lags") + 1))
    behind = [sum((weight(lag) * F.coalesce(F.lag(f"s{i}", lag).over(w), F.lit(0.0)) for lag in range(1, most + 1)), F.lit(0.0)).alias(f"a{i}") for i in range(k)]
    e = e.select(*by, "e", "c", *(f"s{i}" for i in range(k)), *behind)
    meat = F.array(*(F.array(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}") + F.col(f"s{i}") * F.col(f"a{j}") + F.col(f"a{i}") * F.col(f"s{j}")) for j in range(k))) for i in range(k)))
    s = e.groupBy(*by).agg(F.sum(F.col("e") ** 2).alias("sse"), F.sum(F.col("c") ** 2).alias("sst"), meat.alias("meat"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    out = m.join(s, by).withColumns({
        "se": F.transform(F.col("inverse"), lambda row, i: _root(row[i] * F.col("sse") / F.nullif(F.col("n") - k, F.lit(0)))),
        "se_nw": F.transform(F.col("inverse"), lambda row: _root(dot(row, F.transform(F.col("meat"), lambda r: dot(r, row))))),
        "r2": F.when(F.col("sse").isNotNull(), F.coalesce(1 - F.try_divide("sse", "sst"), F.lit(0.0))),
    })
    return out.select(*by, "n", "lags", F.array(*map(F.lit, ["alpha", *xs])).alias("terms"), "beta", "se", "se_nw", F.zip_with("beta", "se_nw", lambda b, s: F.try_divide(b, s)).alias("t"), "r2", (1 - (1 - F.col("r2")) * F.try_divide(F.col("n") - 1, F.col("n") - k)).alias("adj_r2"))
