"""Places where a user's own function is called: on each document, on each resample, on each date's positions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Calls of an extractor on one document before it is given up.
TRIES = 3


def extracted(docs: DataFrame, key: str, text: str, extractor: Callable[[str], Iterable[dict]], schema: str, tries: int = TRIES) -> DataFrame:
    """(key, item, error, and the columns of schema): a row for each dict that `extractor` gives for a document.

    A document is taken once all its dicts were made; a call that fails is made again, `tries` times in all, and then the
    document has one row with the error's text. A document without dicts has no row; null texts are empty. Items count
    from 0. Columns that a dict lacks are null.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kind = docs.schema[key].dataType.simpleString()

    def one(k: object, t: str) -> list[tuple]:
        for left in range(tries - 1, -1, -1):
            try:
                return [(k, i, None, *(x.get(c) for c in names)) for i, x in enumerate(extractor(t))]
            except Exception as e:  # the user's own code may raise anything
                if not left:
                    return [(k, 0, f"{type(e).__name__}: {e}", *(None for _ in names))]
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for k, t in zip(f[key], f[text], strict=True) for r in one(k, t or "")]
            yield pd.DataFrame(rows, columns=[key, "item", "error", *names], dtype=object)

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, item int, error string, {schema}")


def per_group(df: DataFrame, by: list[str], hook: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """(by, and the columns of schema): what `hook` says of each group's rows, one dict a group. Groups are resamples of a series
    or a date's positions, which the calendar and the market bound."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        said = hook(rows)
        return pd.DataFrame([[*key, *(said.get(c) for c in names)]], columns=[*by, *names])

    return df.groupBy(*by).applyInPandas(run, f"{kinds}, {schema}")


def sized(positions: DataFrame, hook: Callable[[pd.DataFrame], pd.Series], by: str = "date", weight: str = "weight") -> DataFrame:
    """positions with the weights that `hook` gives for the rows of each date, in their order by ticker. Weights that are missing or
    not finite count as 0, negative ones stay; a date's gross weight over 1 is scaled to 1."""
    names = [c for c in positions.columns if c != weight]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ticker").reset_index(drop=True)
        w = pd.to_numeric(pd.Series(hook(rows[names])).reset_index(drop=True), errors="coerce").reindex(rows.index)
        w = w.where(w.abs() < float("inf")).fillna(0.0)
        gross = w.abs().sum()
        return rows[names].assign(**{weight: w / gross if gross > 1 else w})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in positions.select(*names).schema.fields)
    return positions.select(*names).groupBy(by).applyInPandas(run, f"{schema}, {weight} double")


def asked(rows: DataFrame, columns: list[str], function: Callable[..., object], tries: int = TRIES) -> DataFrame:
    """rows with `answer`, what `function` says of the columns' values as text, and `error`, what it raised at its last try (the answer is
    null then). Equal questions are asked once in a batch; a null answer is no error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def one(values: tuple) -> tuple[str | None, str | None]:
        for left in range(tries - 1, -1, -1):
            try:
                said = function(*values)
                return (None if said is None else str(said)), None
            except Exception as e:  # the user's own code may raise anything
                if not left:
                    return None, f"{type(e).__name__}: {e}"
        return None, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known: dict[tuple, tuple] = {}
            said = [known[q] if q in known else known.setdefault(q, one(q)) for q in zip(*(f[c] for c in columns), strict=True)]
            yield f.assign(answer=pd.Series([a for a, _ in said], index=f.index, dtype=object), error=pd.Series([e for _, e in said], index=f.index, dtype=object))

    return rows.mapInPandas(run, f"{schema}, answer string, error string")
