"""Quality classifier by co-training: a view of the text and a view of the page's data label documents for each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.llm.shingles import LOWER, Shingler
from hypolith.llm.tables import table, written

#: Labelled documents to fit on at most, rounds in which the views label all other documents for each other, the least
#: confidence, and the weight of such a label against a given one.
LABELLED, ROUNDS, SURE, TOLD = 6000, 2, 0.95, 0.3
#: Width of the hashed features of the text and of the page's data.
TEXT, META = 1 << 18, 1 << 10
#: Documents that a feature must be active in; rarer ones say nothing.
SEEN = 3
#: How much of an unsure contrast is kept: at 1 the share by which it passes chance, at 0 all of it.
SHRINK = 0.7
#: Bytes of a word's begin, and in how many words of a text the same begin counts once more.
BEGIN, AGAIN = 5, 3
#: Weight of the squared weights in the fit.
RIDGE = 2e-3
#: Parts of the labelled documents; each is calibrated on by a fit to the others.
FOLDS = 5
HEADS = ("quality", "toxic")
#: The document columns that are read; those missing or null count as unknown.
COLUMNS = ("text", "lang", "source", "n_chars")
FEATURES = "text_at array<int>, meta_at array<int>"


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _bin(x: float, width: float) -> int:
    return int(min(63, max(0.0, x) // width))


class Viewer:
    """The active features of a document in each view, as distinct positions."""

    def __init__(self):
        self.shingler, self.held = Shingler(1), {}

    def _named(self, *name: object) -> int:
        if (h := self.held.get(name)) is None:
            if len(self.held) > 50_000:
                self.held.clear()
            h = self.held[name] = int(self.shingler.words("_".join(map(str, name)).replace(" ", "_"))[0] >> np.uint64(32))
        return h

    def text(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        words, n = self.shingler.words(text, _BARE), max(1, len(raw))
        kinds = np.bincount(_CLASS[raw], minlength=6) / n
        at = _distinct((words >> np.uint64(32)).astype(np.int32) & (TEXT - 1))
        lines = text.split("\n")
        long = len(text) / len(lines)
        ended = sum(x.endswith((".", "!", "?", ":", '"')) for x in lines) / len(lines)
        shape = [self._named(k, _bin(v, w)) for k, v, w in (
            ("lines", np.log2(1 + len(lines)), 0.5), ("line", np.log2(1 + long), 0.5), ("ended", ended, 0.1), ("unique", len(set(lines)) / len(lines), 0.1),
            ("symbols", kinds[1], 0.01), ("upper", kinds[2], 0.03), ("digits", kinds[3], 0.02), ("blank", kinds[4], 0.02), ("stops", kinds[5], 0.01),
            ("same", (words[1:] == words[:-1]).mean() if len(words) > 1 else 0, 0.02), ("distinct", len(at) / max(1, len(words)), 0.05), ("long", n / max(1, len(words)), 0.5),
        )]
        shape.append(self._named("both", _bin(ended, 0.25), _bin(np.log2(1 + long), 1)))
        return _distinct(np.concatenate([at, np.array(shape, np.int64).astype(np.int32) & (TEXT - 1), self._begins(raw)]))

    def _begins(self, raw: np.ndarray) -> np.ndarray:
        """The first BEGIN bytes of the words that have so many, and those that AGAIN words and more begin with: words that were
        never seen often begin like words that were."""
        raw = np.concatenate([[0x20], _BARE_BYTES[raw], np.full(BEGIN + 1, 0x20)]).astype(np.int64)
        space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
        start = np.flatnonzero(space[: -BEGIN - 1] & ~space[1:-BEGIN]) + 1
        h, long = np.zeros(len(start), np.int64), np.ones(len(start), bool)
        for k in range(BEGIN):
            long &= ~space[start + k]
            h = h * 256 + raw[start + k]
        each, often = np.unique(h[long], return_counts=True)
        mixed = lambda x, salt: (((x * 0x9E3779B1 + salt) >> 13) & (TEXT - 1)).astype(np.int32)
        return np.concatenate([mixed(each, 0), mixed(each[often >= AGAIN], 23_757)])

    def meta(self, lang: object, source: object, chars: object) -> np.ndarray:
        """What the table says of the document beside its text: each column, and pairs of them."""
        size = "none" if chars is None or chars != chars else _bin(np.log2(1 + max(0, chars)), 0.5)
        names = (("lang", lang), ("source", source), ("chars", size), ("lang source", lang, source), ("lang chars", lang, size), ("source chars", source, size))
        return np.unique(np.array([self._named(*x) for x in names]) % META).astype(np.int32)


#: Lower-cases A-Z and takes punctuation off words.
_BARE = bytes(0x20 if chr(i) in ".,;:!?\"'()" else b for i, b in enumerate(LOWER))
_BARE_BYTES = np.frombuffer(_BARE, np.uint8)
_CLASS = np.zeros(256, np.int64)
for _chars, _kind in (("#$%&*|<>{}[]^~=+_/\\@!", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\n\r\x0b\x0c", 4), (".,;:?", 5)):
    _CLASS[[ord(c) for c in _chars]] = _kind


class Told:
    """Documents that the other view labelled: how many of each class, and in how many each feature was active."""

    def __init__(self, width: int):
        self.n, self.active = np.zeros(2), np.zeros((2, width))


class Rows:
    """A sparse matrix of ones."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.size = np.array([len(r) for r in rows], np.int64)
        # Places in four bytes each: all labelled rows' features lie in the driver's memory.
        self.all = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)
        self.of = np.repeat(np.arange(self.n, dtype=np.int32), self.size)
        count = np.bincount(self.all, minlength=width)
        # Only the features that are left get numbers to fit; names holds their positions.
        self.names = np.flatnonzero(count >= max(1, min(SEEN, self.n)))
        place = np.full(width, -1, np.int32)
        place[self.names] = np.arange(len(self.names))
        often = place[self.all] >= 0
        self.at, self.row = place[self.all[often]], self.of[often]

    def contrast(self, y: np.ndarray, weight: np.ndarray, told: Told) -> np.ndarray:
        """The log ratio of each feature's share among the ones to that among the zeros, over the weighted rows and the told
        documents, shrunk by how surely the shares differ; 0 for features that fewer than SEEN have.

        Few labels and many words make chance contrasts, which together drown the real ones. The likelihood ratio of two
        shares against one is what the largest of as many features without a difference reaches, twice the log of their number,
        or more: a feature keeps that part of its contrast, to the power SHRINK, by which it passes that. One example that is like all is added.
        """
        sizes, active = [], []
        for k, p in ((1, y), (0, 1 - y)):
            sizes.append(max(1e-9, (weight * p).sum() + told.n[k] * TOLD))
            active.append(np.bincount(self.all, (weight * p)[self.of], self.width) + told.active[k] * TOLD)
        total, both = sum(sizes), active[0] + active[1]
        shares = [(a + n / total) / n for a, n in zip(active, sizes, strict=True)]
        often = both >= min(SEEN, self.n)

        def log(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(p, 1e-12)), 0.0)

        ratio = np.zeros(self.width)
        for a, n in zip(active, sizes, strict=True):
            ratio += 2 * (log(a, both * n / total) + log(n - a, (total - both) * n / total))
        chance = 2 * np.log(max(2, often.sum()))
        return np.where(often, np.log(shares[0] / shares[1]) * np.maximum(0, 1 - chance / np.maximum(ratio, 1e-9)) ** SHRINK, 0.0)

    def fit(self, y: np.ndarray, weight: np.ndarray, told: Told, steps: int = 150, ridge: float = RIDGE) -> np.ndarray:
        """Logistic regression on features scaled by their contrast, by adaptive gradient steps over all rows.

        The scale makes telling features cheap, so that few labels are enough; the sum of all contrasts is a feature too,
        by which those count that only told documents have. The weights that are returned belong to the plain
        features; the last is the constant.
        """
        scale = self.contrast(y, weight, told)
        # Features without a contrast have no weight, so the steps go over those that have one alone.
        left = np.flatnonzero(scale[self.names])
        place = np.full(len(self.names), -1)
        place[left] = np.arange(len(left))
        use = place[self.at] >= 0
        names, at, row = self.names[left], place[self.at[use]], self.row[use]
        value = scale[names][at]
        sums = np.bincount(self.of, scale[self.all], self.n) / 10
        w, size = np.zeros(len(names) + 2), np.zeros(len(names) + 2)
        total, rate = max(1e-9, weight.sum()), 0.1
        for _ in range(steps):
            r = weight * (_chance(np.bincount(row, w[at] * value, self.n) + w[-2] * sums + w[-1]) - y) / total
            g = np.concatenate([np.bincount(at, r[row] * value, len(names)), [r @ sums, r.sum()]])
            g[:-1] += ridge * w[:-1]
            size += g * g
            w -= rate * g / (np.sqrt(size) + 1e-8)
        out = np.append(scale * w[-2] / 10, w[-1])
        out[names] += w[:-2] * scale[names]
        return out

    def odds(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.all], self.n) + w[-1]


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scaled(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt's calibration: weights for each column of odds and a constant, by Newton's steps with a light ridge."""
    x = np.column_stack([odds, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _chance(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


def fitted(views: tuple[Rows, Rows], y: np.ndarray, fold: np.ndarray, told: tuple[Told, Told]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Weights of both views, the calibration of each, and that of both together, from labelled rows (y: 0 or 1, -1 where
    this label is missing) and what the other view told. Each fold is calibrated on by fits that didn't see it. With one
    class alone the weights are zero, so that nothing is told apart."""
    known = y >= 0
    if len(set(y[known])) < 2:
        return [np.zeros(v.width + 1) for v in views], [np.zeros(2)] * 2, np.zeros(3)
    given, odds = np.where(known, y, 0.5), np.zeros((len(y), 2))
    for k in range(FOLDS):
        if (mine := known & (fold == k)).any():
            weight = (known & (fold != k)).astype(float)
            for i, v in enumerate(views):
                odds[mine, i] = v.odds(v.fit(given, weight, told[i]))[mine]
    scale = [_scaled(odds[known, i : i + 1], y[known]) for i in range(2)]
    both = np.column_stack([odds[known, i] * s[0] + s[1] for i, s in enumerate(scale)])
    return [v.fit(given, known.astype(float), told[i]) for i, v in enumerate(views)], scale, _scaled(both, y[known])


def _told(model: dict[str, tuple], sure: float) -> Callable:
    """Rows of TOLD_ROWS for (known, text_at, meta_at): over the documents without a label of which a view is sure, in how
    many each feature of the other view is active; feature -1 has the documents."""
    packed = {h: ([w.astype(np.float32) for w in m[0]], m[1]) for h, m in model.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((4, width + 1), np.int64) for width in (TEXT, META)]
        # A thousand documents at a time, for each of their features takes some numbers.
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, len(b), 1024)):
            free = ~np.asarray(batch.column(0), bool)
            lists = []
            for c in (1, 2):
                at = np.asarray(batch.column(c).flatten(), np.int64)
                size = np.asarray(pa.compute.list_value_length(batch.column(c)), np.int64)
                lists.append((at, np.repeat(np.arange(len(free)), size)))
            for h, (weights, scale) in enumerate(packed.values()):
                for me in (0, 1):
                    at, row = lists[me]
                    p = _chance(scale[me][0] * (np.bincount(row, weights[me][at], len(free)) + weights[me][-1]) + scale[me][1])
                    for one, yes in ((1, p >= sure), (0, p <= 1 - sure)):
                        yes = yes & free
                        at2, row2 = lists[1 - me]
                        total[1 - me][2 * h + one][:-1] += np.bincount(at2[yes[row2]], minlength=total[1 - me].shape[1] - 1)
                        total[1 - me][2 * h + one][-1] += yes.sum()
        for view, t in enumerate(total):
            some = np.flatnonzero(t.any(0))
            for i in range(0, len(some), 1 << 16):
                part = some[i : i + (1 << 16)]
                feature = np.where(part == t.shape[1] - 1, -1, part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), view, np.int32)), pa.array(feature.astype(np.int32)), *(pa.array(t[k, part]) for k in range(4))], ["view", "feature", "a", "b", "c", "d"])

    return run


TOLD_ROWS = "view int, feature int, a long, b long, c long, d long"
TOLD_LISTS = "view int, block int, feature array<int>, a array<long>, b array<long>, c array<long>, d array<long>"
#: Features of a block, as a power of two: the sums of a block of all tasks meet in one place.
BLOCK = 10


def _lists(view: int, block: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row of TOLD_LISTS."""
    kinds = [pa.int32(), *[pa.int64()] * 4]
    one = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, k)) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([view], pa.int32()), pa.array([block], pa.int32()), *one], [x.split()[0] for x in TOLD_LISTS.split(", ")])


def _listed(told: Callable, bits: int = 16) -> Callable:
    """The batches of `told` as rows of TOLD_LISTS: a task gives as many rows as it has blocks of features, whatever its
    documents hold. The documents' own count, feature -1, is in the first block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in told(batches):
            view, (feature, *sums) = b.column(0)[0].as_py(), (c.to_numpy(zero_copy_only=False) for c in b.columns[1:])
            block = np.maximum(feature, 0) >> bits
            for k in np.unique(block):
                yield _lists(view, int(k), [x[block == k] for x in (feature, *sums)])

    return run


def _added(rows: pa.Table) -> pa.Table:
    """The sums of one block of one view, of all tasks, as one row."""
    flat = [pa.compute.list_flatten(rows.column(c)).to_numpy() for c in ("feature", *"abcd")]
    names, place = np.unique(flat[0], return_inverse=True)
    total = np.zeros((4, len(names)), np.int64)
    for t, x in zip(total, flat[1:], strict=True):
        np.add.at(t, place, x)
    return pa.Table.from_batches([_lists(rows.column("view")[0].as_py(), rows.column("block")[0].as_py(), [names, *total])])


def _columns(docs: DataFrame) -> list[Column]:
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS]


def _viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text_at, meta_at) of (id, *COLUMNS), some hundred rows at a time, so that a task holds the features of no more."""
    v = Viewer()

    def lists(rows: list[np.ndarray]) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32), pa.int32()))

    for batch in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):
        rows = [(v.text(t or ""), v.meta(a, s, c)) for t, a, s, c in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), lists([a for a, _ in rows]), lists([b for _, b in rows])], ["id", "text_at", "meta_at"])


def trained(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE, id_col: str = "doc_id") -> dict[str, tuple]:
    """The fitted views for `quality` and `toxic`.

    At most `labelled` labelled documents, the first in the order of a hash of the id among those whose documents are
    there, come to the driver, a row an id. In every round all other documents are scored on Spark by both views, and how
    often each feature occurs among those of which a view is sure is summed for the other view's next fit: as many
    rows as there are features come to the driver, however many documents they sum up.
    """
    key = F.col(id_col).cast("long").alias(id_col)
    viewed = docs.select(key, *_columns(docs)).mapInArrow(_viewed, f"id long, {FEATURES}").withColumnRenamed("id", id_col)
    viewed = written(viewed, "views", wide=True)
    given = labels.filter(F.col(id_col).isNotNull()).groupBy(key).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    there = given.join(viewed.select(id_col).distinct(), id_col, "left_semi").orderBy(F.xxhash64(id_col, F.lit(1)), id_col).limit(labelled)
    some = F.broadcast(written(there, "sample"))  # at most `labelled` rows
    one = viewed.join(some, id_col).groupBy(id_col).agg(F.min(F.struct("text_at", "meta_at")).alias("v"), F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    pdf = written(one.select("v.*", *(F.coalesce(h, F.lit(-1)).alias(h) for h in HEADS), F.xxhash64(id_col).alias("h")), "labelled").toPandas().sort_values("h")
    views = tuple(Rows(list(pdf[c]), width) for c, width in (("text_at", TEXT), ("meta_at", META)))
    pdf = pdf[["h", *HEADS]]
    fold = pdf["h"].to_numpy(np.int64) % FOLDS
    told = {h: (Told(TEXT), Told(META)) for h in HEADS}
    rest = viewed.join(some.select(id_col, F.lit(True).alias("k")), id_col, "left").select(F.coalesce("k", F.lit(False)).alias("known"), "text_at", "meta_at")
    # Every task tells a sum for each feature it meets, so what is told grows with the tasks: they are as many as the cores ask
    # for, however many files the documents lie in.
    rest = rest.coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)
    for k in range(rounds + 1):
        model = {h: fitted(views, pdf[h].to_numpy(float), fold, told[h]) for h in HEADS}
        if k == rounds or not any(m[2].any() for m in model.values()):
            return model
        each = rest.mapInArrow(_listed(_told(model, sure), BLOCK), TOLD_LISTS).groupBy("view", "block").applyInArrow(_added, TOLD_LISTS)
        # Rows are made of the lists when they are summed up, so that they are no more than there are features.
        sums = each.select("view", F.explode(F.arrays_zip("feature", *"abcd")).alias("x")).select("view", "x.*")
        found = written(sums, "told").toPandas()
        told = {h: (Told(TEXT), Told(META)) for h in HEADS}
        for i, h in enumerate(HEADS):
            for view in (0, 1):
                part = found[found["view"] == view]
                n = part["feature"].to_numpy() < 0
                for one, c in ((0, "abcd"[2 * i]), (1, "abcd"[2 * i + 1])):
                    told[h][view].n[one] = part[c][n].sum()
                    told[h][view].active[one][part["feature"][~n].to_numpy()] = part[c][~n]
    return model


def scorer(model: dict[str, tuple]) -> Callable[..., Column]:
    """A column function of COLUMNS: calibrated chances by text, by the page's data and by both, and of toxicity."""
    packed = {k: ([w.astype(np.float32) for w in m[0]], m[1], m[2]) for k, m in model.items()}

    def score(text: pd.Series, lang: pd.Series, source: pd.Series, chars: pd.Series) -> pd.DataFrame:
        v, out = Viewer(), []
        for t, a, s, c in zip(text, lang, source, chars, strict=True):
            at, row = (v.text(t or ""), v.meta(a, s, c)), []
            for views, scale, both in packed.values():
                odds = [k[0] * (float(w[x].sum()) + float(w[-1])) + k[1] for w, x, k in zip(views, at, scale, strict=True)]
                row += [*odds, both[0] * odds[0] + both[1] * odds[1] + both[2]]
            out.append(row)
        p = _chance(np.array(out, float).reshape(-1, 6))
        return pd.DataFrame({"text_score": p[:, 0], "meta_score": p[:, 1], "quality_score": p[:, 2], "toxic_score": p[:, 5]})

    return F.pandas_udf(score, "text_score double, meta_score double, quality_score double, toxic_score double")


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", name: str = "quality", **bounds: int) -> DataFrame:
    """docs with a struct `name` (text_score, meta_score, quality_score, toxic_score, kept) for each row.

    One view reads the text, the other what the table says beside it (language, source, length).

    kept: the chance of good quality is at least one half and that of toxicity below one half. Null texts count as
    empty, and unknown columns as one unknown value. Without labels of both classes all chances are one half and every
    document is kept. Repeated rows get equal scores, and chances of exactly one half are kept; texts are read whole,
    however long. Other columns are passed on untouched, but one that is called `name` is replaced. Labels of ids that no
    document has are ignored; an id labelled twice takes the larger label, and one with several texts is fitted on once.
    An empty table gives no rows.
    """
    score = scorer(trained(docs, labels, id_col=id_col, **bounds))(*_columns(docs))
    kept = (F.col(f"{name}.quality_score") >= 0.5) & ~(F.col(f"{name}.toxic_score") > 0.5)
    return docs.withColumn(name, score).withColumn(name, F.col(name).withField("kept", kept))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", *COLUMNS)
    return classified(docs, table(spark, sf_dir, "labels")).select("doc_id", "quality.*")
