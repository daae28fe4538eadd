"""Masked pseudo-likelihood: a window network guesses every word from those on both sides of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.llm.shingles import Shingler
from hypolith.llm.tables import table, written

#: The network's outputs are a path of two choices, a group and a member of it. The first FREQUENT members of all groups are
#: the most frequent words, one each; the others share what is left of the vocabulary by the words' hashes.
GROUPS, MEMBERS, FREQUENT = 32, 32, 512
#: Words whose counts every task holds (16 bytes each); rarer ones meet their counts in a join.
COMMON = 1 << 16
#: Words on each side, numbers a word, hidden numbers, input vectors that words share by hash.
SIDE, WIDTH, HIDDEN, INPUTS = 2, 12, 24, 1 << 13
#: Step of training, words a step and a scored block, and words a copy of the network is trained on.
RATE, BATCH, SHARD = 0.1, 4096, 4_000_000
#: What is added to a word's count.
PRIOR = 0.5
#: Numbers a row when networks are averaged.
BLOCK = 1024


class Vocabulary:
    """The cell (group * MEMBERS + member) of each word, and the counts of the most frequent words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        """words: hashes from the most frequent on, COMMON at most."""
        frequent = words[:FREQUENT]
        order = np.argsort(frequent)
        rank = np.arange(len(frequent))
        self.frequent, self.cell = frequent[order], (rank % GROUPS * MEMBERS + rank // GROUPS)[order]
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]

    @staticmethod
    def find(held: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(held):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(held, words), len(held) - 1)
        return at, held[at] == words

    def cells(self, words: np.ndarray) -> np.ndarray:
        own = FREQUENT // GROUPS
        shared = (words >> np.uint64(24)).astype(np.int64) % GROUPS * MEMBERS + own + (words >> np.uint64(40)).astype(np.int64) % (MEMBERS - own)
        at, hit = self.find(self.frequent, words)
        return np.where(hit, self.cell[at], shared) if len(self.frequent) else shared


class Network:
    """The chances of a word's group, and of its member in the group, from the vectors of 2 * SIDE words around it (0
    beyond the text), by one hidden layer."""

    SHAPES = ((INPUTS + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, MEMBERS), (GROUPS, MEMBERS))

    def __init__(self, flat: np.ndarray | None = None, seed: int = 3):
        r = np.random.default_rng(seed)
        sizes = [int(np.prod(s)) for s in self.SHAPES]
        if flat is None:
            flat = np.concatenate([r.normal(0, (0.3, 0.15, 0, 0.15, 0, 0.15, 0)[i], n) for i, n in enumerate(sizes)])
        self.parts = [p.reshape(s).copy() for p, s in zip(np.split(np.asarray(flat, np.float32), np.cumsum(sizes)[:-1]), self.SHAPES, strict=True)]
        self.parts[0][INPUTS] = 0
        self.pace = [np.full(s if i else s[:1], 1e-4, np.float32) for i, s in enumerate(self.SHAPES)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    @staticmethod
    def around(words: np.ndarray) -> np.ndarray:
        """For each word the inputs of its neighbours, left to right; short integers, which sort by digits."""
        ids = (words >> np.uint64(20)).astype(np.int16) & np.int16(INPUTS - 1)
        edge = np.full(SIDE, INPUTS, np.int16)
        padded = np.concatenate([edge, ids, edge])
        return np.stack([padded[SIDE + d : SIDE + d + len(ids)] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        """Of each column. Words lie along the last axis everywhere, so that sums over outputs add long rows."""
        z -= z.max(0)
        np.exp(z, out=z)
        z /= z.sum(0)
        return z

    def _hidden(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The input vectors (a row a word) and the hidden numbers (a column a word)."""
        x = self.parts[0].take(near, 0).reshape(len(near), -1)
        a = self.parts[1].T @ x.T
        a += self.parts[2][:, None]
        return x, np.maximum(a, 0, out=a)

    @staticmethod
    def _by_group(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """An order in which the words of a group lie together, group and member in it, and (group, begin, end)."""
        group, member = np.divmod(cells, MEMBERS)
        order = np.argsort(group.astype(np.int16), kind="stable")
        group, member = group[order], member[order]
        bounds = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        return order, group, member, [(g, i, j) for g, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)) if i < j]

    def log_cells(self, near: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The log chance of each word's cell."""
        order, group, member, runs = self._by_group(cells)
        a, at = self._hidden(near[order])[1], np.arange(len(cells))
        p = self._softmax(self.parts[3].T @ a + self.parts[4][:, None])[group, at]
        p = np.log(np.maximum(p, 1e-12))
        for g, i, j in runs:
            p[i:j] += np.log(np.maximum(self._softmax(self.parts[5][g].T @ a[:, i:j] + self.parts[6][g][:, None])[member[i:j], at[: j - i]], 1e-12))
        out = np.empty_like(p)
        out[order] = p
        return out

    def step(self, near: np.ndarray, cells: np.ndarray, rate: float) -> None:
        """One step by each number's own pace: the rate over the root of its squared gradients so far."""
        word, w1, _, w2, _, w3, _ = self.parts
        n = len(near)
        order, group, member, runs = self._by_group(cells)
        near, at = near[order], np.arange(n)
        x, a = self._hidden(near)
        z = self._softmax(w2.T @ a + self.parts[4][:, None])
        z[group, at] -= 1
        z /= n
        da = w2 @ z
        grads = [None, None, None, a @ z.T, z.sum(1), np.zeros_like(w3), np.zeros_like(self.parts[6])]
        for g, i, j in runs:
            y = self._softmax(w3[g].T @ a[:, i:j] + self.parts[6][g][:, None])
            y[member[i:j], at[: j - i]] -= 1
            y /= n
            grads[5][g], grads[6][g] = a[:, i:j] @ y.T, y.sum(1)
            da[:, i:j] += w3[g] @ y
        da *= a > 0
        grads[1], grads[2] = x.T @ da.T, da.sum(1)
        dx = (da.T @ w1.T).reshape(-1, WIDTH)
        for p, g, h in zip(self.parts[1:], grads[1:], self.pace[1:], strict=True):
            h += g * g
            p -= rate * g / np.sqrt(h)
        at = near.ravel()
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        g, at = np.add.reduceat(dx.take(order, 0), first), at[first]
        self.pace[0][at] += np.einsum("ij,ij->i", g, g)
        word[at] -= rate * g / np.sqrt(self.pace[0][at])[:, None]
        word[INPUTS] = 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, held, size = Shingler(1), [], 0

    def summed() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            words = hasher.words(text.as_py())
            if len(words):
                held.append(words)
                size += len(words)
            if size >= 2_000_000:
                yield summed()
                held, size = [], 0
    if held:
        yield summed()


class Counts:
    """How often each word occurs in all texts: a table as long as the vocabulary (word, n), its most frequent words, and by
    cell the number of words that occur and of distinct ones."""

    def __init__(self, docs: DataFrame, text_col: str = "text", common: int = COMMON):
        rows = docs.select(F.col(text_col).cast("string")).mapInArrow(_counted, "word long, n long")
        self.table = written(rows.groupBy("word").agg(F.sum("n").alias("n")), "counts", wide=True)
        # The words from some count on, as many as are allowed, by a histogram of counts in steps of an eighth of a doubling.
        step = F.floor(F.log2("n") * 8)
        steps = sorted((r[0], r[1]) for r in self.table.groupBy(step).count().collect())
        while steps and sum(n for _, n in steps) > common:
            steps.pop(0)
        top = self.table.filter(step >= (steps[0][0] if steps else 1 << 20)).toPandas().sort_values(["n", "word"], ascending=[False, True])
        self.words, self.n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
        vocabulary = self.vocabulary()

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, GROUPS * MEMBERS), np.int64)
            for batch in batches:
                at = vocabulary.cells(batch.column(0).to_numpy().view(np.uint64))
                np.add.at(total[0], at, batch.column(1).to_numpy())
                total[1] += np.bincount(at, minlength=GROUPS * MEMBERS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS * MEMBERS)), pa.array(total[0]), pa.array(total[1])], ["cell", "n", "kinds"])

        by = self.table.mapInArrow(cells, "cell long, n long, kinds long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toPandas()
        self.cells, self.kinds = np.zeros((2, GROUPS * MEMBERS))
        self.cells[by["cell"]], self.kinds[by["cell"]] = by["n"], by["kinds"]

    def vocabulary(self) -> Vocabulary:
        return Vocabulary(self.words, self.n)

    @property
    def total(self) -> int:
        return int(self.cells.sum())


def _trainer(flat: np.ndarray, vocabulary: Vocabulary, rate: float):
    flat = flat.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, hasher, n = Network(flat), Shingler(1), 0
        near, right, held = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                words = hasher.words(text.as_py())
                for i in range(0, len(words), BATCH):
                    # A stretch of a long text, with its neighbours on both sides.
                    low = max(0, i - SIDE)
                    near.append(net.around(words[low : i + BATCH + SIDE])[i - low : i - low + BATCH])
                    right.append(vocabulary.cells(words[i : i + BATCH]))
                    held += len(right[-1])
                    if held >= BATCH:
                        x, y = np.concatenate(near), np.concatenate(right)
                        net.step(x[:BATCH], y[:BATCH], rate)
                        n += BATCH
                        near, right, held = [x[BATCH:]], [y[BATCH:]], held - BATCH
        if held:
            net.step(np.concatenate(near), np.concatenate(right), rate)
            n += held
        if n:
            blocks = np.array_split(net.flat().astype(np.float64), -(-len(flat) // BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int64()), pa.array([n] * len(blocks), pa.float64()), pa.array(blocks, pa.list_(pa.float64()))], ["block", "weight", "numbers"])

    return run


def trained(docs: DataFrame, counts: Counts, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, rate: float = RATE, shard: int = SHARD) -> Network:
    """A network fitted on every word of every text.

    Texts are dealt by a hash of id and text to as many shards as the number of words asks for, and lie there in the
    hash's order, so that the network depends on the rows and not on how the table is cut. A copy is trained in each
    shard; their mean, weighted by words and summed on Spark, is the network, or where the next round starts.
    """
    flat, vocabulary = Network().flat(), counts.vocabulary()
    cut = np.cumsum([0, *(len(x) for x in np.array_split(flat, -(-len(flat) // BLOCK)))])
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("h")).filter("text is not null")
    rows = rows.repartition(max(1, -(-counts.total // shard)), "h").sortWithinPartitions("h", "text").select("text")
    for k in range(rounds):
        copies = rows.mapInArrow(_trainer(flat, vocabulary, rate / (k + 1)), "block long, weight double, numbers array<double>")
        numbers = copies.select("block", "weight", F.posexplode("numbers").alias("at", "x"))
        mean = numbers.groupBy("block", "at").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x"))
        pdf = written(mean, "network").toPandas()  # as many rows as the network has numbers
        if len(pdf):
            flat = flat.astype(np.float64)
            flat[cut[pdf["block"].to_numpy(np.int64)] + pdf["at"].to_numpy(np.int64)] = pdf["x"]
    return Network(flat)


SCORED = "doc_id long, key long, n_words long, inside double, word long, own int"


def _scorer(flat: np.ndarray, counts: Counts):
    """For each row its words and what needs no join, and a row for each distinct word that isn't common."""
    vocabulary, total, prior = counts.vocabulary(), counts.cells, PRIOR * np.maximum(1, counts.kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, hasher, seen = Network(flat), Shingler(1), set()
        for batch in batches:
            for start in range(0, len(batch), 256):
                docs = list(zip(*batch.slice(start, 256).columns, strict=True))
                keys, lengths, asking, rare = [], [], [], []
                near, cells, of, held = [], [], [], 0
                inside = np.zeros(len(docs))

                def flush() -> None:
                    """Scores the words that wait, of many texts at once."""
                    nonlocal held
                    if held:
                        p = net.log_cells(np.concatenate(near), np.concatenate(cells))
                        inside[:] += np.bincount(np.repeat(*np.array(of).T), p, len(docs))
                    for x in (near, cells, of):
                        x.clear()
                    held = 0

                for d, (_, text) in enumerate(docs):
                    text = text.as_py() or ""
                    words = hasher.words(text)
                    keys.append(key := xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63))
                    lengths.append(len(words))
                    # Of copies of a text in a task one is scored and asks for its rare words.
                    asking.append(key not in seen)
                    if not asking[-1]:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(key)
                    mine = np.zeros(len(total))
                    for i in range(0, len(words), BATCH):
                        low = max(0, i - SIDE)
                        near.append(net.around(words[low : i + BATCH + SIDE])[i - low : i - low + BATCH])
                        cells.append(vocabulary.cells(words[i : i + BATCH]))
                        mine += np.bincount(cells[-1], minlength=len(total))
                        of.append((d, len(cells[-1])))
                        held += len(cells[-1])
                        if held >= BATCH:
                            flush()
                    # The text's own words count neither for a word nor for its cell, so the chances in a cell add up to 1.
                    here = np.flatnonzero(mine)
                    inside[d] -= float((mine[here] * np.log(np.maximum(total[here] - mine[here], 0) + prior[here])).sum())
                    kinds, own = np.unique(words, return_counts=True)
                    at, hit = Vocabulary.find(vocabulary.words, kinds)
                    if hit.any():
                        inside[d] += float((own[hit] * np.log(np.maximum(vocabulary.counts[at[hit]] - own[hit], 0) + PRIOR)).sum())
                    rare.append((key, kinds[~hit].view(np.int64), own[~hit]))
                flush()
                names, none = [x.split()[0] for x in SCORED.split(", ")], lambda n, t=pa.int64(): pa.nulls(n, t)
                own = np.array(asking)
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x, _ in docs], pa.int64()), pa.array(keys, pa.int64()), pa.array(lengths, pa.int64()), pa.array(inside, mask=~own), none(len(docs)), pa.array(own.astype(np.int32))], names)
                if rare:
                    key, words, own = zip(*rare, strict=True)
                    key = np.repeat(np.array(key, np.int64), [len(w) for w in words])
                    n = len(key)
                    yield pa.RecordBatch.from_arrays([none(n), pa.array(key), none(n), none(n, pa.float64()), pa.array(np.concatenate(words)), pa.array(np.concatenate(own).astype(np.int32))], names)

    return run


def scored(docs: DataFrame, net: Network, counts: Counts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, per_word) for each row.

    The sum over all words of the log chance of the word's cell given both sides, by the network, and of the word in its
    cell by how often it occurs in all other texts among all words of the cell there: the scored text's own words are left
    out of both, so the chances of a cell's words add up to 1, and a frequent word, a cell of its own, has chance 1 in it. Common words have their counts in every task; rarer ones meet the table of all words in a
    join, once a text and word. Texts without words: 0 words, 0, null. Null texts are empty; repeated rows get equal
    scores. Texts are scored whole, in blocks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(_scorer(net.flat(), counts), SCORED)
    rows = written(rows, "scores", wide=True)
    each = rows.filter("n_words is not null").select("doc_id", "key", "n_words", "inside", "own")
    # Equal texts ask for equal words, so their sum is as many times the sum of one; they share one score to the last bit,
    # whichever blocks they lay in.
    copies = each.groupBy("key").agg(F.sum("own").alias("copies"), F.min("inside").alias("inside"))
    rare = rows.filter("word is not null").select("key", "word", "own").join(counts.table, "word")
    rare = rare.groupBy("key").agg(F.sum(F.col("own") * F.log(F.greatest(F.col("n") - F.col("own"), F.lit(0)) + PRIOR)).alias("rare"))
    score = F.col("inside") + F.coalesce(F.try_divide("rare", "copies"), F.lit(0.0))
    out = each.select("doc_id", "key", "n_words").join(copies.join(rare, "key", "left").select("key", score.alias("log_likelihood")), "key")
    return out.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("per_word"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a network trained on, and counts taken over, all documents. Null texts have no words;
    repeated rows each count and get equal scores; an empty table gives no rows. Other columns aren't read."""
    docs = table(spark, sf_dir, "documents")
    counts = Counts(docs)
    return scored(docs, trained(docs, counts), counts)
