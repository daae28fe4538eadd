"""Phrase collocation mining: text fragments go to the rarest word of the phrases in them, which are counted there."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hypolith.llm.shingles import LOWER, mixed
from hypolith.llm.tables import small, table, written

#: Occurrences of a phrase at least, its words at most, phrases of a language at most, the unit of scores.
LEAST, LONGEST, TOP, UNIT = 100, 5, 2000, 1000
#: Frequent words that are sent to all tasks at most; beyond, the words of the texts meet their numbers in a join.
WORDS = 500_000
#: Occurrences of one pivot, or of the pivots of a bucket on average, at most; those of a more frequent pivot are dealt to several buckets.
SPLIT = 4_000_000
#: Counts that a task holds, words that it cuts into fragments at a time, and words of a document in one row of the join.
HELD, CHUNK, BLOCK = 400_000, 1 << 20, 1 << 14
_ENDS = ".,;:!?\n\x0b\x0c\r"
_SPACED = bytes(0x20 if chr(i) in _ENDS else b for i, b in enumerate(LOWER))
_MARKED = bytes(0xFF if chr(i) in _ENDS else b for i, b in enumerate(LOWER))
_REACH, _CELLS = LONGEST - 1, 2 * LONGEST - 1
_COUNTS, _PARTS, _PHRASES = "lang string, word string, n long", "bucket long, fragments binary", "ids array<long>, n long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word stands in each language, of (lang, text)."""
    held: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        flat = [(lang, w.decode("utf-8"), n) for lang, words in held.items() for w, n in words.items()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(lang, Counter()).update(text.encode("utf-8").translate(_SPACED).split())
            if sum(map(len, held.values())) >= HELD:
                yield rows()
                held = {}
    yield rows()


def _words(text: str) -> list[bytes]:
    """The words of a text in order; the byte 0xff, which no text has, stands where a piece ends."""
    return text.encode("utf-8").translate(_MARKED).replace(b"\xff", b" \xff ").split()


def _unique(cells: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of cells without repeats, their summed weights and hashes. Rows that differ but share a hash all stay."""
    odd = np.random.default_rng(11).integers(1, 2**63, cells.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.zeros(len(cells), np.uint64)
    for k, x in enumerate(odd):
        h += mixed(cells[:, k].astype(np.uint64) + x) * x
    order = np.argsort(h)
    new = np.append(True, h[order[1:]] != h[order[:-1]]) if len(h) else np.zeros(0, bool)
    same = (cells[order] == cells[order[new]][np.cumsum(new) - 1]).all(1)
    new |= ~same  # such rows end a run, and what follows them is compared anew
    if not same.all():
        new |= np.append(False, ~same[:-1])
    first = np.flatnonzero(new)
    return cells[order[first]], np.add.reduceat(weight[order], first) if len(first) else weight, h[order[first]]


class Cutter:
    """Cuts sequences of word numbers (-1: a rare word or the end of a piece) into fragments, one for each place.

    The place's word is the pivot. To its left stand words that are more frequent, to its right those that aren't rarer, as
    many in a row as there are, four at most; the first other word is where the rewritten text has a gap. So the fragment
    has just those phrases of which this place is the leftmost of their rarest word, and every occurrence of a phrase
    lies in one fragment. Equal fragments of a chunk are one row with a count; fragments of a pivot alone are none.
    """

    def __init__(self, buckets: int, parts: Callable[[np.ndarray], np.ndarray]):
        self.buckets, self.parts, self.ids, self.own, self.size = buckets, parts, [], [], 0

    def add(self, ids: np.ndarray, own: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
        self.ids += [ids, np.full(1, -1, ids.dtype)]
        self.own += [np.ones(len(ids), bool) if own is None else own, np.zeros(1, bool)]
        self.size += len(ids) + 1
        if self.size >= CHUNK:
            yield from self.end()

    def _fragments(self, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
        n, gap = len(ids), np.full(_REACH, -1, ids.dtype)
        wide = np.concatenate([gap, ids, gap])
        cells = np.full((n, _CELLS), -1, ids.dtype)
        cells[:, _REACH] = ids
        for step, fits in ((-1, np.less), (1, np.less_equal)):
            on = ids >= 0
            for k in range(1, _REACH + 1):
                x = wide[_REACH + step * k : _REACH + step * k + n]
                on = on & (x >= 0) & fits(x, ids)
                cells[:, _REACH + step * k] = np.where(on, x, -1)
        return cells[own & ((cells[:, _REACH - 1] >= 0) | (cells[:, _REACH + 1] >= 0))]

    def end(self) -> Iterator[tuple[int, bytes]]:
        if not self.size:
            return
        ids, own = np.concatenate(self.ids), np.concatenate(self.own)
        self.ids, self.own, self.size = [], [], 0
        cells = self._fragments(ids, own)
        cells, count, h = _unique(cells, np.ones(len(cells), np.int64))
        parts = self.parts(cells[:, _REACH]).astype(np.uint64)
        part = np.where(parts > 1, h % np.maximum(parts, np.uint64(1)), np.uint64(0))
        bucket = (mixed(cells[:, _REACH].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part) % np.uint64(self.buckets)).astype(np.int64)
        bucket = np.where(parts > 1, -1 - bucket, bucket)  # below 0: what is counted there is a part
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[order])) + 1
        for at in np.split(order, edge) if len(order) else ():
            yield int(bucket[at[0]]), _packed(cells[at], count[at])


def _packed(cells: np.ndarray, count: np.ndarray) -> bytes:
    """Fragments as bytes: how many, the width of a number, words left and right of each pivot, counts, numbers."""
    kind = np.dtype(np.int32 if cells.max(initial=0) < 1 << 31 and count.max(initial=0) < 1 << 31 else np.int64)
    sides = (cells[:, :_REACH] >= 0).sum(1) * 16 + (cells[:, _REACH + 1 :] >= 0).sum(1)
    return b"".join((np.array([len(cells), kind.itemsize], np.int64).tobytes(), sides.astype(np.uint8).tobytes(), count.astype(kind).tobytes(), cells[cells >= 0].astype(kind).tobytes()))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = (int(x) for x in np.frombuffer(data, np.int64, 2))
    kind = np.dtype(f"i{size}")
    sides = np.frombuffer(data, np.uint8, n, 16)
    count = np.frombuffer(data, kind, n, 16 + n)
    at = np.arange(_CELLS) - _REACH
    there = (at >= -(sides >> 4).astype(int)[:, None]) & (at <= (sides & 15).astype(int)[:, None])
    cells = np.full((n, _CELLS), -1, np.int64)
    cells[there] = np.frombuffer(data, kind, -1, 16 + n + n * size)
    return cells, count.astype(np.int64)


def _mined(cells: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, counts) of the phrases around the pivot that occur `least` times, for each place of the pivot and each length.

    A phrase that is frequent has frequent parts, so a longer one is looked for only where the part of it with one word
    less, which has the pivot too, was found. Numbers are exact: a part's number and the new word's make a key.
    """
    names, dense = np.unique(cells, return_inverse=True)
    dense = dense.reshape(cells.shape)
    words, code = np.unique(cells[:, _REACH], return_inverse=True)
    found = {(_REACH, 1): (words[:, None], code)}
    for n in range(2, LONGEST + 1):
        for start in range(_REACH - n + 1, _REACH + 1):
            right = start + n - 1 > _REACH
            part, col = found[(start, n - 1) if right else (start + 1, n - 1)], start + n - 1 if right else start
            rows = np.flatnonzero((part[1] >= 0) & (cells[:, col] >= 0))
            key, back = np.unique(part[1][rows] * len(names) + dense[rows, col], return_inverse=True)
            count = np.bincount(back, weight[rows], len(key)).astype(np.int64)
            keep = count >= least
            code = np.full(len(cells), -1)
            code[rows] = np.where(keep, np.cumsum(keep) - 1, -1)[back]
            head, new = part[0][key[keep] // len(names)], names[key[keep] % len(names)][:, None]
            ids = np.hstack([head, new] if right else [new, head])
            found[start, n] = ids, code
            if len(ids):
                yield ids, count[keep]


def _counted(least: int) -> Callable:
    """Rows of _PHRASES of _PARTS in the order of their buckets; one bucket at a time is held."""

    def one(bucket: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        cells, weight = (np.concatenate(x) for x in zip(*map(_unpacked, held), strict=True))
        for ids, count in _mined(cells, weight, least if bucket >= 0 else 1):
            for i in range(0, len(ids), 1 << 16):
                x = ids[i : i + (1 << 16)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(count[i : i + (1 << 16)], pa.int64())], ["ids", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield from one(now, held)
                    held = []
                now = bucket
                held.append(data)
        if held:
            yield from one(now, held)

    return run


def _parts(batches: Iterator[pa.RecordBatch], cutter: Cutter, read: Callable) -> Iterator[pa.RecordBatch]:
    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["bucket", "fragments"])

    for batch in batches:
        for ids, own in read(batch):
            if found := list(cutter.add(ids, own)):
                yield rows(found)
    if found := list(cutter.end()):
        yield rows(found)


def _by_broadcast(docs: DataFrame, words: DataFrame, buckets: int, split: int) -> DataFrame:
    """_PARTS of (lang, text), with the numbers of the frequent words (at most WORDS) in every task."""
    pdf = words.toPandas()
    n = np.zeros(len(pdf), np.int64)
    n[pdf["id"]] = pdf["n"]
    known: dict[str, dict[bytes, int]] = {}
    for lang, word, i in zip(pdf["lang"], pdf["word"], pdf["id"], strict=True):
        known.setdefault(lang, {})[word.encode("utf-8")] = i
    sent = docs.sparkSession.sparkContext.broadcast((known, -(-n // split)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = sent.value

        def read(batch: pa.RecordBatch) -> Iterator[tuple]:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _words(text)
                yield np.fromiter(map(known.get(lang, {}).get, words, repeat(-1)), np.int32, len(words)), None

        return _parts(batches, Cutter(buckets, lambda x: parts[x]), read)

    return docs.mapInArrow(run, _PARTS)


def _by_join(docs: DataFrame, words: DataFrame, buckets: int, split: int) -> DataFrame:
    """The same where the words are too many for a task: every word of the texts is joined with its number.

    Words go in blocks of a document, with the four before and after, so that no document is a group; the table of
    blocks is written first, which fixes their keys.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = [None if w == b"\xff" else w.decode("utf-8") for w in _words(text)]
                for i in range(0, len(words), BLOCK):
                    at = range(max(0, i - _REACH), min(len(words), i + BLOCK + _REACH))
                    own = [i <= k < i + BLOCK for k in at]
                    yield pa.RecordBatch.from_pydict({"key": [f"{key}:{i}"] * len(at), "at": pa.array(at, pa.int64()), "own": own, "lang": [lang] * len(at), "word": pa.array([words[k] for k in at], pa.string())})

    keyed = written(docs.select(F.expr("uuid()").alias("key"), "lang", "text"), "keyed", wide=True)
    each = keyed.mapInArrow(blocks, "key string, at long, own boolean, lang string, word string")
    # Rare words and ends stay as gaps, without the join.
    of = words.select("lang", "word", "id", F.ceil(F.col("n") / split).cast("long").alias("parts"))
    met = each.join(of, ["lang", "word"], "left").select("key", F.struct("at", "own", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("parts", F.lit(1)).alias("parts")).alias("x"))
    rows = met.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("x")).select("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, int] = {}

        def read(batch: pa.RecordBatch) -> Iterator[tuple]:
            for x in batch.column(0):
                ids, own, n = (np.asarray(x.values.field(k).to_numpy(zero_copy_only=False)) for k in (2, 1, 3))
                parts.update(zip(ids[n > 1].tolist(), n[n > 1].tolist(), strict=True))
                yield ids.astype(np.int64), own.astype(bool)

        def of(pivots: np.ndarray) -> np.ndarray:
            some, back = np.unique(pivots, return_inverse=True)
            return np.array([parts.get(i, 1) for i in some.tolist()], np.int64)[back] if len(some) else np.zeros(0, np.int64)

        return _parts(batches, Cutter(buckets, of), read)

    return rows.mapInArrow(run, _PARTS)


def _slice(ids: Column, start: Column | int, n: Column | int) -> Column:
    return F.slice(ids, start, n)


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, words: int = WORDS, split: int = SPLIT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of two to five words of each language.

    Texts are lower-cased in A-Z and cut at `[.,;:!?\\x0A-\\x0D]` into pieces, those at spaces and tabs into words. a, l and r
    are how often the phrase and both parts of its weakest cut occur, n how many words the language has; score is
    floor(1000 * a * n / (l * r)), lowest over all cuts, the smallest cut first. Phrases under `least` are none, and those
    that a longer phrase with as many occurrences contains are left out. Equal scores are ranked by a and by the bytes
    of the phrase. All numbers are exact. Null texts are empty, a null language is `und`; repeated rows count each.
    Texts of any length are cut as they are, pieces of any length too. Other columns aren't read; no rows give no rows.

    Words are numbered by falling frequency. Fragments of texts go to buckets by their rarest word, the pivot, and each
    bucket counts the phrases that its pivots own. A pivot of over `split` occurrences is dealt to several buckets by
    its fragments' hashes; those count everything, and the sums come after. As many words as frequent as a pivot or more
    there are, so many different fragments it has, few for the hottest.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    every = written(docs.mapInArrow(_counts, _COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words", wide=True)
    total = written(every.groupBy("lang").agg(F.sum("n").alias("all")), "langs")
    frequent = every.filter(F.col("n") >= least)
    # Sorted into ranges, so that the numbers fall with the frequency; written, so that they stay.
    numbered = frequent.orderBy(F.desc("n"), "lang", "word").select(F.monotonically_increasing_id().alias("id"), "lang", "word", "n")
    few = frequent.limit(words + 1).count() <= words
    numbered = written((numbered.coalesce(1).sortWithinPartitions(F.desc("n"), "lang", "word").select(F.monotonically_increasing_id().alias("id"), "lang", "word", "n")) if few else numbered, "numbered", wide=True)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    size = (total.agg(F.sum("all")).first()[0] or 0) // split
    buckets = max(4 * int(held), size)
    parts = (_by_broadcast if few else _by_join)(docs, numbered, buckets, split)
    dealt = parts.repartition(int(held), "bucket").sortWithinPartitions("bucket")
    mined = dealt.mapInArrow(_counted(least), _PHRASES).groupBy("ids").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    mined = written(mined, "mined", wide=True)

    # Longer phrases say of their two parts with one word less how often they occur; all others follow from those.
    longer = mined.filter(F.size("ids") > 2).select(F.explode(F.array(_slice(F.col("ids"), 1, F.size("ids") - 1), _slice(F.col("ids"), 2, F.size("ids") - 1))).alias("ids"), F.lit(None).cast("long").alias("a"), F.col("a").alias("cover"))
    alone = mined.withColumn("cover", F.lit(None).cast("long")).unionByName(longer).groupBy("ids").agg(F.max("a").alias("a"), F.max("cover").alias("cover")).filter("cover is null or cover < a")
    counts = mined.unionByName(numbered.select(F.array("id").alias("ids"), F.col("n").alias("a")))
    cut = alone.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.select("ids", "a", "k", _slice(F.col("ids"), F.lit(1), F.col("k")).alias("head"), _slice(F.col("ids"), F.col("k") + 1, F.size("ids") - F.col("k")).alias("tail"))
    cut = cut.join(counts.select(F.col("ids").alias("head"), F.col("a").alias("l")), "head").join(counts.select(F.col("ids").alias("tail"), F.col("a").alias("r")), "tail")
    of = numbered.select(F.col("id").alias("first"), "lang").join(F.broadcast(total), "lang")  # a row a language
    cut = cut.withColumn("first", F.element_at("ids", 1)).join(small(of), "first")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (F.lit(UNIT).cast("decimal(5,0)") * F.col("a").cast("decimal(15,0)")).cast("decimal(19,0)") * whole("all"), whole("l") * whole("r"))
    best = cut.withColumn("score", score).groupBy("ids", "a", "lang", "all").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    best = best.select("ids", "a", "lang", F.col("all").alias("n"), F.col("s.score").alias("score"), F.col("s.l").alias("l"), F.col("s.r").alias("r"))
    # Those that may be among the first, with all that tie with the last, get their words; then the phrases break ties.
    first = best.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("rank") <= top).drop("rank")
    first = written(first, "first")
    spelt = first.select("ids", F.posexplode("ids").alias("at", "id")).join(small(numbered.select("id", "word")), "id")
    spelt = spelt.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = first.join(spelt, "ids").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return out.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
worded AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
grams AS (SELECT lang, list_slice(words, s, s + k - 1) AS g FROM (SELECT lang, words, k, unnest(generate_series(1, len(words) - k + 1)) AS s FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(words) >= k)),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM worded GROUP BY lang),
inside AS (SELECT lang, list_slice(g, s, s + k - 1) AS g, max(a) AS cover FROM (SELECT lang, g, a, k, unnest(generate_series(1, len(g) - k + 1)) AS s FROM f, (SELECT unnest([2, 3, 4]) AS k) WHERE len(g) > k) GROUP BY 1, 2),
cuts AS (SELECT f.lang, f.g, f.a, k, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * f.a * t.n) // (l.a::HUGEINT * r.a) AS score
    FROM (SELECT *, unnest(generate_series(1, len(g) - 1)) AS k FROM f WHERE len(g) > 1) f JOIN totals t USING (lang)
    JOIN f l ON l.lang = f.lang AND l.g = list_slice(f.g, 1, k) JOIN f r ON r.lang = f.lang AND r.g = list_slice(f.g, k + 1, len(f.g))
    LEFT JOIN inside i ON i.lang = f.lang AND i.g = f.g WHERE i.cover IS NULL OR 100 * i.cover < 100 * f.a),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
