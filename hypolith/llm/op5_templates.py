"""Benchmark decontamination: texts become templates with typed slots, and template windows find benchmark items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.llm.shingles import LOWER, Shingler, mixed
from hypolith.llm.tables import small, table, written

#: Words a window, share of an item's windows that a document must hold, and share of slots filled alike.
WINDOW, COVERAGE, CONSISTENT = 5, 0.8, 0.8
#: Windows in a row that a document has word by word from a longer item, so that it holds a part of it (25 words), and the
#: least words of an item under WINDOW words that is looked for inside texts.
STRETCH, SHORT = 21, 3
#: Distinct benchmark windows (8 bytes each) that are sent to every task to screen documents; beyond them a join does it.
SCREEN = 2_000_000
#: Units, as words after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec min h hr hrs day days week weeks month months year years kb mb gb tb hz khz mhz ghz w kw v a pa kpa bar c f k percent pct % $ € £ usd eur gbp dollar dollars euro euros cent cents meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres hour hours minute minutes second seconds".split()
_U = np.uint64
_NUMBER, _UNIT, _NAME, _BOTH, _NAMED, _VERBATIM = (mixed(np.array([k], np.uint64))[0] for k in (101, 102, 103, 104, 105, 106))


class Templater:
    """Hashes of a text's words as a template: numbers, units and names are typed placeholders, punctuation is off.

    A capital doesn't tell a name from the first word of a sentence, nor a name from a text that was put in lower case, so
    there are two readings: in the plain one no word is a name, in the named one every word with a capital is, also at
    the begin of a sentence, and names in a row within a sentence are one.
    """

    def __init__(self):
        self.hasher = Shingler(WINDOW)
        kind = np.zeros(256, np.int8)  # 1 letter, 2 digit, 0 punctuation
        kind[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
        kind[0x30:0x3A] = 2
        self.kind = kind
        self.bare = np.where((kind > 0), self.hasher.byte, _U(0))
        self.bare[[ord(c) for c in "%$"]] = self.hasher.byte[[ord(c) for c in "%$"]]
        stop = np.zeros(256, bool)
        stop[[ord(c) for c in ".!?:;\""]] = True
        self.stop = stop
        self.units = np.sort(np.concatenate([self.words(u)[1] for u in UNITS]))

    def is_unit(self, word: np.ndarray) -> np.ndarray:
        return np.isin(word, self.units)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word: template hash in the plain reading, hash of the word itself, whether it is written as a name, and
        whether a sentence begins with it."""
        source = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        n = len(source)
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, bool)
        h = self.hasher
        raw = np.frombuffer(source.tobytes().translate(LOWER), np.uint8).copy()
        after = np.zeros(n, bool)
        after[1:] = raw[:-1] == 0xC3
        upper = after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        raw[upper] += 0x20
        capital = (source != raw) & ~upper
        capital[:-1] |= upper[1:]
        h._grow(n + 1)
        edge = np.diff(np.concatenate([[True], h.space[raw], [True]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        kind = self.kind[raw]
        letters, digits = sums(kind == 1), sums(kind == 2)
        signs = sums((kind == 0) & (self.bare[raw] != 0))
        opened = (kind[begin] == 0) & (self.bare[raw[begin]] == 0) & (end - begin > 1)
        first = begin + opened
        upto = np.zeros(n + 1, np.uint64)
        np.cumsum(self.bare[raw] * h.powers[:n], out=upto[1:])
        nl, nd = letters[end] - letters[begin], digits[end] - digits[begin]
        word = mixed((upto[end] - upto[first]) * h.inverses[first] + (nl + nd + signs[end] - signs[begin]).astype(np.uint64))
        heard = nl + nd + signs[end] - signs[begin] > 0
        number = (nd > 0) & (nl == 0)
        both = (nd > 0) & (nl > 0) & (self.kind[raw[first]] == 2)
        ended = np.ones(len(begin), bool)
        lines = sums(source == 10)
        ended[1:] = self.stop[raw[end[:-1] - 1]] | (lines[begin[1:]] > lines[end[:-1]])
        before = np.zeros(len(begin), bool)
        before[1:] = number[:-1]
        small = sums((source >= 0x61) & (source <= 0x7A))  # texts in capitals hold no more names than others
        name = capital[first] & (nd == 0) & (small[end] > small[begin])
        unit = np.zeros(len(begin), bool)
        if hasattr(self, "units") and len(after_number := np.flatnonzero(before)):
            unit[after_number] = self.is_unit(word[after_number])
        out = np.where(number, _NUMBER, np.where(both, _BOTH, np.where(unit, _UNIT, word)))
        return out[heard], word[heard], name[heard], ended[heard]

    def named(self, template: np.ndarray, word: np.ndarray, name: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Template and own words in the named reading."""
        template = np.where(name, _NAME, template)
        more = np.zeros(len(name), bool)
        more[1:] = name[1:] & name[:-1] & ~ended[1:]
        if more.any():
            first = np.flatnonzero(~more)
            place = np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))
            # A name's words by their places; a single word stays as it is.
            template, word = template[first], np.add.reduceat(word * self.hasher.powers[place], first)
        return template, word

    def windows(self, text: str, widths: tuple[int, ...] = ()) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hash, own words by row, whether each is a slot) of the windows in the plain reading and in the named one. A text
        under WINDOW words is one window of just its words, and has no named reading; `widths` asks for windows of
        so many words, word by word, besides."""
        template, word, name, ended = self.words(text)
        n, out = len(word), []
        view = lambda x, k: np.lib.stride_tricks.sliding_window_view(x, k)
        if n >= WINDOW:
            out.append((self.hasher.windows(template), view(word, WINDOW), view(template != word, WINDOW)))
            template, own = self.named(template, word, name, ended)
            if len(own) >= WINDOW:
                out.append((mixed(self.hasher.windows(template) ^ _NAMED), view(own, WINDOW), view(template != own, WINDOW)))
            else:
                out.append((np.empty(0, np.uint64), np.empty((0, WINDOW), np.uint64), np.empty((0, WINDOW), bool)))
        for k in {*widths, *({n} if 0 < n < WINDOW else ())}:
            if k <= n:
                each = view(word, k)
                out.append((mixed((each * self.hasher.place[:k]).sum(1, dtype=np.uint64) + (_VERBATIM ^ _U(k))), each, np.zeros(each.shape, bool)))
        return out


class Known:
    """A set of hashes: a table of bits rules most others out before the search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.shift = _U(64 - min(24, max(16, len(hashes).bit_length() + 4)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.hashes >> self.shift] = True

    def at(self, h: np.ndarray) -> np.ndarray:
        """The places of those in h that are in the set."""
        maybe = np.flatnonzero(self.bits[h >> self.shift])
        if not len(maybe):
            return maybe
        x = h[maybe]
        return maybe[self.hashes[np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)] == x]


HITS = "id long, part long, window long, at long, words array<long>, slots array<boolean>"


def _windows(hashes: np.ndarray | None, widths: tuple[int, ...] = ()):
    """Rows of HITS for (id, text): of every window, or of those among `hashes`. part tells texts and readings apart; it is
    even in the plain one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = Templater(), None if hashes is None else Known(hashes)
        for batch in batches:
            for start in range(0, len(batch), 256):
                ids, parts, found, at, words, slots = [], [], [], [], [], []
                for i, text in zip(*batch.slice(start, 256).columns, strict=True):
                    text, part = text.as_py(), None
                    for k, (h, w, s) in enumerate(t.windows(text, widths)):
                        hit = np.arange(len(h)) if known is None else known.at(h)
                        if not len(hit):
                            continue
                        if part is None:
                            part = (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 << 1) - (1 << 63)
                        ids += [i.as_py()] * len(hit)
                        parts += [part + (k == 1)] * len(hit)
                        found.append(h[hit].view(np.int64))
                        at.append(hit)
                        words += list(w[hit].view(np.int64))
                        slots += list(s[hit])
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(np.concatenate(found)), pa.array(np.concatenate(at), pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(slots, pa.list_(pa.bool_()))], ["id", "part", "window", "at", "words", "slots"])

    return run


def _share(was: np.ndarray, filled: np.ndarray) -> float:
    """Share of the distinct values in `was` that meet one value in `filled` only; 1 without any."""
    if not len(was):
        return 1.0
    pairs = np.unique(np.stack([was, filled], 1), axis=0)
    return float(np.mean(np.unique(pairs[:, 0], return_counts=True)[1] == 1))


def _occurrence(at: np.ndarray, code: np.ndarray, words: np.ndarray, place: np.ndarray, item: np.ndarray, was: np.ndarray, slots: np.ndarray, coverage: float, consistent: float) -> float | None:
    """The slot share of one occurrence of the item in a text that has `coverage` of its windows and is consistent.

    at, code and words are the text's hits (by code and place), place, item, was and slots the item's windows in order.
    An occurrence is an offset between text and item: each of the item's windows takes the hit that is nearest to its
    own place there, at that very place or up to WINDOW words or half of the item off, as words are put in or left out.
    A hit of placeholders only is no evidence, so one window at least must hold a word.
    """
    n = len(item)
    spans = np.searchsorted(code, item), np.searchsorted(code, item, "right")
    low = int(at.min() - place.max())
    count, worded = np.zeros((2, int(at.max() - place.min()) - low + 1), np.int64)
    for i in range(n):
        to = at[spans[0][i] : spans[1][i]] - place[i] - low
        count[to] += 1
        if not slots[i].all():
            worded[to] += 1
    plain = slots.all()
    for off in sorted({0, WINDOW, max(WINDOW, n // 2)}):
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (count, worded)]
        begin, end = np.maximum(np.arange(len(count)) - off, 0), np.minimum(np.arange(len(count)) + off + 1, len(count))
        near, told = (x[end] - x[begin] for x in sums)
        tries = np.flatnonzero((count > 0) & (near >= coverage * n) & ((told > 0) | plain))
        # Order by code and place at once, so that one search finds each window's neighbours.
        wide = int(at.max() - min(low, 0)) + n + int(place.max()) + 2 * off + 2
        key = code * wide + at
        for d in tries[np.argsort(-count[tries], kind="stable")] + low:
            want = np.clip(place + d, -off, wide - off - 1)
            right = np.searchsorted(key, item * wide + want)
            left = np.maximum(right - 1, 0)
            far = lambda j, ok: np.where(ok, np.abs(at[np.minimum(j, len(at) - 1)] - want), off + 1)
            fl, fr = far(left, (right - 1 >= spans[0]) & (right - 1 < spans[1])), far(right, (right < spans[1]) & (right >= spans[0]))
            hit = np.minimum(fl, fr) <= off
            if hit.sum() < coverage * n or not (plain or (~slots[hit].all(1)).any()):
                continue
            chosen = np.where(fl < fr, left, np.minimum(right, len(at) - 1))[hit]
            share = _share(was[hit][slots[hit]], words[chosen][slots[hit]])
            if share >= consistent:
                return share
    return None


def _stretch(at: np.ndarray, code: np.ndarray, place: np.ndarray, item: np.ndarray) -> int:
    """The most windows in a row of the item (place, item) that a text (at, code) has in a row, by equal codes."""
    order = np.argsort(code, kind="stable")
    at, code = at[order], code[order]
    low, high = np.searchsorted(code, item), np.searchsorted(code, item, "right")
    n = high - low
    mine = np.repeat(place, n)
    theirs = at[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    order = np.lexsort([mine, theirs - mine])
    off, mine = (theirs - mine)[order], mine[order]
    if not len(mine):
        return 0
    breaks = np.flatnonzero((np.diff(off) != 0) | (np.diff(mine) != 1)) + 1
    return int(np.diff(np.concatenate([[0], breaks, [len(mine)]])).max())


def _judged(coverage: float, consistent: float, stretch: int):
    """(id, item, coverage, slot_share) of a document's hits and an item's windows, or no row where it isn't held."""

    def run(hits: pa.Table, body: pa.Table) -> pa.Table:
        out = {"id": [], "item": [], "coverage": [], "slot_share": []}
        column = lambda t, name: t.column(name).to_numpy()
        if len(hits) and len(body):
            share, best = None, 0.0
            parts, wide = column(body, "part"), np.array([len(w) for w in column(hits, "words")])
            for one in np.unique(parts):
                mine = np.flatnonzero(parts == one)
                mine = mine[np.argsort(column(body, "at")[mine])]
                place, names = column(body, "at")[mine], column(body, "window")[mine]
                was, slots = np.stack(column(body, "words")[mine]), np.stack(column(body, "slots")[mine]).astype(bool)
                same = np.flatnonzero(wide == was.shape[1])
                if not len(same):
                    continue
                texts, at, window, words = (column(hits, x)[same] for x in ("part", "at", "window", "words"))
                words = np.stack(words)
                if one % 2 == 0 and len(was) > stretch:
                    exact = np.unique(np.vstack([was, words]), axis=0, return_inverse=True)[1].reshape(-1)
                    if any(_stretch(at[texts == x], exact[len(was) :][texts == x], place, exact[: len(was)]) >= stretch for x in np.unique(texts[texts % 2 == 0])):
                        share = 1.0
                # Where all windows are placeholders only, values must be the item's own.
                own, theirs = (np.hstack([x[:, None], y]) if slots.all() else x[:, None] for x, y in ((names, was), (window, words)))
                code = np.unique(np.vstack([own, theirs]), axis=0, return_inverse=True)[1].reshape(-1)
                item, code = code[: len(own)], code[len(own) :]
                found = np.isin(code, item)
                best = max(best, len(np.unique(code[found])) / len(np.unique(item)))
                if best < coverage:
                    continue
                # Once over all of the document, wherever the windows stand: every value must be filled alike everywhere.
                order = np.argsort(item, kind="stable")
                cells = []
                for c in range(was.shape[1]):
                    to = slots[order, c]
                    pairs = [np.unique(np.stack([x, y], 1), axis=0) for x, y in ((item[order][to], was[order, c][to]), (code[found], words[found, c]))]
                    a, b = pairs
                    lo, hi = np.searchsorted(b[:, 0], a[:, 0]), np.searchsorted(b[:, 0], a[:, 0], "right")
                    # A value that meets one value is told apart from one that meets more by the first and the last.
                    ok = hi > lo
                    cells += [np.stack([a[ok, 1], b[lo[ok], 1]], 1), np.stack([a[ok, 1], b[hi[ok] - 1, 1]], 1)]
                cells = np.vstack(cells)
                pooled = _share(cells[:, 0], cells[:, 1])
                share = max(share or 0.0, pooled) if pooled >= consistent else share
                for text in np.unique(texts) if share is None else []:
                    rows = np.flatnonzero(found & (texts == text))
                    rows = rows[np.lexsort([at[rows], code[rows]])]
                    if len(rows) and (one_share := _occurrence(at[rows], code[rows], words[rows], place, item, was, slots, coverage, consistent)) is not None:
                        share = one_share
                        break
            if share is not None:
                out = {"id": [hits.column("id")[0].as_py()], "item": [hits.column("item")[0].as_py()], "coverage": [best], "slot_share": [share]}
        return pa.table(out, pa.schema([("id", pa.int64()), ("item", pa.int64()), ("coverage", pa.float64()), ("slot_share", pa.float64())]))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistent: float = CONSISTENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", screen: int = SCREEN, stretch: int = STRETCH) -> DataFrame:
    """(doc_id, item_ids, coverage, slot_share, n_items) for each document id that holds a benchmark item.

    A document holds an item if in one of the two readings (see Templater) it has at least `coverage` of the item's
    distinct template windows and at least `consistent` of the item's slot values (the number, unit or name that the item has there) are filled by one and the
    same value, everywhere in the document or in one occurrence of the item that has `coverage` of its windows. So
    renamed questions count, also beside others of the same template, and chance meetings of templates don't. An item of
    nothing but slots counts by its own values only. It also holds an item of which it has `stretch` windows in a row word
    by word, however long the item is.
    Documents and items without words match nothing. Items under WINDOW words have no template: they match word by
    word, inside any text if they have SHORT words and more, else texts of just those words, for one or two words in
    a text are no evidence. Very long texts are read whole, 256 texts at a time. Null ids match nothing. Repeated
    documents and items count once; an item id with several texts is held if one of them is. Nothing else is read. No
    documents, or no items, give no rows.

    Benchmark windows are screened in the pass over the texts when they are few enough to send to each task, and the
    hits, or else all windows, are hash-joined with the items' windows.
    """
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    known = written(items.mapInArrow(_windows(None), HITS).dropDuplicates(["id", "part", "at"]), "items")
    total = known.groupBy(F.col("id").alias("item"), F.col("part").alias("body")).agg(F.count_distinct("window").alias("all"), F.bool_or(F.array_contains("slots", True)).alias("slotted"))
    widths = tuple(r[0] for r in known.select(F.size("words").alias("n")).filter(F.col("n").between(SHORT, WINDOW - 1)).distinct().collect())  # two at most
    distinct = known.select("window").distinct()
    few = distinct.limit(screen + 1).count() <= screen
    held = np.sort(distinct.toPandas()["window"].to_numpy(np.int64).view(np.uint64)) if few else None
    hits = docs.mapInArrow(_windows(held, widths), HITS)
    hits = written(hits if few else hits.join(distinct, "window", "left_semi"), "hits")
    sides = written(known.select("window", F.col("id").alias("item"), F.col("part").alias("body")).distinct(), "sides")
    met = hits.select("id", "window").distinct().join(small(sides, 200_000), "window").groupBy("id", "item", "body").agg(F.count("*").alias("found"))
    met = met.join(small(total), ["item", "body"]).filter(F.col("found") >= F.least(coverage * F.col("all"), F.lit(float(stretch))))
    # In the plain reading an item without numbers has no slots, so that its windows alone tell.
    sure = F.bool_or((F.col("found") >= coverage * F.col("all")) & ~F.col("slotted") & (F.col("body") % 2 == 0))
    met = written(met.groupBy("id", "item").agg(sure.alias("sure"), F.max(F.col("found") / F.col("all")).alias("coverage")), "met")
    plain, met = met.filter("sure").select("id", "item", "coverage", F.lit(1.0).alias("slot_share")), met.filter("not sure").select("id", "item")
    held_by = hits.join(met, "id").join(small(written(sides.select("window", "item").distinct(), "sides"), 200_000), ["window", "item"], "left_semi").select("id", "item", "part", "at", "window", "words")
    body = met.join(known.select(F.col("id").alias("item"), "part", "at", "window", "words", "slots"), "item").select("id", "item", "part", "at", "window", "words", "slots")
    body = body.toDF(*body.columns)
    met = held_by.groupBy("id", "item").cogroup(body.groupBy("id", "item")).applyInArrow(_judged(coverage, consistent, stretch), "id long, item long, coverage double, slot_share double").unionByName(plain)
    return met.groupBy(F.col("id").alias("doc_id")).agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("coverage").alias("coverage"), F.max("slot_share").alias("slot_share")).withColumn("n_items", F.size("item_ids").cast("long"))


def op5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: contaminated or not, and by which items."""
    docs = table(spark, sf_dir, "documents")
    found = written(contaminated(docs, table(spark, sf_dir, "benchmark")), "contaminated")
    out = docs.select("doc_id").join(small(found), "doc_id", "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.expr("cast(array() AS array<bigint>)")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_items", F.lit(0)).alias("n_items"))
