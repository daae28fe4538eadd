"""Vector bin packing: examples go into sequences under limits on tokens, segments and loss-bearing tokens at once."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.llm.tables import table

#: Tokens, segments and loss-bearing tokens of a sequence at most; pieces that wait in a task before they are packed.
TOKENS, SEGMENTS, LOSS, POOL = 1024, 256, 1024, 4096
#: Characters of one kind in a row (white space, letters, digits, signs) from which the tokenizers file is used.
RUN = 10_000
#: The id that ends a document.
END = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long"


class Encoder:
    """The ids of the tokenizers file. Texts in common Latin letters go through a faster library with the same vocabulary and merges."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        import re

        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        # Letters for which the two libraries' tables can't differ; a marker of special tokens leaves it to the first, and
        # so do long runs of one kind of character, on which the second's patterns run out of stack.
        # A run is looked for from its first character alone, so that runs just under RUN cost what other text costs.
        self.other = re.compile("[^\x00-ɏ‐-‧€]|<\\|")
        self.runs = re.compile("|".join(f"(?<!{c}){c}{{{RUN}}}" for c in (r"\s", r"[^\W\d_]", r"\d", r"[^\w\s]", "_")))
        if ranks and pattern:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                held = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=held, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or self.other.search(text) or (len(text) >= RUN and self.runs.search(text)):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return np.frombuffer(array("I", self.fast.encode_ordinary(text)), np.uint32)
        except BaseException as e:  # a panic inside the library is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Takes pieces (doc, start, ids, all ids of the doc, first loss-bearing id of the doc) and gives rows of PIECES.

    Pieces that reach a limit on tokens or loss are sequences of their own. The rest wait in a pool; a sequence is
    filled by always adding the piece whose demand has the largest dot product with what is left of the three limits.
    When none fits whole, one is cut to fill what is left. At the end the last sequences are cut to lengths that are
    powers of two.
    """

    def __init__(self, first: int, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL):
        self.limit, self.pool, self.next, self.rows = np.array([tokens, segments, loss], float), pool, first, []
        self.items: list[tuple] = []
        self.tokens, self.segments, self.loss = tokens, segments, loss

    def _demand(self, item: tuple) -> tuple[int, int, int]:
        _, start, ids, _, bears = item
        return len(ids), 1, max(0, start + len(ids) - max(start, bears))

    def _cut(self, item: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, ids, total, bears = item
        return (doc, start, ids[:n], total, bears), (doc, start + n, ids[n:], total, bears)

    def _room(self, item: tuple, left: np.ndarray) -> int:
        """The most ids of the item, from its start, that fit."""
        _, start, ids, _, bears = item
        free = max(0, bears - start)
        return 0 if left[1] < 1 else int(min(len(ids), left[0], free + left[2]))

    def _close(self, items: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total, bears in items:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at, max(0, start + len(ids) - max(start, bears))))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray, bears: int = 0) -> None:
        item = (doc, 0, ids, len(ids), bears)
        while len(item[2]) and (n := self._room(item, self.limit)) and (n == self.tokens or n < len(item[2])):
            part, item = self._cut(item, n)
            self._close([part]) if n == self.tokens else self.items.append(part)
        if len(item[2]):
            self.items.append(item)
        if len(self.items) >= self.pool:
            self._pack(self.pool // 4)

    def _pack(self, keep: int) -> None:
        """Fills sequences until at most `keep` pieces wait."""
        items = self.items
        need = np.array([self._demand(x) for x in items], float).reshape(-1, 3)
        here = np.ones(len(items), bool)
        # A row for each limit, as steps go over all pieces, and gone pieces are left out as soon as they are half of them.
        at = np.arange(len(items))
        by, share = self._rows(need)
        while (left_over := int(here.sum())) > keep:
            if 2 * left_over < len(at):
                at = np.flatnonzero(here)
                by, share = self._rows(need[at])
            left, chosen = self.limit.copy(), []
            while left[0] > 0 and left[1] > 0:
                part = left / self.limit
                worth = share[0] * part[0] + share[1] * part[1] + share[2] * part[2]
                worth[(by[0] > left[0]) | (by[1] > left[1]) | (by[2] > left[2])] = -1.0
                k = int(np.argmax(worth))
                if worth[k] < 0:
                    break
                i = int(at[k])
                chosen.append(items[i])
                # What is gone never fits.
                left, here[i], by[0, k] = left - need[i], False, np.inf
            for i in np.flatnonzero(here) if left[0] > 0 and left[1] > 0 else ():
                if n := self._room(items[i], left):
                    part, items[i] = self._cut(items[i], n)
                    chosen.append(part)
                    left = left - self._demand(part)
                    need[i] = self._demand(items[i])
                    here[i] = len(items[i][2]) > 0
                    k = np.searchsorted(at, i)
                    by[:, k], share[:, k] = need[i], need[i] / self.limit
                    if not here[i]:
                        by[0, k] = np.inf
                if left[0] <= 0 or left[1] <= 0:
                    break
            total = int(self.limit[0] - left[0])
            if total == self.tokens or not left_over - len(chosen) < 1:
                self._close(chosen)
            else:
                self._halve(chosen, total)
        self.items = [x for x, y in zip(items, here, strict=True) if y]

    def _rows(self, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Demands, and their shares of the limits, with a row for each limit."""
        return need.T.copy(), (need / self.limit).T.copy()

    def _halve(self, items: list[tuple], total: int) -> None:
        """The last pieces of all, in sequences whose lengths are the powers of two that add up to theirs."""
        for k in range(total.bit_length() - 1, -1, -1):
            if total >> k & 1:
                want, part = 1 << k, []
                while want:
                    head, *items = items
                    if len(head[2]) > want:
                        head, rest = self._cut(head, want)
                        items = [rest, *items]
                    want -= len(head[2])
                    part.append(head)
                self._close(part)

    def end(self) -> None:
        self._pack(0)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def packed(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", bears_col: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL) -> DataFrame:
    """One row of PIECES for each piece of a document in a sequence.

    A document is the ids of its whole text (null: empty) by the file `tokenizer`, then END; `ranks` and `pattern` name
    the same vocabulary for the faster library. bears_col: the document's first loss-bearing id (none or null: 0),
    which for instruction data is the prompt's length. A text of any length, also of one
    run of white space, is encoded whole, in time that grows with its length. Every id lies in exactly one piece. Each task packs what it
    reads, as it reads, with at most `pool` pieces waiting: no shuffle, bounded memory, and a lost task is done again
    with the same result. Only the last few sequences of a task are short, and their lengths are powers of two. Rows with
    a null id or repeated ids are packed like others. Other columns aren't read. No rows give no rows.
    """
    schema = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(bears_col) if bears_col else F.lit(0)).cast("long").alias("bears")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks, pattern)
        packer = Packer(TaskContext.get().partitionId() << 40, tokens, segments, loss, pool)
        for batch in batches:
            for doc, text, bears in zip(*batch.columns, strict=True):
                packer.add(doc.as_py(), np.append(encoder.ids(text.as_py() or ""), np.uint32(END)), bears.as_py() or 0)
                if len(packer.rows) >= 4096:
                    yield _batch(packer.taken())
        packer.end()
        if rows := packer.taken():
            yield _batch(rows)

    return docs.select(*schema).mapInArrow(run, PIECES)


def public_files() -> dict[str, str]:
    """Where the installed files of the byte-level vocabulary are."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), **public_files())
