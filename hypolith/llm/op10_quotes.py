"""Chat formatting: quoted passages are linked to the messages they come from, and replies follow what they answer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.llm.components import components
from hypolith.llm.tables import small, table, written

#: A quoted line's marks, the line that announces a quotation, and the share of a passage's lines that a source must have.
_MARKS = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
_SAYS = re.compile(r"(?i)^\s*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,80}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió|.{1,80}\b(?:wrote|said))\s*:\s*$")
_OTHER = re.compile(r"[^\w]+")
SHARE = 0.5
#: Turns that one task of the search for the turn before looks at together.
STRETCH = 256
#: Messages that have a line, beyond which they are looked at by the sets of such lines that they have.
HOT = 100


def normal(text: str) -> str:
    """Words in lower case, one space between them: what a quotation keeps of its source."""
    return _OTHER.sub(" ", text.lower()).strip()


def parsed(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """The message without quotations, and its passages: (level, normalised lines) for each run of lines of one level."""
    own, passages = [], []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
            passages.append((0, []))  # what follows is another passage
        else:
            if own and _SAYS.match(own[-1]):
                own.pop()
            if (line := normal(line[m.end() :])):
                if not passages or passages[-1][0] != level:
                    passages.append((level, []))
                passages[-1][1].append(line)
    return "\n".join(own).strip(), [p for p in passages if p[0] and p[1]]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


PARSED = "conv_id long, turn long, role string, text string, own array<long>, quotes array<struct<level:int,lines:array<long>>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("lines", pa.list_(pa.int64()))]))
    for batch in batches:
        texts, own, quotes = [], [], []
        for text in batch.column(3):
            mine, passages = parsed(text.as_py())
            texts.append(mine)
            lines = [n for x in mine.split("\n") if (n := normal(x))]
            own.append(sorted({_hash(x) for x in lines} | ({_hash(" ".join(lines))} if lines else set())))
            # A passage that was wrapped anew still has the words of the whole.
            quotes.append([{"level": k, "lines": sorted({_hash(x) for x in p} | {_hash(" ".join(p))})} for k, p in passages])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(own, pa.list_(pa.int64())), pa.array(quotes, kind)], ["conv_id", "turn", "role", "text", "own", "quotes"])


def _previous(turns: DataFrame) -> DataFrame:
    """turns with `last`, the turn before in the conversation: within stretches of STRETCH numbers, and from one
    stretch's end to the next's begin, so that a long conversation is dealt to many tasks."""
    s = turns.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    ends = s.groupBy("conv_id", "stretch").agg(F.max("turn").alias("end"))
    ends = ends.select("conv_id", "stretch", F.expr("lag(end) OVER (PARTITION BY conv_id ORDER BY stretch)").alias("before"))
    s = s.withColumn("here", F.expr("lag(turn) OVER (PARTITION BY conv_id, stretch ORDER BY turn)"))
    return s.join(ends, ["conv_id", "stretch"]).select("conv_id", "turn", F.coalesce("here", "before").alias("last"))


def _sources(asked: DataFrame, lines: DataFrame, share: float, hot: int) -> DataFrame:
    """(conv_id, turn, passage, level, source) for each passage of `asked` (a row a line) that has a source in `lines`.

    All earlier holders of a line with up to `hot` holders are candidates. Those that share only lines with more are
    alike if they have the same set of such lines: of each set the first message of all and the latest earlier one of
    the own conversation are candidates, and no other can come before them.
    """
    key, before = ["conv_id", "turn", "passage"], F.struct("conv_id", "turn")
    many = small(written(lines.groupBy("line").count().filter(F.col("count") > hot).select("line"), "hot"))
    sets = written(lines.join(many, "line", "left_semi").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("line")).alias("set")), "sets")
    told = asked.join(many, "line", "left_semi").groupBy(*key).agg(F.array_sort(F.collect_set("line")).alias("hot"))
    asking = written(asked.select(*key, "level", "lines").distinct().join(told, key, "left"), "passages")
    # By rare lines: their number, and that of the hot lines of both.
    rare = lines.join(many, "line", "left_anti").select("line", F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    met = asked.join(rare, "line").filter(F.struct("c", "t") < before).groupBy(*key, "c", "t").agg(F.count("*").alias("n"))
    met = met.join(asking, key).join(sets.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "set"), ["c", "t"], "left")
    met = met.withColumn("n", F.col("n") + F.coalesce(F.when(F.col("hot").isNotNull() & F.col("set").isNotNull(), F.size(F.array_intersect("hot", "set"))), F.lit(0)))
    met = met.select(*key, "level", "lines", "n", "c", "t")
    # By hot lines only: sets against sets, each once.
    kinds = sets.groupBy("set").agg(F.min(before).alias("first"))
    pairs = asking.filter("hot is not null").select("hot").distinct().select("hot", F.explode("hot").alias("line")).join(kinds.select("set", "first", F.explode("set").alias("line")), "line").groupBy("hot", "set", "first").agg(F.count("*").alias("n"))
    alike = written(asking.join(written(pairs, "pairs"), "hot").filter(F.col("n") >= share * F.col("lines")).select(*key, "level", "lines", "n", "set", "first"), "alike")
    first = alike.filter(F.col("first") < before).select(*key, "level", "lines", "n", F.col("first.conv_id").alias("c"), F.col("first.turn").alias("t"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("passage", "int"), ("level", "int"), ("lines", "int"), ("n", "long"))]
    events = alike.select(*key, "level", "lines", "n", "set", F.lit(None).cast("long").alias("said")).unionByName(sets.join(alike.select("conv_id", "set").distinct(), ["conv_id", "set"], "left_semi").select("conv_id", "turn", *none, "set", F.col("turn").alias("said")))
    last = F.expr("last(said, true) OVER (PARTITION BY conv_id, set ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    own = events.withColumn("t", last).filter("passage is not null and t is not null").select(*key, "level", "lines", "n", F.col("conv_id").alias("c"), "t")
    rank = F.expr("row_number() OVER (PARTITION BY conv_id, turn, passage ORDER BY n DESC, c = conv_id DESC, CASE WHEN c = conv_id THEN t END DESC, c, t)")
    found = met.unionByName(first).unionByName(own).filter(F.col("n") >= share * F.col("lines")).withColumn("rank", rank).filter("rank = 1")
    return found.select(*key, "level", F.struct(F.col("c").alias("conv_id"), F.col("t").alias("turn")).alias("source"))


def threaded(messages: DataFrame, share: float = SHARE, hot: int = HOT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, thread_id, depth, parent_conv, parent_turn, n_quotes, n_linked, chat) for each message.

    text is the message without its quotations and their announcing lines; chat is it with the role's mark. A passage's
    lines, and all of it joined, are hashed in normal form and joined to the messages that have such lines as their
    own and are earlier by (conv_id, turn). The source of a passage is the message with most of its lines, at least
    `share` of them: among equals the latest of the same conversation, else the first of all. A message answers the
    source of its outermost passage, else the turn before it in its
    conversation; conversations that are linked form one thread, named by its smallest conv_id. Sorted by
    (thread_id, depth, conv_id, turn), every reply follows what it answers.

    Messages that share only lines of more than `hot` messages with a passage are reduced to one for each set of such
    lines, and one for each set and conversation, so a line that very many messages share is never paired out. Null texts are empty messages; rows with a null conv_id or turn are
    dropped from threads and returned alone (depth 0, no thread); repeated rows of a (conv_id, turn) are one message,
    the smallest by role and text. Messages of any length are read whole, other columns aren't, whatever they are called. An
    empty table gives no rows.
    """
    rows = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    keyed = rows.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.*")
    parts = written(keyed.mapInArrow(_parsed, PARSED), "messages")
    asked = parts.select("conv_id", "turn", F.posexplode("quotes").alias("passage", "q")).select("conv_id", "turn", "passage", F.col("q.level").alias("level"), F.size("q.lines").alias("lines"), F.explode("q.lines").alias("line"))
    asked = written(asked, "quoted")
    wanted = asked.select("line").distinct()
    lines = written(parts.select("conv_id", "turn", F.explode("own").alias("line")).join(wanted, "line", "left_semi"), "sources")
    best = _sources(asked, lines, share, hot)
    linked = best.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "passage", "source")).alias("s")).select("conv_id", "turn", "n_linked", F.col("s.source").alias("source"))
    linked = written(linked, "answers")
    tree = _previous(parts.select("conv_id", "turn")).join(linked, ["conv_id", "turn"], "left")
    up = F.coalesce("source", F.when(F.col("last").isNotNull(), F.struct("conv_id", F.col("last").alias("turn"))))
    tree = written(tree.select("conv_id", "turn", up.alias("up"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "tree")
    across = tree.filter("up is not null and up.conv_id <> conv_id").select(F.col("up.conv_id").alias("low"), F.col("conv_id").alias("high")).distinct()
    threads = written(components(written(across, "across")), "threads")
    # Depth: everyone's ancestor is replaced by its ancestor until all are at the top; the distance doubles each time.
    now = written(tree.select("conv_id", "turn", F.col("up").alias("at"), F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth")), "depths")
    while now.filter("at is not null").limit(1).count():
        jump = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("at").alias("next"), F.col("depth").alias("more"))
        # Only those below the top move on, so that one long conversation doesn't move all others with it.
        below = now.filter("at is not null").join(jump, (F.col("at.conv_id") == F.col("c")) & (F.col("at.turn") == F.col("t")))
        now = written(below.select("conv_id", "turn", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth")).unionByName(now.filter("at is null")), "depths")
    out = parts.join(tree, ["conv_id", "turn"]).join(now.select("conv_id", "turn", "depth"), ["conv_id", "turn"]).join(threads, F.col("conv_id") == F.col("node"), "left")
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "text", F.lit("\n"))
    out = out.select("conv_id", "turn", "role", "text", F.coalesce("root", "conv_id").alias("thread_id"), "depth", F.col("up.conv_id").alias("parent_conv"), F.col("up.turn").alias("parent_turn"), F.size("quotes").cast("long").alias("n_quotes"), "n_linked", chat.alias("chat"))
    alone = rows.filter("conv_id is null or turn is null").mapInArrow(_parsed, PARSED)
    none = F.lit(None).cast("long")
    return out.unionByName(alone.select("conv_id", "turn", "role", "text", none.alias("thread_id"), F.lit(0).cast("long").alias("depth"), none.alias("parent_conv"), none.alias("parent_turn"), F.size("quotes").cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"), chat.alias("chat")))


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threaded(table(spark, sf_dir, "conversations"))
