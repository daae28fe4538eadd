"""Secret scans: plain credentials anywhere, and weak candidates only next to the other parts of a credential."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.llm.tables import table, written

#: (kind, pattern, which group is measured, least length of it, part of a credential that it is, whether reported alone).
#: The order of kinds is the order among spans that start together. Runs of one class of characters ask for their least
#: length in the pattern, which finds the same spans as measuring every run; a word with a value is measured after it was
#: found, for one that is too short may hide another.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 3, 8, "secret", True),
    ("access", r"(AKIA[A-Z0-9]{12,})", 2, 16, "id", True),
    ("hex", r"([0-9a-f]{32,})", 2, 32, "secret", True),
    ("login", r"""((?i:access_?key_?id|client_?id|user_?name|account|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)""", 3, 4, "id", False),
    ("endpoint", r"""((?i:https?|ftp|sftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+)""", 2, 12, "endpoint", False),
    ("opaque", r"((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,})", 2, 20, "secret", False),
)
#: Patterns that say quickly whether a text can hold the kind at all.
_QUICK = {"hex": r"[0-9a-f]{32}", "access": "AKIA[A-Z0-9]", "opaque": r"[A-Za-z0-9+/_=-]{20}"}
#: Code points between parts of one credential at most.
SCOPE = 300


def _matches(text: Column, order: int) -> Column:
    """An array of (kind, order, at, gap, span, ok): a kind's matches, each with the length of what lies before it since the last."""
    kind, pattern, group, least, _, _ = KINDS[order]
    whole = F.lit(f"(?s)\\G(.*?){pattern}")  # each from the end of the last on, so gaps and matches cover the text
    parts = (("all", 0), ("gap", 1), ("value", group)) if group > 2 else (("gap", 1), ("value", group))  # group 2 is the match
    found = F.arrays_zip(*(F.regexp_extract_all(text, whole, F.lit(g)).alias(name) for name, g in parts))

    def span(x: Column, at: Column) -> Column:
        ok = F.char_length(x["value"]) >= least
        if kind == "opaque":
            ok = ok & x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]")
        gap = F.char_length(x["gap"]).cast("long")
        whole = F.char_length(x["all"]).cast("long") if group > 2 else gap + F.char_length(x["value"])
        return F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), at.alias("at"), gap.alias("gap"), whole.alias("span"), ok.alias("ok"))

    return F.when(text.rlike(_QUICK.get(kind, pattern)), F.transform(found, span))


def _candidates(text: Column) -> Column:
    return F.flatten(F.array_compact(F.array(*(_matches(text, i) for i in range(len(KINDS))))))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak) for each row of docs.

    The first three KINDS are reported wherever they stand. The others are weak: a login name, an endpoint or an
    opaque string is reported only if a candidate that is another part of a credential (an identifier, a secret or an
    endpoint) lies within `scope` code points in the same text. That is an interval join: candidates are dealt to
    cells of the text as wide as the scope, so a cell holds few, whatever the text's length, and each weak candidate
    keeps one row. Offsets are code points of the whole text, ends exclusive. Null texts are empty; without spans the
    string is empty and base_sha256 that of the empty string. Rows are judged one by one, whatever their ids: repeated
    rows get equal results, and null ids stay null. Texts are read whole, however long; other columns
    aren't read, whatever they are called, and no rows give no rows. DataFrame functions only.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # A row's name is drawn once, as the table is written.
    rows = docs.select("doc_id", F.expr("uuid()").alias("row"), "text").select("doc_id", "row", F.explode_outer(_candidates(F.col("text"))).alias("c")).select("doc_id", "row", "c.*")
    rows = written(rows, "candidates", wide=True)
    found = rows.withColumn("end", F.expr("sum(span) OVER (PARTITION BY row, kind ORDER BY at)")).filter("ok")
    found = found.select("row", "kind", "order", (F.col("end") - F.col("span") + F.col("gap")).alias("start"), "end")
    part, alone = (F.create_map(*(F.lit(x) for k in KINDS for x in (k[0], k[i]))) for i in (4, 5))
    found = written(found.withColumns({"part": part[F.col("kind")], "alone": alone[F.col("kind")]}), "found")
    # Weak candidates that a plain one covers say nothing more.
    cells = lambda before, after: F.explode(F.sequence(F.floor((F.col("start") - before) / scope), F.floor((F.col("end") + after) / scope)))
    weak = found.filter(~F.col("alone")).select("*", cells(scope, scope).alias("cell"))
    near = found.select(F.col("row").alias("of"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("part").alias("p"), F.col("alone").alias("plain"), cells(0, 0).alias("c"))
    meets = (weak["row"] == near["of"]) & (weak["cell"] == near["c"]) & (F.col("s") < F.col("end") + scope) & (F.col("start") - scope < F.col("e"))
    linked = weak.join(near, meets & (F.col("p") != F.col("part")), "left_semi").drop("cell").distinct()
    linked = linked.select("*", cells(0, 0).alias("cell"))
    linked = linked.join(near, (linked["row"] == near["of"]) & (linked["cell"] == near["c"]) & F.col("plain") & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left_anti").drop("cell")
    spans = found.filter("alone").unionByName(linked.distinct()).select("row", F.struct("start", "order", "end", "kind", "alone").alias("s"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("s"))
    ids = rows.select("row", "doc_id").distinct()
    text = lambda keep: F.array_join(F.transform(F.filter("s", keep), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda keep: F.coalesce(F.size(F.filter("s", keep)), F.lit(0)).cast("long")
    of = lambda kind: lambda x: x["kind"] == kind
    out = ids.join(spans, "row", "left")
    return out.select(
        "doc_id",
        *(count(of(k)).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(F.coalesce(text(lambda x: x["alone"]), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(text(lambda x: F.lit(True)), F.lit("")).alias("spans"),
        count(lambda x: ~x["alone"]).alias("n_weak"),
    )


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
