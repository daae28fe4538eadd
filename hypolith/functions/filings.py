"""Parts of filings and transcripts as column expressions: sections, risk items, audit matters, questions and answers.

Texts are cut by setting a mark before each match of a pattern and splitting there, so that nothing leaves the JVM and the
same patterns hold in other regex dialects (they use no look-around; Spark alone is told to try some at line ends only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolith.functions.text import first_match, once

#: Headings of sections in annual and quarterly filings, and in filings of events.
SECTIONS = {
    "risk_factors": r"item\s*1A[.\s]\s*Risk\s*Factors",
    "mda": r"item\s*7[.\s]\s*Management(?:.s)?\s*Discussion",
    "business": r"item\s*1[.\s]\s*Business",
    "market_risk": r"item\s*7A[.\s]\s*Quantitative",
    "legal_proceedings": r"item\s*3[.\s]\s*Legal\s*Proceedings",
    "audit_report": r"REPORT\s+OF\s+INDEPENDENT\s+REGISTERED\s+PUBLIC\s+ACCOUNTING\s+FIRM",
    "cam": r"Critical\s+Audit\s+Matters?|(?:The\s+)?critical\s+audit\s+matters?\s+(?:communicated|identified|are)",
}
EVENT_SECTIONS = {
    "departure": r"item\s*5\.02[.\s]?\s*(?:Departure|Election)",
    "earnings_release": r"item\s*2\.02[.\s]?\s*(?:Results|Disclosure)",
    "material_agreement": r"item\s*1\.01[.\s]?\s*(?:Entry|Material)",
    "other_events": r"item\s*8\.01[.\s]?\s*(?:Other|Events)",
    "amendments": r"item\s*5\.03[.\s]?\s*(?:Amendments|Amendment)",
    "regulation_fd": r"item\s*7\.01[.\s]?\s*(?:Regulation|Reg\s*FD)",
}
#: What ends a section.
NEXT_SECTION, NEXT_EVENT = r"\n\s*item\s*\d+[A-Z]?\s*[.\s]\s", r"\n\s*item\s*\d+\.\d+\s"
#: Begins of risk items, sub-headings among them, and what isn't part of their text.
ITEM_START = r"(?:^|\n)\s*(?:\(\d{1,2}\)|\d{1,2}[.)]\s|[•\-*]\s|(?:Risk|Factor|Item)\s+(?:relating|Related|Regarding))"
SUBHEAD = r"(?:^|\n)\s*(?:Risks?\s+(?:Related|Relating|Associated|from|of)|(?:Legal|Regulatory|Operational|Financial|Market|Competition|Cybersecurity|Technology|Supply\s*Chain|Macroeconomic|Environmental|Climate|Reputation|Strategic|Compliance|Litigation|Intellectual\s*Property|Data\s*Privacy|Foreign\s*Exchange|Interest\s*Rate|Credit|Liquidity)\s+Risks?)"
CLEANUP = r"(?im)(?:Table\s+of\s+Contents|ITEM\s+1A|RISK\s+FACTORS|^\s*\d+\s*$|Page\s+\d+)"
#: Begin and end of the part on critical audit matters, the heading of each, and the end of their introduction.
CAM_START = r"(?:^|\n)\s*Critical\s+Audit\s+Matters?\s*\n"
CAM_END = r"\n\s*/s/\s*\n|\nREPORT\s+OF\s+INDEPENDENT|\n\s*(?:CONSOLIDATED\s+)?BALANCE\s+SHEETS?\s*\n|\n\s*ITEM\s*(?:9B|10|11|12|13|14|15)[.\s]"
CAM_HEADING = r"(?:^|\n)\s*(?:Critical\s+(?:Accounting|Audit)\s+Matter\s+Description|Description\s+of\s+the\s+Matter)\s*\n"
CAM_INTRO = r"(?:communicated\s+below|do\s+not\s+alter|providing\s+separate|does\s+not\s+alter|in\s+any\s+way\s+our\s+opinion)"
#: Words that tell the topic of an audit matter, in order, and the group of each topic.
CAM_TOPICS = [
    (r"goodwill|impairment|indefinite.?lived\s+intangible|fair\s+value\s+of\s+reporting\s+unit|proved\s+reserves?|full\s+cost\s+method|oil\s+and\s+gas\s+propert", "asset_valuation"),
    (r"allowance\s+for\s+(?:loan|credit)\s+loss|credit\s+loss|expected\s+loss|cecl|loan\s+portfolio|reserve\s+for\s+credit", "credit_risk"),
    (r"litigation|legal\s+proceed|contingen|loss\s+contingen|settlement|regulatory\s+matter", "tax_liability"),
    (r"tax\s+provision|uncertain\s+tax\s+position|deferred\s+tax\s+asset|valuation\s+allowance|transfer\s+pric|unrecognized\s+tax\s+benefit", "tax_liability"),
    (r"business\s+combin|acquis|purchase\s+price\s+alloc|intangible\s+asset|contingent\s+consideration", "acquisition"),
    (r"revenue\s+recogni|performance\s+obligation|variable\s+consideration|percentage\s+of\s+completion|contract\s+(?:cost|revenue|drilling)", "revenue"),
    (r"inventor|obsolescence|lower\s+of\s+cost|net\s+realizable\s+value|excess\s+and\s+obsolete", "asset_valuation"),
    (r"financial\s+instrument|derivative|hedg|fair\s+value\s+measurement|level\s+[123]", "financial_instruments"),
    (r"pension|post.?retirement\s+benefit|defined\s+benefit|actuarial\s+assumption|discount\s+rate", "benefit_obligations"),
    (r"estimate|assumption|judgment|subjectivity|management\s+bias|complex\s+accounting", "estimates"),
]
#: The description of an audit matter, up to how it was addressed.
CAM_DESCRIPTION = r"critical\s+(?:accounting|audit)\s+matter\s+description\s*\n(.*?)(?:how\s+(?:the\s+)?critical\s+audit\s+matter\s+was\s+addressed|\z)"
#: Begin and end of questions and answers in a filing, and their begin in a transcript.
QA_START = r"\n\s*(?:Questions?\s*(?:and|&)\s*Answers?|Q\s*&?\s*A\s*Session|Conference\s*Call\s*(?:Q&A|Questions)|Operator\b)"
QA_END = r"\n\s*(?:Copyright\s+(?:©|\(c\))|END\s*OF\s*(?:TRANSCRIPT|CALL)|\n-{5,}|This\s+transcript\s+is\s+provided\s+by)"
SEGMENT_START = r"\n\s*Questions?\s*(?:and|&)\s*Answers?\s*\n|\n\s*Q\s*&?\s*A\s*Session\s*\n|\n\s*Operator\b|\n\s*Question-and-Answer|\n\s*Q&A\b"
#: What names an exhibit a transcript.
TRANSCRIPT = r"transcript|earnings\s*call|conference\s*call|investor\s*call|webcast|presentation\s*slides"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


#: The begin of patterns that match at the begin of a line, and what has a pattern tried at line ends only, several times faster.
AT_LINE, AHEAD = r"(?:^|\n)", r"(?=\n)"


def _lined(text: Column, pattern: str) -> tuple[Column, str]:
    """The text without marks and the pattern in either case; with a line end before the text, and tried at line ends only, if the
    pattern matches at the begin of a line."""
    plain = F.replace(text, F.lit("\u0001"), F.lit(" "))
    return (F.concat(F.lit("\n"), plain), AHEAD + pattern) if pattern.startswith(AT_LINE) else (plain, pattern)


def cut(text: Column, pattern: str) -> Column:
    """The text before the first match, and a piece from each match on to the next."""
    lined, tried = _lined(text, pattern)
    marked = F.regexp_replace(lined, f"(?i)({tried})", "\u0001$1")
    if tried != pattern:  # without the line end set before, which may have a mark before it
        rest = lambda m, at: F.substring(m, F.lit(at), F.char_length(m))
        marked = once(marked, lambda m: F.when(F.startswith(m, F.lit("\u0001")), F.concat(F.lit("\u0001"), rest(m, 3))).otherwise(rest(m, 2)))
    return F.split(marked, "\u0001", -1)


def before(text: Column, pattern: str) -> Column:
    """The text up to the first match; null without one."""
    lined, tried = _lined(text, pattern)
    head = lambda p: F.get(p, 0) if tried == pattern else F.substring(F.get(p, 0), F.lit(2), F.char_length(F.get(p, 0)))
    return once(F.split(lined, f"(?i)(?:{tried})", 2), lambda p: F.when(F.size(p) > 1, head(p)))


def section(text: Column, heading: str, following: str, most: int = 100_000, least: int = 100) -> Column:
    """From the last match of the heading (the first stands in a table of contents) to what follows next, or up to `most`
    characters; null without a heading and up to `least` characters."""

    def body(last: Column) -> Column:
        head = F.regexp_extract(last, f"(?i)^(?:{heading})", 0)
        upto = once(F.char_length(head), lambda n: before(F.substring(last, n + 1, F.char_length(last)), following))
        return stripped(F.coalesce(F.concat(head, upto), F.substring(last, 1, most)))

    last = lambda p: F.when(F.size(p) > 1, F.element_at(p, -1))
    return once(once(cut(text, heading), last), lambda x: F.when(x.isNotNull(), once(body(x), lambda y: F.when(F.char_length(y) > least, y))))


def risk_items(text: Column) -> Column:
    """Risk factors: by numbers or bullets if there are three, else by sub-headings if there are three, else paragraphs if
    there are five, else none. Items have 50 characters and more, paragraphs 100."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, CLEANUP, " "), "\n{3,}", "\n\n"), "[ \t]{2,}", " ")
    none = F.expr("cast(array() AS array<string>)")

    def by(t: Column, pattern: str) -> Column:
        own = lambda pieces: F.filter(F.transform(F.slice(pieces, 2, F.greatest(F.lit(1), F.size(pieces))), stripped), lambda x: F.char_length(x) >= 50)
        return once(cut(t, pattern), lambda pieces: F.when(F.size(pieces) > 3, once(own(pieces), lambda items: F.when(F.size(items) >= 3, items))))

    paragraphs = lambda t: once(F.filter(F.transform(F.split(t, "\n\n", -1), stripped), lambda x: F.char_length(x) >= 100), lambda x: F.when(F.size(x) >= 5, x))
    return once(clean, lambda t: F.coalesce(by(t, ITEM_START), by(t, SUBHEAD), paragraphs(t), none))


def audit_matters_part(text: Column) -> Column:
    """The whole part on critical audit matters, up to the signature, the balance sheet or the next item; null without one."""

    def part(rest: Column) -> Column:
        end = F.char_length(before(F.substring(rest, F.lit(101), F.char_length(rest)), f"{AHEAD}(?:{CAM_END})"))
        return once(end, lambda n: F.when(n.isNotNull(), F.substring(rest, F.lit(1), n + 100)).otherwise(rest))

    return once(F.char_length(before(text, CAM_START)), lambda at: F.when(at.isNotNull(), once(F.substring(text, at + 1, F.char_length(text)), part)))


def audit_matters(df: DataFrame, text: str, name: str = "matters") -> DataFrame:
    """df with an array of audit matters: the text from each heading on, with what stands before it as its topic if that is
    under 800 characters. Without headings the whole part is one, if it has 300 characters. Matters under 100 characters
    are left out. In steps, so that each cut of a text is made once."""
    none = F.expr("cast(array() AS array<string>)")
    d = df.withColumn("_part", audit_matters_part(F.col(text)))
    d = d.withColumn("_pieces", cut(F.col("_part"), CAM_HEADING)).withColumn("_intro", cut(F.element_at("_pieces", 1), CAM_INTRO))
    after = F.array_join(F.slice("_intro", 2, F.greatest(F.lit(1), F.size("_intro"))), "")
    topic = F.when(F.size("_intro") > 1, F.regexp_extract(after, r"(?s)^.*?\n\s*\n(.*)$", 1)).otherwise(F.element_at("_pieces", 1))
    d = d.withColumn("_topic", topic)
    heads = F.transform(F.slice("_pieces", 2, F.greatest(F.lit(1), F.size("_pieces"))), lambda x: F.regexp_replace(x, f"(?i)^(?:{CAM_HEADING})", ""))
    d = d.withColumn("_heads", F.transform(F.concat(F.array("_topic"), heads), lambda x: stripped(F.regexp_replace(F.regexp_replace(x, r"\n\s*\d{1,3}\s*\n", "\n"), r"(?i)\nTable\s+of\s+Contents\s*\n", "\n"))))
    one = lambda x, i: F.when((F.char_length(F.get("_heads", i)) > 0) & (F.char_length(F.get("_heads", i)) < 800), F.concat(F.get("_heads", i), F.lit("\n"), stripped(x))).otherwise(stripped(x))
    each = F.filter(F.transform(F.slice("_pieces", 2, F.greatest(F.lit(1), F.size("_pieces"))), one), lambda x: F.char_length(x) >= 100)
    whole = F.when(F.char_length(stripped(F.col("_part"))) >= 300, F.array(stripped(F.col("_part")))).otherwise(none)
    d = d.withColumn(name, F.when(F.col("_part").isNull(), none).when(F.size("_pieces") > 1, each).otherwise(whole))
    return d.drop("_part", "_pieces", "_intro", "_topic", "_heads")


def audit_topic(matter: Column) -> Column:
    """The group of the first topic whose words are in the description, else in all of the text, else other."""
    told = lambda m: once(F.regexp_extract(m, f"(?is){CAM_DESCRIPTION}", 1), lambda t: F.nullif(first_match(t, CAM_TOPICS, "other"), F.lit("other")))
    return once(F.lower(matter), lambda m: F.coalesce(told(m), first_match(m, CAM_TOPICS, "other")))


def questions_part(text: Column) -> Column:
    """Questions and answers: from their heading to the end mark after 200 characters and a fifth of what is left, or 50,000
    characters; null without a heading and under 500 characters."""

    def part(rest: Column) -> Column:
        skip = F.greatest(F.lit(200), F.floor(F.char_length(rest) / 5).cast("int"))
        end = once(skip, lambda s: s + F.char_length(before(F.substring(rest, s + 1, F.char_length(rest)), QA_END)))
        out = once(end, lambda n: F.when(n.isNotNull(), F.substring(rest, F.lit(1), n)).otherwise(F.substring(rest, 1, 50_000)))
        return once(out, lambda o: F.when(F.char_length(o) >= 500, stripped(o)))

    return once(F.char_length(before(text, QA_START)), lambda at: F.when(at.isNotNull(), once(F.substring(text, at + 1, F.char_length(text)), part)))


def segments(transcript: Column) -> Column:
    """(prepared, qa): cut at the first heading of questions; all is prepared where the rest is under a tenth of more than
    2,000 characters."""

    def parts(head: Column) -> Column:
        said, qa = stripped(head), stripped(F.substring(transcript, F.char_length(head) + 1, F.char_length(transcript)))

        def chosen(x: Column) -> Column:
            said, qa = x["said"], x["qa"]
            whole = said.isNull() | ((F.char_length(said) > 2000) & (F.char_length(qa) < 0.1 * F.char_length(said)))
            return F.struct(F.when(whole, transcript).otherwise(said).alias("prepared"), F.when(whole, "").otherwise(qa).alias("qa"))

        return once(F.struct(said.alias("said"), qa.alias("qa")), chosen)

    return once(before(transcript, SEGMENT_START), parts)


def transcripts(submission: Column) -> Column:
    """The texts of a submission's exhibits 99 whose description or file name tells a transcript; over 500 characters."""
    blocks = F.split(submission, r"\n\s*</?DOCUMENT>\s*\n", -1)
    field = lambda b, name: F.regexp_extract(b, rf"(?i)<{name}>\s*([^\n<]+)", 1)
    told = lambda b: b.rlike(r"(?i)<TYPE>\s*EX-99") & F.concat(field(b, "DESCRIPTION"), F.lit(" "), field(b, "FILENAME")).rlike(f"(?i){TRANSCRIPT}")
    texts = F.transform(F.filter(blocks, told), lambda b: F.regexp_extract(b, r"(?is)<TEXT>\s*(.*?)\s*</TEXT>", 1))
    return F.filter(texts, lambda x: (F.char_length(x) > 500) & ~F.lower(x).rlike("<pdf>|<xml>") & ~F.startswith(x, F.lit("JVBER")))


#: A JSON object with objects and lists in it, to a depth of three.
_STRING, _IN = r'"(?:[^"\\]|\\.)*"', r"[^{}\"]+"
OBJECT = rf"\{{(?:{_IN}|{_STRING}|\{{(?:{_IN}|{_STRING}|\{{(?:{_IN}|{_STRING})*\}})*\}})*\}}"


def tolerant_json(text: Column, fields: dict[str, float | None]) -> dict[str, Column]:
    """Number fields of a JSON object in a text: fences off, the first object in braces, commas before a closing brace off;
    where that doesn't parse, by the fields' names. The value in `fields` counts where a field is missing."""
    t = stripped(F.regexp_replace(text, r"(?m)^```.*$", ""))
    found = F.nullif(F.regexp_extract(t, f"(?s)({OBJECT})", 1), F.lit(""))
    mended = F.regexp_replace(F.coalesce(found, t), r",\s*([}\]])", "$1")
    return {k: F.coalesce(F.get_json_object(mended, f"$.{k}"), F.nullif(F.regexp_extract(t, rf'"{k}"\s*:\s*(-?[\d.]+)', 1), F.lit("")), F.lit(d)).try_cast("double") for k, d in fields.items()}
