"""Text features as column expressions. Word boundaries are spelled out, so that they mean the same in any regex dialect."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Expressions of uncertainty.
HEDGES = (
    "may be", "might be", "could be", "would be", "should be", "may have", "might have", "could have", "would have", "may not", "might not", "may still",
    "approximately", "roughly", "about", "around", "nearly", "close to", "more or less", "somewhat", "relatively",
    "it appears", "it seems", "it would appear", "it would seem", "appears to", "seems to", "appeared to", "seemed to", "tends to", "tended to", "tend to",
    "it is possible", "it is conceivable", "it is likely", "it is probable", "it is unlikely", "it is plausible", "there is a possibility", "there is a chance",
    "we believe", "we think", "we suspect", "we speculate", "in our view", "in our opinion", "to our knowledge", "we interpret", "we suggest",
    "according to", "reportedly", "allegedly", "purportedly", "ostensibly", "presumably",
    "rather", "quite", "fairly", "pretty", "a little", "slightly", "to some extent", "in part", "to a certain degree", "to a degree",
    "sometimes", "occasionally", "from time to time", "now and then", "in some cases", "in certain cases", "in some instances",
    "potentially", "possibly", "conceivably", "maybe", "perhaps",
)
#: Expressions of certainty.
CERTAINTIES = (
    "clearly", "obviously", "undoubtedly", "undeniably", "unquestionably", "definitely", "certainly", "absolutely", "indisputably", "incontrovertibly",
    "all", "every", "none", "never", "always", "entirely", "completely", "totally", "fully", "wholly",
    "we conclude", "we find", "we determine", "we establish", "we demonstrate", "we confirm", "we prove", "it is clear", "it is evident", "it is certain", "there is no doubt", "without doubt",
    "demonstrates", "demonstrated", "establishes", "established", "confirms", "confirmed", "proves", "proved", "shows conclusively", "shown conclusively",
    "significant", "substantial", "robust", "compelling", "conclusive", "definitive", "decisive", "unequivocal",
    "we found", "we observed", "we detected", "we identified", "we measured", "we quantified", "we verified",
    "statistically significant", "p <", "p =", "highly significant", "strongly significant", "95% confidence", "99% confidence", "p-value", "effect size",
)
#: Forms of "to be" before a participle, each pattern counted by itself.
PASSIVES = (
    r"(?:am|is|are|was|were|be|been|being)\s+[a-z]+(?:ed|en|t|d)",
    r"(?:am|is|are|was|were|be|been|being)\s+[a-z]+ed",
    r"(?:has|have|had|having)\s+been\s+[a-z]+(?:ed|en|t|d)",
    r"(?:will|would|shall|should|may|might|must|can|could)\s+be\s+[a-z]+(?:ed|en|t|d)",
)
#: Pronouns by group.
PRONOUNS = {"we": ("we", "us", "our", "ours", "ourselves"), "they": ("they", "them", "their", "theirs", "themselves"), "i": ("i", "me", "my", "mine", "myself"), "you": ("you", "your", "yours", "yourself"), "he_she": ("he", "she", "him", "her", "his", "hers"), "it": ("it", "its", "itself")}


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once a row, however often the body names it: a column's expression is written out, and
    its patterns are looked for, at each place where it stands."""
    return F.get(F.transform(F.array(value), body), 0)


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.+*?()[]{}|^$" else c for c in word)


def spaced(text: Column) -> Column:
    """Lower case, everything but ASCII letters, digits and a few signs as one space, and a space doubled around words."""
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9%<=-]+", "  "), "^ +| +$", ""), F.lit(" "))


def phrase_count(text: Column, phrases: tuple[str, ...]) -> Column:
    """How often any of the phrases stands in the text as whole words; of those that begin together the first listed."""
    return spaced_count(spaced(text), phrases)


def spaced_count(spaced_text: Column, phrases: tuple[str, ...]) -> Column:
    """phrase_count of a text that is spaced already, for those who count several lists in it."""
    alternatives = "|".join(_quoted(p).replace(" ", " +") for p in phrases)
    return F.regexp_count(spaced_text, F.lit(f" (?:{alternatives}) ")).cast("long")


def words(text: Column) -> Column:
    """Runs of ASCII letters in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space and a capital letter, of three tokens and more."""
    marked = F.regexp_replace(text, r"([.!?])\s+([A-Z])", "$1\u0001$2")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.size(F.split(F.trim(s), r"\s+")) >= 3)


def syllables(word: Column) -> Column:
    """Groups of vowels without a final e, at least one; one for words up to three letters."""
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(word, "e$", ""), F.lit("[aeiouy]+"))))


def passive_count(text: Column) -> Column:
    """The sum over the passive patterns, which count some phrases twice by design."""
    s = spaced(text)
    return sum((F.regexp_count(s, F.lit(f" {p.replace(chr(92) + 's+', ' +')} ")).cast("long") for p in PASSIVES[1:]), F.regexp_count(s, F.lit(f" {PASSIVES[0].replace(chr(92) + 's+', ' +')} ")).cast("long"))


def pronoun_counts(text: Column) -> dict[str, Column]:
    return spaced_pronouns(spaced(text))


def spaced_pronouns(spaced_text: Column) -> dict[str, Column]:
    return {k: spaced_count(spaced_text, v) for k, v in PRONOUNS.items()}


def plural_ratio(text: Column, least: int = 5) -> Column:
    """First person plural over all pronouns; null under `least`."""

    def ratio(c: Column) -> Column:
        return once(sum((c[k] for k in list(PRONOUNS)[1:]), c["we"]), lambda total: F.when(total >= least, c["we"] / total))

    return once(spaced(text), lambda s: once(F.struct(*(v.alias(k) for k, v in spaced_pronouns(s).items())), ratio))


def stripped_html(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, a few references decoded, white space collapsed."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, r"[ \t\n\r\f]+", " "))


def needed(pattern: str) -> list[str]:
    """For each alternative of a pattern its longest run of letters that all its matches hold; none where one has no such run, or
    the pattern holds more than letters, signs of a kind, classes, what is optional, and groups without groups in them."""
    plain = re.sub(r"\(\?:[^()]*\)[?*+]?|\[[^]]*\][?*+]?|\\[sSdDwWbB.][?*+]?|.[?*]", " ", pattern)
    runs = [re.findall("[a-z]+", p) for p in plain.split("|")]
    return [] if re.search(r"[^a-z |+.-]", plain) or not all(runs) else [max(r, key=len) for r in runs]


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule (pattern, name) whose pattern is in the lower-case text. A pattern is looked for only where
    letters stand that it needs, which are found many times faster than it."""

    def found(lowered: Column) -> Column:
        out = F.lit(otherwise)
        for pattern, name in reversed(rules):
            there = [lowered.contains(x) for x in dict.fromkeys(needed(pattern))]
            out = F.when(reduce(or_, there) & lowered.rlike(pattern) if there else lowered.rlike(pattern), name).otherwise(out)
        return out

    return once(F.lower(text), found)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
