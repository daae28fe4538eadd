"""Personal data: plain patterns anywhere, and a character tagger for the forms that no pattern has."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.llm.tables import table
from hypolith.llm.tagger import KINDS, WINDOW, Tagger, best, classes, spans

#: Labelled texts that are made up for the fit, and steps of it.
MADE, STEPS = 3000, 1000
#: Characters before and after each place that may belong to personal data which the tagger reads.
AROUND = WINDOW
#: Characters of zones that are tagged at a time.
AT_ONCE = 1 << 18
#: No span of any kind is without one of these.
_ANCHOR = re.compile(r"[0-9]+|@|[\[({]\x20?(?:at|AT)\x20?[\])}]|\x20(?:dot|DOT)\x20")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
#: Each attempt begins where a run of digits begins and takes runs whole, which finds what the plain patterns find, in one pass.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
ROWS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_tagged long"


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def base(text: str) -> list[tuple[str, int, int]]:
    """The spans of the plain patterns by kind and start, in time linear in the text."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        # What stands before the sign is read backwards, so that a long run without a sign costs nothing.
        start = at
        while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if _is_card(_digits(m[0]))]
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def _holds(kind: str, text: str) -> bool:
    """Whether a tagged stretch can be what the tagger says."""
    digits = _digits(text)
    if kind == "card":
        return _is_card(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and not any(x.isalpha() for x in text)
    if kind == "ip":
        return len(parts := re.findall("[0-9]+", text)) == 4 and all(map(_byte, parts))
    sides = re.split(r"@|[\[({]\x20?at\x20?[\])}]|\x20at\x20", text, flags=re.I)
    host = re.split(r"\.|[\[({]\x20?dot\x20?[\])}]|\x20dot\x20", sides[-1], flags=re.I)
    return len(sides) == 2 and len(host) > 1 and all(any(x.isalnum() for x in part) for part in (sides[0], *host)) and "\n" not in text


def _zones(text: str) -> list[tuple[int, int]]:
    """Stretches of the text around its anchors, as wide as a window on both sides; those that touch are one."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        lo, hi = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _tagged(model: Tagger, zones: Sequence[str]) -> list[list[tuple[str, int, int]]]:
    return [spans(x) for x in best(model.chances([classes(z) for z in zones]))]


def found(model: Tagger, texts: Sequence[str]) -> list[tuple[list[tuple], list[tuple]]]:
    """Of each text the plain spans, and those that the tagger adds: what it marks in the zones that passes the test of its kind and
    doesn't overlap a plain span."""
    plain = [base(t) for t in texts]
    more: list[list[tuple]] = [[] for _ in texts]
    held: list[tuple[int, int, str]] = []
    size = 0

    def tag() -> None:
        for (i, lo, zone), marks in zip(held, _tagged(model, [z for _, _, z in held]), strict=True):
            more[i] += [(kind, lo + a, lo + b) for kind, a, b in marks if _holds(kind, zone[a:b])]

    for i, text in enumerate(texts):
        for lo, hi in _zones(text):
            held.append((i, lo, text[lo:hi]))
            size += hi - lo
            if size >= AT_ONCE:
                tag()
                held, size = [], 0
    tag()
    out = []
    for x, y in zip(plain, more, strict=True):
        taken = np.array(sorted((a, b) for _, a, b in x), np.int64).reshape(-1, 2)
        ends = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
        # The plain spans that begin before a mark's end; the last end among them says whether they overlap.
        at = lambda b: int(np.searchsorted(taken[:, 0], b))
        out.append((x, [m for m in y if not (k := at(m[2])) or ends[k - 1] <= m[1]]))
    return out


_STARTS = ("b", "br", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "st", "t", "tr", "v", "w", "z", "sch", "th", "ch", "")
_MIDDLES = ("a", "e", "i", "o", "u", "ai", "ou", "é", "ä", "ö", "ó", "ie", "y")
_FINALS = ("", "n", "r", "s", "l", "t", "nd", "ng", "st", "m", "ñ", "ß")
_TOPS = ("com", "org", "net", "de", "fr", "es", "io", "example")


class Maker:
    """Made-up texts with personal data in many forms and with other numbers, and where that data stands."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def one(self, *x: object) -> object:
        return x[int(self.r.integers(0, len(x)))]

    def digits(self, n: int, first: int = 0) -> str:
        return "".join(str(int(x)) for x in np.append(self.r.integers(first, 10, 1), self.r.integers(0, 10, n - 1)))

    def word(self) -> str:
        w = "".join(str(self.one(*_STARTS)) + str(self.one(*_MIDDLES)) + str(self.one(*_FINALS)) for _ in range(int(self.r.integers(1, 4))))
        return w.capitalize() if self.r.random() < 0.15 else w

    def plain_word(self) -> str:
        return re.sub("[^a-z]", "", self.word().lower()) or "ana"

    def email(self) -> str:
        name = self.plain_word() + str(self.one("", "", ".", "_", "-", "+"))
        name = name + (self.plain_word() if name[-1] in "._-+" else "") + str(self.one("", self.digits(2), "." + self.digits(2)))
        host = [self.plain_word() + str(self.one("", self.digits(1))), *([self.plain_word()] if self.r.random() < 0.4 else []), str(self.one(*_TOPS))]
        sign, stop = (("@", "."), ("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), (" @ ", "."))[int(self.r.integers(0, 8))]
        if self.r.random() < 0.15:
            name = str(self.one("ö", "é", "ñ", "ß")) + name
        out = name + sign + stop.join(host)
        return out.upper() if self.r.random() < 0.15 else out

    def ip(self) -> str:
        return str(self.one(".", ".", ".", "[.]", " . ", "(.)")).join(str(int(x)) for x in self.r.integers(0, 256, 4))

    def card(self) -> str:
        n = int(self.one(13, 15, 16, 16, 16, 19))
        head = self.digits(n - 1, 3)
        number = next(head + str(k) for k in range(10) if luhn(head + str(k)))
        sign = str(self.one("", "", " ", "-", ".", "/", "_"))
        return sign.join(number[i : i + 4] for i in range(0, n, 4))

    def phone(self) -> str:
        a, b, c, land = self.digits(3), self.digits(3), self.digits(4), self.digits(2, 1)
        return str(self.one(f"+1 ({a}) {b}-{c}", f"+{land} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{land} {a} {b} {c}", f"0{a}/{b}{c}", f"+{land}-{a}-{b}-{c}", f"{a} {b} {c}"))

    def other(self) -> str:
        d = self.digits
        text = str(self.one(
            d(int(self.r.integers(1, 12)), 1), f"{d(2)}.{d(2)}", f"{d(1, 1)}.{d(1)}.{d(1)}", f"20{d(2)}-0{d(1, 1)}-1{d(1)}", f"{d(2)}:{d(2)}:{d(2)}", f"${d(3, 1)},{d(3)}.{d(2)}", f"{d(2, 1)} %", f"@{self.plain_word()}",
            f"https://{self.plain_word()}.com/{self.plain_word()}?id={d(5)}", "".join(str(self.one(*"0123456789abcdef")) for _ in range(int(self.r.integers(8, 40)))), f"{self.word()} at {self.word()}", f"{d(4)} - {d(4)}", f"[{d(2)}]", f"{d(2)}, {d(3)}, {d(2)}",
            f"v{d(1)}.{d(2)}.{d(1)}", f"{self.word()} @ {d(2)}", f"{d(3)} {self.word()} {d(4)}", f"({d(2)})", f"{self.word()} dot {self.word()}", f"{d(2, 3)}.{d(3)}.{d(3)}.{d(3)}.{d(2)}",
        ))
        return text.upper() if self.r.random() < 0.1 else text

    def text(self) -> tuple[str, list[tuple[str, int, int]]]:
        out, marks, upper = "", [], self.r.random() < 0.1
        for _ in range(int(self.r.integers(8, 26))):
            x = self.r.random()
            if x < 0.13:
                kind = KINDS[int(self.r.integers(0, len(KINDS)))]
                before = str(self.one("", "", "", "(", "<", ": ", "tel: ", '"'))
                value = getattr(self, kind)()
                marks.append((kind, len(out) + len(before), len(out) + len(before) + len(value)))
                out += before + value + {"(": ")", "<": ">", '"': '"'}.get(before, "")
            else:
                w = self.other() if x < 0.3 else self.word()
                out += w.upper() if upper else w
            out += str(self.one(" ", " ", " ", " ", " ", ", ", ". ", "\n", "!! ", "; "))
        return out, marks


def made(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n labelled texts: (text, [(kind, start, end)])."""
    maker = Maker(seed)
    return [maker.text() for _ in range(n)]


@functools.cache
def fitted(texts: int = MADE, steps: int = STEPS) -> Tagger:
    """The tagger, fitted on the driver to `texts` made-up texts: no row of any table is read, and the result is the same each time."""
    return Tagger().fit(made(texts, 1), steps)


def personal(docs: DataFrame, model: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROWS, one for each row of docs: how many plain spans of each kind, the digest of them, all spans, and how many the tagger added.

    Plain spans are the leftmost matches of each kind's pattern that pass its test (parts of an address up to 255, Luhn's sum,
    numbers of digits). The tagger reads overlapping windows around every place with a digit, an at sign or its
    spelt forms, without which no span is one; each window is decoded by its own chain, the chances of all windows over a
    place are weighed together, and one best sequence is found for the whole stretch. What it marks is added if it passes the
    test of its kind and overlaps no plain span. Offsets are code points, ends exclusive; spans are ordered by kind and
    start. Null texts are empty; without spans the string is empty and the digest that of the empty string. Texts are read
    whole, in time linear in their length; rows are judged one by one, so repeated rows get equal results and null ids stay
    null. Other columns aren't read, and no rows give no rows.
    """
    model = model or fitted()
    order = {k: i for i, k in enumerate(KINDS)}
    joined = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(x, key=lambda s: (order[s[0]], s[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):
            rows = []
            for doc, (plain, more) in zip(batch.column(0).to_pylist(), found(model, batch.column(1).to_pylist()), strict=True):
                counts = [sum(x[0] == k for x in plain) for k in KINDS]
                rows.append((doc, *counts, hashlib.sha256(joined(plain).encode()).hexdigest(), joined(plain + more), len(more)))
            names = [x.split() for x in ROWS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(zip(*rows, strict=True), names, strict=True)], [name for name, _ in names])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(run, ROWS)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(table(spark, sf_dir, "documents"))
