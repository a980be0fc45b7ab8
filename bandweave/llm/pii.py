"""Personal data, disguised or not: offset-preserving transducers, detectors, and spans in the source's characters.

A transducer rewrites a text and keeps, for each character it writes, the span of source characters that it stands for.
Three run one after another: characters that look like others (or show nothing) become plain ones; at and dot in words
or brackets become @ and a full stop; spelled digits become digits. The detectors read the source and the rewritten
text; what they find in the latter is mapped back. Spans in the source itself (base) stay as they are; a disguised one
is added unless a base span of its kind holds it.

Disguised addresses have a bracketed at, or a spelled one with a spelled dot and a known top-level domain, or an @ among
blanks with such a domain. A spelled at before a plain full stop ("look at example.com") isn't taken: it is prose more often.
Neither blanks nor names nor rows of digits are bounded in length.

Null and empty texts have no spans. Rows, repeated or not, are worked on one by one; further columns stay as they are,
and an input column named like the output is replaced. Texts are read whole, in linear time.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from bandweave.llm.common import arrow_pass

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins with the first digit of a row and takes rows whole, so that rows of any length are read a few times at most.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def plain(text: str) -> list[tuple[str, int, int]]:
    """Undisguised spans (kind, start, end): leftmost, not overlapping within a kind; failing matches are passed over."""
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL_CHARS:
            first -= 1
        if first < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", first, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not DIGIT.search(text):
        return out
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


class Mapped:
    """A rewritten text with the source span of each character."""

    def __init__(self, text: str, first: np.ndarray | None = None, last: np.ndarray | None = None) -> None:
        self.text = text
        self.first = np.arange(len(text)) if first is None else first
        self.last = np.arange(1, len(text) + 1) if last is None else last

    def replaced(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Each (start, end, new) written in place of that part; edits ascend and don't overlap."""
        if not edits:
            return self
        texts, firsts, lasts, at = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            firsts += [self.first[at:a], np.full(len(new), self.first[a])]
            lasts += [self.last[at:a], np.full(len(new), self.last[b - 1])]
            at = b
        return Mapped("".join([*texts, self.text[at:]]), np.concatenate([*firsts, self.first[at:]]), np.concatenate([*lasts, self.last[at:]]))

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start]), int(self.last[end - 1])


# Letters of other scripts that look like Latin ones, in pairs of letter and likeness.
LOOKALIKES = dict(zip("АВЕЗІЈКМНОРСТУХЅаеіјорсухѕһԁԛԝвкмнтɡαινορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABE3IJKMHOPCTYXSaeijopcyxshdqwBKMHTgaivopuxABEZHIKMNOPTYX", strict=True))
# Signs that stand for others.
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "․": ".", "·": "."}
# Characters that show nothing.
HIDDEN = "\xad​‌‍‎‏⁠﻿"
ODD = re.compile("[\xa0\xad\xb7Ā-\U0010ffff]")


def likeness(c: str) -> str | None:
    """What a character outside Latin-1 stands for, or None for itself."""
    if c in HIDDEN:
        return ""
    if (x := LOOKALIKES.get(c) or SIGNS.get(c)) is not None:
        return x
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    x = unicodedata.normalize("NFKC", c)
    return x if x != c and x.isascii() else None


def homoglyphs(m: Mapped) -> Mapped:
    known = {c: likeness(c) for c in set(ODD.findall(m.text))}
    return m.replaced([(x.start(), x.end(), known[x.group()]) for x in ODD.finditer(m.text) if known[x.group()] is not None]) if any(v is not None for v in known.values()) else m


# Words for at and dot in English, Spanish, German and French, and common top-level domains.
AT_WORDS, DOT_WORDS = "at|arroba|arobase", "dot|punto|punkt|point"
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co me dev app eu de fr es uk us ca au ch at it nl be se no dk fi pl pt ru br in jp cn".split())
# Blanks in front belong to a match from their first one on, so that a row of blanks is read once.
DOT = re.compile(rf"(?<!\s)(?:\s*+[\[({{<]\s*+(?:{DOT_WORDS}|\.)\s*+[\])}}>]\s*+|\s++(?:{DOT_WORDS})\s++)|\.", re.I)
AT = re.compile(rf"(?<!\s)(?:\s*+[\[({{<]\s*+(?P<bracketed>{AT_WORDS}|@)\s*+[\])}}>]\s*+|\s++(?P<spelled>{AT_WORDS})\s++|\s*+@\s*+)", re.I)
HINT = re.compile(rf"[\[({{<]\s*+(?:{AT_WORDS}|@|{DOT_WORDS}|\.)\s*+[\])}}>]|\s(?:{DOT_WORDS})\s|\s@|@\s", re.I)
NAME_CHARS = LOCAL_CHARS - {"."}
LABEL = re.compile(r"[A-Za-z0-9-]++")


def at_and_dot(m: Mapped) -> Mapped:
    """Mail addresses with bracketed or spelled at and dot. In words alone, a known top-level domain must follow.

    From each at the names before it and the labels behind it are followed from dot to dot; what two ats pass over doesn't
    overlap, so that a text is read a few times at most.
    """
    if not HINT.search(m.text):
        return m
    edits: list[tuple[int, int, str]] = []
    text, done = m.text, 0
    dots = [x.span() for x in DOT.finditer(text)]
    ends, starts = {b: a for a, b in dots}, dict(dots)
    for x in AT.finditer(text):
        at, behind = x.span()
        labels: list[tuple[int, int]] = []  # from, to
        here = behind
        while (label := LABEL.match(text, here)) is not None:
            labels.append(label.span())
            if (here := starts.get(label.end(), -1)) < 0:
                break
        if len(labels) < 2 or at < done:
            continue
        if not x["bracketed"]:
            spelled = any(text[b] != "." or c - b > 1 for (_, b), (c, _) in zip(labels, labels[1:]))
            while labels and text[slice(*labels[-1])].lower() not in TOP_LEVEL:
                labels.pop()
            if len(labels) < 2 or x["spelled"] and not spelled:
                continue
        first, joints = at, []
        while first > done and text[first - 1] in NAME_CHARS:
            while first > done and text[first - 1] in NAME_CHARS:
                first -= 1
            dot = ends.get(first, -1)
            if dot <= done or text[dot - 1] not in NAME_CHARS:
                break
            joints.append((dot, first))
            first = dot
        if first == at:
            continue
        joints += [(b, c) for (_, b), (c, _) in zip(labels, labels[1:])]
        edits += [(*joint, ".") for joint in joints if text[slice(*joint)] != "."]
        if text[at:behind] != "@":
            edits.append((at, behind, "@"))
        done = labels[-1][1]
    return m.replaced(sorted(set(edits)))


# The digits' names in four languages.
DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
SPELLED = {lang: {name: str(k) for k, name in enumerate(names.split())} for lang, names in DIGIT_NAMES.items()}
#: Two digit names in a row: what a text must have to be read for spelled digits.
ROW = {lang: re.compile(rf"\b(?:{'|'.join(names)})[\s,.-]++(?:{'|'.join(names)})\b", re.I) for lang, names in SPELLED.items()}
ANY_ROW = re.compile("|".join(f"(?:{p.pattern})" for p in ROW.values()), re.I)
RUN = {lang: re.compile(rf"(?<!\w)(?:(?:plus|\+)[\s-]*+)?(?:{'|'.join(names)}|[0-9]+)(?:[\s,-]++(?:{'|'.join(names)}|[0-9]+|(?:{DOT_WORDS})(?=[\s,-]))|\.(?=[0-9]))*(?!\w)", re.I) for lang, names in SPELLED.items()}
ATOM = re.compile(rf"plus|\+|{DOT_WORDS}|[0-9]|[^\W\d_]+|\.", re.I)
#: Fewer digits than this in a row stay as they are written.
LEAST_DIGITS = 4


def spelled_digits(m: Mapped) -> Mapped:
    """Rows of digit names, digits and dots: one digit each, without what stands between; plus in front becomes +."""
    for lang, names in SPELLED.items():
        if not ROW[lang].search(m.text):
            continue
        edits: list[tuple[int, int, str]] = []
        for run in RUN[lang].finditer(m.text):
            if not ROW[lang].search(run.group()):
                continue
            atoms = [(a.start() + run.start(), a.end() + run.start(), a.group().lower()) for a in ATOM.finditer(run.group())]
            new = [names.get(a, "+" if a in ("plus", "+") else "." if not a.isdigit() else a) for _, _, a in atoms]
            if sum(c.isdigit() for c in new) < LEAST_DIGITS:
                continue
            end = run.start()
            for (a, b, _), c in zip(atoms, new):
                if a > end:
                    edits.append((end, a, ""))
                edits.append((a, b, c))
                end = b
        m = m.replaced([e for e in edits if e[0] < e[1]])
    return m


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base) of a text, by start, kind as listed, and end."""
    if not text:
        return []
    base = plain(text)
    found = {(k, a, b): True for k, a, b in base}
    begins = {kind: [a for k, a, _ in base if k == kind] for kind in KINDS}
    ends = {kind: [b for k, _, b in base if k == kind] for kind in KINDS}
    m = Mapped(text) if ODD.search(text) or HINT.search(text) or ANY_ROW.search(text) else None
    if m is not None:
        m = spelled_digits(at_and_dot(homoglyphs(m)))
        for kind, a, b in plain(m.text) if m.text != text else ():
            a, b = m.source(a, b)
            at = bisect_right(begins[kind], a) - 1  # base spans of a kind don't overlap
            if at < 0 or ends[kind][at] < b:
                found[(kind, a, b)] = False
    return [(*key, kept) for key, kept in sorted(found.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))]


def redacted(text: str | None) -> str | None:
    """The text with each span (overlapping ones as one) replaced by the kind of its first, in brackets."""
    if not text or not (found := spans(text)):
        return text
    out, at, k = [], 0, 0
    while k < len(found):
        kind, a, b, _ = found[k]
        while k < len(found) and found[k][1] < b:
            b = max(b, found[k][2])
            k += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find(df: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """df with its texts' spans in a new column: array<struct<kind, start, end, base>>, in code points, end exclusive."""
    df = df.drop(to)
    kind = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    schema = df.selectExpr("*", f"cast(null as {kind}) as `{to}`").schema

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            yield p | {to: [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans(x)] for x in p[text]]}

    return arrow_pass(df, work, schema)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its texts redacted; null and empty texts stay."""

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            yield p | {text: [*map(redacted, p[text])]}

    return arrow_pass(df, work, df.schema)
