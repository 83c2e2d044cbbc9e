"""Personal data with offsets, also where it is disguised.

Base patterns find emails, IP addresses, card and phone numbers as they stand. Then a chain of transducers normalises a
text, each on the output of the one before: look-alike and invisible characters, letters that stand for digits, spelled
digits, and ``at`` and ``dot`` disguises. Every one keeps the stretch of its input that each piece of its output comes
from; the same patterns run on the last output, and their spans are mapped back through the chain.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Every match of the three patterns below lies within one such stretch.
STRETCH = re.compile(r"[+0-9][+0-9\x20().-]{6,}")
#: The contract's pattern, made linear: where a run of digits fails, so does each of its later digits.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: list[str]) -> bool:
    plain, doubled = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, plain)) + sum(int(d) * 2 - 9 * (d > "4") for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    at, done = text.find("@"), 0
    while at >= 0:
        if (m := DOMAIN.match(text, at + 1)) and at > done and text[at - 1] in LOCAL:
            start = at - 1
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def numbers(text: str) -> Iterator[Span]:
    for s in STRETCH.finditer(text):
        a, b = s.span()
        for m in IP.finditer(text, a, b):
            if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
                yield "ip", *m.span()
        for m in CARD.finditer(text, a, b):
            if 13 <= len(d := DIGITS.findall(m[0])) <= 19 and luhn(d):
                yield "card", *m.span()
        for m in PHONE.finditer(text, a, b):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                yield "phone", *m.span()


def base_spans(text: str) -> list[Span]:
    """All base spans by kind, then start; offsets in code points, end exclusive."""
    return sorted([*emails(text), *numbers(text)], key=lambda x: (KINDS.index(x[0]), x[1]))


#: Letters of other scripts that look like Latin ones, and what they look like.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSaovpABEZHIKMNOPTYX", strict=True))
INVISIBLE = "​‌‍⁠﻿­"
WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SIGNS = {"plus": "+", "dash": "-", "hyphen": "-"}
STRANGE = re.compile(f"[{''.join(LOOKALIKES)}{INVISIBLE}！-～٠-٩۰-۹०-९⁰-₉①-⑨\U0001d7ce-\U0001d7ff]")
OPEN, CLOSE = r"[(\[{<]", r"[)\]}>]"
BOXED = re.compile(rf"\s?{OPEN}\s?(at|dot|@|\.|punto|point|arroba)\s?{CLOSE}\s?", re.I)
#: What stands on both sides of a spoken sign.
INNER = rf"[\w{INVISIBLE}]"
SPOKEN_DOT = re.compile(rf"(?<={INNER})\s{{1,3}}(?:dot|punto|point)\s{{1,3}}(?={INNER})", re.I)
SPOKEN_AT = re.compile(rf"(?<={INNER})\s{{1,3}}(?:at|arroba)\s{{1,3}}(?={INNER})", re.I)
#: After a spoken at: a domain with a disguised dot, or a plain one.
LABEL = rf"[\w{INVISIBLE}-]+"
DISGUISED = re.compile(rf"{LABEL}(?:\.{LABEL})*(?:\s?{OPEN}\s?(?:dot|\.|punto|point)\s?{CLOSE}\s?|\s{{1,3}}(?:dot|punto|point)\s{{1,3}}){INNER}", re.I)
PLAIN = re.compile(rf"{LABEL}(?:\.{LABEL})+")
#: A local part that is no word of prose: it has a digit or a sign within, or a disguised dot before its last part.
NAMED = re.compile(rf"(?:[\w.%+-]*[0-9_.%+-][\w.%+-]*|(?:{CLOSE}\s?|\s(?:dot|punto|point)\s{{1,3}})\w+)\Z", re.I)
TIMES = {"double": 2, "triple": 3}
DIGIT = "|".join(WORDS)
TWICE = rf"(?:{'|'.join(TIMES)})\s{{1,3}}"
UNIT, GAP = rf"(?:{TWICE}(?:{DIGIT}|[0-9](?![0-9]))|{DIGIT}|{'|'.join(SIGNS)}|[0-9]+)", r"[\s,-]{1,3}"
#: A spelled digit with the digits, spelled or not, before and after it.
SPELLED = re.compile(rf"(?<!\w){UNIT}(?!\w)(?:{GAP}{UNIT}(?!\w))*+", re.I)
NUMBER_WORD = re.compile(rf"(?<!\w)(?:{DIGIT}|{'|'.join(TIMES)})(?!\w)", re.I)
TOKEN = re.compile(rf"(?:({'|'.join(TIMES)})\s+(?=(?:{DIGIT}|[0-9])(?!\w)))?([A-Za-z]+|[0-9]+)", re.I)
#: Letters and signs written for digits, within a word of such and digits only.
FOR_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1"}
LETTERED = re.compile(r"(?<![A-Za-z0-9|])(?=[OolI|]*[0-9])[0-9OolI|]*[OolI|][0-9OolI|]*(?![A-Za-z0-9|])")
JOINED = re.compile(r"[A-Za-z0-9.+-]_at_[A-Za-z0-9-]+(?:_dot_[A-Za-z0-9-]+)+", re.I)
JOINED_LOCAL = re.compile(r"(?:_dot_[A-Za-z0-9.+-]+)+\Z", re.I)
JOINT = re.compile(r"_(at|dot)_", re.I)


@cache
def plain(c: str) -> str:
    """The ASCII character that ``c`` stands for; itself if there is none."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    simple = unicodedata.normalize("NFKC", c)
    return simple if simple.isascii() and len(simple) == 1 else c


Change = tuple[int, int, str]


def characters(text: str) -> list[Change]:
    """Look-alikes, other scripts' digits and full-width forms become ASCII; invisible characters go."""
    return [] if text.isascii() else [(m.start(), m.end(), plain(m[0])) for m in STRANGE.finditer(text)]


def lettered(text: str) -> list[Change]:
    """Letters that stand for digits, one by one."""
    return [(i, i + 1, FOR_DIGITS[text[i]]) for m in LETTERED.finditer(text) for i in range(*m.span()) if text[i] in FOR_DIGITS]


def spelled(text: str) -> list[Change]:
    """Spelled digits and signs, with what separates them from the digits beside them."""
    found: list[Change] = []
    low = text.lower()
    if not any(w in low for w in WORDS) or not NUMBER_WORD.search(text):
        return found
    for m in SPELLED.finditer(text):
        end, worded = m.start(), False
        for t in TOKEN.finditer(text, *m.span()):
            word = t[2].lower()
            instead = WORDS.get(word, SIGNS.get(word))
            if t[1]:
                instead = (instead or word) * TIMES[t[1].lower()]
            # what separates two tokens goes, if one of them is a word
            if end > m.start() and end < t.start() and (worded or instead):
                found.append((end, t.end() if instead else t.start(), instead or ""))
            elif instead:
                found.append((t.start(), t.end(), instead))
            end, worded = t.end(), bool(instead)
    return found


def signs(text: str) -> list[Change]:
    """``at`` and ``dot`` in brackets, spoken or between underscores; in order and without overlaps."""
    found: list[Change] = []
    low = text.lower()
    if "(" in text or "[" in text or "{" in text or "<" in text:
        found += [(*m.span(), "@" if m[1].lower() in ("at", "@", "arroba") else ".") for m in BOXED.finditer(text)]
    if "dot" in low or "punto" in low or "point" in low:
        found += [(*m.span(), ".") for m in SPOKEN_DOT.finditer(text)]
    for m in SPOKEN_AT.finditer(text) if "at" in low or "arroba" in low else ():
        if DISGUISED.match(text, m.end()) or PLAIN.match(text, m.end()) and NAMED.search(text, max(0, m.start() - 80), m.start()):
            found.append((*m.span(), "@"))
    for m in JOINED.finditer(text) if "_at_" in low and "_dot_" in low else ():
        before = JOINED_LOCAL.search(text, max(0, m.start() - 80), m.start() + 1)
        found += [(*j.span(), "@" if j[1].lower() == "at" else ".") for j in JOINT.finditer(text, before.start() if before else m.start(), m.end())]
    out: list[Change] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


CHAIN = (characters, lettered, spelled, signs)


class Rewritten:
    """A rewritten text that knows where each of its characters comes from."""

    def __init__(self, text: str, changes: list[tuple[int, int, str]]) -> None:
        self.at, self.source, parts, done, size = [0], [(0, 0, True)], [], 0, 0
        for start, end, instead in [*changes, (len(text), len(text), "")]:
            for piece, a, b, same in ((text[done:start], done, start, True), (instead, start, end, False)):
                if piece:
                    self.at.append(size)
                    self.source.append((a, b, same))
                    parts.append(piece)
                    size += len(piece)
            done = end
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the rewritten text: a replaced piece counts whole."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (a, _, same), (c, d, whole) = self.source[i], self.source[j]
        return a + (start - self.at[i]) * same, c + end - self.at[j] if whole else d


def normalised(text: str) -> list[Rewritten]:
    """The outputs of the transducers that change something, in order."""
    out: list[Rewritten] = []
    for transducer in CHAIN:
        if changes := transducer(text):
            out.append(Rewritten(text, changes))
            text = out[-1].text
    return out


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the normalised text shows; those that lie within a base span of their kind are left out."""
    chain, out = normalised(text), []
    for kind, a, b in base_spans(chain[-1].text) if chain else ():
        for step in reversed(chain):
            a, b = step.back(a, b)
        if not any(k == kind and x <= a and b <= y for k, x, y in base):
            out.append((kind, a, b))
    return out


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised, n_spans) for each row of ``docs``.

    The counts are those of the base spans. spans: all spans, ``kind:start:end`` by kind, then start, comma-joined; n_spans: how many.
    Null or empty text: no spans. Texts of any length are searched whole, in time that grows with the length. Repeated
    rows each get their row. Other columns, whatever their names, are ignored. No rows: none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base = base_spans(text or "")
                more = disguised_spans(text or "", base)
                kinds = [k for k, _, _ in base]
                every = sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if more else base
                rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), len(more), len(every)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised", "n_spans"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    schema = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long, n_spans long"
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data in its text replaced by its kind in angle brackets."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                if text:
                    base, done, parts = base_spans(text), 0, []
                    for k, s, e in sorted([*base, *disguised_spans(text, base)], key=lambda x: (x[1], -x[2])):
                        if s >= done:
                            parts += [text[done:s], f"<{k}>"]
                        done = max(done, e)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            yield pd.Series(out, dtype=object)

    return docs.withColumn("text", F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)("text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
