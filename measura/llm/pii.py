"""Personal data with offset-preserving deobfuscation.

Base spans are found in the text itself. Around signs of disguise the text is rewritten by small transducers: look-alike
letters, digits and signs of other scripts, invisible characters, digits spelled in words, letters standing for digits, and
written "at" and "dot". Each output character remembers the source characters it came from. Identifiers found in the rewritten
text that used a rewritten character are mapped back to source offsets and added.

Offsets are code points, ends exclusive. Base matches are leftmost and do not overlap within a kind; a match that fails its check
is dropped, with no retry inside it. An added span may contain a base span of its kind, the visible rest of a disguised
identifier, but never cuts one.

Defined cases: null text counts as empty, with no spans. Texts are read whole. Repeated rows get equal results. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: As many digits as there are, never fewer on a second try: a run of digits is read once, from its first one or where a match ended.
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+(?=[0-9])([\x20().0-9-]++)")

#: Words for digits.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip(
    "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρ",
    "aeopcyxijsdhqwABEKMHOPCTYXIJS" "ABEZHIKMNOPTYXovip"))
TOP_LEVEL = "com|org|net|edu|gov|info|io|de|fr|es|eu|uk|us|ch|at|it|nl|biz|dev|app|co|example|test"

_number = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ODD = "­Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९​-‍‐-―․⁠⁰-₉①-⑳。﹒﹫﻿！-～｡\U0001d400-\U0001d7ff"
ODD = re.compile(f"[{_ODD}]")
AT = r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s*(?:&\#0*64;|&\#x0*40;|&commat;|%40)\s*|[ \t]+at[ \t]+(?=[a-z0-9-]+(?:[ \t]+dot[ \t]+[a-z0-9-]+|\s*[\[({<]\s*dot\s*[\])}>]|(?:\.[a-z0-9-]+)*\.(?:" + TOP_LEVEL + r")\b))|(?<=[a-z0-9])[_-]at[_-](?=[a-z0-9])"
DOT = r"\s*[\[({<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}>]\s*|[ \t]+dot[ \t]+|(?<=[a-z0-9])[_-]dot[_-](?=[a-z0-9])"
RULES = re.compile(
    rf"(?P<at>{AT})|(?P<dot>{DOT})|(?P<plus>\bplus[ \t]+(?=[0-9]|(?:{_number})\b))"
    rf"|(?P<digit>\b(?:{_number})\b(?:[ \t,]*[ \t-]+(?=(?:{_number})\b))?)|(?P<like>(?<=[0-9])[OolI]+(?=[0-9OolI \-.]))|(?P<odd>[{_ODD}])", re.I)
BRACKETS = re.compile(r"[\[({<]\s*(?:at|dot|@|\.|punkt|point|punto)\s*[\])}>]|&\#0*64;|&\#x0*40;|&commat;|%40|[_-](?:at|dot)[_-]", re.I)
WORD_DOT = re.compile(r"[ \t](?:dot|at)[ \t]+[a-z0-9-]+(?:[ \t]+dot[ \t]|\.(?:" + TOP_LEVEL + r")\b)|[0-9][ \t]+dot[ \t]+[0-9]", re.I)
#: Number words beside a digit, a plus sign or another number word.
WORD_DIGITS = re.compile(rf"\b(?:{_number})\b(?=[ \t,().-]*(?:[0-9+]|\b(?:{_number})\b))|[0-9+][ \t,().-]*\b(?:{_number})\b|\bplus[ \t]+(?:[0-9]|(?:{_number})\b)", re.I)
LIKE = re.compile(r"[0-9][OolI][0-9OolI \-.]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping. Each match is at one @ sign, so only those are visited."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def find(text: str) -> dict[str, list[Span]]:
    out: dict[str, list[Span]] = {"email": emails(text) if "@" in text else []}
    out["ip"] = [(a, b) for a, b in _quads(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text[a:b].split("."))]
    out["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out["phone"] = [(a, b) for a, b in _plus(text) if b - a > 10 and 10 <= len(_digits(text[a:b])) <= 15] if "+" in text else []
    return out


def _quads(text: str) -> Iterator[Span]:
    """Leftmost matches of four numbers joined by dots. A number that starts no match is skipped whole: no match starts inside it, as the
    dots that follow are the same."""
    at = 0
    while m := DIGITS.search(text, at):
        if q := IP.match(text, m.start()):
            yield q.span()
            m = q
        at = m.end()


def _plus(text: str) -> Iterator[Span]:
    """Leftmost matches of a plus sign, a digit, signs and digits, and a digit at the end."""
    at = 0
    while m := PHONE.search(text, at):
        body = m[1]
        last = len(body.rstrip("\x20().-"))
        at = m.end()
        if last >= 3:  # a digit at both ends and something between
            yield m.start(), m.start(1) + last
            at = m.start(1) + last


def rewrite(text: str, start: int, stop: int) -> tuple[str, list[int], list[int], list[bool]]:
    """The rewritten part of the text; for each of its characters the source range and whether it was rewritten."""
    out: list[str] = []
    first: list[int] = []
    last: list[int] = []
    made: list[bool] = []

    def put(chars: str, a: int, b: int, new: bool) -> None:
        for c in chars:
            out.append(c), first.append(a), last.append(b), made.append(new)

    at = start
    for m in RULES.finditer(text, start, stop):
        for k in range(at, m.start()):
            put(text[k], k, k + 1, False)
        a, b = m.span()
        at = b
        kind, got = m.lastgroup, m.group()
        if kind == "at":
            put("@", a, b, True)
        elif kind == "dot":
            put(".", a, b, True)
        elif kind == "plus":
            put("+", a, b, True)
        elif kind == "digit":
            word = re.match(r"\w+", got).group()
            if digit := DIGIT_WORDS.get(word.lower()):
                put(digit, a, a + len(word), True)
            else:  # letters like the long s, which only the pattern takes for one of ours
                for k in range(a, b):
                    put(text[k], k, k + 1, False)
        elif kind == "like":
            for k in range(a, b):
                put("0" if text[k] in "Oo" else "1", k, k + 1, True)
        else:
            put(_plain(got), a, b, True)
    for k in range(at, stop):
        put(text[k], k, k + 1, False)
    return "".join(out), first, last, made


def _plain(c: str) -> str:
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in "­​‌‍⁠﻿":
        return ""
    if "‐" <= c <= "―":
        return "-"
    if c in "․。｡﹒":
        return "."
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    return unicodedata.normalize("NFKC", c)


def _signs(text: str) -> list[Span]:
    """Where disguises may be."""
    found: list[Span] = []
    if not text.isascii():
        found += [m.span() for m in ODD.finditer(text)]
    if any(c in text for c in "[({<&%_-"):
        found += [m.span() for m in BRACKETS.finditer(text)]
    low = text.lower()
    if " dot " in low or "\tdot" in low or " at " in low:
        found += [m.span() for m in WORD_DOT.finditer(text)]
    found += [m.span() for m in WORD_DIGITS.finditer(text)]
    found += [m.span() for m in LIKE.finditer(text)]
    return sorted(found)


def _spoils(span: Span, base: list[Span], starts: list[int]) -> bool:
    """Whether a span is a base span, or overlaps one without holding it whole. Base spans are sorted and apart, so only the first and the
    last of those that it meets can reach out of it."""
    first = bisect.bisect_right(starts, span[0]) - 1
    if first < 0 or base[first][1] <= span[0]:
        first += 1
    last = bisect.bisect_left(starts, span[1]) - 1
    if first > last:
        return False
    return base[first] == span or base[first][0] < span[0] or base[last][1] > span[1]


def hidden(text: str, base: dict[str, list[Span]], reach: int = 120) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    windows: list[list[int]] = []

    def to_space(b: int) -> int:
        while b < len(text) and not text[b].isspace():
            b += 1
        return b

    for a, b in _signs(text):  # no window cuts an identifier; windows never overlap, so no character is looked at twice
        a, b = max(0, a - reach), min(len(text), b + reach)
        end = windows[-1][1] if windows else 0
        if a > end or not windows:
            while a > end and not text[a - 1].isspace():
                a -= 1
        if windows and a <= end:
            if b > end:
                windows[-1][1] = to_space(b)
        else:
            windows.append([a, to_space(b)])
    starts = {k: [a for a, _ in base[k]] for k in KINDS}
    for a, b in windows:
        new, first, last, made = rewrite(text, a, b)
        for kind, spans in find(new).items():
            for s, e in spans:
                if any(made[s:e]):
                    span = (first[s], max(last[s:e]))
                    if not _spoils(span, base[kind], starts[kind]):
                        out[kind].append(span)
    return out


def written(spans: dict[str, list[Span]]) -> str:
    rows = sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in spans[kind])
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(*part) for b in batches for part in by_bytes(b.column(1), 8 << 20)):
        rows: list[list] = [[] for _ in range(7)]
        for x in batch.column(1):
            text = x.as_py() or ""
            base = find(text)
            more = hidden(text, base)
            every = {k: base[k] + more[k] for k in KINDS}
            values = [*(len(base[k]) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every), sum(map(len, more.values()))]
            for column, value in zip(rows, values):
                column.append(value)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, t) for r, t in zip(rows, types))],
                                         ["i", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id; n_email, n_ip, n_card, n_phone: base spans by kind; base_sha256; spans: all spans; n_disguised: those added."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    out = rows.mapInArrow(_detect, f"i {rows.schema['i'].dataType.simpleString()}, {kinds}, base_sha256 string, spans string, n_disguised long")
    return out.withColumnRenamed("i", id_col)
