"""Personal data in texts, disguised or not, at its place in the text as given."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# An address is found from its @: characters of a local part hold no @, so each run of them has one address at most.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match ends with a whole run of digits, so the next can only begin where a run begins: no run is read twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield "email", start, (end := m.end())


def find_plain(text: str) -> list[Span]:
    """Spans (kind, start, end) of undisguised data in code points, end exclusive, by start and then by kind. Time is
    in proportion to the length of the text, whatever it holds."""
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- what the transducers read -------------------------------------------------------------------------------------

#: Look-alike letters and digits (fixed values: letters of other scripts that are drawn like Latin ones).
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "﹫": "@",
}
#: Digits of any script are digits, full-width forms the printable ASCII characters, wide and narrow spaces spaces.
_FOLD = str.maketrans(LOOK_ALIKE | {chr(c): str(unicodedata.decimal(chr(c))) for c in range(128, 0x20000) if chr(c).isdecimal()}
                      | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)} | {c: " " for c in "\u00a0\u2009\u202f\u3000"})
#: Characters that are not drawn (fixed values).
_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digits as words in the languages of the corpus (fixed values).
SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_WORD_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
_PLUS = "plus|más|mas"
_DOT = "dot|point|punkt|punto"
_AT = "at|arroba|arobase|klammeraffe"
_SEP = r"[ \-,]{1,3}"
_ONE = rf"(?:(?:{_WORD_DIGIT})(?![^\W_])|[0-9]+)"
_SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:(?:{_PLUS}){_SEP}|\+ ?)?{_ONE}(?:{_SEP}(?:(?:{_DOT}){_SEP})?{_ONE}){{3,}}", re.IGNORECASE)
_IN_RUN = re.compile(rf"(?P<plus>{_PLUS})|(?P<dot>{_DOT})|(?P<word>{_WORD_DIGIT})|(?P<digits>[0-9]+)|\+", re.IGNORECASE)
# at and dot in brackets anywhere; as bare words only in the form: name at host dot com, with no other dots in reach
_BRACKET_AT = rf" ?(?:[\[({{<] ?(?:{_AT}|@) ?[\])}}>]) ?"
_BRACKET_DOT = rf" ?(?:[\[({{<] ?(?:{_DOT}|\.) ?[\])}}>]) ?"
_AROUND_AT = re.compile(rf"{_BRACKET_AT}| (?:{_AT}) | @ ?|@ ", re.IGNORECASE)
_A_DOT = re.compile(rf"{_BRACKET_DOT}| (?:{_DOT}) ", re.IGNORECASE)
#: How far from its at a disguised address may begin or end; longer names aren't valid (fixed value: 254, here with room for disguises).
_REACH = 512
_MARKS = re.compile(rf"[\[({{<] ?(?:{_AT}|{_DOT}|@|\.) ?[\])}}>]| @|@ ", re.IGNORECASE)
_FOREIGN = re.compile("[^\x00-\x7f\u00c0-\u017f]")
_BARE_DOTS = tuple(f" {d} " for d in _DOT.split("|"))
_BARE_ATS = tuple(re.compile(rf" {a} [a-z0-9-]+\.[a-z]") for a in _AT.split("|"))



class Rewritten:
    """A text and, for each piece of it, where it came from."""

    def __init__(self):
        self.out: list[str] = []
        self.length = 0
        self.at: list[int] = []  # starts of pieces in the rewritten text
        self.source: list[tuple[int, int, bool]] = []  # their source spans; whether characters match one to one

    def add(self, new: str, start: int, end: int, same: bool = False) -> None:
        if new:
            self.at.append(self.length)
            self.source.append((start, end, same))
            self.out.append(new)
            self.length += len(new)

    @property
    def text(self) -> str:
        return "".join(self.out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span behind a span of the rewritten text: of a piece that stands for other characters, all of them."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a, _, same = self.source[i]
        first = a + start - self.at[i] if same else a
        b, to, same = self.source[j]
        return first, b + end - self.at[j] if same else to


def _substitute(text: str, edits: list[tuple[int, int, str]]) -> Rewritten:
    r, at = Rewritten(), 0
    for start, end, new in edits:
        if start >= at:
            r.add(text[at:start], at, start, True)
            r.add(new, start, end)
            at = end
    r.add(text[at:], at, len(text), True)
    return r


def _unhide(text: str) -> Rewritten:
    """Look-alikes become ASCII, one character for one; characters that aren't drawn go."""
    folded = text.translate(_FOLD)
    return _substitute(folded, [(m.start(), m.end(), "") for m in re.finditer(f"[{_HIDDEN}]+", folded)])


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Runs of four or more digits of which two or more are words become digits; ``dot`` and ``plus`` among them signs."""
    out: list[tuple[int, int, str]] = []
    for m in _SPELLED_RUN.finditer(text):
        signs = list(_IN_RUN.finditer(m[0]))
        if sum(bool(t["word"]) for t in signs) > 1:
            for k, t in enumerate(signs):
                new = "+" if t["plus"] or t[0] == "+" else "." if t["dot"] else str(SPELLED[t["word"].lower()]) if t["word"] else t[0]
                # what lies between two signs of a run goes
                out.append((m.start() + t.start(), m.start() + (signs[k + 1].start() if k + 1 < len(signs) else t.end()), new))
    return out


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn disguised at and dot signs into the signs, where both parts of an address stand around them."""
    edits, done = [], 0
    for at in _AROUND_AT.finditer(text):
        lo, hi = max(done, at.start() - _REACH), min(len(text), at.end() + _REACH)
        bare = not re.search(r"[\[({<@]", at[0])
        right = _HOST.match(text, at.end(), hi)
        if not right or bare and not _A_DOT.search(right[0]) and not _TOP.search(right[0]) or not (left := _LOCAL_BEFORE.search(text, lo, at.start())):
            continue
        if bare and not _A_DOT.search(right[0]) and not _NAME.search(left[0]):
            continue
        host = right[0]
        edits += [(left.start() + d.start(), left.start() + d.end(), ".") for d in _A_DOT.finditer(left[0])]
        edits.append((at.start(), at.end(), "@"))
        edits += [(at.end() + d.start(), at.end() + d.end(), ".") for d in _A_DOT.finditer(host)]
        done = at.end() + len(host)
    return edits


_HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:{_BRACKET_DOT}|\.| (?:{_DOT}) )[A-Za-z0-9-]+)+", re.IGNORECASE)
# name at host.com, with a plain dot, is an address if the name is no ordinary word: letters with a digit, dot or the like
_NAME = re.compile(r"(?=.*[A-Za-z]).*(?:[0-9._+%]|[A-Za-z0-9]-)")
_TOP = re.compile(r"\.[A-Za-z]{2,}\Z")
_LOCAL_BEFORE = re.compile(rf"[A-Za-z0-9%+_-]+(?:(?:{_BRACKET_DOT}|\.| (?:{_DOT}) )[A-Za-z0-9%+_-]+){{0,3}}\Z", re.IGNORECASE)


def _disguised(text: str) -> bool:
    """Whether any step of the rewriting could change the text; true for any text with a disguise."""
    if _MARKS.search(text) or not text.isascii() and _FOREIGN.search(text):
        return True
    low = text.lower()
    if any(d in low for d in _BARE_DOTS) or any(p.search(low) for p in _BARE_ATS):
        return True
    return sum(map(SPELLED.__contains__, low.replace(",", " ").replace("-", " ").split())) > 1


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """Undisguised spans, and those with the disguised ones added (none that overlaps an undisguised one of its kind)."""
    plain = find_plain(text)
    if not _disguised(text):
        return plain, plain
    first = _unhide(text)
    one = first.text
    second = _substitute(one, sorted(_spelled(one)))
    two = second.text
    third = _substitute(two, sorted(_addresses(two)))
    added = []
    for kind, start, end in find_plain(third.text):
        start, end = first.back(*second.back(*third.back(start, end)))
        if not any(k == kind and s < end and start < e for k, s, e in plain):
            added.append((kind, start, end))
    return plain, sorted(plain + added, key=lambda s: (s[1], KINDS.index(s[0])))


def find(text: Column) -> Column:
    """Personal data of each whole text: a struct of ``plain`` and ``spans``, arrays of (kind, start, end) in code points
    of the text, end exclusive, by start and then by kind.

    Transducers rewrite a text in three steps and keep, for each piece of the result, the characters it stands for:
    look-alike letters and hidden characters; runs of spelled digits; at and dot disguises. Data are found in the result
    as in plain text, and their spans mapped back through the three steps. Null and empty texts have none; repeated rows
    have equal spans; texts without a trace of a disguise skip the rewriting.
    """
    span = "struct<kind: string, start: int, end: int>"

    @F.pandas_udf(f"struct<plain: array<{span}>, spans: array<{span}>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = [find_all(t) if t else ([], []) for t in texts]
        named = [[[{"kind": k, "start": s, "end": e} for k, s, e in part] for part in row] for row in rows]
        return pd.DataFrame({"plain": [r[0] for r in named], "spans": [r[1] for r in named]})

    return found(text)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def private_data(df: DataFrame, text: str) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (undisguised), their ``plain`` spans and all ``spans``."""
    t = df.withColumn("_found", find(F.col(text)))
    for k in KINDS:
        t = t.withColumn(f"n_{k}", count(F.col("_found.plain"), k))
    return t.withColumn("plain", F.col("_found.plain")).withColumn("spans", F.col("_found.spans")).drop("_found")
