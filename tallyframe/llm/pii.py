"""Personal data by anchor expansion.

One Aho-Corasick automaton finds all anchors of a text: at-signs, plus signs, digits, `://` and
identifier cues (words such as `token`, `password` or `iban`, in any case). At every anchor a deterministic parser
looks at the neighbouring characters only, expands to the span's borders and validates it. Spans are
(kind, start, end) in code points, end exclusive.

Base kinds: email, ip (4 parts up to 255), card (14 to 19 digits, Luhn), phone (+, 10 to 15 digits).
Added kinds: login (user and password in a URL), secret (value after a credential cue) and account
(value after an account cue: IBAN with valid check digits, or 6 and more digits).

Defined results: NULL and empty texts hold nothing; repeated rows are each answered; spans of one start
stand in the order of the kinds; texts of any length are read whole; an empty table gives an empty result; input columns named like a result
column give way to it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "secret", "account")
Span = tuple[int, int, int]

SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "access_key", "private_key")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_LOGIN = re.compile(r"[A-Za-z0-9._~%+-]+:[^\s/@:]+@")
_VALUE = re.compile(r"""["']?[ \t]*[=:][ \t]*["']?([A-Za-z0-9_+/.=-]{8,})""")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:no\.?|number|nr\.?|#))?[ \t]*[=:#]?[ \t]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9][0-9-]{4,}[0-9])")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def _iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def lowered(text: str) -> str:
    """Lower case, so that cues of any spelling are found; every character keeps its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def finder() -> Callable[[str], list[Span]]:
    """A function from a text to its spans (start, kind index, end), sorted."""
    anchors = ahocorasick.Automaton()
    for word in ("@", "+", "://", *"0123456789"):
        anchors.add_word(word, (word, len(word)))
    for cue in (*SECRET_CUES, *ACCOUNT_CUES):
        anchors.add_word(cue, (cue, len(cue)))
    anchors.make_automaton()
    accounts = frozenset(ACCOUNT_CUES)

    def find(text: str) -> list[Span]:
        out: list[Span] = []
        email_end = number_end = digit_end = phone_end = 0
        for last, (what, size) in anchors.iter(lowered(text)):
            at = last - size + 1
            if what == "@":
                start = at
                while start > email_end and text[start - 1] in _LOCAL_SET:
                    start -= 1
                domain = _DOMAIN.match(text, at + 1) if start < at else None
                if domain:
                    email_end = domain.end()
                    out.append((start, 0, email_end))
            elif what == "+":
                m = _PHONE.match(text, at) if at >= phone_end else None
                if m:
                    run = m.group().rstrip(" ().-")
                    if len(run) >= 4:
                        phone_end = at + len(run)
                        if 10 <= sum(map(run.count, "0123456789")) <= 15:
                            out.append((at, 3, phone_end))
            elif what in "0123456789":
                if at >= number_end:
                    m = _NUMBERS.match(text, at)
                    number_end = m.end()
                    parts = m.group().split(".")
                    begin = at
                    for i in range(0, len(parts) - 3, 4):
                        four = parts[i : i + 4]
                        end = begin + sum(map(len, four)) + 3
                        if all(map(_octet, four)):
                            out.append((begin, 1, end))
                        begin = end + 1
                if at >= digit_end:
                    m = _DIGITS.match(text, at)
                    digit_end = m.end()
                    if digit_end - at >= 14:
                        digits = m.group().replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            out.append((at, 2, digit_end))
            elif what == "://":
                m = _LOGIN.match(text, at + 3)
                if m:
                    out.append((at + 3, 4, m.end() - 1))
            elif what in accounts:
                m = _ACCOUNT.match(text, last + 1)
                if m and (m.group(1)[0].isdigit() or _iban(m.group(1))):
                    out.append((m.start(1), 6, m.end(1)))
            else:
                m = _VALUE.match(text, last + 1)
                if m:
                    out.append((m.start(1), 5, m.end(1)))
        return sorted(set(out))

    return find


def spans(text: str = "text") -> Column:
    """array<struct<kind, start, end>> of every text, sorted by start, then kind as in KINDS."""

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = finder()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        names = pa.array(KINDS)
        for a in arrays:
            found, off = [], [0]
            for i in range(len(a)):
                text = a[i].as_py()
                if text:
                    found += find(text)
                off.append(len(found))
            cols = [names.take(pa.array([s[1] for s in found], pa.int32())), pa.array([s[0] for s in found], pa.int32()), pa.array([s[2] for s in found], pa.int32())]
            yield pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(kind.value_type)))

    return run(F.col(text))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span in `text` by its kind in angle brackets; overlapping spans become one, named after the first."""

    @F.arrow_udf("string")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = finder()

        def clean(text: str) -> str:
            found = find(text)
            if not found:
                return text
            parts, at, end = [], 0, 0
            for start, kind, stop in found:
                if start >= end:
                    parts += [text[max(at, end) : start], f"<{KINDS[kind]}>"]
                end = max(end, stop)
                at = end
            return "".join([*parts, text[end:]])

        for a in arrays:
            yield pa.array([clean(t) if t else t for t in (x.as_py() for x in a)], pa.string())

    return df.withColumn(text, run(F.col(text)))


def listed(found: Column) -> Column:
    """`kind:start:end` of all spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
