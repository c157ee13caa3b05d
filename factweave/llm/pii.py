"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Found values are validated (check digits, calendar, octets), written as a number
below the size of their format, and permuted there by a Feistel network keyed
with the secret and the format; numbers beyond the size are permuted again until
they fit.  So a card number becomes a card number with a right check digit, a
date a date, and equal values become equal pseudonyms in every document.

Kinds: cards (13-19 digits, Luhn), IBANs (mod 97), US social security numbers,
phone numbers with a country code or of the form (ddd) ddd-dddd, IPv4 addresses,
e-mail addresses (the part before @), dates (1900-2099: ISO, and d/m/y or m/d/y
with four-digit years), and secrets (hexadecimal strings of 32, 40 or 64 digits,
access keys that begin with AKIA).
What looks similar but isn't valid stays as it is; where a match isn't, shorter
ones at its start and other kinds are tried, then what begins a character later.

Null texts stay null, empty ones empty.  Every other column is kept, whatever its
name; rows are independent, so repeated ones get equal pseudonyms.  A text is in
memory as a whole; the time is in proportion to its length.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factweave.llm import exchange as X

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "email", "date", "secret")

_LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿœ"
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _LATIN]
_CLASS = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
_EPOCH, _DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def feistel(number: int, size: int, key: bytes) -> int:
    """A keyed permutation of the numbers below size."""
    if size < 2:
        return number
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = number >> half, number & mask
        for i in range(ROUNDS):
            message = bytes((i,)) + right.to_bytes((half + 7) // 8, "big")
            left, right = right, left ^ (int.from_bytes(hmac.digest(key, message, hashlib.sha256), "big") & mask)
        number = (left << half) | right
        if number < size:
            return number


def unfeistel(number: int, size: int, key: bytes) -> int:
    """The inverse."""
    if size < 2:
        return number
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = number >> half, number & mask
        for i in reversed(range(ROUNDS)):
            message = bytes((i,)) + left.to_bytes((half + 7) // 8, "big")
            left, right = right ^ (int.from_bytes(hmac.digest(key, message, hashlib.sha256), "big") & mask), left
        number = (left << half) | right
        if number < size:
            return number


def _spelled(text: str, key: bytes, permute) -> str:
    """Each letter or digit for one of its own alphabet; all else stays."""
    number, size = 0, 1
    for c in text:
        if c in _CLASS:
            alphabet, i = _CLASS[c]
            number, size = number * len(alphabet) + i, size * len(alphabet)
    number = permute(number, size, key + size.to_bytes((size.bit_length() + 7) // 8, "big"))
    out = []
    for c in reversed(text):
        if c in _CLASS:
            number, i = divmod(number, len(_CLASS[c][0]))
            c = _CLASS[c][0][i]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _fill(text: str, digits: str) -> str:
    """text with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _card(text: str, key: bytes, permute) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), key + bytes((len(digits),)))).zfill(len(digits) - 1)
    return _fill(text, next(body + str(i) for i in range(10) if luhn(body + str(i))))


def _iban(text: str, key: bytes, permute) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _spelled(plain[4:], key + plain[:2].encode(), permute)
    whole = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(whole) for c in text)


def _ssn(text: str, key: bytes, permute) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = 898  # 001-899 without 666
    number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    number, serial = divmod(permute(number, areas * 99 * 9999, key), 9999)
    area, group = divmod(number, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, key: bytes, permute) -> str | None:
    head = re.match(r"\+\d{1,3}(?=[\s.(-])", text)
    rest = text[head.end() :] if head else text
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 14:
        return None
    return (head[0] if head else "") + _fill(rest, str(permute(int(digits), 10 ** len(digits), key + bytes((len(digits),)))).zfill(len(digits)))


def _ip(text: str, key: bytes, permute) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    number = permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key)
    return ".".join(map(str, number.to_bytes(4, "big")))


def _email(text: str, key: bytes, permute) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{_spelled(local, key + domain.lower().encode(), permute)}@{domain}"


def _date(text: str, key: bytes, permute) -> str | None:
    sep = re.search(r"\D", text)[0]
    parts = text.split(sep)
    forms = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for y, m, d in forms:
        try:
            day = dt.date(int(parts[y]), int(parts[m]), int(parts[d]))
        except ValueError:
            continue
        number = (day - _EPOCH).days
        if not 0 <= number < _DAYS:
            return None
        day = _EPOCH + dt.timedelta(permute(number, _DAYS, key + bytes((y, m, d))))
        if (y, m, d) == (2, 0, 1):  # must not read as day first again
            while day.day <= 12:
                day = _EPOCH + dt.timedelta(permute((day - _EPOCH).days, _DAYS, key + bytes((y, m, d))))
        out = [""] * 3
        for i, x, w in ((y, day.year, 4), (m, day.month, len(parts[m]) if len(parts[m]) == 2 else 1), (d, day.day, len(parts[d]) if len(parts[d]) == 2 else 1)):
            out[i] = str(x).zfill(w)
        return sep.join(out)
    return None


def _secret(text: str, key: bytes, permute) -> str | None:
    if text.startswith("AKIA"):
        return "AKIA" + _spelled(text[4:], key, permute)
    if text.isdigit():
        return None
    new = f"{permute(int(text, 16), 16 ** len(text), key + bytes((len(text),))):x}".zfill(len(text))
    return new.upper() if text.upper() == text else new


_VALID = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "email": _email, "date": _date, "secret": _secret}
_FORMS = {
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "card": r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\w)",
}
_ANY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _FORMS.items()))
_EACH = {k: re.compile(v) for k, v in _FORMS.items()}
# IBAN lengths by country.
_IBAN_LENGTHS = {c: n for n, names in {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in names.split()}
_AT = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])")
_LOCAL = frozenset(".%+-_")


def _ends(text: str, start: int, end: int, kind: str) -> Iterator[int]:
    """Where a value of this kind may end that begins at start and reaches to end at most, the likeliest first."""
    cut = lambda e: text[e - 1].isalnum() and not (text[e : e + 1].isalnum() or text[e : e + 1] == "_")
    if kind == "iban" and (length := _IBAN_LENGTHS.get(text[start : start + 2])):
        at = [i + 1 for i in range(start, end) if text[i] != " "]
        if length <= len(at) and cut(at[length - 1]):
            yield at[length - 1]
        yield end
        return
    yield end
    if kind in ("card", "iban", "phone"):
        yield from (e for e in range(end - 1, start, -1) if cut(e))


def _valid(text: str, start: int, kind: str, free: int) -> int | None:
    """The end of the valid value of this kind at start, not beyond free."""
    m = _EACH[kind].match(text, start)
    if not m:
        return None
    for end in _ends(text, start, m.end(), kind):
        if end <= free and _VALID[kind](text[start:end], b"", lambda number, size, key: number) is not None:
            if kind == "phone":  # its last groups may be the first of another value
                for i in range(start + 1, end):
                    if text[i - 1] in " .-" and any((e := _valid(text, i, k, free)) and e > end for k in ("card", "date", "ssn", "ip")):
                        short = text[start:i].rstrip(" .-")
                        return start + len(short) if _phone(short, b"", lambda number, size, key: number) is not None else end
            return end
    return None


def found(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of personal data."""
    out, high = [], 0
    for m in _AT.finditer(text):
        low = m.start()
        while low > high and (text[low - 1].isalnum() or text[low - 1] in _LOCAL):
            low -= 1
        while low < m.start() and text[low] in _LOCAL:
            low += 1
        if low < m.start():
            high = m.end()
            out.append((low, high, "email"))
    taken, lows = out[:], [x[0] for x in out]
    at = 0
    while m := _ANY.search(text, at):
        start = m.start()
        i = bisect_right(lows, start)
        if i and start < taken[i - 1][1]:
            at = taken[i - 1][1]
            continue
        free = lows[i] if i < len(lows) else len(text)
        kind, end = next(((k, e) for k in _EACH if (e := _valid(text, start, k, free)) is not None), (None, start + 1))
        if kind:
            out.append((start, end, kind))
        at = end
    return sorted(out)


class Pseudonyms:
    def __init__(self, secret: str, kinds: tuple[str, ...] = KINDS):
        self.keys = {k: hashlib.sha256(f"{k}\0{secret}".encode()).digest() for k in kinds}
        self.value = lru_cache(1 << 14)(self._value)

    def _value(self, kind: str, text: str) -> str | None:
        new = _VALID[kind](text, self.keys[kind], feistel)
        return new

    def restore(self, kind: str, text: str) -> str | None:
        """The value that a pseudonym stands for (dates written month first may have been permuted several times)."""
        return _VALID[kind](text, self.keys[kind], unfeistel)

    def apply(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and where they are in it."""
        out, spans, last, at = [], [], 0, 0
        for low, high, kind in found(text):
            new = self.value(kind, text[low:high]) if kind in self.keys else None
            if new is None:
                continue
            out += [text[last:low], new]
            at += low - last
            spans.append((at, at + len(new), kind))
            at += len(new)
            last = high
        return "".join([*out, text[last:]]) if spans else text, spans


def pseudonymised(docs: DataFrame, secret: str, kinds: tuple[str, ...] = KINDS, spans: str | None = None) -> DataFrame:
    """docs with pseudonyms in text; where they are goes to a column named spans, which replaces one of that name.

    Who has the secret can undo them.
    """
    if not secret:
        raise ValueError("pseudonyms need a secret")
    X.tune(docs.sparkSession)
    docs = docs.drop(spans) if spans else docs
    names = docs.columns
    at = names.index("text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    schema = T.StructType(list(docs.schema.fields))
    if spans:
        schema = T.StructType([*schema.fields, *T._parse_datatype_string(f"`{spans}` array<struct<start:int,end:int,kind:string>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Pseudonyms(secret, kinds)
        for batch in batches:
            text = batch.column(at)
            # what no text can hold any without: a digit, an @, or a secret of letters alone
            some = pc.fill_null(pc.match_substring_regex(text, "[0-9@]|AKIA|[A-Fa-f]{32}"), False).to_pylist()
            new, where = [], []
            for i, may in enumerate(some):
                value, held = tool.apply(text[i].as_py()) if may else (None, [])
                new.append(value)
                where.append([{"start": a, "end": b, "kind": c} for a, b, c in held])
            columns = list(batch.columns)
            columns[at] = pc.if_else(pa.array(some, pa.bool_()), pa.array(new, text.type), text)
            if spans:
                columns.append(pa.array(where, kind))
            yield pa.RecordBatch.from_arrays(columns, [*names, *([spans] if spans else [])])

    return docs.mapInArrow(run, schema)
