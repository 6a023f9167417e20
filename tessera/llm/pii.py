"""Format-preserving pseudonyms for personal data, by keyed permutations (Feistel networks) within each format.

What is found and validated: payment card numbers (Luhn), IBANs (mod 97), telephone numbers (with a country code, or in
the 3-3-4 form), United States social security numbers, IPv4 addresses, calendar dates from 1900 to 2099, and the local
part of e-mail addresses. Each value becomes another valid value of the same format and length: a card keeps its first
digit and gets the check digit that fits, an IBAN keeps its country, a telephone number its country code, a date its
notation, an address its domain. The permutation depends on key, kind and format alone, so equal values stay linked
across documents, and whoever holds the key can turn pseudonyms back (`reveal`). Dates are permuted among the dates that
every notation writes at the same length and reads the same way (day 1 to 9, 10 to 12 or later; month 1 to 9 or later), so
that a date stays linked across notations too.

A Feistel network over pairs (l, r) with l < a and r < b, a * b >= n, is walked until it lands below n, which permutes
any n values. Rounds are keyed with BLAKE2b.

A pattern may reach into the words behind a value. So every end at a border of words or groups within a match is a
reading: an IBAN ends at its country's length, a telephone number at the length its country has (where that is fixed, else
it is the longest reading), a card at the shortest length cards of its first digit are issued in that validates, else at
the whole match. If no reading validates, the search goes on behind the first group of the match. Digits that stand
directly before or behind a value can still make another reading valid by chance, before or after the replacement.

Where matches overlap, the kind that comes first in KINDS wins, then the earlier one; what the winner leaves of the other
is read for itself. Numbers that validate as nothing (order numbers, hashes, versions) are left alone, as is everything
between.

Defined results: null texts stay null; empty texts, and texts without a match, come back unchanged; nothing depends on
the id, which may be null or repeated; an empty table gives an empty result. Other columns are passed through.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import lru_cache
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, read, texts

ROUNDS = 10
KINDS = ("iban", "email", "ip", "date", "phone", "card", "ssn")
_L, _R = rb"(?<![0-9A-Za-z_\x80-\xff])", rb"(?![0-9A-Za-z_\x80-\xff])"
PATTERNS = {
    "iban": re.compile(_L + rb"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?" + _R),
    "email": re.compile(rb"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,24}" + _R),
    "ip": re.compile(rb"(?<![0-9A-Za-z_.\x80-\xff])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z_\x80-\xff])"),
    "date": re.compile(_L + rb"(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})" + _R),
    "phone": re.compile(rb"(?<![0-9A-Za-z_+\x80-\xff])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}([-.])[0-9]{3}\1[0-9]{4})" + _R),
    "card": re.compile(_L + rb"[0-9](?:[ \-]?[0-9]){12,18}" + _R),
    "ssn": re.compile(_L + rb"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R),
}
#: Lengths of IBANs by country (ISO 13616), of national telephone numbers where a country code has one length, and of cards
#: by first digit.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.encode().split()
}
PHONE_LENGTHS = {b"1": 10, b"7": 10, b"33": 9, b"34": 9, b"41": 9, b"44": 10, b"45": 8, b"48": 9, b"61": 9, b"91": 10}
CARD_LENGTHS = {49: (15,), 50: (16,), 51: (14, 15, 16), 52: (13, 16, 19), 53: (16,), 54: (16, 19)}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of range(n) for every (tweak, n), and its inverse."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, x: int) -> int:
        data = b"%d|%d|%d|" % (len(tweak), i, x) + tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=40).digest(), "big")

    def permute(self, x: int, n: int, tweak: bytes, inverse: bool = False) -> int:
        if n <= 1:
            return x
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
                sign = -1 if inverse else 1
                if i % 2:
                    right = (right + sign * self._round(tweak, i, left)) % b
                else:
                    left = (left + sign * self._round(tweak, i, right)) % a
            x = left * b + right
            if x < n:
                return x


def digits_of(raw: bytes) -> bytes:
    return bytes(c for c in raw if 48 <= c <= 57)


def refill(raw: bytes, symbols: bytes, places: Callable[[int], bool] = lambda c: 48 <= c <= 57) -> bytes:
    """raw with the characters at its places replaced in order."""
    following = iter(symbols)
    return bytes(next(following) if places(c) else c for c in raw)


def luhn_digit(payload: bytes) -> int:
    """The digit that completes the payload to a number whose Luhn sum is a multiple of ten."""
    doubled = [(2 * (c - 48)) if i % 2 == 0 else c - 48 for i, c in enumerate(reversed(payload))]
    return -sum(x - 9 if x > 9 else x for x in doubled) % 10


def iban_number(text: bytes) -> int:
    return int("".join(str(int(chr(c), 36)) for c in text))


def alphabet(c: int) -> bytes:
    """The characters that may stand where c stands."""
    if 48 <= c <= 57:
        return b"0123456789"
    if 97 <= c <= 122:
        return b"abcdefghijklmnopqrstuvwxyz"
    return b""


def is_card(digits: bytes) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1] - 48 and len(set(digits)) > 1


def country_digits(raw: bytes) -> int:
    """How many digits of a telephone number are its country code."""
    if raw[:1] != b"+":
        return 0
    digits = digits_of(raw)
    country = len(digits_of(re.match(rb"\+?[0-9]*", raw).group()))
    return min(country, 3) if country < len(digits) and not raw[1 : 1 + country].isdigit() else (1 if digits[:1] in b"17" else min(country, 2))


def borders(text: bytes, start: int, end: int) -> list[int]:
    """Ends of groups within a match, the longest reading first; its own end among them."""
    return [m.end() for m in WORD.finditer(text, start, end)][::-1]


def iban_ends(text: bytes, start: int, end: int) -> list[int]:
    """The end at the country's length first. Countries without a known length may end anywhere, others at the match's end."""
    want, ends = IBAN_LENGTHS.get(text[start : start + 2].upper()), borders(text, start, end)
    own = [e for e in ends if len(text[start:e].replace(b" ", b"")) == want]
    return own + [e for e in ends if e not in own and (want is None or e == end)]


def phone_ends(text: bytes, start: int, end: int) -> list[int]:
    ends = borders(text, start, end)
    country = country_digits(text[start:end])
    want = PHONE_LENGTHS.get(digits_of(text[start:end])[:country])
    own = [e for e in ends if want and len(digits_of(text[start:e])) == country + want]
    return own + [e for e in ends if e not in own]


def card_ends(text: bytes, start: int, end: int) -> list[int]:
    """Ends at lengths that cards are issued in, ascending, so that a value's own digits decide; last the match's end."""
    lengths = CARD_LENGTHS.get(text[start], ())
    own = [e for e in borders(text, start, end)[::-1] if len(digits_of(text[start:e])) in lengths]
    return own + [e for e in (end,) if e not in own]


WORD, GROUP = re.compile(rb"[0-9A-Za-z]+"), re.compile(rb"[^0-9A-Za-z]*[0-9A-Za-z]+")
ENDS = {"iban": iban_ends, "phone": phone_ends, "card": card_ends}


def parsed_date(raw: bytes) -> tuple[datetime.date, str] | None:
    """The date and the order of its parts; day before month where both readings are valid."""
    parts = [int(x) for x in re.split(rb"[-/.]", raw)]
    for order in ("ymd",) if parts[0] > 31 else ("dmy", "mdy"):
        got = dict(zip(order, parts, strict=True))
        try:
            day = datetime.date(got["y"], got["m"], got["d"])
        except ValueError:
            continue
        if FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return day, order
    return None


def date_class(day: datetime.date) -> int:
    """Dates of one class have as many digits in each part, and are read alike whichever of day and month stands first."""
    return 2 * ((day.day > 9) + (day.day > 12)) + (day.month > 9)


@lru_cache(maxsize=1)
def dates_by_class() -> list[list[int]]:
    """Ordinals of the dates that are replaced, ascending, by class."""
    classes: list[list[int]] = [[] for _ in range(6)]
    for x in range(FIRST_DAY, LAST_DAY + 1):
        classes[date_class(datetime.date.fromordinal(x))].append(x)
    return classes


class Pseudonyms:
    """Finds, validates and replaces; with inverse, turns pseudonyms back."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.feistel, self.inverse = Feistel(key), inverse
        self.value = lru_cache(maxsize=50_000)(self._value)

    def _shift(self, x: int, n: int, tweak: str) -> int:
        return self.feistel.permute(x, n, tweak.encode(), self.inverse)

    def _number(self, digits: bytes, tweak: str) -> bytes:
        return b"%0*d" % (len(digits), self._shift(int(digits), 10 ** len(digits), f"{tweak}:{len(digits)}")) if digits else b""

    def _spelled(self, text: bytes, tweak: str) -> bytes:
        """Permute a text within the strings of the same character classes."""
        sets = [alphabet(c) for c in text]
        sizes = [len(s) for s in sets if s]
        x = 0
        for c, s in zip(text, sets, strict=True):
            if s:
                x = x * len(s) + s.index(c)
        shape = "".join("9" if s[:1] == b"0" else "a" if s else chr(c) for c, s in zip(text, sets, strict=True))
        x = self._shift(x, prod(sizes), f"{tweak}:{shape}")
        out = bytearray(text)
        for i in range(len(text) - 1, -1, -1):
            if sets[i]:
                x, place = divmod(x, len(sets[i]))
                out[i] = sets[i][place]
        return bytes(out)

    def _value(self, kind: str, raw: bytes) -> bytes | None:
        """The pseudonym of a match, or None if it does not validate."""
        return getattr(self, "_" + kind)(raw)

    def _card(self, raw: bytes) -> bytes | None:
        digits = digits_of(raw)
        if not is_card(digits):
            return None
        before = [len(digits_of(raw[:e])) for e in card_ends(raw, 0, len(raw)) if e < len(raw)]
        while True:  # walk until no shorter reading validates, as none did here
            payload = digits[:1] + self._number(digits[1:-1], f"card:{chr(digits[0])}")
            digits = payload + b"%d" % luhn_digit(payload)
            if is_card(digits) and not any(is_card(digits[:n]) for n in before):
                return refill(raw, digits)

    def _iban(self, raw: bytes) -> bytes | None:
        text = raw.replace(b" ", b"").upper()
        if not 15 <= len(text) <= 34 or iban_number(text[4:] + text[:4]) % 97 != 1:
            return None
        body = self._spelled(text[4:].lower(), "iban:" + text[:2].decode()).upper()
        check = b"%02d" % (98 - iban_number(body + text[:2] + b"00") % 97)
        return self._cased(raw, text[:2] + check + body, lambda c: c != 32)

    def _cased(self, raw: bytes, text: bytes, places: Callable[[int], bool]) -> bytes:
        out = refill(raw, text, places)
        return bytes(o + 32 if 97 <= c <= 122 and 65 <= o <= 90 else o - 32 if 65 <= c <= 90 and 97 <= o <= 122 else o for c, o in zip(raw, out, strict=True))

    def _email(self, raw: bytes) -> bytes | None:
        local, at, domain = raw.partition(b"@")
        return self._cased(local, self._spelled(local.lower(), "email"), lambda c: True) + at + domain

    def _ip(self, raw: bytes) -> bytes | None:
        octets = [int(x) for x in raw.split(b".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == 48 for x in raw.split(b".")):
            return None
        # the same digits in each octet, so that the length stays
        ranges = [(0, 10) if x < 10 else (10, 90) if x < 100 else (100, 156) for x in octets]
        sizes, x = [n for _, n in ranges], 0
        for value, (low, n) in zip(octets, ranges, strict=True):
            x = x * n + value - low
        x = self._shift(x, prod(sizes), "ip:" + ".".join(map(str, sizes)))
        out = []
        for low, n in reversed(ranges):
            x, place = divmod(x, n)
            out.append(b"%d" % (low + place))
        return b".".join(reversed(out))

    def _phone(self, raw: bytes) -> bytes | None:
        digits, country = digits_of(raw), country_digits(raw)
        if not 7 <= len(digits) - country <= 13 or not 8 <= len(digits) <= 15:
            return None
        return refill(raw, digits[:country] + self._number(digits[country:], "phone:" + digits[:country].decode()))

    def _ssn(self, raw: bytes) -> bytes | None:
        area, group, serial = (int(x) for x in raw.split(b"-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x = self._shift(x, 898 * 99 * 9999, "ssn")
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return b"%03d-%02d-%04d" % (area + 1 + (area >= 665), group + 1, serial + 1)

    def _date(self, raw: bytes) -> bytes | None:
        found = parsed_date(raw)
        if not found:
            return None
        day, order = found
        kind = date_class(day)
        alike = dates_by_class()[kind]
        new = datetime.date.fromordinal(alike[self._shift(bisect_left(alike, day.toordinal()), len(alike), f"date:{kind}")])
        widths, mark = [len(x) for x in re.split(rb"[-/.]", raw)], re.search(rb"[-/.]", raw).group()
        return mark.join(b"%0*d" % (w, {"y": new.year, "m": new.month, "d": new.day}[o]) for o, w in zip(order, widths, strict=True))

    def spans(self, text: bytes) -> list[tuple[int, int, str, bytes]]:
        """(start, end, kind, pseudonym) of what is replaced, in bytes and in order."""
        found: list[tuple[int, int, str, bytes]] = []
        for kind in KINDS:
            if kind == "email" and b"@" not in text:
                continue
            taken, at, pattern = sorted(found), 0, PATTERNS[kind]
            starts = [s for s, *_ in taken]
            while m := pattern.search(text, at):
                start, end = m.span()
                i = bisect_right(starts, start)
                if i and start < taken[i - 1][1]:
                    at = taken[i - 1][1]
                    continue
                limit = starts[i] if i < len(starts) else end
                at = GROUP.match(text, start).end()
                for stop in ENDS[kind](text, start, end) if kind in ENDS else (end,):
                    if stop > limit or stop < end and not pattern.fullmatch(text, start, stop):
                        continue
                    new = self.value(kind, text[start:stop])
                    if new is not None:
                        found.append((start, stop, kind, new))
                        at = stop
                        break
        return sorted(found)

    def replace(self, text: bytes | None) -> tuple[bytes | None, list[str]]:
        if not text or not any_digit.search(text):
            return text, []
        found = self.spans(text)
        if not found:
            return text, []
        out, at = [], 0
        for start, end, _, new in found:
            out += [text[at:start], new]
            at = end
        return b"".join([*out, text[at:]]), [k for _, _, k, _ in found]


any_digit = re.compile(rb"[0-9@]")
#: A stand-in so that queries and tests run; callers pass a secret of their own.
DEMONSTRATION_KEY = b"demonstration key, not a secret"


def pseudonymise(docs: DataFrame, key: bytes = DEMONSTRATION_KEY, text_col: str = "text", kinds_col: str | None = None, inverse: bool = False) -> DataFrame:
    """docs with personal data in the text replaced; kinds_col, if named, is added: the kinds replaced, in order."""
    place = docs.columns.index(text_col)
    text_type = docs.schema[text_col].dataType

    def make():
        own = Pseudonyms(key, inverse)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            done = [own.replace(t) for t in texts(batch.column(place))]
            columns = [pa.array([t for t, _ in done], pa.binary()).cast(pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            names = list(batch.schema.names)
            if kinds_col:
                columns.append(pa.array([k for _, k in done], pa.list_(pa.string())))
                names.append(kinds_col)
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    fields = [*docs.schema.fields, *([T.StructField(kinds_col, T.ArrayType(T.StringType()))] if kinds_col else [])]
    assert isinstance(text_type, T.StringType)
    return map_texts(docs, make, T.StructType(fields), text_col)


def reveal(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The texts that were pseudonymised with this key."""
    return pseudonymise(docs, key, text_col, inverse=True)


def op4(spark, sf_dir: str) -> DataFrame:
    got = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), kinds_col="kinds")
    return got.select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds"))
