"""Operator 4: personal data replaced by format-preserving pseudonyms.

Numbers, dates and addresses are found and validated (Luhn, mod 97, calendar, octets), then permuted within their
format by a keyed Feistel network: a card number becomes another valid card number, a date another date. Equal
values get equal pseudonyms in every document, whatever their spacing and, in mail addresses, their case; different
values of one format, different ones. A telephone number with its country's code and one without it are different values.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm.common import by_batch, texts

#: For tests and examples; in production the caller passes a secret of its own.
EXAMPLE_KEY = b"an example key, not a secret"
ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: a balanced Feistel network on the next even number of bits, walked along its
    cycle until it is back in range (under four steps on average)."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    salt = tweak.encode()[:32] + b"|"
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            drawn = hashlib.blake2b(salt + bytes([r]) + right.to_bytes(width, "big"), key=key[:64], digest_size=min(64, width)).digest()
            if width > 64:
                drawn = hashlib.shake_256(drawn).digest(width)
            left, right = right, left ^ (int.from_bytes(drawn, "big") & mask)
        x = left << half | right
        if x < size:
            return x


def _digits(value: str, key: bytes, tweak: str) -> str:
    return str(permute(int(value), 10 ** len(value), key, f"{tweak}{len(value)}")).zfill(len(value))


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdecimal() else c for c in shape)


#: The digit sum of twice a digit, by its character.
_TWICE = bytes(sum(divmod(2 * (b - 48), 10)) if 48 <= b < 58 else 0 for b in range(256))


def luhn(digits: str) -> int:
    """The check digit that these digits need after them."""
    raw = (digits if digits.isascii() else "".join(str(int(c)) for c in digits)).encode()
    return -(sum(raw[::-2].translate(_TWICE)) + sum(raw[-2::-2]) - 48 * len(raw[-2::-2])) % 10


def _card(text: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]):
        return None
    body = _digits(d[:-1], key, "card")
    return _refill(text, body + str(luhn(body)))


#: What a letter or digit counts in an IBAN.
_BASE36 = {c: str(int(c, 36)) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _iban(text: str, key: bytes) -> str | None:
    s = text.replace(" ", "")
    value = lambda x: int("".join(map(_BASE36.__getitem__, x)))
    if not 15 <= len(s) <= 34 or value(s[4:] + s[:4]) % 97 != 1:
        return None
    body = _mixed(s[4:], key, "iban")
    new = s[:2] + f"{98 - value(body + s[:2] + '00') % 97:02d}" + body
    it = iter(new)
    return "".join(" " if c == " " else next(it) for c in text)


#: Country codes of one and of two digits (ITU-T E.164). All others have three.
_CODES = set(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def _phone(text: str, key: bytes) -> str | None:
    """The digits are permuted; behind a plus sign, the country code and a zero in brackets stay."""
    d = re.sub(r"\D", "", text.replace("(0)", ""))
    kept = 0
    if text[0] == "+":
        kept = next((k for k in (1, 2) if d[:k] in _CODES), 3)
    if not (8 <= len(d) <= 15 if kept else 7 <= len(d) <= 14) or len(d) - kept < 4:
        return None
    new = d[:kept] + _digits(d[kept:], key, "phone")
    head, zero, tail = text.partition("(0)")
    cut = sum(c.isdecimal() for c in head)
    return _refill(head, new[:cut]) + zero + _refill(tail, new[cut:])


def _ssn(text: str, key: bytes) -> str | None:
    d = text.replace("-", "")
    if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000":
        return None
    while True:  # along the cycle to the next valid one, which keeps the permutation one to one
        d = _digits(d, key, "ssn")
        if not (d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000"):
            return f"{d[:3]}-{d[3:5]}-{d[5:]}"


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    n = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _date(text: str, key: bytes) -> str | None:
    """ISO, or day and month in either order before the year (month first only where the day can't be). Day,
    month and year widths and the separators stay. Days up to the twelfth and later ones are permuted apart, so that a date has
    one pseudonym in whatever format it stands."""
    a, sep, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", text).groups()
    year_first = len(a) == 4
    y, p, q = (int(a), int(b), int(c)) if year_first else (int(c), int(a), int(b))
    month_first = year_first or q > 12
    try:
        day = dt.date(y, *((p, q) if month_first else (q, p))).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    ordinal, late = day, dt.date.fromordinal(day).day > 12
    while True:  # along the cycle to one that reads back in the same order however it is written
        ordinal = FIRST_DAY + permute(ordinal - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date")
        new = dt.date.fromordinal(ordinal)
        if (new.day > 12) == late:
            break
    if year_first:
        return f"{new.year:04d}{sep}{new.month:0{len(b)}d}{sep}{new.day:0{len(c)}d}"
    p, q = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{p:02d}{sep}{q:02d}{sep}{new.year:04d}"


@lru_cache(maxsize=4096)
def _both_cases(c: str) -> bool:
    """Letters that are one character in either case, and the same again when put back."""
    low, up = c.lower(), c.upper()
    return len(low) == len(up) == 1 and low != up and low.upper() == up and up.lower() == low


@lru_cache(maxsize=4096)
def _class(c: str) -> str:
    """The characters that may stand for a letter or digit: of ASCII, 0-9, A-Z or a-z; else those of its category among the 256
    codes around it that aren't ASCII, and that have two cases if it has."""
    if not c.isalnum():
        return c
    kind, first = (unicodedata.category(c), c.isascii(), _both_cases(c)), ord(c) & ~255
    return "".join(x for x in map(chr, range(first, first + 256)) if (unicodedata.category(x), x.isascii(), _both_cases(x)) == kind)


#: Characters of the longest value that is permuted as one number.
NUMBER = 64


def _mixed(value: str, key: bytes, tweak: str) -> str:
    """Each digit and letter becomes one of its class; other characters stay. Longer values are permuted by halves."""
    if len(value) > NUMBER:
        return _halves(value, key, tweak)
    classes = list(map(_class, value))
    tweak += hashlib.blake2b("".join(own[0] for own in classes).encode(), digest_size=8).hexdigest()
    size = math.prod(map(len, classes))
    if size == 1:
        return value
    n = 0
    for c, own in zip(value, classes):
        n = n * len(own) + own.index(c)
    n = permute(n, size, key, tweak)
    out = []
    for own in reversed(classes):
        n, k = divmod(n, len(own))
        out.append(own[k])
    return "".join(reversed(out))


def _halves(value: str, key: bytes, tweak: str) -> str:
    """A Feistel network whose halves are those of the value: in each round the places of one half's characters in their classes
    are moved on by numbers drawn from the other half, modulo the classes' sizes. Linear in the length."""
    codes, own = np.unique(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    classes = [_class(chr(c)) for c in codes]
    lengths = np.array([len(x) for x in classes], np.uint64)
    starts, sizes = (np.cumsum(lengths) - lengths)[own], lengths[own]
    at = np.array([x.index(chr(c)) for c, x in zip(codes, classes)], np.uint64)[own]
    letters = np.frombuffer("".join(classes).encode("utf-32-le", "surrogatepass"), "<u4")
    salt = hashlib.blake2b(tweak.encode() + letters[starts].tobytes(), key=key[:64]).digest()
    left, right = slice(0, len(value) // 2), slice(len(value) // 2, None)
    for r in range(ROUNDS):
        seed = hashlib.blake2b(salt + bytes([r]) + at[left].tobytes(), key=key[:64]).digest()
        drawn = np.frombuffer(hashlib.shake_256(seed).digest(8 * len(at[right])), "<u8")
        at[right] = (at[right] + drawn % sizes[right]) % sizes[right]
        left, right = right, left
    return letters[starts + at].tobytes().decode("utf-32-le", "surrogatepass")


def _email(text: str, key: bytes) -> str:
    """All but the last part of the domain. Capitals are permuted as small letters and put back where they were."""
    head, _, last = text.rpartition(".")
    low = "".join(c.lower() if _both_cases(c) else c for c in head)
    new = _mixed(low, key, "email")
    if low != head:
        new = "".join(c.upper() if a != b else c for a, b, c in zip(head, low, new))
    return f"{new}.{last}"


#: Length by country, of the IBAN registry.
_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Groups of digits in which cards are printed, the usual ones first. One group of 13 to 19 is as usual.
_PRINTED = ({(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}, {(4, 4, 4, 4, 3), (6, 13), (4, 5, 6)})

_LOCAL, _DOMAIN = re.compile(r"[\w.+%\u0300-\u036f-]+"), re.compile(r"@[\w\u0300-\u036f-]+(?:\.[\w\u0300-\u036f-]+)+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_IBAN_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
_DATE = re.compile(r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}([/.-])\d{2}\1\d{4})(?!\d|[./-]\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(
    r"(?<![\d.])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d|[.-]\d)|\+\d{8,15}(?!\d)"
    # with a country's code also pairs of digits, and an area's code and one group
    r"|\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\d(?:[ .-]\d\d){4}|\d\d[ .-]\d{3}(?:[ .-]\d\d){2}|\(?\d{2,5}\)?[ .-]\d{4,8})(?!\d|[.-]\d)"
)
_RUN, _GROUP = re.compile(r"\d+(?:[ -]\d+)*"), re.compile(r"\d+")

#: start, end and pseudonym
Found = Iterator[tuple[int, int, str]]


def _each(expression: re.Pattern, make: Callable[[str, bytes], str | None]) -> Callable[[str, bytearray, bytes], Found]:
    """Matches that are valid and free. After another one the search goes on inside it, not behind it."""

    def find(text: str, taken: bytearray, key: bytes) -> Found:
        at = 0
        while m := expression.search(text, at):
            s, e = m.span()
            if (last := taken.rfind(1, s, e)) >= 0:
                at = last + 1
            elif (new := make(m[0], key)) is None:
                at = s + 1
            else:
                yield s, e, new
                at = e

    return find


def _emails(text: str, taken: bytearray, key: bytes) -> Found:
    """From each at sign to the left and to the right: runs without one are never read twice."""
    back, at = text[::-1], 0
    for sign in re.finditer("@", text):
        p = sign.start()
        if p < at or not (domain := _DOMAIN.match(text, p)) or not (local := _LOCAL.match(back, len(text) - p, len(text) - at)):
            continue
        s, at = len(text) - local.end(), domain.end()
        yield s, at, _email(text[s:at], key)


def _ibans(text: str, taken: bytearray, key: bytes) -> Found:
    """At each start the country's length is tried first, then every end of a group from the last one on."""
    at = 0
    while m := _IBAN.search(text, at):
        s, at = m.start(), m.start() + 1
        ends = []
        for end in _IBAN_END.finditer(text, s):
            if end.start() > m.end():
                break
            ends.append(end.start())
        wanted = _LENGTHS.get(text[s : s + 2])
        for e in sorted(ends, key=lambda e: (e - s - text.count(" ", s, e) != wanted, -e)):
            if taken.find(1, s, e) < 0 and (new := _iban(text[s:e], key)) is not None:
                yield s, e, new
                at = e
                break


def _cards(text: str, taken: bytearray, key: bytes) -> Found:
    """Any neighbouring groups of digits that are valid together: first those grouped as cards are printed, then others,
    from each start on the longest first. The others don't cut through what reads as a whole telephone number."""
    free = bytearray(taken)
    runs = []
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 13:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, *run.span())]
        opens = text[run.start() - 1 : run.start()] not in (".", "-")
        closes = not re.match(r"[.]\d", text[run.end() : run.end() + 2])
        runs.append((groups, opens, closes))
    for rank in range(3):
        phones = [(s, e) for s, e, _ in PHONES(text, free, key)] if rank == 2 and runs else []
        inside = bytearray(len(text) + 1)  # places at which a cut would go through a telephone number
        for s, e in phones:
            inside[s + 1 : e] = b"\1" * (e - s - 1)
        for groups, opens, closes in runs:
            i = 0 if opens else 1
            while i < len(groups):
                s, n, ends = groups[i][0], 0, []
                for j in range(i, len(groups)):
                    n += groups[j][1] - groups[j][0]
                    if n > 19 or free[groups[j][0]]:
                        break
                    if n >= 13 and (closes or j < len(groups) - 1):
                        ends.append(j)
                for j in reversed(ends):
                    e = groups[j][1]
                    shape = tuple(y - x for x, y in groups[i : j + 1])
                    if rank < 2 and not (shape in _PRINTED[rank] or rank == 0 and i == j) or inside[s] or inside[e]:
                        continue
                    digits = "".join([text[x:y] for x, y in groups[i : j + 1]])
                    if luhn(digits[:-1]) == int(digits[-1]) and (new := _card(text[s:e], key)) is not None:
                        free[s:e] = b"\1" * (e - s)
                        yield s, e, new
                        i = j
                        break
                i += 1


PHONES = _each(_PHONE, _phone)
#: Kinds in order: a later one doesn't overlap an earlier one.
KINDS = {
    "email": _emails,
    "iban": _ibans,
    "ip": _each(_IP, _ip),
    "date": _each(_DATE, _date),
    "ssn": _each(_SSN, _ssn),
    "card": _cards,
    "phone": PHONES,
}
_ANY = re.compile(r"[0-9@]")


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced, in code points of the given text.
    Kinds are tried in order, and a later one doesn't overlap an earlier one."""
    if not _ANY.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind, find in KINDS.items():
        if kind == "email" and "@" not in text:
            continue
        own = list(find(text, taken, key))
        for s, e, _ in own:
            taken[s:e] = b"\1" * (e - s)
        found += [(s, e, kind, new) for s, e, new in own]
    out, at = [], 0
    for s, e, _, new in sorted(found):
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), [(k, s, e) for s, e, k, _ in sorted(found)]


def pseudonymise(docs: DataFrame, key: bytes = EXAMPLE_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms; null stays null), kinds, starts, ends for each row, repeated rows included.

    Rows are independent of each other, so repeated rows and ties get equal results, and an empty table gives an empty one. An empty
    text stays empty. Texts are read whole, in time linear in their length. Other columns go, so none can clash."""
    rows = texts(docs, id_col, text_col)

    def run(batch: pa.RecordBatch):
        done = [(None, []) if t is None else replace(t, key) for t in batch.column(1).to_pylist()]
        lists = [pa.array([[x[i] for x in spans] for _, spans in done], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), *lists], ["doc_id", "text", "kinds", "starts", "ends"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, kinds array<string>, starts array<long>, ends array<long>"
    return by_batch(rows, run, schema)


def replaced(docs: DataFrame, key: bytes = EXAMPLE_KEY, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in its texts; other columns, whatever their names, stay as they are. Nulls, empty and very long texts,
    repeated rows and empty tables are as in pseudonymise()."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        new = [t if t is None else replace(t, key)[0] for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.string()))

    return by_batch(docs, run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counted = [F.size(F.array_remove(F.col("kinds"), kind)) for kind in KINDS]
    counted = [(F.size("kinds") - n).cast("long").alias(f"n_{kind}") for n, kind in zip(counted, KINDS)]
    spans = F.zip_with("kinds", F.arrays_zip("starts", "ends"), lambda k, x: F.concat_ws(":", k, x["starts"].cast("string"), x["ends"].cast("string")))
    return found.select("doc_id", F.size("kinds").cast("long").alias("n_found"), *counted, F.array_join(spans, ",").alias("spans"), "text")
