"""Pseudonyms for personal data that keep the format: a keyed Feistel network permutes each value's own domain.

Numbers are replaced only if they are valid (Luhn, mod 97, octets, area rules, calendar), and what replaces them is
valid again. The permutation depends on key and kind alone, so equal values stay linked across documents and sources,
without a table of values and without a shuffle; whoever holds the key can invert it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from firegrid.llm.shingles import in_slices

ROUNDS = 10


def _round(key: bytes, kind: str, i: int, half: int, n: int) -> int:
    h = hashlib.blake2b(f"{kind}|{i}|{half}|{n}".encode(), key=key[:64], digest_size=16 + (n.bit_length() + 7) // 8)
    return int.from_bytes(h.digest(), "big")


def _feistel(x: int, n: int, key: bytes, kind: str, back: bool) -> int:
    """Alternating Feistel network on [0, a*b) with a, b about sqrt(n); walks on until the number is below n again."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)  # left < a, right < b
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * _round(key, kind, i, right, n)) % a
            else:
                right = (right + sign * _round(key, kind, i, left, n)) % b
        x = left * b + right
        if x < n:
            return x


def permute(x: int, n: int, key: bytes, kind: str, back: bool = False) -> int:
    """Keyed permutation of 0..n-1."""
    return x if n < 2 else _feistel(x, n, key, kind, back)


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _refill(shape: str, digits: str) -> str:
    """Digits put back where the value had digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def _card(value: str, key: bytes, back: bool) -> str | None:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    n = len(d) - 1
    while True:  # a number of one digit throughout is no valid card, so it is walked over
        body = str(permute(int(d[:-1]), 10**n, key, f"card{n}", back)).zfill(n)
        d = next(body + c for c in "0123456789" if luhn(body + c))
        if len(set(d)) > 1:
            return _refill(value, d)


def _iban(value: str, key: bytes, back: bool) -> str | None:
    s = value.replace(" ", "").upper()
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
        return None
    body = s[4:]
    d = _digits(body)
    new = str(permute(int(d), 10 ** len(d), key, f"iban{s[:2]}{len(d)}", back)).zfill(len(d)) if d else ""
    body = _refill(body, new)
    check = 98 - number(body + s[:2] + "00") % 97
    return _spaced(value, f"{s[:2]}{check:02d}{body}")


# characters of an IBAN by country, as registered
_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


def _iban_ends(m: re.Match[str]) -> list[int]:
    """The length of the country first, then the ends of groups from the longest on."""
    ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]
    size = lambda end: len(m.string[m.start() : end].replace(" ", ""))
    return sorted((e for e in ends if size(e) >= 15), key=lambda e: size(e) != _LENGTHS.get(m[0][:2]))


def _spaced(shape: str, text: str) -> str:
    it = iter(text)
    return "".join(c if c == " " else next(it) for c in shape)


def _ssn(value: str, key: bytes, back: bool) -> str | None:
    d = _digits(value)
    valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    if not valid(d):
        return None
    while True:
        d = str(permute(int(d), 10**9, key, "ssn", back)).zfill(9)
        if valid(d):
            return _refill(value, d)


# country codes of one and two digits; all others have three
_CODES = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})")


def _phone_head(value: str) -> int:
    """Length of the country code: up to a separator, or as assigned where none follows."""
    head = re.match(r"\+\d{1,3}(?=[ .(-])", value) or _CODES.match(value)
    return head.end() if head else len(value)


def _phone_end(m: re.Match[str]) -> int | None:
    """Where a number of 7 to 12 digits ends: after ten behind +1, else as late as no other value or number begins.

    Only the shape of the text decides, so that a pseudonym ends where its number does.
    """
    text, h = m.string, _phone_head(m[0])
    ends, n, last, run = [], 0, "", 0
    for i in range(m.start() + h, m.end()):
        c = text[i]
        if not c.isdigit():
            last, run = c, 0
            continue
        n, run = n + 1, run + 1
        after = text[i + 1 : i + 3]
        if n < 7 or after[:1].isdigit():
            continue
        if n > 12:
            break
        ends.append((n, i + 1))
        if after[:1] == " " and (last in "-." and last or run >= 6):
            break  # a blank after other separators or a long run of digits is no part of a number
        if any(p.match(text, i + 2) for k, p in PATTERNS.items() if k != "phone"):
            break
    if m[0][:h] == "+1":
        ends = [e for e in ends if e[0] == 10] or ends
    clean = [e for e in ends if not re.match(r"[^\W_]|[./-][0-9]", text[e[1] : e[1] + 2])]
    return max(clean or ends)[1] if ends else None


def _phone(value: str, key: bytes, back: bool) -> str | None:
    h = _phone_head(value)
    d = _digits(value[h:])
    if not 7 <= len(d) <= 12:
        return None
    new = str(permute(int(d), 10 ** len(d), key, f"phone{value[:h]}{len(d)}", back)).zfill(len(d))
    return value[:h] + _refill(value[h:], new)


def _ip(value: str, key: bytes, back: bool) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts)), 1 << 32, key, "ip", back)
    return ".".join(str(x >> 8 * (3 - i) & 255) for i in range(4))


_FIRST, _LAST = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def _date(value: str, key: bytes, back: bool) -> str | None:
    """Year first, or day.month.year, or month/day/year; all formats of a day share its pseudonym."""
    sep = value[4] if value[:4].isdigit() else value[2]
    order = "ymd" if value[:4].isdigit() else "mdy" if sep == "/" else "dmy"
    parts = dict(zip(order, map(int, value.split(sep)), strict=True))
    try:
        day = dt.date(parts["y"], parts["m"], parts["d"])
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    new = _FIRST + dt.timedelta(permute((day - _FIRST).days, (_LAST - _FIRST).days + 1, key, "date", back))
    return sep.join(f"{new.year:04d}" if c == "y" else f"{new.month if c == 'm' else new.day:02d}" for c in order)


def _mail(value: str, key: bytes, back: bool) -> str | None:
    """Letters A-Z and digits of the local part, each within its kind, in the case it has; the host stays."""
    local, _, host = value.rpartition("@")
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in local)
    alphabets = ["abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "0123456789" if "0" <= c <= "9" else "" for c in low]
    x, n = 0, 1
    for c, letters in zip(low, alphabets, strict=True):
        if letters:
            x, n = x * len(letters) + letters.index(c), n * len(letters)
    shape = "".join("a" if len(a) == 26 else "9" if a else c for c, a in zip(low, alphabets, strict=True))
    x, out = permute(x, n, key, f"mail|{shape}|{host.lower()}", back), []
    for c, letters in zip(reversed(local), reversed(alphabets), strict=True):
        if letters:
            x, r = divmod(x, len(letters))
        out.append((letters[r].upper() if c.isupper() else letters[r]) if letters else c)
    return "".join(reversed(out)) + "@" + host


# kind, pattern, replacement; the patterns that fit at a place are tried in turn, and where none gives a valid value the
# search goes on behind its first character
KINDS: tuple[tuple[str, str, Callable[[str, bytes, bool], str | None]], ...] = (
    ("mail", r"[^\W_][\w.+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}", _mail),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]+(?:[ .-][0-9]{2,}){0,8}(?![0-9])", _phone),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}([-./])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\2[0-9]{4})(?![0-9]|[./-][0-9])", _date),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", _ssn),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    ("card", r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9])", _card),
)
NAMES = tuple(k for k, _, _ in KINDS)
_POSSIBLE = re.compile(r"[0-9]|@")


def _compiled() -> re.Pattern[str]:
    groups, at = [], 1
    for name, pattern, _ in KINDS:
        inner = re.compile(pattern).groups
        groups.append(f"(?P<{name}>" + re.sub(r"\\([0-9])", lambda m, at=at: f"\\{int(m[1]) + at}", pattern) + ")")
        at += 1 + inner
    return re.compile("|".join(groups))


PATTERN = _compiled()
PATTERNS = {name: re.compile(pattern) for name, pattern, _ in KINDS}


def _ends(kind: str, m: re.Match[str]) -> list[int]:
    """Where a value that begins like this may end, the likeliest first."""
    if kind == "phone":
        end = _phone_end(m)
        return [] if end is None else [end]
    return _iban_ends(m) if kind == "iban" else [m.end()]


def replace_text(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """Text with valid values replaced, and how many of each kind; ``back`` inverts."""
    counts = dict.fromkeys(NAMES, 0)
    if not _POSSIBLE.search(text):
        return text, counts
    out, done, at = [], 0, 0
    while first := PATTERN.search(text, at):
        start = first.start()
        at = start + 1
        for name, _, replaced in KINDS[NAMES.index(first.lastgroup) :]:
            m = PATTERNS[name].match(text, start)
            ends = _ends(name, m) if m else []
            tries = ((end, replaced(text[start:end], key, back)) for end in ends)
            end, new = next((t for t in tries if t[1] is not None), (0, None))
            if new is not None:
                earlier = ends[: ends.index(end)]
                # what is valid with another end would not be found again, so it is walked over
                while any(replaced(new[: e - start] + text[end:e], key, back) is not None for e in earlier):
                    new = replaced(new, key, back)
                out += [text[done:start], new]
                counts[name] += 1
                done = at = end
                break
    return "".join([*out, text[done:]]), counts


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", counted: bool = True) -> DataFrame:
    """``docs`` with its texts replaced; ``counted`` adds ``n_mail, n_iban, ...`` (long).

    Whole texts are searched. NULL texts stay NULL and empty ones empty, with counts of zero. All other columns pass
    unchanged; columns of ``docs`` named like a count are replaced. Repeated rows are treated alike. One row needs
    memory for its own text only; nothing is shuffled, and a lost task gives the same result again.
    """
    added = [f"n_{k}" for k in NAMES] if counted else []
    docs = docs.drop(*added)
    names = docs.columns
    at = names.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(it):
            done = [(None, dict.fromkeys(NAMES, 0)) if t is None else replace_text(t, key) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            if counted:
                columns += [pa.array([c[k] for _, c in done], pa.int64()) for k in NAMES]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{a} bigint" for a in added)])
    return docs.mapInArrow(batches, schema)
