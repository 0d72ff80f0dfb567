"""Format-preserving pseudonyms: validated numbers and dates, permuted with a key inside their format.

Each value found becomes a number of a finite domain (all values of that format), a keyed Feistel
network permutes the domain, and the result is written in the layout of the original. Equal values
therefore stay equal in all documents, different ones stay different, lengths and separators stay,
and checksums hold again. Kinds, with what makes a value valid:

* card: 13 to 19 digits in a row or in groups with a right Luhn digit; the first digit stays
* iban: country, check digits mod 97; letters of the account part stay
* ssn: three-two-four digits with a possible area, group and serial
* date: a calendar day of 1900 to 2099, as y-m-d, y/m/d, d.m.y, m/d/y (or d/m/y if m > 12)
* phone: 7 to 15 digits with a country code or area code in a usual layout; the country code stays
* ip: four numbers up to 255 without leading zeros, none of the unspecified, loopback and broadcast ones
* email: letters and digits of the local part; the domain is the tweak

A value ends where no digit or letter touches it; a digit beyond a sign of its own layout (a decimal point
for cards) makes it part of something longer, other signs do not: values stand in lists, time stamps and
before ports. Where groups of digits follow, the longest valid length counts.

Null texts stay null with no finding; empty texts stay empty; texts without a valid value come back
unchanged. The number of characters never changes. Repeated rows get equal results.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: Feistel rounds on value = left * b + right, cycle-walked."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)

    def round_value(r: int, half: int, modulus: int) -> int:
        text = f"{tweak}|{size}|{r}|{half}".encode()
        digest = hashlib.blake2b(text, key=key, digest_size=32).digest()
        return int.from_bytes(digest, "big") % modulus

    while True:
        left, right = divmod(value, b)
        for r in range(ROUNDS):
            if r % 2:
                right = (right + round_value(r, left, b)) % b
            else:
                left = (left + round_value(r, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """Sum of the Luhn scheme modulo 10 (0: valid)."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def lay(template: str, symbols: str, kind: str = "0123456789") -> str:
    """The template with its characters of `kind` replaced in order."""
    rest = iter(symbols)
    return "".join(next(rest) if c in kind else c for c in template)


def only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _digits(payload: str, key: bytes, tweak: str) -> str:
    return str(permute(int(payload), 10 ** len(payload), key, tweak)).zfill(len(payload)) if payload else ""


def card(m: re.Match, key: bytes) -> str | None:
    digits = only_digits(m[0])
    if not 13 <= len(digits) <= 19 or luhn(digits) or not int(digits):
        return None
    body = digits[0] + _digits(digits[1:-1], key, "card" + digits[0])
    return lay(m[0], body + str((10 - luhn(body + "0")) % 10))


def iban_rest(country: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def iban(m: re.Match, key: bytes) -> str | None:
    plain = m[0].replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or 98 - iban_rest(country, account) != int(check):
        return None
    letters = re.sub(r"[0-9]", "#", account)
    account = lay(letters, _digits(only_digits(account), key, f"iban{country}{letters}"), "#")
    made = f"{country}{98 - iban_rest(country, account):02d}{account}"
    return lay(re.sub(r"[^ ]", "#", m[0]), made, "#")


def ssn(m: re.Match, key: bytes) -> str | None:
    area, group, serial = map(int, m[0].split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    if area not in areas or not group or not serial:
        return None
    value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(permute(value, len(areas) * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(value, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


FIRST_DAY, DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def date(m: re.Match, key: bytes) -> str | None:
    parts = re.split(r"([-/.])", m[0])
    numbers, sign = [int(p) for p in parts[::2]], parts[1]
    if len(parts[0]) == 4:
        order = "ymd"
    elif sign == "/" and numbers[0] <= 12:
        order = "mdy"
    else:
        order = "dmy"
    at = {c: numbers[i] for i, c in enumerate(order)}
    try:
        day = dt.date(at["y"], at["m"], at["d"])
    except ValueError:
        return None
    widths = [len(p) for p in parts[::2]]
    value = (day - FIRST_DAY).days
    if not 0 <= value < DAYS:
        return None
    while True:  # walk on until the day fits the widths of the original and reads in the same order
        value = permute(value, DAYS, key, f"date{order}{sign}{widths}")
        new = FIRST_DAY + dt.timedelta(days=value)
        made = {"y": new.year, "m": new.month, "d": new.day}
        fits = all(len(str(made[c])) <= w and (w != 1 or made[c] < 10) for c, w in zip(order, widths))
        if fits and not (order == "dmy" and sign == "/" and new.day <= 12):
            return sign.join(str(made[c]).zfill(w) for c, w in zip(order, widths))


def phone(m: re.Match, key: bytes) -> str | None:
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+1|", m[0])[0]
    rest = m[0][len(code) :]
    digits = only_digits(rest)
    if not 7 <= len(digits) <= 15 - len(code[1:]):
        return None
    return code + lay(rest, _digits(digits, key, "phone" + code))


def ip(m: re.Match, key: bytes) -> str | None:
    octets = m[0].split(".")
    if any(int(o) > 255 or str(int(o)) != o for o in octets) or m[0] in ("0.0.0.0", "127.0.0.1", "255.255.255.255"):
        return None
    low, many = [0, 0, 10, 100], [0, 10, 90, 156]  # first value and number of values by width
    value, size = 0, 1
    for o in octets:
        value, size = value * many[len(o)] + int(o) - low[len(o)], size * many[len(o)]
    value = permute(value, size, key, "ip" + str([len(o) for o in octets]))
    out = []
    for o in reversed(octets):
        value, rest = divmod(value, many[len(o)])
        out.append(str(low[len(o)] + rest))
    return ".".join(reversed(out))


def email(m: re.Match, key: bytes) -> str | None:
    local, domain = m[0].rsplit("@", 1)
    radix = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in local]
    value, size = 0, 1
    for c, r in zip(local.lower(), radix):
        value, size = value * r + (ord(c) - ord("a") if r == 26 else int(c) if r == 10 else 0), size * r
    shape = "".join("a" if r == 26 else "0" if r == 10 else c for c, r in zip(local, radix))
    value = permute(value, size, key, f"email{shape}@{domain.lower()}")
    out = []
    for c, r in zip(reversed(local), reversed(radix)):
        value, rest = divmod(value, r)
        new = chr(ord("a") + rest) if r == 26 else str(rest) if r == 10 else c
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out)) + "@" + domain


def edged(pattern: str, signs: str = "", letters: str = "A-Za-z") -> str:
    """The pattern where no digit or letter touches it, nor a digit beyond one of the signs that would
    make it part of a longer value of its kind."""
    before, after = (f"(?<![0-9][{signs}])", f"(?![{signs}][0-9])") if signs else ("", "")
    return f"(?<![0-9A-Za-z]){before}(?:{pattern})(?![0-9{letters}]){after}"


def _card(sign: str) -> str:
    return "[0-9]{4}S[0-9]{4}S[0-9]{4}S[0-9]{1,7}|[0-9]{4}S[0-9]{6}S[0-9]{5}".replace("S", sign)


def _date(pattern: str, sign: str) -> str:
    """A time may follow: T and digits."""
    return edged(pattern.replace("S", re.escape(sign)), sign, "A-SU-Za-su-z") + "(?![Tt](?![0-9]))"


YMD, DMY = "[0-9]{4}S[0-9]{1,2}S[0-9]{1,2}", "[0-9]{1,2}S[0-9]{1,2}S[0-9]{4}"
PHONE_STOP = r"(?![0-9A-Za-z])(?![.-][0-9])"
KINDS = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,63}(?![A-Za-z0-9-])"), email),
    ("iban", re.compile(edged("[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)")), iban),
    ("card", re.compile(edged("[0-9]{13,19}|" + _card(" "), ".") + "|" + edged(_card("-"), ".-")), card),
    ("ssn", re.compile(edged("[0-9]{3}-[0-9]{2}-[0-9]{4}", "-")), ssn),
    ("date", re.compile("|".join(_date(p, sign) for p, sign in ((YMD, "-"), (YMD, "/"), (DMY, "."), (DMY, "/")))), date),
    ("phone", re.compile(
        r"(?<![0-9A-Za-z+])(?<![0-9][.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})" + PHONE_STOP
        + r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-][0-9]{2,8}){2,5}" + PHONE_STOP
        + r"|(?<![0-9A-Za-z+])\+[0-9]{8,15}" + PHONE_STOP), phone),
    ("ip", re.compile(edged(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", ".")), ip),
]
ANY_DIGIT = re.compile(r"[0-9]")


def pseudonymise(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with its valid values permuted, and the kinds found in text order."""
    if not ANY_DIGIT.search(text) and "@" not in text:
        return text, []
    found: list[tuple[int, int, str, str]] = []
    for name, pattern, fn in KINDS:
        if name == "email" and "@" not in text:
            continue
        taken = sorted((a, b) for a, b, _, _ in found)
        k = at = 0
        while m := pattern.search(text, at):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            start, end, free = m.start(), m.end(), taken[k][0] if k < len(taken) else len(text)
            new = fn(m, key) if end <= free else None
            while new is None and end > start:  # shorter lengths of the same start, without the last groups
                end = text.rfind(" ", start, end)
                shorter = pattern.fullmatch(text, start, end) if start < end <= free else None
                new = fn(shorter, key) if shorter else None
            if new is not None:
                found.append((start, end, name, new))
            at = end if new is not None else start + 1
    out, at = [], 0
    for a, b, _, new in sorted(found):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [name for _, _, name, _ in sorted(found)]


def pseudonyms(text: Column, key: bytes) -> Column:
    """struct(text, kinds): the changed text (null stays null) and the kinds of the values found."""

    @F.arrow_udf("text string, kinds array<string>")
    def changed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cached = functools.lru_cache(maxsize=1)(lambda t: pseudonymise(t, key))
        for texts in batches:
            rows = [(None, []) if t is None else cached(t) for t in texts.to_pylist()]
            new = pa.array([r[0] for r in rows], pa.string())
            kinds = pa.array([r[1] for r in rows], pa.list_(pa.string()))
            yield pa.StructArray.from_arrays([new, kinds], names=["text", "kinds"])

    return changed(text.cast("string"))


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", kinds: str | None = None) -> DataFrame:
    """The documents with `text` changed; `kinds` names a column to hold what was found."""
    if not 1 <= len(key) <= 64:
        raise ValueError("the key needs 1 to 64 bytes")
    made = docs.withColumn("_pseudonyms", pseudonyms(F.col(text), key))
    out = made.withColumn(text, F.col("_pseudonyms.text"))
    return (out.withColumn(kinds, F.col("_pseudonyms.kinds")) if kinds else out).drop("_pseudonyms")
