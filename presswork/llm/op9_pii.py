"""Operator 9: format-preserving pseudonyms for personal data and secrets.

Values are found by pattern and validated (checksum, range, calendar), and each is replaced by the value that a
keyed Feistel permutation of its own format's domain gives. A permutation has an inverse under the key
(`restore_text`), and equal values get equal pseudonyms in all documents, so records stay linked. What is found:

- card numbers: 13 to 19 digits, the first 2 to 6, with a right check digit, in one or in groups; these stay so. Other
  numbers stay as they are, and no pseudonym is one of them
- IBANs with right check digits, which stay right, also before words and numbers that look like further groups
- telephone numbers with a country code (8 to 15 digits) or in North American form, also with spaces or a leading 1: the country code stays,
  and one number maps alike however it is grouped
- IPv4 addresses; social security numbers in their valid ranges
- dates of the calendar, 1900 to 2099, in numbers (year first, or day or month first) or with an English month name, days
  and months of one or two digits, also joined to others: another date, written alike. Dates with a day over 12, and those
  with a number under 10, change places among themselves, so what is written can be read back
- the local part of e-mail addresses: letters for letters, digits for digits
- access key ids, and values of six characters or more named as passwords, tokens, secrets or API keys, if they aren't plain
  words (a digit, a sign, or a capital behind a small letter): punctuation stays

Values of more than 64 characters are permuted in pieces, forwards and then backwards, each keyed by those before it, so
that time grows with length and every character changes under the key.

There is no shuffle. Nulls and odd input: a null text stays null, an empty one empty, with 0 replacements; an empty table
gives an empty table. Texts are read in one pass, so a text of a megabyte without spaces takes seconds. Values of one
digit or letter that can't differ stay. Repeated rows get equal pseudonyms. All columns are kept, whatever their names, but for those of
the result's names. `restore_text` gives back every value; of a date with a month's name it may write the name's other form
(Sept and Sep, Mar and March by way of May) or a day without its leading 0.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import table

ROUNDS = 8
DEFAULT_KEY = "presswork"
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to the end of 2099


def _stream(secret: bytes, number: int, data: bytes, size: int) -> bytes:
    """`size` bytes of a keyed function of `data`, block by block."""
    out = hashlib.blake2b(data, key=secret, salt=bytes([number]), digest_size=min(64, size)).digest()
    if size > 64:
        out = b"".join(hashlib.blake2b(out, key=secret, salt=bytes([number]), person=i.to_bytes(8, "big")).digest() for i in range(-(-size // 64)))
    return out[:size]


def permute(value: int, size: int, key: str, kind: str, inverse: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network, with cycle-walking back into the domain."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    secret = hashlib.blake2b(f"{key}\x00{kind}\x00{size}".encode("utf-8", "surrogatepass"), digest_size=32).digest()
    mixed = lambda x, i: int.from_bytes(_stream(secret, i, x.to_bytes(width, "big"), width), "big") & mask
    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            left, right = (right ^ mixed(left, i), left) if inverse else (right, left ^ mixed(right, i))
        value = left << half | right
        if value < size:
            return value


@dataclass(frozen=True)
class Cipher:
    """A key, and whether pseudonyms are made or taken back."""

    key: str
    inverse: bool = False

    def permute(self, value: int, size: int, kind: str) -> int:
        return permute(value, size, self.key, kind, self.inverse)


def _digits(text: str, key: Cipher, kind: str) -> str:
    return str(key.permute(int(text), 10 ** len(text), f"{kind}{len(text)}")).zfill(len(text)) if text else text


def _refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def luhn_digit(body: str) -> int:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
    return -total % 10


def _is_card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return digits[0] in "23456" and int(digits[-1]) == luhn_digit(digits[:-1])


def _card(text: str, key: Cipher) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not _is_card(text):
        return None
    body = digits[0] + _digits(digits[1:-1], key, "card" + digits[0])
    return _refill(text, body + str(luhn_digit(body)))


def iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


PIECE = 64


def _piece(text: str, key: Cipher, kind: str, alphabets: tuple[str, ...]) -> str:
    """Every character for one of its own alphabet, all in one permutation; others stay."""
    number, size, used = 0, 1, []
    for c in text:
        own = next((a for a in alphabets if c in a), None)
        used.append(own)
        if own:
            number, size = number * len(own) + own.index(c), size * len(own)
    if size == 1:
        return text
    shape = "".join(a[0] if a else c for c, a in zip(text, used, strict=True))
    number = key.permute(number, size, kind + shape)
    out = []
    for c, own in zip(reversed(text), reversed(used), strict=True):
        if own:
            number, at = divmod(number, len(own))
            c = own[at]
        out.append(c)
    return "".join(reversed(out))


def _chained(pieces: list[str], key: Cipher, kind: str, alphabets: tuple[str, ...]) -> list[str]:
    """Each piece keyed by what all pieces before it have become."""
    seen, out = hashlib.blake2b(kind.encode("utf-8", "surrogatepass"), digest_size=16), []
    for piece in pieces:
        new = _piece(piece, key, kind + seen.hexdigest(), alphabets)
        out.append(new)
        seen.update((piece if key.inverse else new).encode("utf-8", "surrogatepass"))
    return out


def _classes(text: str, key: Cipher, kind: str, alphabets: tuple[str, ...] = _ALPHABETS) -> str:
    """A permutation of the texts of one shape; long ones go in pieces, forwards, then backwards."""
    if len(text) <= PIECE:
        return _piece(text, key, kind, alphabets)
    pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    passes = (lambda p: _chained(p, key, kind + "|>", alphabets), lambda p: _chained(p[::-1], key, kind + "|<", alphabets)[::-1])
    for step in reversed(passes) if key.inverse else passes:
        pieces = step(pieces)
    return "".join(pieces)


#: Lengths by country, of the registry. Others are tried at every length.
_IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


def _iban_reading(text: str) -> int:
    """How many characters at the start of the text are an IBAN: of the country's length, else the longest to a word's end that is right; or 0."""
    ends = [m.start() for m in re.finditer(r"(?<=\w)(?!\w)", text)]
    known = _IBAN_LENGTHS.get(text[:2])
    for end in sorted(ends, key=lambda e: (len(text[:e].replace(" ", "")) != known, -e)):
        plain = text[:end].replace(" ", "")
        if len(plain) >= 15 and int(plain[2:4]) == iban_check(plain[:2], plain[4:]):
            return end
    return 0


def _iban(text: str, key: Cipher) -> str:
    plain = text.replace(" ", "")
    country, body = plain[:2], _classes(plain[4:], key, "iban" + plain[:2])
    new = iter(f"{country}{iban_check(country, body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _ip(text: str, key: Cipher) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    new = key.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


def _ssn(text: str, key: Cipher) -> str | None:
    valid = lambda a, g, s: a not in (0, 666) and a < 900 and g > 0 and s > 0
    number = tuple(map(int, text.split("-")))
    if not valid(*number):
        return None
    value = number[0] * 10**6 + number[1] * 10**4 + number[2]
    while True:
        value = key.permute(value, 10**9, "ssn")
        if valid(a := value // 10**6, g := value // 10**4 % 100, s := value % 10**4):
            return f"{a:03d}-{g:02d}-{s:04d}"


def _date(year: str, month: str, day: str, key: Cipher) -> tuple[int, int, int] | None:
    try:
        date = datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None
    at = date.toordinal() - _DAY0
    if not 0 <= at < _DAYS:
        return None
    # What can be told from how the date is written has to stay: which number is the day, and whether one has a digit only.
    kind = lambda d: (d.day > 12, d.day < 10 or d.month < 10)
    while True:
        at = key.permute(at, _DAYS, "date")
        new = datetime.date.fromordinal(at + _DAY0)
        if kind(new) == kind(date):
            return new.year, new.month, new.day


def _written(shape: str, year: int, *rest: int) -> list[str]:
    """Numbers of a date, day and month without zeros where the shape has one of one digit."""
    width = 1 if re.search(r"(?<!\d)\d(?!\d)", shape) else 2
    return [f"{year:04d}", *(str(n).zfill(width) for n in rest)]


def _iso_date(text: str, key: Cipher) -> str | None:
    parts = re.split(r"\D", text)
    new = _date(*parts, key)
    return None if new is None else text[4].join(_written(text, *new))


def _day_date(text: str, key: Cipher) -> str | None:
    """Day first where that is a date, else month first."""
    a, b, year = re.split(r"\D", text)
    if (new := _date(year, b, a, key)) is not None:
        return re.search(r"\D", text).group().join(reversed(_written(text, *new)))
    if (new := _date(year, a, b, key)) is not None:
        year, month, day = _written(text, *new)
        return re.search(r"\D", text).group().join((month, day, year))
    return None


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?"
_ORDINAL = r"(?i:st|nd|rd|th)?"


def _named_date(text: str, key: Cipher) -> str | None:
    """With the month's name, short where it was short (May counts as long), in capitals or small letters as it was."""
    word = re.search(r"[A-Za-z]{3,}", text).group()
    month = next(i for i, name in enumerate(_MONTHS, 1) if name[:3].lower() == word[:3].lower())
    year, day = re.search(r"\d{4}", text).group(), re.search(r"(?<!\d)\d{1,2}(?!\d)", text).group()
    if (new := _date(year, str(month), day, key)) is None:
        return None
    name = _MONTHS[new[1] - 1]
    name = name[:3] if len(word) < 5 and word.lower() not in ("may", "june", "july") else name
    name = name.upper() if word.isupper() else name.lower() if word.islower() else name
    suffix = "th" if new[2] in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(new[2] % 10, "th")

    def put(match: re.Match) -> str:
        if match["year"]:
            return f"{new[0]:04d}"
        if match["word"]:
            return name
        number = f"{new[2]:02d}" if match["day"][0] == "0" else str(new[2])
        return number + ((suffix.upper() if match["nth"].isupper() else suffix) if match["nth"] else "")

    return re.sub(rf"(?P<year>\d{{4}})|(?P<day>\d{{1,2}})(?P<nth>{_ORDINAL})|(?P<word>[A-Za-z]{{3,}})", put, text)


# Country calling codes of one and two digits; all others have three.
_SHORT_CODES = {"1", "7"} | set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(text: str, key: Cipher) -> str | None:
    """The digits behind the country code are permuted, wherever groups end; a 0 in brackets stays.

    An international number has 8 to 15 digits; what has fewer or more is a row of numbers.
    """
    digits = re.sub(r"\D", "", text)
    if text[0] == "+" and not 8 <= len(digits) <= 15:
        return None
    code = "1" if re.match(r"1[ .-]", text) else ""
    if text[0] == "+":
        code = next((digits[:n] for n in (1, 2) if digits[:n] in _SHORT_CODES), digits[:3])
    at = re.match(r"\D*" + r"\D*".join(code), text).end() if code else 0
    at += trunk.end() if (trunk := re.match(r"[ .-]?\(0\)", text[at:])) and code else 0
    rest = text[at:]
    return text[:at] + _refill(rest, _digits(re.sub(r"\D", "", rest), key, "phone" + (code or "1")))


def _email(text: str, key: Cipher) -> str:
    local, at, host = text.rpartition("@")
    return _classes(local, key, "mail") + at + host


def _is_secret(value: str) -> bool:
    """Not a plain word: with a digit, a sign that words don't have, or capitals behind small letters."""
    word = value.rstrip(".:!?)]}…")
    return re.search(r"[0-9]|[a-z][A-Z]|[^\w'’.:-]", word) is not None


def _secret(text: str, key: Cipher) -> str | None:
    head = re.match(r"(?i)[a-z_ -]+?\s*[:=]\s*[\"']?", text).group()
    value = text[len(head) :]
    if not _is_secret(value):
        return None
    is_hex = lambda x: re.fullmatch(r"[0-9a-f]+", x) is not None
    small = is_hex(value)
    while True:
        value = _classes(value, key, "hex", ("0123456789abcdef",)) if small else _classes(value, key, "secret")
        if is_hex(value) == small and _is_secret(value):
            return head + value


_KINDS = [
    ("mail", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("secret", r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key))\s*[:=]\s*[\"']?(?:[^\s\"'<>&,;]|[&,;](?![\s\"'<>]|$|[\w.-]+=)){6,}", _secret),
    ("key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", lambda t, k: t[:4] + _classes(t[4:], k, "key", ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",))),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("isodate", r"(?<!\d)(?<!\d\.)(?:19|20)\d\d(?P<s1>[-/.])\d\d?(?P=s1)\d\d?(?!\d)", _iso_date),
    ("daydate", r"(?<!\d)(?<!\d\.)\d\d?(?P<s2>[-/.])\d\d?(?P=s2)(?:19|20)\d\d(?!\d)", _day_date),
    (
        "namedate",
        rf"\b{_MONTH}[ /-]?\d\d?{_ORDINAL}(?:, ?|[ /-])(?:19|20)\d\d(?!\d)|(?<!\d)\d\d?{_ORDINAL}(?:[ /-]|\. ?| of ){_MONTH}(?:, ?|[ /-])(?:19|20)\d\d(?!\d)|(?<!\d)(?:19|20)\d\d(?:, ?|[ /-]){_MONTH}[ /-]\d\d?(?!\d)",
        _named_date,
    ),
    ("ssn", r"(?<!\d)(?<!\d-)\d{3}-\d\d-\d{4}(?!\d)(?!-\d)", _ssn),
    ("card", r"(?<!\d)(?:\d{13,19}|\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,7}|\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5})(?!\d)", _card),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)", _ip),
    (
        "phone",
        r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)(?:1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\d)(?<!\d-)(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)(?!-\d)",
        _phone,
    ),
]
_PATTERN = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in _KINDS))
_REPLACE = {name: f for name, _, f in _KINDS}
_HINT = re.compile(r"[0-9@]|AKIA|ASIA|(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)")


@lru_cache(maxsize=50_000)
def _pseudonym(kind: str, text: str, key: Cipher) -> tuple[str, int]:
    """The pseudonym of the value at the start of the text, and the value's length; 0 where it isn't valid."""
    used = _iban_reading(text) if kind == "iban" else len(text)
    new = _REPLACE[kind](text[:used], key) if used else None
    return ("", 0) if new is None else (new, used)


def _replaced(text: str | None, key: Cipher) -> tuple[str | None, int]:
    if not text or not _HINT.search(text):
        return text, 0
    count, out, done, at, wrong = 0, [], 0, 0, 0
    while match := _PATTERN.search(text, at):
        kind, start = match.lastgroup, match.start()
        # Long values aren't kept for the next time.
        new, used = (_pseudonym if len(match.group()) <= 256 else _pseudonym.__wrapped__)(kind, match.group(), key)
        if used:
            at = start + used
            out += (text[done:start], new)
            count += new != text[start:at]
            done = at
        elif kind == "card" and start < wrong:
            at = match.end()  # part of an IBAN that isn't right
        elif kind != "iban":
            at = start + 1  # not a date of the calendar, or a number that isn't right
        else:
            at, wrong = start + 4, match.end()  # behind country and check digits: what follows may be another value
    return "".join(out) + text[done:], count


def pseudonymise_text(text: str | None, key: str) -> tuple[str | None, int]:
    """The text with all values replaced, and how many were."""
    return _replaced(text, Cipher(key))


def restore_text(text: str | None, key: str) -> str | None:
    """The text that `pseudonymise_text` made this one from, under the same key."""
    return _replaced(text, Cipher(key, inverse=True))[0]


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, text_column: str = "text", count_column: str = "n_replaced") -> DataFrame:
    """The documents with pseudonyms in their texts, and the number of values replaced."""

    @F.pandas_udf("text string, n long")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pseudonymise_text(t if isinstance(t, str) else None, key) for t in texts], columns=["text", "n"])

    rest = [c for c in docs.columns if c not in (text_column, count_column)]
    done = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), run(F.col(text_column).cast("string")).alias("r"))
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), F.col("r.text").alias(text_column), F.col("r.n").alias(count_column))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
