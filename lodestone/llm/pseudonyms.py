"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

Validated numbers and dates are replaced by others of the same format: payment cards (issuer prefix and Luhn digit stay valid), phone numbers, IPv4 addresses,
social security numbers, bank account numbers (IBAN; country and check digits stay valid), calendar dates, with English names of months too, and the letters and
digits of mail addresses. Each format is a range 0..n-1 which the key permutes, so equal values get equal pseudonyms in all documents, and different values
different ones. Numbers that fail validation stay as they are. Dates of all forms share one calendar, so a day is the same pseudonym however it is written; as a date
with slashes is read month first, or day first if its first number is over 12, days up to the 12th and later ones are permuted among themselves. Mail addresses
have at most 64 characters before the sign, as their standard says.

Defined results: null text stays null with no spans; empty texts stay empty; repeated rows get equal results; whole texts are read, in time proportional to
their length; an empty table gives no rows; other columns are kept, but for one named pii_spans, which the result replaces.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


class Permutation:
    """Keyed permutations of 0..n-1, one for every tweak (the name of a format)."""

    def __init__(self, key: bytes):
        self.key = key

    @functools.lru_cache(maxsize=65536)  # noqa: B019  lives as long as its worker
    def __call__(self, tweak: str, value: int, n: int) -> int:
        """value's image: a balanced Feistel network over the next even number of bits, walked until it is below n."""
        if n <= 1:
            return value
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, size = (1 << half) - 1, (half + 7) // 8
        while True:
            left, right = value >> half, value & mask
            for r in range(ROUNDS):
                mixed = hmac.digest(self.key, f"{tweak}|{n}|{r}|".encode() + right.to_bytes(size, "big"), "sha256")
                while len(mixed) < size:
                    mixed += hashlib.sha256(mixed).digest()
                left, right = right, left ^ (int.from_bytes(mixed[:size], "big") & mask)
            value = left << half | right
            if value < n:
                return value


def luhn_digit(digits: str) -> str:
    """The check digit behind digits."""
    odd, even = map(int, digits[::-1][::2]), map(int, digits[::-1][1::2])
    return str(-(sum(2 * d - 9 * (d > 4) for d in odd) + sum(even)) % 10)


#: Issuer prefixes and the lengths of their card numbers.
CARD = re.compile(r"(?:(4)\d{12}(?:\d{3}){0,2}|(5[1-5])\d{14}|(2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720))\d{12}|(3[47])\d{13}|(6011|65\d\d)\d{12})")
#: The months' names and their usual short forms.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
SHORT = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH = "|".join((*MONTHS, *SHORT))
#: What is looked at, by kind; each is validated before it is replaced.
FOUND = re.compile(
    r"(?:(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<mail>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,10}\.[A-Za-z]{2,63}))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\w-]))"
    rf"|(?P<named>(?<!\w)(?:\d{{1,2}} (?:{MONTH}),? \d{{4}}|(?:{MONTH}) \d{{1,2}},? \d{{4}})(?!\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{2,4}\)(?:[ .-]?\d{3,4}){2}|(?:[ .-]?(?!\d{1,3}(?:\.\d{1,3}){3})\d{2,4}){2,4})(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|\d{4}(?P<r>[ -])\d{6}(?P=r)\d{5})(?![\w-]))",
    re.ASCII,
)
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DATE_FORM = {"-": "%Y-%m-%d", "/": "%Y/%m/%d", ".": "%d.%m.%Y", "//": "%m/%d/%Y", "d": "%d/%m/%Y"}


def relaid(layout: str, digits: str) -> str:
    """layout with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in layout)


def card(s: str, permute: Permutation) -> str | None:
    digits = re.sub(r"\D", "", s)
    m = CARD.fullmatch(digits)
    if not m or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    prefix = next(g for g in m.groups() if g)
    free = digits[len(prefix) : -1]
    new = prefix + str(permute(f"card{prefix}", int(free), 10 ** len(free))).zfill(len(free))
    return relaid(s, new + luhn_digit(new))


def phone(s: str, permute: Permutation) -> str | None:
    digits = re.sub(r"\D", "", s)
    own = len(digits) - (re.match(r"\+(\d{1,3})", s) is not None) * len(re.match(r"\+?(\d*)", s)[1]) if re.match(r"\+\d{1,3}[ .(-]", s) else min(len(digits), 10)
    if not 7 <= own <= 12 or len(digits) > 15:
        return None
    return relaid(s, digits[: len(digits) - own] + str(permute("phone", int(digits[-own:]), 10**own)).zfill(own))


def ip(s: str, permute: Permutation) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    n = permute("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, n.to_bytes(4, "big")))


def ssn(s: str, permute: Permutation) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    n = permute("ssn", (areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999)
    return f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


@functools.cache
def calendar(early: bool) -> list[int]:
    """The days (ordinals) up to the 12th of their months, or the later ones."""
    return [d for d in range(FIRST_DAY, LAST_DAY + 1) if (datetime.date.fromordinal(d).day <= 12) == early]


def other_day(day: datetime.date, permute: Permutation) -> datetime.date | None:
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    early = day.day <= 12
    days = calendar(early)
    return datetime.date.fromordinal(days[permute(f"date{early:d}", bisect.bisect_left(days, day.toordinal()), len(days))])


def date(s: str, permute: Permutation) -> str | None:
    form = DATE_FORM["-" if "-" in s else "." if "." in s else "/" if s[4] == "/" else "//" if int(s[:2]) <= 12 else "d"]
    try:
        new = other_day(datetime.datetime.strptime(s, form).date(), permute)
    except ValueError:
        return None
    return new and form.replace("%Y", f"{new.year:04d}").replace("%m", f"{new.month:02d}").replace("%d", f"{new.day:02d}")


def named(s: str, permute: Permutation) -> str | None:
    """A date with a month's name, long or short as it was; the day has as many digits as it needs."""
    name, (first, second) = re.search(MONTH, s)[0], re.findall(r"\d+", s)
    names = MONTHS if name in MONTHS and name != "May" else SHORT if len(name) == 3 and name != "May" else MONTHS
    try:
        new = other_day(datetime.date(int(second), names.index(name) + 1, int(first)), permute)
    except ValueError:
        return None
    return new and re.sub(rf"{MONTH}|\d+", lambda m: names[new.month - 1] if m[0] == name else f"{new.year:04d}" if m.start() and len(m[0]) == 4 else str(new.day), s)


def iban(s: str, permute: Permutation) -> str | None:
    """Validated by its check digits; letters and digits are permuted within their classes, and the check digits follow."""
    plain = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    own, value, n = plain[4:], 0, 1
    for c in own:
        base = 10 if c.isdigit() else 26
        value, n = value * base + (int(c) if c.isdigit() else ord(c) - 65), n * base
    new, out = permute(f"iban{plain[:2]}{re.sub('[A-Z]', 'A', re.sub('[0-9]', '0', own))}", value, n), []
    for c in reversed(own):
        new, k = divmod(new, 10 if c.isdigit() else 26)
        out.append(str(k) if c.isdigit() else chr(65 + k))
    own = "".join(reversed(out))
    made = iter(f"{plain[:2]}{98 - number(own + plain[:2] + '00') % 97:02d}{own}")
    return "".join(c if c == " " else next(made) for c in s)


def mail(s: str, permute: Permutation) -> str | None:
    """The local part's letters and digits, each within its class; the domain stays."""
    local, at, domain = s.partition("@")
    low, value, n = local.lower(), 0, 1
    for c in low:
        if c.isalpha() or c.isdigit():
            base = 26 if c.isalpha() else 10
            value, n = value * base + (ord(c) - 97 if c.isalpha() else int(c)), n * base
    shape = re.sub(r"[a-z]", "a", re.sub(r"\d", "0", low))
    new, out = permute(f"mail{shape}@{domain.lower()}", value, n), []
    for c, is_ in zip(reversed(low), reversed(local), strict=True):
        if c.isalpha() or c.isdigit():
            new, k = divmod(new, 26 if c.isalpha() else 10)
            c = (chr(97 + k).upper() if is_.isupper() else chr(97 + k)) if c.isalpha() else str(k)
        out.append(c)
    return "".join(reversed(out)) + at + domain


KINDS: dict[str, Callable[[str, Permutation], str | None]] = {"mail": mail, "ip": ip, "date": date, "named": named, "iban": iban, "ssn": ssn, "phone": phone, "card": card}
SPAN = "array<struct<kind: string, start: long, end: long, pseudonym: string>>"


def pseudonymised(text: str, permute: Permutation) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and what was replaced: kind, start and end in the text as it was (code points), pseudonym."""
    out, at, spans, m = [], 0, [], FOUND.search(text)
    while m:
        kind = m.lastgroup
        start, end = m.span(kind)
        new = KINDS[kind](m[kind], permute)
        if new is not None:
            out += [text[at:start], new]
            at = end
            spans.append({"kind": kind, "start": start, "end": end, "pseudonym": new})
        m = FOUND.search(text, start + 1 if new is None else at)  # what is not valid as a whole may hold something that is
    return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, and a column pii_spans."""
    kept = [c for c in docs.columns if c not in (text_col, "pii_spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Permutation(key.encode())
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))
        for b in batches:
            own = [(None, []) if (t := x.as_py()) is None else pseudonymised(t, permute) for x in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x[0] for x in own], pa.string()), pa.array([x[1] for x in own], kind)], names=[*b.schema.names[:-1], text_col, "pii_spans"])

    d = docs.select(*kept, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields) + f", pii_spans {SPAN}"
    return d.mapInArrow(run, schema).select(*[c for c in docs.columns if c != "pii_spans"], "pii_spans")
