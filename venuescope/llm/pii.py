"""Format-preserving pseudonyms for personal data.

Validated card numbers, bank accounts, phone numbers, social security numbers, network addresses, dates
and mail names are replaced by keyed permutations of their own format: a Feistel network over the
format's number range, walked until it lands in the range again. Equal values get equal pseudonyms in
every document, different values different ones, and the holder of the key can undo them. Checks stay
valid: a card number's last digit is worked out anew, a bank account's check digits too.

Nulls: a null text stays null and has no spans; a null id stays null. Repeated rows are treated alike.
An empty table gives an empty result. `pseudonymise` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "mail")
#: The setting that holds the key of the query, and the key of a demonstration, which everyone can undo.
KEY_SETTING, DEMONSTRATION = "spark.venuescope.pii.key", b"set a key of your own"
FIRST_DAY, DAYS = date(1900, 1, 1), 73_049  # to the end of 2099
LETTERS = "abcdefghijklmnopqrstuvwxyz"

PATTERN = re.compile(
    r"(?P<mail>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))"
    r"|(?P<date>(?<![\d./-])(?:\d{4}([-/.])\d{2}\5\d{2}|\d{2}([-/.])\d{2}\6\d{4})(?!\d|[./-]\d))"
    r"|(?P<phone>(?<![\d+])(?:\+1[ .-]?)?\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d+])(?:\+1[ .-]?)?\d{3}([-.])\d{3}\8\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ -]?\d{2,4}){2,5}(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)\d{13,19}(?!\d)|(?<!\d)\d{4}([ -])\d{4}\11\d{4}\11\d{1,7}(?!\d))"
)

HINT = re.compile("[0-9@]")


class Permutation:
    """Keyed bijections of range(n)."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _step(self, value: int, n: int, tweak: str, back: bool) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, size = (1 << half) - 1, half // 8 + 1
        left, right = value >> half, value & mask
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            side = left if back else right
            told = hashlib.blake2b(side.to_bytes(size + 1, "big") + bytes([i]) + f"{n}:{tweak}".encode(), key=self.key, digest_size=size + 8).digest()
            mixed = int.from_bytes(told, "big") & mask
            left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
        return left << half | right

    def of(self, value: int, n: int, tweak: str, back: bool = False) -> int:
        value = self._step(value, n, tweak, back)
        while value >= n:
            value = self._step(value, n, tweak, back)
        return value


def luhn_digit(digits: str) -> str:
    """The digit that makes digits + itself valid."""
    total = sum(int(c) if i % 2 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{account}{country}00')) % 97:02d}"


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _fill(shape: str, digits: str) -> str:
    """shape with its digits, from the right, replaced by digits."""
    left = list(digits)
    out = [left.pop() if c.isdigit() and left else c for c in reversed(shape)]
    return "".join(reversed(out))


class Pseudonyms:
    """Finds and replaces; `undo` finds the same formats and restores the originals."""

    def __init__(self, key: bytes):
        self.permutation = Permutation(key)

    def _number(self, digits: str, kind: str, back: bool) -> str:
        return str(self.permutation.of(int(digits), 10 ** len(digits), f"{kind}{len(digits)}", back)).zfill(len(digits))

    def card(self, value: str, back: bool) -> str | None:
        digits = _digits(value)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        own = self._number(digits[:-1], "card", back)
        while len(set(own + luhn_digit(own))) == 1:
            own = self._number(own, "card", back)
        return _fill(value, own + luhn_digit(own))

    def iban(self, value: str, back: bool) -> str | None:
        plain = value.replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if iban_check(country, account) != check:
            return None
        number, n = 0, 1
        for c in account:
            base, at = (10, int(c)) if c.isdigit() else (26, ord(c) - 65)
            number, n = number * base + at, n * base
        number = self.permutation.of(number, n, f"iban{re.sub('[A-Z]', 'A', re.sub('[0-9]', '0', account))}", back)
        out = ""
        for c in reversed(account):
            number, at = divmod(number, 10 if c.isdigit() else 26)
            out = (str(at) if c.isdigit() else chr(65 + at)) + out
        new = iter(country + iban_check(country, out) + out)
        return "".join(c if c == " " else next(new) for c in value)

    def ssn(self, value: str, back: bool) -> str | None:
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        digits = _digits(value)
        if not valid(digits):
            return None
        digits = self._number(digits, "ssn", back)
        while not valid(digits):
            digits = self._number(digits, "ssn", back)
        return _fill(value, digits)

    def phone(self, value: str, back: bool) -> str | None:
        digits = _digits(value)
        if value.startswith("+") and not value.startswith("+1"):
            if not 8 <= len(digits) <= 15:
                return None
            code = len(re.match(r"\+(\d{1,3}?)(?=[ -])|\+\d\d", value)[0]) - 1
            return _fill(value, self._number(digits[code:], "phone", back))
        return _fill(value, self._number(digits[-10:], "phone", back)) if len(digits) in (10, 11) else None

    def ip(self, value: str, back: bool) -> str | None:
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255 or any(x != str(int(x)) for x in value.split(".")):
            return None
        number = self.permutation.of(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
        return ".".join(map(str, number.to_bytes(4, "big")))

    def date(self, value: str, back: bool) -> str | None:
        sep = re.search(r"\D", value)[0]
        a, b, c = value.split(sep)
        orders = [(a, b, c, lambda d: (f"{d.year}", f"{d.month:02d}", f"{d.day:02d}"))] if len(a) == 4 else [(c, b, a, lambda d: (f"{d.day:02d}", f"{d.month:02d}", f"{d.year}"))]
        if len(a) == 2:
            orders = orders if sep != "/" else [(c, a, b, lambda d: (f"{d.month:02d}", f"{d.day:02d}", f"{d.year}")), *orders]
        for year, month, day, shape in orders:
            try:
                at = (date(int(year), int(month), int(day)) - FIRST_DAY).days
            except ValueError:
                continue
            if 0 <= at < DAYS:
                new = FIRST_DAY + timedelta(self.permutation.of(at, DAYS, "date", back))
                # A date that only reads day first walks on until its pseudonym only reads so too.
                while sep == "/" and len(a) == 2 and a > "12" and new.day < 13:
                    new = FIRST_DAY + timedelta(self.permutation.of((new - FIRST_DAY).days, DAYS, "date", back))
                return sep.join(shape(new))
        return None

    def mail(self, value: str, back: bool) -> str | None:
        name, _, domain = value.partition("@")
        number, n = 0, 1
        for c in name:
            base, at = (10, int(c)) if c in "0123456789" else (26, LETTERS.index(c.lower())) if c.isalpha() else (1, 0)
            number, n = number * base + at, n * base
        shape = re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", name))
        number = self.permutation.of(number, n, f"mail{shape}@{domain.lower()}", back) if n > 1 else 0
        out = ""
        for c in reversed(name):
            if c in "0123456789":
                number, at = divmod(number, 10)
                out = str(at) + out
            elif c.isalpha():
                number, at = divmod(number, 26)
                out = (LETTERS[at].upper() if c.isupper() else LETTERS[at]) + out
            else:
                out = c + out
        return f"{out}@{domain}"

    def replaced(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and the spans (kind, start, end) of the values in it."""
        found: list = []

        def one(m: re.Match) -> str:
            kind = m.lastgroup
            make: Callable = getattr(self, kind)
            new = make(m[kind], back)
            if new is None:
                return m[0]
            found.append((kind, m.start(), m.end()))
            return new

        return (PATTERN.sub(one, text) if HINT.search(text) else text), found

    def undo(self, text: str) -> str:
        return self.replaced(text, back=True)[0]


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """All columns of docs, the text with pseudonyms, and `spans`: kind:start:end of each value before, joined."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for b in batches:
            made = [(None, []) if t is None else own.replaced(t) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array([t for t, _ in made], pa.string())
            spans = pa.array([",".join(f"{k}:{s}:{e}" for k, s, e in found) for _, found in made], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, spans], [*names, "spans"])

    schema = docs.toDF(*names).withColumn("spans", F.lit("")).schema
    return docs.toDF(*names).mapInArrow(tidy(run), schema).toDF(*docs.columns, spans_col)
