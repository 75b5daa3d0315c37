"""Format-preserving pseudonyms of personal data, by Feistel networks under a key.

Only valid values are replaced: card numbers by their check digit, addresses by their ranges, dates by the calendar, and
so on. Each is permuted within its own format, so a pseudonym looks like what it stands for, as wide as it, and equal
values, wherever they occur and however they are grouped or spelled out, get equal pseudonyms.
"""

import hashlib
import hmac
import re
import secrets
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date
from functools import cache, lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release

ROUNDS = 10
KEY_SETTING = "spark.proofmark.pseudonymKey"


def key_of(spark: SparkSession) -> bytes:
    """The session's key. A session without one draws its own, at random: its pseudonyms can't be traced back by anybody who
    reads this, and link values within the session, but not with those of another."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


class Permuter:
    """Keyed permutations of 0 .. n-1: a Feistel network over two nearly equal factors, repeated until the value is inside."""

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.of = lru_cache(maxsize=100_000)(self._of)

    def _round(self, name: str, n: int, k: int, half: int) -> int:
        digest = hmac.digest(self.key, f"{name}/{n}/{k}/{half}".encode(), hashlib.sha256)
        return int.from_bytes(digest, "big")

    def _of(self, name: str, value: int, n: int) -> int:
        if n < 2:
            return value
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        out = value
        while True:
            left, right = divmod(out, b)
            for k in range(ROUNDS):  # halves of unequal size take turns
                if k % 2:
                    right = (right + self._round(name, n, k, left)) % b
                else:
                    left = (left + self._round(name, n, k, right)) % a
            out = left * b + right
            if out < n:
                return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _refill(like: str, digits: str) -> str:
    """The digits in the places of the digits of `like`."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in like)


class Pseudonyms:
    """Finds and replaces values. One pattern finds them all, the first alternative that fits at a place has it."""

    # Months as written in dates, calling codes of one and two digits (others have three), words before secrets.
    MONTHS = {
        "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
        "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
        "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
        "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    }
    CALLING = frozenset(
        "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
    )
    SECRETS = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key")
    # The patterns of the formats.
    PATTERN = re.compile(
        r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
        r"|(?P<secret>(?<![A-Za-z])(?i:" + "|".join(SECRETS) + r")[\"']?[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9_+/-]{16,})"
        r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))"
        r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
        r"|(?P<isodate>(?<![\w-])\d{4}(?P<mark>[-/.])\d{1,2}(?P=mark)\d{1,2}(?![\w-]))"
        r"|(?P<date>(?<![\w/.-])\d{1,2}(?P<sign>[-/.])\d{1,2}(?P=sign)\d{4}(?![\w/-]))"
        r"|(?P<named>(?<!\w)(?i:" + "|".join(MONTHS["en"]) + r") \d{1,2}, \d{4}(?!\w))"
        r"|(?P<worded>(?<!\w)\d{1,2}(?:\.|er)? (?:de )?(?i:" + "|".join(sorted({m for ms in MONTHS.values() for m in ms}, key=len, reverse=True)) + r")(?: de)? \d{4}(?!\w))"
        r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
        r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
        r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|-\d|\.\d))"
    )
    #: A text without any of these can't hold a value: no pattern is tried on it.
    HINT = re.compile(r"@|\d").search

    def __init__(self, key: bytes) -> None:
        self.permute = Permuter(key)

    def replace(self, text: str) -> tuple[str, int]:
        """The text with pseudonyms, and how many values were replaced."""
        if not self.HINT(text):
            return text, 0
        found = 0

        def change(m: re.Match) -> str:
            nonlocal found
            new = getattr(self, "_" + m.lastgroup)(m.group())
            found += new is not None
            return m.group() if new is None else new

        return self.PATTERN.sub(change, text), found

    def _number(self, name: str, digits: str) -> str:
        return str(self.permute.of(f"{name}{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits)) if digits else digits

    def _email(self, value: str) -> str | None:
        """Letters and digits of the mailbox and of the names under the last part of the domain; their case stays."""
        local, _, domain = value.rpartition("@")
        names, _, last = domain.rpartition(".")
        return f"{self._letters('mailbox', local)}@{self._letters('domain', names)}.{last}"

    def _letters(self, name: str, value: str, letters: int = 26) -> str:
        """One number of mixed bases, 26 for a letter and 10 for a digit, permuted; other characters stay.

        With 16 `letters` the value is hexadecimal, and a digit can become a letter.
        """
        base = lambda c: 16 if letters == 16 else 10 if c.isdigit() else 26
        shape = "".join(("x" if letters == 16 else "0" if c.isdigit() else "a") if c.isalnum() else c for c in value)
        bases = [base(c) for c in value if c.isalnum()]
        n, number = 1, 0
        for c in value.lower():
            if c.isalnum():
                n, number = n * base(c), number * base(c) + (int(c, 36) if letters == 16 or c.isdigit() else ord(c) - 97)
        number = self.permute.of(f"{name}{shape}", number, n)
        out = []
        for k in reversed(bases):
            number, d = divmod(number, k)
            out.append("0123456789abcdef"[d] if k == 16 else str(d) if k == 10 else chr(97 + d))
        it = iter(reversed(out))
        cased = lambda c, new: new.upper() if c.isupper() else new
        return "".join(cased(c, next(it)) if c.isalnum() else c for c in value)

    def _secret(self, value: str) -> str | None:
        """What is assigned to a token, key or password, if it has a digit; hexadecimal stays so, letters stay letters."""
        word = re.search(r"[A-Za-z0-9_+/-]+\Z", value)[0]
        if not any(c.isdigit() for c in word):
            return None
        hexadecimal = not set(word) - set("0123456789abcdef")
        return value[: -len(word)] + self._letters("secret", word, 16 if hexadecimal else 26)

    def _phone(self, value: str) -> str | None:
        """All but the calling code, which the digits alone tell; numbers that start with 0 or 1 after it stay among such."""
        digits = _digits(value)
        if not 8 <= len(digits) <= 15:
            return None
        code = next((k for k in (1, 2) if digits[:k] in self.CALLING), 3) if value[0] == "+" else 0
        rest = digits[code:]
        low = 2 * 10 ** (len(rest) - 1)
        if int(rest) < low:
            new = self.permute.of(f"phone0{len(rest)}", int(rest), low)
        else:
            new = self.permute.of(f"phone2{len(rest)}", int(rest) - low, 10 ** len(rest) - low) + low
        return _refill(value, digits[:code] + str(new).zfill(len(rest)))

    def _ssn(self, value: str) -> str | None:
        """Area 001-899 but 666, group 01-99, serial 0001-9999."""
        area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        number, serial = divmod(self.permute.of("ssn", number, 898 * 99 * 9999), 9999)
        area, group = divmod(number, 99)
        return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"

    def _ip(self, value: str) -> str | None:
        """Any of the four numbers up to 255, as one number of 32 bits."""
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        number = self.permute.of("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(str(b) for b in number.to_bytes(4, "big"))

    def _card(self, value: str) -> str | None:
        """13 to 19 digits whose check digit is right; the pseudonym's is too, and its first digit stays."""
        digits = _digits(value)
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        body = digits[0] + self._number("card", digits[1:-1])
        check = next(c for c in "0123456789" if luhn(body + c))
        return _refill(value, body + check)

    def _iban(self, value: str) -> str | None:
        """Right by the remainder of 97, and so is the pseudonym; the country and the kinds of characters stay."""
        plain = value.replace(" ", "")
        as_number = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(plain) <= 34 or as_number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._letters("iban" + plain[:2], plain[4:])
        new = iter(plain[:2] + f"{98 - as_number(body + plain[:2] + '00') % 97:02}" + body)
        return "".join(c if c == " " else next(new) for c in value)

    def _day(self, year: int, month: int, day: int) -> date | None:
        """A day of 1900 to 2099, permuted among those whose month and day are as wide; None for what is none."""
        try:
            number = date(year, month, day).toordinal()
        except ValueError:
            return None
        among = _days()[month > 9, day > 9]
        k = bisect_left(among, number)
        if k == len(among) or among[k] != number:
            return None
        return date.fromordinal(among[self.permute.of(f"date{month > 9}{day > 9}", k, len(among))])

    def _isodate(self, value: str) -> str | None:
        mark = value[4]
        year, month, day = value.split(mark)
        new = self._day(int(year), int(month), int(day))
        return new and f"{new.year}{mark}{new.month:0{len(month)}}{mark}{new.day:0{len(day)}}"

    def _date(self, value: str) -> str | None:
        """Day first if that is a date, else month first."""
        mark = next(c for c in value if not c.isdigit())
        a, b, year = value.split(mark)
        if new := self._day(int(year), int(b), int(a)):
            return f"{new.day:0{len(a)}}{mark}{new.month:0{len(b)}}{mark}{new.year}"
        new = self._day(int(year), int(a), int(b))
        return new and f"{new.month:0{len(a)}}{mark}{new.day:0{len(b)}}{mark}{new.year}"

    def _month(self, word: str, language: str, month: int) -> str:
        """The month's name in a language, in capitals where the word had them."""
        new = self.MONTHS[language][month - 1].lower()
        return new.upper() if word.isupper() else new.capitalize() if word[0].isupper() else new

    def _named(self, value: str) -> str | None:
        word, day, year = value.replace(",", "").split(" ")
        new = self._day(int(year), [m.lower() for m in self.MONTHS["en"]].index(word.lower()) + 1, int(day))
        return new and f"{self._month(word, 'en', new.month)} {new.day:0{len(day)}}, {new.year}"

    def _worded(self, value: str) -> str | None:
        """Day, month and year in words: a point after the day is German; the first of a month is 1er in French."""
        first, *between, year = value.split(" ")
        word = next(w for w in between if w != "de")
        order = ("de", "en", "fr", "es") if first[-1] == "." else ("fr", "en", "es", "de") if first[-1] == "r" else ("es", "en", "fr", "de") if "de" in between else ("en", "fr", "es", "de")
        language = next(x for x in order if word.lower() in [m.lower() for m in self.MONTHS[x]])
        digits = first.removesuffix("er").removesuffix(".")
        new = self._day(int(year), [m.lower() for m in self.MONTHS[language]].index(word.lower()) + 1, int(digits))
        if new is None:
            return None
        after = "er" if language == "fr" and new.day == 1 else "." if first[-1] == "." else ""
        return " ".join([f"{new.day:0{len(digits)}}{after}", *(w if w == "de" else self._month(word, language, new.month) for w in between), str(new.year)])


@cache
def _days() -> dict[tuple[bool, bool], list[int]]:
    """The days of 1900 to 2099, by whether the month and whether the day has two digits."""
    out: dict[tuple[bool, bool], list[int]] = {(m, d): [] for m in (False, True) for d in (False, True)}
    for number in range(date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal()):
        day = date.fromordinal(number)
        out[day.month > 9, day.day > 9].append(number)
    return out


_makers: dict[bytes, Pseudonyms] = {}


def _replacer(key: bytes) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        maker = _makers.setdefault(key, Pseudonyms(key))
        for s in series:
            yield pd.DataFrame([(None, 0) if t is None else maker.replace(t) for t in s], columns=["text", "n"])
        release()

    return run


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """`docs` with its own columns, text with pseudonyms for personal data, and n_replaced (a column of this name is taken over).

    A null text stays null with 0 replaced; an empty one stays empty; rows and other columns stay as they are. No shuffle.
    """
    of = F.pandas_udf(_replacer(key), "text string, n long")
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_replaced")]
    made = docs.select(*names, of("text").alias("pseudonyms__"))
    return made.select(*names, F.col("pseudonyms__.text").alias("text"), F.col("pseudonyms__.n").alias("n_replaced"))


def pseudonymised_texts(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, n_replaced: see `pseudonymise`."""
    return pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
