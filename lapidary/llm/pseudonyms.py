"""Format-preserving pseudonyms by a keyed Feistel permutation.

A value that its own rules confirm (Luhn for cards, mod 97 for IBANs, octets for addresses,
the calendar for dates, issued ranges for SSNs, lengths for phones) is read as a number within the set of values of its format, permuted
within that set by a Feistel network with cycle walking, and written in the same format, its
check digits made anew. Equal values get equal pseudonyms in every document, a date in whatever
order it is written, and whoever holds the key can invert them. Text around them stays as it is.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapidary.llm.resident import resident
from lapidary.llm.scratch import small_batches

KINDS = ("email", "secret", "iban", "card", "address", "date", "phone", "ssn")
_PATTERN = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-]))
    |(?P<secret>(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9_])(?:[sr]k_(?:live|test)_|gh[opsur]_|glpat-|xox[abpr]-)[A-Za-z0-9_-]{12,}[A-Za-z0-9](?![A-Za-z0-9_-])|(?<=["'])[0-9A-Fa-f]{32,128}(?=["']))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<card>(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]))
    |(?P<address>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))
    |(?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9]))
    |(?P<phone>(?<![0-9A-Za-z+.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{9,15}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.(])\([0-9]{2,5}\)[ -]?[0-9]{4,9}(?![0-9A-Za-z]))
    |(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))""",
    re.VERBOSE,
)
_HINT = re.compile("[0-9@]")
#: cards as they are usually written, the shorter first; within a run of digit groups one may follow a hyphen
_CARDS = [
    re.compile(rf"(?<![0-9A-Za-z.+])(?:{shape})(?![0-9A-Za-z])")
    for shape in ("[0-9]{13,19}", "[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}", "[0-9]{4}([ -])[0-9]{6}\\1[0-9]{4,5}", "[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,3}")
]
#: twelve digits in fours that more stand before or behind are no phone, but of a card that may fail its check
_FOURS = re.compile("(?<=[0-9]{4}[ -])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?![0-9])|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]")
_SHORTER = re.compile("[0-9](?=[ -])")
_OTHERS = {kind: re.compile(next(x for x in _PATTERN.pattern.split("\n") if f"(?P<{kind}>" in x).strip().removeprefix("|").replace(f"(?P<{kind}>", "(?:"), re.VERBOSE) for kind in ("address", "date", "phone", "ssn")}
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


class Feistel:
    """A keyed permutation of ``range(n)`` for any n; ``tweak`` makes formats independent."""

    def __init__(self, key: bytes, rounds: int = 10):
        self.key, self.rounds = key, rounds

    def _round(self, tweak: bytes, number: int, half: int, bits: int) -> int:
        data = tweak + bytes([number]) + half.to_bytes((bits + 7) // 8 or 1, "big")
        size = min(64, (bits + 7) // 8 + 8)
        out = hashlib.blake2b(data, key=self.key, digest_size=size).digest()
        while 8 * len(out) < bits:
            out += hashlib.blake2b(out, key=self.key, digest_size=64).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, tweak: bytes, backwards: bool) -> int:
        mask = (1 << bits) - 1
        left, right = x >> bits, x & mask
        for number in reversed(range(self.rounds)) if backwards else range(self.rounds):
            if backwards:
                left, right = right ^ self._round(tweak, number, left, bits), left
            else:
                left, right = right, left ^ self._round(tweak, number, right, bits)
        return left << bits | right

    def permute(self, x: int, n: int, tweak: bytes, backwards: bool = False) -> int:
        bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, bits, tweak, backwards)
            if x < n:
                return x


def _luhn(digits: str) -> int:
    """The check digit that makes ``digits`` followed by it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


#: fixed values: what common access tokens start with
_SECRET_PREFIX = re.compile("[sr]k_(?:live|test)_|gh[opsur]_|glpat-|xox[abpr]-")


def _case(text: str) -> str:
    return "lower" if text.lower() == text else "upper" if text.upper() == text else "mixed"


def _is_phone(text: str) -> bool:
    """6 to 15 digits, as numbering plans have, and not one digit alone."""
    digits = [c for c in text if c.isdigit()]
    return 6 <= len(digits) <= 15 and len(set(digits)) > 1


def _is_ssn(text: str) -> bool:
    """Area not 000, 666 or from 900, neither group nor serial of zeros only."""
    return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"


def _alphabet(c: str) -> str | None:
    return next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), None)


class Pseudonyms:
    """Replaces the confirmed values of a text; ``value(kind, text)`` gives None where its rules fail."""

    def __init__(self, key: bytes, backwards: bool = False):
        self.feistel, self.backwards = Feistel(key), backwards
        self.value = functools.lru_cache(20_000)(self._value)

    def _spell(self, text: str, tweak: str, alphabets: list[str | None]) -> str:
        """Permute the characters that have an alphabet, all at once."""
        n, x = 1, 0
        for c, a in zip(text, alphabets, strict=True):
            if a:
                n, x = n * len(a), x * len(a) + a.index(c)
        if n == 1:
            return text
        shape = "".join("x" if a is None else str(len(a)) + "," for a in alphabets)
        x = self.feistel.permute(x, n, f"{tweak}:{shape}".encode(), self.backwards)
        out = []
        for c, a in zip(reversed(text), reversed(alphabets), strict=True):
            if a:
                x, k = divmod(x, len(a))
                out.append(a[k])
            else:
                out.append(c)
        return "".join(reversed(out))

    def _digits(self, text: str, tweak: str, skip: int = 0) -> str:
        left = [skip]

        def alphabet(c: str) -> str | None:
            if not c.isdigit():
                return None
            left[0] -= 1
            return None if left[0] >= 0 else _DIGITS

        return self._spell(text, tweak, [alphabet(c) for c in text])

    def _value(self, kind: str, text: str) -> str | None:
        plain = re.sub("[ -]", "", text)
        if kind == "email":
            end = text.rindex(".")
            return self._spell(text[:end], "email", [_alphabet(c) for c in text[:end]]) + text[end:]
        if kind == "secret":
            if text.startswith("AKIA"):
                return "AKIA" + self._spell(text[4:], "akia", [_UPPER + _DIGITS] * 16)
            if (prefix := _SECRET_PREFIX.match(text)) is not None:
                rest = text[prefix.end() :]
                return prefix[0] + self._spell(rest, "token", [_alphabet(c) for c in rest])
            case = _case(text)
            letters = _DIGITS + {"lower": "abcdef", "upper": "ABCDEF", "mixed": "abcdefABCDEF"}[case]
            return self._walk(text, lambda t: self._spell(t, case, [letters] * len(t)), lambda t: _case(t) == case)
        if kind == "iban":
            if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != int(plain[2:4]):
                return None
            account = self._spell(plain[4:], "iban" + plain[:2], [_alphabet(c) for c in plain[4:]])
            new = iter(f"{plain[:2]}{_iban_check(plain[:2], account):02d}{account}")
            return "".join(c if c == " " else next(new) for c in text)
        if kind == "card":
            if _luhn(plain[:-1]) != int(plain[-1]) or len(set(plain)) == 1:
                return None
            body = self._digits(plain[:-1], "card")
            new = iter(body + str(_luhn(body)))
            return "".join(next(new) if c.isdigit() else c for c in text)
        if kind == "address":
            parts = text.split(".")
            if any(int(p) > 255 or str(int(p)) != p for p in parts):
                return None
            x = self.feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"address", self.backwards)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "date":
            form = "%Y-%m-%d" if text[4] == "-" else "%d.%m.%Y" if "." in text else "%d/%m/%Y"
            for form in (form, "%m/%d/%Y") if "/" in text else (form,):
                try:
                    day = datetime.datetime.strptime(text, form).date()
                    break
                except ValueError:
                    continue
            else:
                return None
            # days of 400 years, as the calendar repeats: 1801 to 2200 and those before and after
            year = 1801 + (day.year - 1801) // 400 * 400
            first = datetime.date(max(1, year), 1, 1).toordinal()
            n = datetime.date(min(9999, year + 399), 12, 31).toordinal() - first + 1
            permute = lambda d: datetime.date.fromordinal(first + self.feistel.permute(d.toordinal() - first, n, f"date:{year}".encode(), self.backwards))
            # days after the 12th stay such, since only they tell month and day apart in every order
            new = self._walk(day, permute, lambda d: (d.day > 12) == (day.day > 12))
            return form.replace("%Y", f"{new.year:04d}").replace("%m", f"{new.month:02d}").replace("%d", f"{new.day:02d}")
        if kind == "phone":
            if not _is_phone(text):
                return None
            code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
            return self._walk(text, lambda t: self._digits(t, "phone", len(code[0]) - 1 if code else 0), _is_phone)
        if not _is_ssn(text):
            return None
        return self._walk(text, lambda t: self._digits(t, kind), _is_ssn)

    @staticmethod
    def _walk(value, permute, confirmed):
        """Permute until the value is again one that its rules confirm: a permutation of those."""
        value = permute(value)
        while not confirmed(value):
            value = permute(value)
        return value

    def _usual_card(self, text: str, at: int) -> tuple[int, str] | None:
        """End and pseudonym of the card in a usual form that starts there."""
        for form in _CARDS:
            if (m := form.match(text, at)) and (new := self.value("card", m[0])) is not None:
                return m.end(), new
        return None

    def _other(self, text: str, at: int) -> tuple[str, int, str] | None:
        for kind, form in _OTHERS.items():
            if (m := form.match(text, at)) and (new := self.value(kind, m[0])) is not None:
                if kind != "phone" or not _FOURS.match(text, at):
                    return kind, m.end(), new
        return None

    def _in_run(self, text: str, start: int, end: int) -> tuple[int, str, int, str] | None:
        """Start, kind, end and pseudonym of the value at the start of a run of digit groups, or of a card right behind its first group.

        Usual cards come first; then cards in other groups, the longest first, unless another
        value starts within them; then other kinds, unless a usual card starts within them.
        """
        if card := self._usual_card(text, start):
            return start, "card", *card
        starts = [m.start() for m in re.finditer("(?<=[ -])[0-9]", text[start:end])]
        hidden = next(((start + i, card) for i in starts if (card := self._usual_card(text, start + i))), None)
        other = self._other(text, start)
        inner = [i for i in (0, *starts) if self._other(text, start + i)]
        for stop in (end, *(start + m.end() for m in reversed(list(_SHORTER.finditer(text[start : end + 1]))) if start + m.end() < end)):
            if sum(c.isdigit() for c in text[start:stop]) < 13:
                break
            if (hidden is None or hidden[0] >= stop) and not any(start + i < stop for i in inner):
                if (new := self.value("card", text[start:stop])) is not None:
                    return start, "card", stop, new
        if other and (hidden is None or other[1] <= hidden[0]):
            return start, *other
        if hidden and hidden[0] == start + starts[0]:
            return hidden[0], "card", *hidden[1]
        return None

    def replace(self, text: str) -> tuple[str, list[int]]:
        """The text with pseudonyms, and how many values of each of KINDS it had."""
        counts = [0] * len(KINDS)
        if not _HINT.search(text):
            return text, counts
        out, at = [], 0
        while (m := _PATTERN.search(text, at)) is not None:
            kind, start, end = m.lastgroup, m.start(), m.end()
            if kind == "card":
                found = self._in_run(text, start, end)
                start, kind, end, new = found or (start, kind, end, None)
            else:
                new = None if kind == "phone" and _FOURS.match(text, start) else self.value(kind, m[0])
            if new is None:  # not confirmed: it stays; an IBAN's first word or a run's first digits may hide others behind them
                end = start + len(re.match(r"[0-9A-Za-z]+|.", m[0], re.S)[0]) if kind in ("iban", "card", "phone") else end
                out.append(text[at:end])
                at = end
                continue
            out += [text[at:start], new]
            counts[KINDS.index(kind)] += 1
            at = end
        out.append(text[at:])
        return "".join(out), counts


def session_key(spark) -> bytes:
    """The key that the session names in ``spark.lapidary.pseudonymKey``; without it an example key, with a warning."""
    key = spark.conf.get("spark.lapidary.pseudonymKey", None)
    if not key:
        warnings.warn("spark.lapidary.pseudonymKey is not set: pseudonyms are made with a public example key", stacklevel=2)
    return (key or "lapidary-example-key").encode()


def _pseudonyms(key: bytes, backwards: bool) -> Pseudonyms:
    return resident(("pseudonyms", key, backwards), lambda: Pseudonyms(key, backwards))


def pseudonymise(docs: DataFrame, key: bytes, backwards: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced and a struct ``found`` of counts by kind.

    A null text stays null and has no counts; every other column stays as it is. ``backwards``
    restores the values, given the key. Repeated rows and values are treated alike.
    """
    name = "found"
    while name in docs.columns:
        name += "_"

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(k, T.LongType()) for k in KINDS)]))
    def apply(texts: pd.Series) -> pd.DataFrame:
        own = _pseudonyms(key, backwards)
        rows = [(None, *[0] * len(KINDS)) if t is None else (lambda r: (r[0], *r[1]))(own.replace(t)) for t in texts]
        return pd.DataFrame(rows, columns=["text", *KINDS])

    small_batches(docs.sparkSession)
    done = docs.withColumn(name, apply("text"))
    return done.withColumn("text", F.col(f"{name}.text")).withColumn(name, F.col(name).dropFields("text"))
