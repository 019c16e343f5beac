"""Format-preserving pseudonyms of personal data by a keyed Feistel network.

Candidates found by patterns are validated (check digits, ranges, calendar).
A value is then numbered within its format, the number is permuted within the
size of the format, and the result written in the same format again: a card
number stays a valid card number of that length, a date a date.  The permutation
depends on the key and the kind alone, so equal values have equal pseudonyms in
all documents and different values different ones.  A date is the same value in
all its spellings, and an address whatever its letters' case.

Permutation of [0, n): the number is a pair (l, r) of a grid of a x b >= n
cells, and rounds add a keyed hash of one half to the other; a result beyond n
is permuted again until it lies within (cycle walking).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date", "secret")
ROUNDS = 10
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
CACHED = 100_000
#: Characters of a secret that are permuted as one number.
BLOCK = 128
#: Least length of a secret; of one without a digit that mixes no cases, and its least different characters; of a password.
SECRET, PLAIN_SECRET, DIFFERENT, PASSWORD = 16, 24, 10, 6

#: Characters of an IBAN by country.
_IBAN_LENGTHS = {code: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for code in codes.split()}

_FREE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Every repetition is bounded or starts at the edge of its run, so the time is linear in the text.
_PATTERN = re.compile(
    rf"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{1,8}})"
    rf"|(?P<iban>{_FREE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END})"
    rf"|(?P<ip>(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![0-9A-Za-z]|\.[0-9]))"
    rf"|(?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}(?P<sep>[./-])[0-9]{{1,2}}(?P=sep)[0-9]{{4}})(?![0-9A-Za-z]|[./-][0-9]))"
    rf"|(?P<ssn>(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z]|-[0-9]))"
    rf"|(?P<nanp>(?<![0-9A-Za-z+])\+1[ .-]?(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-]?)[0-9]{{3}}[ .-]?[0-9]{{4}}(?![0-9A-Za-z]))"
    rf"|(?P<local>(?<![0-9A-Za-z+])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[.-])[0-9]{{3}}[ .-][0-9]{{4}}(?![0-9A-Za-z]|[.-][0-9]))"
    rf"|(?P<phone>(?<![0-9A-Za-z+])\+[2-9][0-9]{{0,2}}(?:[ .-]?\([0-9]{{1,4}}\))?(?:[ .-]?[0-9]{{2,5}}){{2,4}}(?![0-9A-Za-z]))"
    rf"|(?P<card>{_FREE}(?:[0-9]{{13,19}}|[0-9]{{4}}(?P<gap>[ -])[0-9]{{4}}(?P=gap)[0-9]{{4}}(?P=gap)[0-9]{{4}}|[0-9]{{4}}(?P<amex>[ -])[0-9]{{6}}(?P=amex)[0-9]{{5}}){_END})"
    rf"|(?P<secret>(?<![A-Za-z])(?P<label>(?i:token|secret|password|api[_-]?key))[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?(?P<value>[A-Za-z0-9_+/-]{{{PASSWORD},}}))"
)
_LIKELY = re.compile(r"[0-9@]|token|secret|password|api[_-]?key", re.IGNORECASE)


def shake(seed: bytes, key: bytes, width: int) -> bytes:
    """``width`` keyed bytes."""
    blocks = (blake2b(seed, key=key, salt=i.to_bytes(16, "big")).digest() for i in range(-(-width // 64)))
    return b"".join(blocks)[:width]


def permute(number: int, size: int, key: bytes, kind: str) -> int:
    """The place of ``number`` in the keyed permutation of [0, size)."""
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8 + 8
    while True:
        left, right = number % a, number // a
        for i in range(ROUNDS):
            half = right if i % 2 == 0 else left
            seed = f"{kind}:{size}:{i}:{half}".encode()
            drawn = int.from_bytes(shake(seed, key, width), "big")
            if i % 2 == 0:
                left = (left + drawn) % a
            else:
                right = (right + drawn) % b
        number = right * a + left
        if number < size:
            return number


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def permute_text(value: str, key: bytes, kind: str) -> str:
    """Digits stay digits and letters letters of their case; other characters stay as they are."""
    sets = [next((s for s in _SETS if c in s), c) for c in value]
    number, size = 0, 1
    for c, s in zip(value, sets, strict=True):
        number, size = number * len(s) + s.index(c), size * len(s)
    if size == 1:
        return value
    number = permute(number, size, key, f"{kind}:{''.join(s[0] for s in sets)}")
    out = []
    for s in reversed(sets):
        number, i = divmod(number, len(s))
        out.append(s[i])
    return "".join(reversed(out))


def is_secret(value: str, label: str) -> bool:
    """Whether what follows a label is a secret rather than a word or a path.

    With a digit, ``SECRET`` characters do; for a password beside a letter ``PASSWORD``.  Without one it has many different
    characters, and mixes cases within a word of ``SECRET`` letters or is a word of ``PLAIN_SECRET``.
    """
    if any(c.isdigit() for c in value):
        return len(value) >= SECRET or (label.lower() == "password" and any(c.isalpha() for c in value))
    if len(set(value)) < DIFFERENT:
        return False
    word = max(re.split("[^A-Za-z]", value), key=len)
    mixed = word[1:] != word[1:].lower() and word != word.upper()
    return len(word) >= (SECRET if mixed else PLAIN_SECRET)


def permute_secret(value: str, key: bytes) -> str:
    """The whole value; a longer one than ``BLOCK`` in blocks, each keyed by what stands before and after it."""
    if len(value) <= BLOCK:
        return permute_text(value, key, "secret")
    blocks = [value[i : i + BLOCK] for i in range(0, len(value), BLOCK)]
    # Backwards each block depends on all later ones, then forwards on all earlier: two passes tie every block to the whole.
    for pass_, step in (("back", -1), ("forth", 1)):
        chain = b""
        for i in range(len(blocks))[::step]:
            blocks[i] = permute_text(blocks[i], key, f"secret:{pass_}:{len(value)}:{chain.hex()}")
            chain = blake2b(chain + blocks[i].encode(), key=key, digest_size=16).digest()
    return "".join(blocks)


def _refill(pattern: str, characters: str, fills: Callable[[str], bool] = str.isdigit) -> str:
    """``characters`` in the places of ``pattern`` that ``fills`` names."""
    new = iter(characters)
    return "".join(next(new) if fills(c) else c for c in pattern)


def luhn_digit(payload: str) -> str:
    total = sum(2 * int(c) - 9 * (int(c) > 4) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _card(found: str, key: bytes) -> str | None:
    digits = re.sub(r"[ -]", "", found)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload = permute_text(digits[:-1], key, "card")
    return _refill(found, payload + luhn_digit(payload))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(found: str, key: bytes) -> str | None:
    plain = found.replace(" ", "")
    if plain != plain.upper() or not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    body = permute_text(plain[4:], key, f"iban:{plain[:2]}")
    check = 98 - _mod97(plain[:2] + "00" + body)
    return _refill(found, f"{plain[:2]}{check:02d}{body}", lambda c: c != " ")


def _ends(found: str) -> list[int]:
    """Where ``found`` may end, longest first: at its end and before its separators."""
    return [len(found), *(i for i in range(len(found) - 1, 0, -1) if found[i] in " .-" and found[i - 1].isalnum())]


def _iban_ends(found: str) -> list[int]:
    """Where the country's IBAN ends, else the whole; every end where the country's length isn't known."""
    length, ends = _IBAN_LENGTHS.get(found[:2]), _ends(found)
    if length is None:
        return ends
    return [e for e in ends if e - found.count(" ", 0, e) == length] or ends[:1]


def _phone(found: str, key: bytes) -> str | None:
    """The first digits of a country code stay; NANP numbers, with +1 or without, have ten more."""
    code = "+1" if found.startswith("+1") else found[:3] if found[0] == "+" else ""
    rest = found[len(code):]
    digits = re.sub("[^0-9]", "", rest)
    if code in ("", "+1"):
        if len(digits) != 10:
            return None
    elif not 6 <= len(digits) <= 12:
        return None
    return code + _refill(rest, permute_text(digits, key, f"phone:{code.replace('+1', '')}"))


def _ssn(found: str, key: bytes) -> str | None:
    def valid(digits: str) -> bool:
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"

    digits = found.replace("-", "")
    if not valid(digits):
        return None
    while True:  # cycle walking within the valid numbers
        digits = permute_text(digits, key, "ssn")
        if valid(digits):
            return _refill(found, digits)


def _ip(found: str, key: bytes) -> str | None:
    parts = [int(x) for x in found.split(".")]
    if max(parts) > 255:
        return None
    number = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, number.to_bytes(4, "big")))


def _date(found: str, key: bytes) -> str | None:
    """Year first, or day and month first: month/day with slashes where it is one, else day and month.

    Days of the month up to 12 stay among themselves, and so do the later ones, since a slashed day-first
    date must not become one that reads as month-first; so a day has one pseudonym in every spelling.
    """
    a, b, c = (int(x) for x in re.split(r"[./-]", found))
    sep = re.search(r"[./-]", found).group()
    for order in ("ymd",) if a > 31 else (("mdy", "dmy") if sep == "/" else ("dmy",)):
        given = dict(zip(order, (a, b, c), strict=True))
        try:
            day = dt.date(given["y"], given["m"], given["d"])
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        days = (LAST_DAY - FIRST_DAY).days + 1
        number = (day - FIRST_DAY).days
        while True:
            number = permute(number, days, key, "date")
            new = FIRST_DAY + dt.timedelta(number)
            if (new.day > 12) == (day.day > 12):
                break
        parts = {"y": new.year, "m": new.month, "d": new.day}
        widths = [len(x) for x in re.split(r"[./-]", found)]
        return sep.join(f"{parts[k]:0{w}d}" for k, w in zip(order, widths, strict=True))
    return None


def _email(found: str, key: bytes) -> str | None:
    name, _, host = found.partition("@")
    if name.startswith(".") or name.endswith(".") or ".." in name or not re.search("[A-Za-z]{2,}$", host):
        return None
    new = permute_text(name.lower(), key, f"email:{host.lower()}")
    return f"{''.join(n.upper() if c.isupper() else n for n, c in zip(new, name, strict=True))}@{host}"


_MAKERS = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}


class Pseudonyms:
    """Replaces the validated values of texts; remembers the pseudonyms of values."""

    def __init__(self, key: bytes):
        if not 16 <= len(key) <= 64:
            raise ValueError("the key must have 16 to 64 bytes")
        self.key, self.known = key, {}

    def _made(self, kind: str, found: str) -> str | None:
        if (kind, found) not in self.known:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[kind, found] = _MAKERS[kind](found, self.key)
        return self.known[kind, found]

    def _new(self, match: re.Match) -> tuple[str, str | None, int]:
        """The kind of a match, what to write for it (None if it isn't valid), and where the value ends."""
        found = match.group()
        if match["secret"]:
            value = match["value"]
            address = len(value) < SECRET and match.string[match.end() : match.end() + 1] == "@"  # the name of one, found next
            new = permute_secret(value, self.key) if not address and is_secret(value, match["label"]) else None
            return "secret", None if new is None else found[: -len(value)] + new, match.end()
        kind = next(k for k in ("email", "iban", "ip", "date", "ssn", "nanp", "local", "phone", "card") if match[k])
        kind = "phone" if kind in ("nanp", "local") else kind
        for end in _iban_ends(found) if kind == "iban" else _ends(found) if match["phone"] else (len(found),):
            new = self._made(kind, found[:end])  # words and numbers behind a value may look like a part of it
            if new is not None:
                return kind, new, match.start() + end
        return kind, None, match.end()

    def text(self, text: str | None) -> tuple[str | None, list[int]]:
        """The text with pseudonyms, and the number of values replaced by kind."""
        counts = [0] * len(KINDS)
        if not text or not _LIKELY.search(text):
            return text, counts
        out, done, at = [], 0, 0
        while match := _PATTERN.search(text, at):
            kind, new, end = self._new(match)
            if new is None:  # a value may begin within what looked like another
                at = match.start() + 1
                continue
            counts[KINDS.index(kind)] += 1
            out += [text[done : match.start()], new]
            done = at = end
        return "".join(out) + text[done:] if out else text, counts


def pseudonyms(key: bytes):
    """A column function text -> struct of the new text and a count for each kind."""
    kind = "text string, " + ", ".join(f"n_{k} long" for k in KINDS)

    @F.pandas_udf(kind)
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker = Pseudonyms(key)
        for texts in batches:
            found = [worker.text(t) for t in texts]
            yield pd.DataFrame([[t, *counts] for t, counts in found], columns=["text", *(f"n_{k}" for k in KINDS)])

    return lambda text: replaced(text.cast("string"))


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the new text, how many values of each kind it replaced, and n_found.

    A null text stays null with counts 0; a text without a valid value comes
    back as it is.  Repeated rows stay and get the same pseudonyms.  Other
    columns are not read.
    """
    made = docs.select(F.col(id_col).alias(id_col), pseudonyms(key)(F.col(text_col)).alias("made"))
    n_found = sum((F.col(f"made.n_{k}") for k in KINDS[1:]), F.col(f"made.{'n_' + KINDS[0]}"))
    return made.select(id_col, "made.*", n_found.alias("n_found"))


def replaced_text(docs: DataFrame, key: bytes, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the new texts, and their lengths where the table holds lengths.

    Rows, null texts, repeated rows and all other columns stay as they are; an
    empty table stays empty.
    """
    made: Column = pseudonyms(key)(F.col(text_col))["text"]
    out = docs.withColumn(text_col, made)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
