"""Format-preserving pseudonyms for personal data.

Values are found by pattern and, where their kind has a rule, validated (check digits, octets, calendar). A valid
value is mapped by a keyed Feistel permutation of its own format's values: a card number becomes another
card number with a right check digit, a date another date in the same notation. The map is one to one and depends on nothing but
key, kind and value, so equal values stay linked across documents and different ones stay apart; with the key it can be undone.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from duskwatch.llm.common import column, map_batches, text_of, utf8_parts

ROUNDS = 10
DEMO_KEY = "set a secret key of your own"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _round(key: bytes, i: int, value: int, out: int) -> int:
    digest = hashlib.blake2b(i.to_bytes(1, "big") + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big"), key=key, digest_size=32).digest()
    return int.from_bytes(digest, "big") % out


def permute(key: bytes, value: int, size: int, undo: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: an alternating Feistel network on a x b >= size, walked until it is back inside."""
    if size <= 1:
        return value
    a = int(size**0.5)
    while a * a < size:
        a += 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            sign = -1 if undo else 1
            if i % 2 == 0:
                left = (left + sign * _round(key, i, right, a)) % a
            else:
                right = (right + sign * _round(key, i, left, b)) % b
        value = left * b + right
        if value < size:
            return value


def _subkey(key: str, kind: str) -> bytes:
    return hashlib.blake2b(kind.encode(), key=hashlib.sha256(key.encode()).digest(), digest_size=32).digest()


def _by_alphabet(alphabets: list[str], key: bytes, text: str, undo: bool) -> str:
    """Permute ``text`` among all texts whose i-th character comes from the same one of ``alphabets`` as its own."""
    sets = [next((s for s in alphabets if c in s), c) for c in text]
    size, value = 1, 0
    for c, s in zip(text, sets, strict=True):
        size, value = size * len(s), value * len(s) + s.index(c)
    # Digits and letters keep their places, so their pattern is part of the key: one permutation for each pattern.
    pattern = hashlib.blake2b("|".join(s if len(s) == 1 else str(alphabets.index(s)) for s in sets).encode(), key=key, digest_size=32).digest()
    value, out = permute(pattern, value, size, undo), []
    for s in reversed(sets):
        value, i = divmod(value, len(s))
        out.append(s[i])
    return "".join(reversed(out))


BLOCK = 64  # characters that one permutation takes; its halves stay below the 256 bits of a round's digest


def _chained(alphabets: list[str], key: bytes, text: str, undo: bool) -> str:
    """Like ``_by_alphabet`` for any length: blocks are permuted in order, keyed by the plain ones before, then backwards, keyed by the finished ones behind."""
    if len(text) <= BLOCK:
        return _by_alphabet(alphabets, key, text, undo)
    parts = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]

    def forward():
        state = hashlib.blake2b(b"forward", key=key, digest_size=32)
        for i, part in enumerate(parts):
            parts[i] = _by_alphabet(alphabets, state.digest(), part, undo)
            state.update((parts[i] if undo else part).encode())

    def backward():
        state = hashlib.blake2b(b"backward", key=key, digest_size=32)
        for i in reversed(range(len(parts) - 1)):
            state.update((behind if undo and i < len(parts) - 2 else parts[i + 1]).encode())
            behind, parts[i] = parts[i], _by_alphabet(alphabets, state.digest(), parts[i], undo)

    for step in (backward, forward) if undo else (forward, backward):
        step()
    return "".join(parts)


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    supply = iter(digits)
    return "".join(next(supply) if c in DIGITS else c for c in shape)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def card(text: str, key: bytes, undo: bool) -> str | None:
    """13 to 19 digits with a right check digit: all but that are permuted, and it follows."""
    digits = _only_digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    # The first digit tells the kind of card and stays.
    payload = digits[0] + _by_alphabet([DIGITS], key + digits[0].encode(), digits[1:-1], undo)
    return _refill(text, payload + luhn_digit(payload))


def iban(text: str, key: bytes, undo: bool) -> str | None:
    """Country, two check digits (remainder 97) and an account: the account is permuted, the check digits follow."""
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = _by_alphabet([DIGITS, UPPER], key + plain[:2].encode(), plain[4:], undo)
    made = iter(plain[:2] + f"{98 - number(account + plain[:2] + '00') % 97:02d}" + account)
    return "".join(c if c == " " else next(made) for c in text)


def phone(text: str, key: bytes, undo: bool) -> str | None:
    """7 to 15 digits, international or with a bracketed or separated area: country code and punctuation stay.

    In North American numbers area and exchange go on to begin with 2 to 9.
    """
    digits = _only_digits(text)
    if not 7 <= len(digits) <= 15:
        return None
    american = len(digits) == 10 or len(digits) == 11 and digits[0] == "1"
    if american:
        rest = digits[-10:]
        if rest[0] in "01" or rest[3] in "01":
            american = False
    if american:
        first = "23456789"
        value = ((first.index(rest[0]) * 100 + int(rest[1:3])) * 8 + first.index(rest[3])) * 10**6 + int(rest[4:])
        value = permute(key + b"na", value, 64 * 10**8, undo)
        value, tail = divmod(value, 10**6)
        value, exchange = divmod(value, 8)
        area, middle = divmod(value, 100)
        return _refill(text, digits[:-10] + f"{first[area]}{middle:02d}{first[exchange]}{tail:06d}")
    keep = 2 if text.startswith("+") else 0
    return _refill(text, digits[:keep] + _by_alphabet([DIGITS], key + digits[:keep].encode(), digits[keep:], undo))


def social_security(text: str, key: bytes, undo: bool) -> str | None:
    """AAA-GG-SSSS; area 001 to 899 but 666, group and serial above zero."""
    a, g, s = (int(x) for x in text.split("-"))
    if not (1 <= a <= 899 and a != 666 and g and s):
        return None
    area = a - 1 if a < 666 else a - 2
    value = permute(key, (area * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, undo)
    value, s = divmod(value, 9999)
    area, g = divmod(value, 99)
    return f"{area + 1 if area < 665 else area + 2:03d}-{g + 1:02d}-{s + 1:04d}"


def address(text: str, key: bytes, undo: bool) -> str | None:
    """Four octets of 0 to 255 without leading zeros, as a number of 32 bits."""
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    value = permute(key, int.from_bytes(bytes(map(int, parts)), "big"), 2**32, undo)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _day(year: int, month: int, day: int, key: bytes, undo: bool) -> datetime.date | None:
    try:
        number = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= number <= LAST_DAY:
        return None
    return datetime.date.fromordinal(FIRST_DAY + permute(key, number - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, undo))


def iso_date(text: str, key: bytes, undo: bool) -> str | None:
    """YYYY-MM-DD (or with / or .), a day of 1900 to 2099."""
    mark = text[4]
    made = _day(int(text[:4]), int(text[5:7]), int(text[8:]), key, undo)
    return made and f"{made.year:04d}{mark}{made.month:02d}{mark}{made.day:02d}"


def day_first_date(text: str, key: bytes, undo: bool) -> str | None:
    """DD.MM.YYYY or DD-MM-YYYY; with slashes MM/DD/YYYY if that is a day, else DD/MM/YYYY. A pseudonym reads back the same way.

    Day or month may have one digit: the pseudonym's has one there too, found by walking on.
    """
    mark = re.search(r"[./-]", text)[0]
    wide_a, wide_b, _ = map(len, text.split(mark))
    a, b, year = (int(x) for x in text.split(mark))
    fits = lambda a, b: (wide_a == 2 or a < 10) and (wide_b == 2 or b < 10)
    if mark == "/":
        sets = {}
        for order in ("mdy", "dmy"):
            m, d = (a, b) if order == "mdy" else (b, a)
            try:
                sets[order] = datetime.date(year, m, d)
            except ValueError:
                continue
        if not sets:
            return None
        order = "mdy" if "mdy" in sets else "dmy"
        made = sets[order]
        while True:  # walk on among the days that are read in this order
            made = _day(made.year, made.month, made.day, key + order.encode(), undo)
            if made is None or (fits(made.month, made.day) if order == "mdy" else made.day > 12 and fits(made.day, made.month)):
                break
        if made is None:
            return None
        a, b = (made.month, made.day) if order == "mdy" else (made.day, made.month)
        return f"{a:0{wide_a}d}/{b:0{wide_b}d}/{made.year:04d}"
    made = _day(year, b, a, key, undo)
    while made and not fits(made.day, made.month):
        made = _day(made.year, made.month, made.day, key, undo)
    return made and f"{made.day:0{wide_a}d}{mark}{made.month:0{wide_b}d}{mark}{made.year:04d}"


def email(text: str, key: bytes, undo: bool) -> str | None:
    """Letters and digits of the local part, each within its own kind; the domain stays."""
    local, _, domain = text.rpartition("@")
    return _by_alphabet([DIGITS, LOWER, UPPER], key + domain.lower().encode(), local, undo) + "@" + domain


def secret(text: str, key: bytes, undo: bool) -> str | None:
    """Hexadecimal of one case within that, other letters and digits each within their kind; a known prefix stays."""
    prefix = text[:4] if re.fullmatch(r"A[KS]IA[0-9A-Z]{16}", text) else ""
    rest = text[len(prefix) :]
    if prefix:
        alphabets = [DIGITS + UPPER]
    elif re.fullmatch(r"[0-9a-f]+", rest):
        alphabets = [DIGITS + "abcdef"]
    elif re.fullmatch(r"[0-9A-F]+", rest):
        alphabets = [DIGITS + "ABCDEF"]
    else:
        alphabets = [DIGITS, LOWER, UPPER]
    return prefix + _chained(alphabets, key + prefix.encode(), rest, undo)


# The patterns by which kinds of personal data are known.
PATTERNS: list[tuple[str, Callable, str]] = [
    ("email", email, r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}"),
    ("secret", secret, r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("setting", secret, r"""(?i:password|passwd|secret|token|api_?key)["']?\s{0,3}[=:]\s{0,3}["']?(?P<value>[!#$%*+./0-9:=?@A-Z^_a-z|~-]{6,}+)"""),
    ("secret", secret, r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"),
    ("iban", iban, r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("date", iso_date, r"(?<![0-9./-])[0-9]{4}(?P<m1>[-/.])[0-9]{2}(?P=m1)[0-9]{2}(?![0-9]|[./-][0-9])"),
    ("date", day_first_date, r"(?<![0-9./-])[0-9]{1,2}(?P<m2>[-/.])[0-9]{1,2}(?P=m2)[0-9]{4}(?![0-9]|[./-][0-9])"),
    ("ip", address, r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("ssn", social_security, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", card, r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", card, r"(?<![0-9])[0-9]{4}(?P<m3>[ -])[0-9]{4}(?P=m3)[0-9]{4}(?P=m3)[0-9]{1,7}(?![0-9])"),
    ("card", card, r"(?<![0-9])[0-9]{4}(?P<m4>[ -])[0-9]{6}(?P=m4)[0-9]{5}(?![0-9])"),
    ("phone", phone, r"(?<![0-9+])\+1[ .-]?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    ("phone", phone, r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"),
    ("phone", phone, r"(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
]

# Characters of which a text must hold one for a kind's pattern to be worth a try.
_NEEDS = {"email": "@", "setting": "=:"}
_DIGIT = re.compile(r"[0-9]")


class Pseudonymiser:
    def __init__(self, key: str, undo: bool = False):
        self.undo = undo
        self.rules = [(kind, make, re.compile(pattern), _subkey(key, "secret" if kind == "setting" else kind)) for kind, make, pattern in PATTERNS]
        self.made = lru_cache(maxsize=100_000)(self._make)

    def _make(self, rule: int, value: str) -> str | None:
        _, make, _, key = self.rules[rule]
        return make(value, key, self.undo)

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the values found, in order; where two overlap, the kind listed first wins."""
        digits = _DIGIT.search(text) is not None
        taken: list[tuple[int, int, str, str]] = []
        open_text = text  # what is taken is blotted out, so that a later pattern can't run into it
        for i, (kind, _, pattern, _) in enumerate(self.rules):
            if not (any(c in text for c in _NEEDS[kind]) if kind in _NEEDS else digits or kind == "secret"):
                continue
            group = "value" if "value" in pattern.groupindex else 0
            found = [(*m.span(group), made) for m in pattern.finditer(open_text) if (made := self.made(i, m[group])) is not None]
            for start, end, made in found:
                taken.append((start, end, "secret" if kind == "setting" else kind, made))
            if found:
                ends = [0, *(e for _, e, _ in found)]
                starts = [*(s for s, _, _ in found), len(text)]
                open_text = "".join(x for a, b, n in zip(ends, starts, [*(e - s for s, e, _ in found), 0], strict=True) for x in (open_text[a:b], "\0" * n))
        return sorted(taken)

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        spans, out, at = self.spans(text), [], 0
        for start, end, _, made in spans:
            out += (text[at:start], made)
            at = end
        return "".join([*out, text[at:]]), spans


_made: dict[tuple[str, bool], Pseudonymiser] = {}


def pseudonymise(df: DataFrame, key: str = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text", undo: bool = False) -> DataFrame:
    """One row for each row of ``df``: doc_id, text with pseudonyms, n_values, and spans (start, end, kind: where values stood, in code points).

    Null text counts as empty. Ids may be null or repeated; other columns play no part. What looks like a number but fails
    its check stays as it is. Spans are those of the text that was given. ``undo`` with the same key gives the values back.
    """
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def work(batch):
        own = _made.setdefault((key, undo), Pseudonymiser(key, undo))
        for part in utf8_parts(batch, "text"):
            found = [own.replace(t) for t in part.column(1).to_pylist()]
            lists = [[{"start": s, "end": e, "kind": k} for s, e, k, _ in spans] for _, spans in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([len(x) for x in lists], pa.int64()), pa.array(lists, pa.list_(span))], names=["doc_id", "text", "n_values", "spans"])

    rows = df.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_batches(rows, work, f"doc_id {kind}, text string, n_values bigint, spans array<struct<start:int,end:int,kind:string>>")
