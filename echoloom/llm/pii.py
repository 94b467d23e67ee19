"""Format-preserving pseudonyms for personal data and secrets.

Values are found by pattern, validated (Luhn sums, address parts, calendar dates), and replaced through a keyed
Feistel permutation of the values of their own format: a card number becomes another number with a right check
digit and the same grouping, a date another date in the same notation, an address another of the same shape.
The permutation is a bijection, so equal values have equal pseudonyms in all documents and different values of a
kind stay different; with the key, pseudonyms can be turned back. It is a step round one keyed cycle of all values
(the network, the next number, the network back), so no value is its own pseudonym.
A match that isn't valid is tried with shorter ends and the later patterns, and then the search goes on one position
further, so values beside other numbers are found.

A value has one permutation wherever it stands: what follows a word like ``password``, also with words joined to it
(db_password), is taken without marks at its ends, and as the kind that it would be alone, if any. A value without a
digit counts where it is quoted or follows an equals sign. Letters of addresses are permuted alike in both cases;
letters beyond ASCII stay in their block of 64 characters. A date with slashes is read as month and day if it can be,
and then linked with other notations, spelled months (English, German, French, Spanish) included; else as day and
month, among the dates that can only be read so. Days and months of one digit come back with two. Of phone numbers the
national number is permuted, by its length, and the country code stays, so notations are linked, with and without it.
Social security numbers are permuted among the valid ones. Addresses of four padded parts (192.168.001.001) are those
without the zeros; version 6 addresses come back in their short notation.

Null texts stay null; texts without such values come back unchanged, empty texts and tables too. Repeated rows are
treated alike, and texts of any length are searched whole. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import ipaddress
import math
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, replace_batches

_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
#: Every value holds a digit, an @ or the beginning of an access key, but for those after a word of SECRET_WORDS.
_ANY = re.compile(r"[0-9@]|A[KS]IA|gh[pousr]_|[sp]k_(?:live|test)_")
_MARGIN = 160  # characters around such a place that are searched, and on to the next white space: no value begins further before
_SPACE = re.compile(r"\s")


class Feistel:
    """Keyed permutation of 0..size-1: a balanced Feistel network over the next larger square, with cycle walking."""

    def __init__(self, key: bytes, kind: str, size: int, rounds: int = 8) -> None:
        self.size, self.rounds = size, rounds
        self.half = math.isqrt(max(0, size - 1)) + 1
        self.keys = [hashlib.blake2b(f"{kind}/{size}/{r}".encode(), key=key, digest_size=16).digest() for r in range(rounds)]

    def _f(self, r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes(32, "big"), key=self.keys[r], digest_size=16).digest(), "big") % self.half

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.half)
        for r in range(self.rounds):
            left, right = right, (left + self._f(r, right)) % self.half
        return left * self.half + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.half)
        for r in reversed(range(self.rounds)):
            left, right = (right - self._f(r, left)) % self.half, left
        return left * self.half + right

    def forward(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x

    def backward(self, x: int) -> int:
        x = self._back(x)
        while x >= self.size:
            x = self._back(x)
        return x


def luhn_sum(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10


#: Words before a secret.
SECRET_WORDS = "password passwd pwd secret token api_key apikey access_key accesskey auth".split()
_LABEL_WORDS = rf"(?<![A-Za-z0-9])(?:[A-Za-z0-9]{{1,30}}[_-]){{0,4}}(?:{'|'.join(SECRET_WORDS)})(?:[_-][A-Za-z0-9]{{1,30}}){{0,2}}"
_SECRET_LABEL = rf"""(?i:{_LABEL_WORDS}["']?\s*[=:]\s*["']?|\bbearer\s+)"""
_LABELLED = re.compile(_SECRET_LABEL + r"\S{0,256}")
#: The names of the months in each language, in order.
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "en short": "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
_MONTH = "(?i:" + "|".join(sorted({m for names in MONTHS.values() for m in names}, key=lambda m: (-len(m), m))) + ")"
_DAY_MONTH = rf"[0-9]{{1,2}}(?:st|nd|rd|th|er|\.)?\s(?:of\s|de\s)?{_MONTH},?\s(?:de\s|del\s)?[0-9]{{4}}"
_MONTH_DAY = rf"{_MONTH}\s[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s[0-9]{{4}}"
_SPELLED = re.compile(rf"(?P<day>[0-9]{{1,2}})(?P<suffix>st|nd|rd|th|er)?(?P<a>\.?\s(?:of\s|de\s)?)(?P<month>{_MONTH})(?P<b>,?\s(?:de\s|del\s)?)(?P<year>[0-9]{{4}})")
_SPELLED_FIRST = re.compile(rf"(?P<month>{_MONTH})(?P<a>\s)(?P<day>[0-9]{{1,2}})(?P<suffix>st|nd|rd|th)?(?P<b>,?\s)(?P<year>[0-9]{{4}})")
#: The country codes of two digits; those that begin with 1 or 7 have one, all others three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_QUAD = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}")
#: The patterns, each with its kind, in order of precedence.
PATTERNS = (
    ("secret", r"\b(?:AKIA|ASIA)[A-Z2-7]{16}\b"),
    ("secret", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    ("secret", r"\b[sp]k_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    ("secret_value", _SECRET_LABEL + r"""(?P<sv>(?<=")[^"\s]{4,128}(?=")|(?<=')[^'\s]{4,128}(?=')|[^\s"'<>,;()\[\]{}]{6,})"""),
    ("email", r"(?<![\w.+%-])[\w][\w.+%-]{0,63}@(?:[^\W_](?:(?:[^\W_]|-){0,61}[^\W_])?\.)+[^\W\d_]{2,24}\b"),
    ("iban", r"\b(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)\b"),
    ("card", r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9])"),
    ("ip", r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])"),
    ("ip6", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])"),
    ("date", r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-]|\.[0-9])"),
    ("date", rf"(?<![\w/.-])(?:{_DAY_MONTH}|{_MONTH_DAY})(?![\w/-]|\.[0-9])"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]){1,3}[0-9]{2,5}(?![\w-])|(?<![\w+])\+[0-9]{8,15}(?!\w)"),
)
_ONE = re.compile("|".join(f"(?P<k{k}>{p})" for k, (_, p) in enumerate(PATTERNS)))
_EACH = [re.compile(p) for _, p in PATTERNS]
_SHORTER = frozenset(("iban", "card", "phone"))  # patterns that run on over separate groups
_GAP = re.compile(r"[ -]")
_AFTER = re.compile(r"[0-9]-\Z")
_CARD = next(k for k, (kind, _) in enumerate(PATTERNS) if kind == "card")
_APART = [k for k, (kind, _) in enumerate(PATTERNS) if kind in ("ip", "date", "ssn")]
_DATE = _EACH[next(k for k, (kind, _) in enumerate(PATTERNS) if kind == "date")]
_LABEL_AT = next(k for k, (kind, _) in enumerate(PATTERNS) if kind == "secret_value")
_CARD_GROUPS = re.compile(r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])")
_DATE_FORMS = (("%Y-%m-%d", re.compile(r"\d{4}-\d\d-\d\d")), ("%Y/%m/%d", re.compile(r"\d{4}/\d\d/\d\d")), ("%d.%m.%Y", re.compile(r"\d{1,2}\.\d{1,2}\.\d{4}")))
_HEX = re.compile(r"[0-9a-f]{8,}")
_EDGES = re.compile(r"[^A-Za-z0-9]*")


@functools.cache
def _late_days() -> list[int]:
    """The days after the 12th of their month, which can't be read as month and day."""
    return [d for d in range(_DAYS) if datetime.date.fromordinal(_DAY0 + d).day > 12]


@functools.cache
def _letters(c: str, caseless: bool) -> str:
    """The letters among which one beyond ASCII is permuted: those of its block and kind, or itself alone. Caseless ones
    are lower-case letters with a capital of their own."""
    kind, low = unicodedata.category(c), ord(c) >> 6 << 6
    every = [chr(x) for x in range(low, low + 64)]
    if caseless and kind in ("Ll", "Lu"):
        return "".join(x for x in every if unicodedata.category(x) == "Ll" and len(x.upper()) == 1 and x.upper().lower() == x)
    return "".join(x for x in every if unicodedata.category(x) == kind) if kind.startswith("L") else ""


class Pseudonymizer:
    """Replaces the values in texts; ``key`` decides the permutations."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.permutations: dict[tuple[str, int], Feistel] = {}
        self.known: dict[tuple[str, str], str | None] = {}

    def _permute(self, kind: str, size: int, x: int, back: bool = False) -> int:
        if size < 2:
            return x
        p = self.permutations.get((kind, size))
        if p is None:
            if len(self.permutations) >= 4096:
                self.permutations.clear()
            p = self.permutations[kind, size] = Feistel(self.key, kind, size)
        return p.backward((p.forward(x) + (-1 if back else 1)) % size)

    def _digits(self, kind: str, value: str, back: bool) -> str:
        """Permutes all digits of a value together; the rest of it stays."""
        d = "".join(c for c in value if c in "0123456789")
        new = iter(str(self._permute(f"{kind}{len(d)}", 10 ** len(d), int(d), back)).zfill(len(d)))
        return "".join(next(new) if c in "0123456789" else c for c in value)

    def _secret(self, value: str, back: bool) -> str:
        """Hexadecimal numbers stay such, and no other secret becomes one."""
        if _HEX.fullmatch(value):
            return self._mixed("secret", value, back, hexes=True)
        new = self._mixed("secret", value, back)
        while _HEX.fullmatch(new):
            new = self._mixed("secret", new, back)
        return new

    def _mixed(self, kind: str, value: str, back: bool, hexes: bool = False) -> str:
        """Permutes the values of the same shape: letters stay letters of their case, digits digits, other characters stay.

        Addresses that differ in case alone have the same letters afterwards.
        """
        caseless = kind in ("email", "domain")
        x, size, shape, tables = 0, 1, [], []
        for c in value:
            if "0" <= c <= "9":
                table, mark = ("0123456789abcdef", "h") if hexes else ("0123456789", "9")
            elif "a" <= c <= "z" or "A" <= c <= "Z":
                table, mark = ("0123456789abcdef", "h") if hexes else ("abcdefghijklmnopqrstuvwxyz", "A" if c.isupper() and not caseless else "a")
            else:
                table = _letters(c.lower() if caseless and len(c.lower()) == 1 else c, caseless) if c.isalpha() else ""
                mark = f"<{table}>"
            at = table.find(c.lower() if caseless or ord(c) < 128 else c) if table else -1
            if at >= 0:
                x, size = x * len(table) + at, size * len(table)
            tables.append(table if at >= 0 else "")
            shape.append(mark if at >= 0 else c)
        x = self._permute(f"{kind}:{''.join(shape)}", size, x, back)
        out = []
        for c, table in zip(reversed(value), reversed(tables), strict=True):
            if table:
                x, d = divmod(x, len(table))
                c = table[d].upper() if c.isupper() and (ord(c) < 128 or caseless) else table[d]
            out.append(c)
        return "".join(reversed(out))

    def _card(self, value: str, back: bool) -> str | None:
        d = "".join(c for c in value if c.isdigit())
        if not 13 <= len(d) <= 19 or luhn_sum(d) or len(set(d)) == 1:
            return None
        body = str(self._permute(f"card{len(d)}", 10 ** (len(d) - 1), int(d[:-1]), back)).zfill(len(d) - 1)
        new = iter(body + str(-luhn_sum(body + "0") % 10))
        return "".join(next(new) if c.isdigit() else c for c in value)

    def _ip(self, value: str, back: bool) -> str | None:
        parts = value.split(".")
        padded = all(len(p) == 3 for p in parts) and any(p[0] == "0" for p in parts)
        if any(int(p) > 255 for p in parts) or (not padded and any(len(p) > 1 and p[0] == "0" for p in parts)):
            return None
        x = self._permute("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"), back)
        return ".".join(f"{b:03d}" if padded else str(b) for b in x.to_bytes(4, "big"))

    def _ip6(self, value: str, back: bool) -> str | None:
        """Addresses with three groups and a digit at least; times and names are none."""
        if sum(map(bool, value.split(":"))) < 3 or not any(c.isdigit() for c in value):
            return None
        try:
            x = int(ipaddress.IPv6Address(value))
        except ValueError:
            return None
        return str(ipaddress.IPv6Address(self._permute("ip6", 1 << 128, x, back)))

    def _spelled(self, value: str, back: bool) -> str | None:
        """A date with its month's name: in the language, capitals and order that it has."""
        m = _SPELLED.fullmatch(value) or _SPELLED_FIRST.fullmatch(value)
        if m is None:
            return None
        name = m["month"].lower()
        liked = "de" if "." in m["a"] else "es" if "de" in m["a"].split() else "en"
        language = next(x for x in sorted(MONTHS, key=lambda x: x != liked) if name in MONTHS[x])
        try:
            day = datetime.date(int(m["year"]), MONTHS[language].index(name) + 1, int(m["day"])).toordinal() - _DAY0
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        new = datetime.date.fromordinal(_DAY0 + self._permute("date", _DAYS, day, back))
        month = MONTHS[language][new.month - 1]
        month = month.upper() if m["month"].isupper() else month.capitalize() if m["month"][0].isupper() else month
        suffix = m["suffix"] or ""
        if suffix in ("st", "nd", "rd", "th"):
            suffix = "th" if new.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
        else:
            suffix = "er" if language == "fr" and new.day == 1 else ""
        first = f"{new.day}{suffix}{m['a']}{month}" if m.re is _SPELLED else f"{month}{m['a']}{new.day}{suffix}"
        return f"{first}{m['b']}{new.year:04d}"

    def _ssn(self, value: str, back: bool) -> str | None:
        """Areas but 000 and 666, groups from 01, serials from 0001: a number in their product."""
        area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
        if area in (0, 666) or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._permute("ssn", 998 * 99 * 9999, x, back), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, value: str, back: bool) -> str | None:
        digits = [k for k, c in enumerate(value) if "0" <= c <= "9"]
        if not 7 <= len(digits) <= 15 or _QUAD.fullmatch(value):
            return None
        code = 0
        if value[0] == "+":
            first = "".join(value[k] for k in digits[:2])
            if first[0] == "0":
                return None
            code = 1 if first[0] in "17" else 2 if first in TWO_DIGIT_CODES else 3
            if len(digits) - code < 4:
                return None
        at = digits[code]
        return value[:at] + self._digits("phone", value[at:], back)

    def _date(self, value: str, back: bool) -> str | None:
        if any(c.isalpha() for c in value):
            return self._spelled(value, back)
        forms = [f for f, p in _DATE_FORMS if p.fullmatch(value)] or (["%m/%d/%Y", "%d/%m/%Y"] if value.count("/") == 2 else [])
        for form in forms:
            try:
                day = datetime.datetime.strptime(value, form).date().toordinal() - _DAY0
            except ValueError:
                continue
            if not 0 <= day < _DAYS:
                continue
            if form == "%d/%m/%Y":
                late = _late_days()
                day = late[self._permute("late date", len(late), bisect.bisect_left(late, day), back)]
            else:
                day = self._permute("date", _DAYS, day, back)
            new = datetime.date.fromordinal(_DAY0 + day)
            return form.replace("%Y", f"{new.year:04d}").replace("%m", f"{new.month:02d}").replace("%d", f"{new.day:02d}")
        return None

    def _iban(self, value: str, back: bool) -> str | None:
        plain = value.replace(" ", "").upper()

        def number(x: str) -> int:
            return int("".join(str(int(c, 36)) for c in x))

        if not 15 <= len(plain) <= 34 or (value.islower() and sum(c.isdigit() for c in plain) < 10) or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._mixed(f"iban{plain[:2]}", plain[4:], back)
        new = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
        made = "".join(c if c == " " else next(new) for c in value)
        return made.lower() if value.islower() else made

    def pseudonym(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym of a value, or None if it isn't valid."""
        if kind == "card":
            return self._card(value, back)
        if kind == "ip":
            return self._ip(value, back)
        if kind == "date":
            return self._date(value, back)
        if kind == "iban":
            return self._iban(value, back)
        if kind == "ip6":
            return self._ip6(value, back)
        if kind == "ssn":
            return self._ssn(value, back)
        if kind == "phone":
            return self._phone(value, back)
        if kind == "email":
            name, at, domain = value.rpartition("@")
            new = self._mixed("email", name, back)
            first, dot, rest = domain.partition(".")
            return new + at + self._mixed("domain", first, back) + dot + rest
        if kind == "secret":
            head = re.match(r"[A-Za-z]+_(?:(?:live|test)_)?|A[A-Z]{3}", value)[0]
            rest, alphabet = value[len(head) :], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
            if "_" in head:
                return head + self._secret(rest, back)
            x = 0
            for c in rest:
                x = x * 32 + alphabet.index(c)
            x = self._permute("access key", 32 ** len(rest), x, back)
            return head + "".join(alphabet[x >> 5 * k & 31] for k in reversed(range(len(rest))))
        head, tail = _EDGES.match(value)[0], _EDGES.match(value[::-1])[0]
        core = value[len(head) : len(value) - len(tail)]
        for other, pattern in zip((kind for kind, _ in PATTERNS), _EACH, strict=True):
            if other != "secret_value" and pattern.fullmatch(core) and (new := self.pseudonym(other, core, back)) is not None:
                return head + new + tail[::-1]
        return head + self._secret(core, back) + tail[::-1]

    @staticmethod
    def _windows(text: str) -> list[tuple[int, int]]:
        """Disjoint parts of the text, cut at white space, that hold all places where a value can be."""
        places = [m.span() for m in _ANY.finditer(text)]
        if any(map(text.lower().__contains__, (*SECRET_WORDS, "bearer"))):
            places = sorted(places + [m.span() for m in _LABELLED.finditer(text)])
        out: list[tuple[int, int]] = []
        for start, end in places:
            if out and end + _MARGIN <= out[-1][1]:
                continue
            a = max(0, start - _MARGIN)
            a = max(text.rfind(" ", 0, a), text.rfind("\n", 0, a), 0)
            space = _SPACE.search(text, min(len(text), end + _MARGIN))
            b = space.start() if space else len(text)
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def _found(self, kind: str, value: str) -> str | None:
        """The pseudonym of a value that a pattern took, or None if it isn't valid."""
        found = self.known.get((kind, value), 0)
        if found == 0:
            if len(self.known) >= 200_000:
                self.known.clear()
            found = self.known[kind, value] = self.pseudonym(kind, value)
        return found

    def _value_at(self, text: str, m: re.Match[str], stop: int) -> tuple[int, int, str, str] | None:
        """The valid value that begins where a match does: start, end, kind, pseudonym.

        Of each pattern, in their order, the longest match is tried, and then shorter ones that end before a blank or
        hyphen; a shorter card number needs the groups of a card, as one in ten numbers has a right sum. What another
        pattern tells apart inside a phone number, or a card number of other groups, goes before it.
        """
        first = int(m.lastgroup[1:]) if m.lastgroup != "sv" else _LABEL_AT
        for k in range(first, len(PATTERNS)):
            kind = PATTERNS[k][0]
            x = m if k == first else _EACH[k].match(text, m.start(), stop)
            if x is None:
                continue
            start, end = x.span("sv") if kind == "secret_value" else x.span()
            if kind == "secret_value":
                label, value = text[x.start() : start].rstrip(), x["sv"]
                plain = not any(c.isdigit() for c in value) and label[-1] not in "=\"'"
                if plain or "://" in value or (label[-6:].lower() == "bearer" and len(value) < 12):
                    continue
            gaps = [g.start() for g in _GAP.finditer(text, start, end)] if kind in _SHORTER else []
            for e in (end, *reversed(gaps)):
                value = text[start:e]
                if kind == "card":
                    if not _CARD_GROUPS.fullmatch(value) and (e != end or self._holds(text, start, e, stop)):
                        continue
                elif e != end and (text[e] == "-" or not _EACH[k].fullmatch(text, start, e)):
                    continue
                elif kind == "phone" and (_AFTER.search(text, max(0, start - 2), start) or _DATE.fullmatch(value) or self._holds(text, start, e, stop)):
                    continue
                found = self._found(kind, value)
                if found is not None:
                    return start, e, kind, found
        if PATTERNS[first][0] == "card" and _GAP.search(m[0]) and not self._holds(text, *m.span(), stop):
            found = self._found("phone", m[0])
            return found and (*m.span(), "card", found)
        return None

    def _holds(self, text: str, start: int, end: int, stop: int) -> bool:
        """Whether a valid date, address, social security number or grouped card number begins in a run of numbers."""
        for at in (start, *(g.end() for g in _GAP.finditer(text, start, end))):
            for k in _APART:
                x = _EACH[k].match(text, at, stop)
                if x is not None and self._found(PATTERNS[k][0], x[0]) is not None:
                    return True
            if (c := _CARD_GROUPS.match(text, at, stop)) is not None and (at > start or c.end() < end) and self._found("card", c[0]) is not None and _EACH[_CARD].match(text, at, stop):
                return True
        return False

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and the replaced spans (start, end in the given text, kind)."""
        if not text:
            return text, []
        out, spans, at = [], [], 0
        for a, b in self._windows(text):
            while (m := _ONE.search(text, a, b)) is not None:
                got = self._value_at(text, m, b)
                if got is None:
                    a = m.start() + 1
                    continue
                start, end, kind, found = got
                a = max(end, m.start() + 1)
                if found == text[start:end]:
                    continue
                out += (text[at:start], found)
                spans.append((start, end, "secret" if kind == "secret_value" else kind))
                at = end
        out.append(text[at:])
        return "".join(out), spans


def pseudonymize(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the text with pseudonyms, n_replaced, and the spans replaced (start, end, kind). A narrow map."""

    def make():
        p = Pseudonymizer(key)

        def f(x):
            got = [p.replace(t) for t in x[text_col]]
            return {"id": x[id_col], "text": [t for t, _ in got], "n_replaced": [len(s) for _, s in got], "spans": [[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in got]}

        return f

    kind = dict(docs.dtypes)[id_col]
    out = map_texts(docs, [id_col, text_col], make, f"id {kind}, text string, n_replaced int, spans array<struct<start:int,end:int,kind:string>>")
    return out.select(F.col("id").alias(id_col), "text", "n_replaced", "spans")


def pseudonymize_rows(docs: DataFrame, key: bytes, *, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows with all their columns; ``length_col`` is set to the text's new number of code points."""
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def make():
        p = Pseudonymizer(key)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [p.replace(t)[0] for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([o if t is None or o is None else len(t) for t, o in zip(texts, old, strict=True)], batch.schema.field(size).type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return f

    return replace_batches(docs, make)


def kinds_of(spans: list[tuple[int, int, str]]) -> Counter:
    return Counter(k for _, _, k in spans)
