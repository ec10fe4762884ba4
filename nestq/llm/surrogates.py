"""Replacement of personal data by keyed surrogates of the same kind, script and format.

A surrogate is a keyed permutation of the entity within its own format: digits become digits, vowels vowels and
consonants consonants of the same alphabet, upper case stays upper case, given names from the lists become
given names of the same gender and script, punctuation stays. A permutation never maps two entities
to one, so distinct entities stay distinct, and one entity gets one surrogate in all documents, without any table shared between tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from nestq.llm.common import ready

DEFAULT_KEY = b"change me: the key decides all surrogates"
ROUNDS = 8

# Given names by gender and script.
GIVEN_NAMES = {
    ("f", "latin"): "anna maria julia laura sarah emma lucia elena sofia clara marie claire camille sophie petra ingrid monika heike carmen pilar jane mary linda susan karen".split(),
    ("m", "latin"): "john james robert michael david thomas peter paul hans klaus stefan jürgen pierre jean luc antoine carlos juan pedro miguel antonio george henry mark frank".split(),
    ("f", "cyrillic"): "анна мария елена ольга наталья татьяна ирина светлана юлия екатерина".split(),
    ("m", "cyrillic"): "иван александр сергей дмитрий андрей алексей михаил николай владимир павел".split(),
    ("f", "greek"): "μαρία ελένη αικατερίνη βασιλική σοφία άννα".split(),
    ("m", "greek"): "γεώργιος ιωάννης δημήτριος νικόλαος παναγιώτης χρήστος".split(),
}
# Alphabets as (vowels, consonants); a letter goes to one of its own group.
ALPHABETS = (
    ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    ("áéíóú", "ñç"),
    ("àèìòù", "šžč"),
    ("äöüâêîôû", "ßł"),
    ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"),
    ("αεηιουω", "βγδζθκλμνξπρσςτφχψ"),
)
GROUPS = {c: g for pair in ALPHABETS for g in pair for c in g} | dict.fromkeys("0123456789", "0123456789")


class Permutation:
    """A keyed permutation of 0 .. size - 1 for any size and tweak: Feistel rounds on bits, walked until inside."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, r: int, half: int, bits: int) -> int:
        h = hashlib.blake2b(half.to_bytes((bits + 7) // 8 or 1, "big") + bytes([r]) + tweak, key=hashlib.sha256(self.key).digest(), digest_size=64)
        value = h.digest()
        while len(value) * 8 < bits:
            value += hashlib.blake2b(value, digest_size=64).digest()
        return int.from_bytes(value, "big") & ((1 << bits) - 1)

    def drawn(self, tweak: bytes, k: int) -> int:
        return self._round(b"drawn" + tweak, 0, k, 512)

    def __call__(self, value: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return value
        bits = max(1, -(-(size - 1).bit_length() // 2))
        while True:
            left, right = value >> bits, value & ((1 << bits) - 1)
            for r in range(ROUNDS):
                left, right = right, left ^ self._round(tweak, r, right, bits)
            value = left << bits | right
            if value < size:
                return value


def permuted(text: str, permutation: Permutation, tweak: bytes, valid: Callable[[str], bool] = lambda s: True) -> str:
    """``text`` with letters and digits replaced within their groups. ``valid`` must hold for the text itself; the result is valid too and another text.

    Where the permutation leads to none, the text's letters and digits are drawn by the key, which may (seldom) give two texts one surrogate.

    Case is a matter of format: two spellings of one text get two spellings of one surrogate.
    """
    low = [c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c for c in text]
    groups = [GROUPS.get(c) for c in low]
    size, value = 1, 0
    for c, g in zip(low, groups, strict=True):
        if g:
            value, size = value * len(g) + g.index(c), size * len(g)
    shape = tweak + "".join(g[0] if g else c for c, g in zip(low, groups, strict=True)).encode()

    def spelled(rest: int) -> str:
        out = []
        for c, g, was in zip(reversed(low), reversed(groups), reversed(text), strict=True):
            if g:
                rest, k = divmod(rest, len(g))
                c = g[k].upper() if was != c else g[k]
            out.append(c if g else was)
        return "".join(reversed(out))

    now = value
    for _ in range(10_000):
        now = permutation(now, size, shape)
        if valid(found := spelled(now).lower()) and found != text.lower():
            return spelled(now)
        if now == value:  # once around
            break
    for k in range(1000 if size > 1 else 0):
        now = permutation.drawn(shape + "".join(low).encode(), k) % size
        if valid(found := spelled(now).lower()) and found != text.lower():
            return spelled(now)
    return re.sub(r"[^\W_]+", lambda m: _drawn_word(m.group(), permutation, tweak), text)


def _drawn_word(word: str, permutation: Permutation, tweak: bytes) -> str:
    """Keyed Latin letters in place of a word that no alphabet holds."""
    letters, now = ALPHABETS[0][1], permutation.drawn(tweak + word.lower().encode(), 0)
    out = "".join(letters[now // len(letters) ** i % len(letters)] for i in range(max(8, len(word))))
    return out.upper() if word.isupper() and len(word) > 1 else out.capitalize() if word[0].isupper() else out


def luhn_rest(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    gender: str = ""


# The kinds of entity and their patterns, in order of precedence.
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.){1,8}[A-Za-zА-Яа-я]{2,24}(?![\w-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])")),
    ("ip6", re.compile(r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){1,6}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z+])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])(?:[0-9]{10}|[0-9]{3}-[0-9]{4})(?![0-9A-Za-z-]|\.[0-9])")),
)
HONORIFICS = {"mr": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "господин": "m", "κύριος": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "госпожа": "f", "κυρία": "f", "dr": "", "prof": ""}
#: A part of a name: letters, with hyphens and apostrophes within, or an initial with its full stop.
PART = r"[^\W\d_]\.(?=[ ][^\W\d_])|[^\W\d_]+(?:['’-][^\W\d_]+)*"
NAME = re.compile(r"\b(" + "|".join(sorted(HONORIFICS, key=len, reverse=True)) + rf")\b(\.?[ ]+)((?:{PART})(?:[ ](?:{PART})){{0,2}})", re.IGNORECASE)
SPLIT = re.compile(r"[^\W\d_]+")
GENDER_OF = {n: (g, s) for (g, s), names in GIVEN_NAMES.items() for n in names}
GIVEN_SPELLINGS = {x for n in GENDER_OF for x in (n.capitalize(), n.upper())}
WORD = re.compile(r"[^\W\d_]+")
MAY_HOLD = re.compile(r"[0-9@]|::")
MAY_NAME = re.compile(r"\b(?:" + "|".join(sorted(HONORIFICS, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def _uncased(c: str) -> bool:
    """Whether a letter's script has no upper case."""
    return c.isalpha() and c.lower() == c.upper()


def detect(text: str) -> list[Entity]:
    """Entities in order, none overlapping: names behind an honorific and their parts wherever else the text has them, listed given names, and PATTERNS; where kinds overlap the one named first in PATTERNS holds."""
    found: list[Entity] = []
    if MAY_HOLD.search(text):
        for kind, pattern in PATTERNS:
            if kind == "email" and "@" not in text or kind == "ip6" and text.count(":") < 2:
                continue
            found += [Entity(kind, *m.span()) for m in pattern.finditer(text)]
    if MAY_NAME.search(text):
        for m in NAME.finditer(text):
            for part in re.finditer(r"[^ ]+", m.group(3)):
                if not (part.group()[0].isupper() or _uncased(part.group()[0])):
                    break
                for w in SPLIT.finditer(part.group()):  # each piece of a hyphenated or apostrophed name by itself, so all have surrogates
                    begin = m.start(3) + part.start()
                    found.append(Entity("name", begin + w.start(), begin + w.end(), HONORIFICS[m.group(1).lower()]))
    genders = {text[e.start : e.end].lower(): e.gender for e in reversed(found) if e.kind == "name"}
    if genders or not GIVEN_SPELLINGS.isdisjoint(WORD.findall(text)):
        for m in WORD.finditer(text):
            word = m.group()
            low = word.lower()
            if (word[0].isupper() or _uncased(word[0])) and (low in genders or low in GENDER_OF):
                found.append(Entity("name", *m.span(), genders[low] if low in genders else GENDER_OF[low][0]))
    rank = {k: i for i, (k, _) in enumerate(PATTERNS)}
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (e.start, rank.get(e.kind, 99))):
        while out and e.start < out[-1].end and rank.get(e.kind, 99) < rank.get(out[-1].kind, 99):
            out.pop()
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def _private(value: int) -> bool:
    a, b = value >> 24, value >> 16 & 255
    return a in (0, 10, 127) or (a, b) in ((192, 168), (169, 254)) or (a == 172 and 16 <= b < 32)


class Surrogates:
    """Surrogates of entities under one key."""

    REMEMBERED = 100_000

    def __init__(self, key: bytes = DEFAULT_KEY):
        self.permutation, self.known = Permutation(key), {}

    def __call__(self, kind: str, text: str, gender: str = "") -> str:
        at = (kind, text, gender if kind == "name" else "")
        if at not in self.known:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            self.known[at] = getattr(self, "_" + kind)(text, gender)
        return self.known[at]

    def _email(self, text: str, _: str) -> str:
        body, dot, top = text.rpartition(".")
        return permuted(body, self.permutation, b"email", lambda s, was=body.lower(): s != was) + dot + top

    def _iban(self, text: str, _: str) -> str:
        return text[:2] + permuted(text[2:], self.permutation, b"iban" + text[:2].encode(), lambda s, was=text[2:].lower(): s != was)

    def _ssn(self, text: str, _: str) -> str:
        def valid(s):
            return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"

        ok = valid(text)
        return permuted(text, self.permutation, b"ssn", lambda s: valid(s) == ok and s != text)

    def _phone(self, text: str, _: str) -> str:
        m = re.match(r"\+(?:1(?=[0-9]{10}$)|[0-9]{1,3}[ .-])", text)
        head = m.group(0) if m else ""
        digits = [c for c in text[len(head) :] if c.isdigit()]
        plain = "".join(digits)
        kind = (plain[0] in "01", len(plain) == 10 and plain[3] in "01")  # area and exchange codes stay possible ones
        new = iter(permuted(plain, self.permutation, b"phone", lambda s: (s[0] in "01", len(s) == 10 and s[3] in "01") == kind and s != plain))
        return head + "".join(next(new) if c.isdigit() else c for c in text[len(head) :])

    def _card(self, text: str, _: str) -> str:
        digits = "".join(c for c in text if c.isdigit())
        rest = luhn_rest(digits)

        def full(body: str) -> str:
            return next(body + c for c in "0123456789" if luhn_rest(body + c) == rest)

        body = permuted(digits[1:-1], self.permutation, b"card" + digits[:1].encode() + bytes([rest]), lambda s: s != digits[1:-1])
        new = iter(full(digits[0] + body))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def _ip(self, text: str, _: str) -> str:
        value = now = sum(int(p) << 8 * (3 - i) for i, p in enumerate(text.split(".")))
        while True:
            now = self.permutation(now, 1 << 32, b"ip")
            if _private(now) == _private(value) and now != value:
                return ".".join(str(now >> 8 * (3 - i) & 255) for i in range(4))

    def _ip6(self, text: str, _: str) -> str:
        """Every group by itself becomes another of as many hexadecimal digits; colons stay."""
        digits = "0123456789abcdef"

        def group(m: re.Match) -> str:
            was = m.group()
            value, size = int(was, 16), 16 ** len(was)
            now = self.permutation(value, size, b"ip6" + bytes([len(was)]))
            new = "".join(digits[now // 16**k % 16] for k in reversed(range(len(was))))
            return new.upper() if was.upper() == was and was.lower() != was else new

        new = re.sub(r"[0-9A-Fa-f]+", group, text)
        return new if new.lower() != text.lower() else self._ip6(text[:-1] + digits[(int(text[-1], 16) + 1) % 16], _)

    def _name(self, text: str, gender: str) -> str:
        low = text.lower()
        if low in GENDER_OF:
            group = GENDER_OF[low]
            names = GIVEN_NAMES[group]
            ring = [names[self.permutation(k, len(names), repr(group).encode())] for k in range(len(names))]
            new = ring[(ring.index(low) + 1) % len(ring)]  # each name goes to the next, none to itself
            return new.upper() if text.isupper() and len(text) > 1 else new.capitalize() if text[0].isupper() else new
        return permuted(text, self.permutation, b"name", lambda s: s not in GENDER_OF and s != low)

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int, str]]]:
        """The text with all entities replaced, and (kind, start, end, surrogate) of each.

        Distinctness is checked: were two entities of a text to meet in one surrogate, the later would be permuted on.
        """
        if not text:
            return text, []
        out, at, told = [], 0, []
        owner: dict[tuple[str, str], str] = {}
        for e in detect(text):
            was = text[e.start : e.end]
            same = (e.kind, was.lower())
            new = self(e.kind, was, e.gender)
            while owner.setdefault((e.kind, new.lower()), same[1]) != same[1]:
                new = self(e.kind, new, e.gender)
            out += [text[at : e.start], new]
            told.append((e.kind, e.start, e.end, new))
            at = e.end
        return "".join(out) + text[at:], told


def replace_private(documents: DataFrame, key: bytes = DEFAULT_KEY, text_column: str = "text") -> DataFrame:
    """``documents``, all columns, with entities in the text replaced, and n_entities (long) and entities (string: kind:start:end, in code points of the old text) appended.

    Null and empty texts stay as they are, with no entities. The same entity has the same surrogate in all rows; repeated rows
    come out alike; existing columns n_entities and entities are replaced; an empty table gives an empty result. No shuffle.
    """
    ready(documents.sparkSession)
    plain = documents.drop("n_entities", "entities")
    at = plain.columns.index(text_column)
    kinds = [T.StructField("n_entities", T.LongType()), T.StructField("entities", T.StringType())]

    def run(batches):
        surrogates = Surrogates(key)
        for b in batches:
            done = [surrogates.replace(t) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array([t for t, _ in done], b.schema.field(at).type)
            told = pa.array([",".join(f"{k}:{s}:{e}" for k, s, e, _ in x) for _, x in done], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) for _, x in done], pa.int64()), told], [*b.schema.names, "n_entities", "entities"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *kinds]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_private(docs)
