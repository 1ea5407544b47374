"""Personal data replaced by keyed surrogates of the same type and format.

Mentions are found in the whole text and normalised to entities (type, value): a phone number is its digits, an
e-mail address its lower case, so that all mentions of an entity get one surrogate, laid into the format of each
mention. A surrogate is a keyed permutation of the values of one format, whatever its length: digits stay digits,
letters keep case and script, addresses stay valid, card numbers and IBANs keep a right check digit. Names in Latin,
Cyrillic and Greek letters are built anew from syllables, with endings of their gender, about as long and written as
the name; other scripts permute their letters, and initials go round the letters of their script and case.

What is left to check goes over the table of distinct entities, by joins: a surrogate must not be an entity that
occurs in the texts, nor one that another entity has. Those that fail get the next attempt until none does; names get
more syllables on the way. Entities left after ``MOST_ATTEMPTS``, whose format is too full, and values without a
character that could change get one of a wider format of their type: more classes of characters and, where the type
allows it, more of them, which grow with the attempts. Values of all types are compared, without regard to
capitals. Only initials are not checked: they go round classes of letters that share none.

Names of persons are found behind a form of address in ``TITLES``: initials, a given name and a surname that begin with
capitals; and, without one, where a given name of ``GIVEN`` comes before a word with a capital. Their words are then
found in the whole of that text, in any capitals that begin with one: "NOVAK" and "Novak" are one entity. Not found are
other names that no title precedes in their text, further words of longer names, and names in scripts without capitals.

Only entities that needed another attempt have to be looked up when texts are rewritten. They are broadcast up to
a bound; beyond it, they are joined to the documents that mention them.

Defined cases: null text stays null; empty text has no mentions; a null doc_id is a document; repeated rows get
equal results; overlapping mentions: the first by start, then the longest, counts; an empty table gives no rows;
input columns named like an output give way.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save, ship, without

OUTPUT = {"n_entities": "int", "entity_types": "string", "spans": "array<struct<start:int,end:int,type:string>>"}
#: Exceptions that may be broadcast.
BROADCAST_EXCEPTIONS = 100_000
#: Attempts within the format of an entity; those from ``WIDE`` on leave it.
MOST_ATTEMPTS = 64
WIDE = 1 << 16

#: Forms of address and their gender (f, m, or none).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f", "Господин": "m", "Госпожа": "f",
          "Sir": "m", "Madam": "f", "Lady": "f", "Lord": "m", "Dr": "", "Prof": "", "Professor": "", "Doctor": "", "Fräulein": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f", "Mme": "f", "Mlle": "f", "Docteur": "", "Κύριος": "m", "Κυρία": "f"}
#: Given names by gender and script.
GIVEN = {
    "given_f_latin": ["Anna", "Carla", "Clara", "Diana", "Elena", "Emma", "Irene", "Julia", "Laura", "Lucia", "Maria", "Nora", "Paula", "Rosa", "Sofia", "Vera"],
    "given_m_latin": ["Adam", "Bruno", "Carlos", "Daniel", "David", "Felix", "Hugo", "Jonas", "Leon", "Martin", "Oscar", "Pablo", "Peter", "Simon", "Thomas", "Victor"],
    "given_f_cyrillic": ["Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга", "София", "Юлия"],
    "given_m_cyrillic": ["Антон", "Борис", "Виктор", "Денис", "Иван", "Олег", "Павел", "Сергей"],
}
_run = lambda a, b: "".join(map(chr, range(ord(a), ord(b) + 1)))
CLASSES = [_run("0", "9"), _run("a", "z"), _run("A", "Z"), _run("а", "я"), _run("А", "Я"), _run("α", "ρ") + _run("σ", "ω"), _run("Α", "Ρ") + _run("Σ", "Ω"), _run("à", "ö"), _run("ø", "ÿ"), _run("À", "Ö"), _run("Ø", "Þ")]
_CLASS = {c: alphabet for alphabet in CLASSES for c in alphabet}
HEX = "0123456789abcdef"


def _mac(key: bytes, text: str) -> bytes:
    return hashlib.blake2b(text.encode(), key=hashlib.blake2b(key).digest()).digest()


def permuted(value: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the numbers with the given radices.

    Six rounds: each adds to one half, place by place, a key stream that depends on the whole other half.
    """
    half = len(radices) // 2
    sides, sizes = [list(value[:half]), list(value[half:])], [radices[:half], radices[half:]]
    head = _mac(key, f"{tweak}|{','.join(map(str, radices))}")
    for turn in range(6):
        s = turn % 2
        other = b"".join(v.to_bytes(4, "big") for v in sides[1 - s])
        stream = hashlib.shake_256(head + bytes([turn]) + other).digest(8 * len(sizes[s]))
        sides[s] = [(v + int.from_bytes(stream[8 * i : 8 * i + 8], "big")) % r for i, (v, r) in enumerate(zip(sides[s], sizes[s]))]
    return sides[0] + sides[1]


def same_format(value: str, key: bytes, tweak: str, alphabets: list[str] | None = None) -> str:
    """``value`` with each character replaced by one of its class, as one permutation; characters of no class stay."""
    places = alphabets or [_CLASS.get(c, "") for c in value]
    at = [i for i, a in enumerate(places) if a]
    got = permuted([places[i].index(value[i]) for i in at], [len(places[i]) for i in at], key, tweak) if at else []
    out = list(value)
    for i, v in zip(at, got):
        out[i] = places[i][v]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


@cache
def _letters(script: str, category: str) -> str:
    return "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == category and unicodedata.name(c, "").split(" ")[0] == script and unicodedata.normalize("NFKC", c) == c)


def alphabet(c: str) -> str:
    """The class of ``c``; of a letter outside ``CLASSES``, the letters of its script and case."""
    if c in _CLASS:
        return _CLASS[c]
    if unicodedata.category(c) not in ("Lu", "Ll", "Lo"):
        return ""
    script = unicodedata.name(c, "").split(" ")[0]
    plain = {"LATIN": 1, "CYRILLIC": 3, "GREEK": 5}.get(script)
    if plain is not None and c.lower() != c.upper():
        return CLASSES[plain + c.isupper()]
    return _letters(script, unicodedata.category(c))


@cache
def _initial_classes() -> list[str]:
    """All letters in classes that share none: those of ``CLASSES``, then those of one script and case, and what is left of each case."""
    by_script: dict[tuple[str, str], list[str]] = {}
    for c in map(chr, range(0x110000)):
        case = unicodedata.category(c)
        if (case[0] == "L" or case in ("Nl", "No")) and c not in _CLASS:
            plain = unicodedata.normalize("NFKC", c) == c
            by_script.setdefault((unicodedata.name(c, "").split(" ")[0] if plain else "", case), []).append(c)
    rest: dict[str, list[str]] = {}
    for (script, case), letters in list(by_script.items()):
        if not script or len(letters) < 2:
            rest.setdefault(case, []).extend(letters)
            del by_script[script, case]
    return [*CLASSES[1:], *map("".join, by_script.values()), *map("".join, rest.values())]


@cache
def _next_initial(key: bytes) -> dict[str, str]:
    """One keyed cycle through the letters of each class, so none stays and no two get the same."""
    out = {}
    for letters in _initial_classes():
        cycle = sorted(letters, key=lambda c: _mac(key, f"initial|{c}"))
        out.update(zip(cycle, [*cycle[1:], cycle[0]]))
    return out


def wider(kind: str, value: str, key: bytes, attempt: int) -> str:
    """A keyed draw from a wider format of the type, larger with every eighth attempt; joins check that it is free."""
    extra = 1 + attempt // 8

    def drawn(places: list[str]) -> str:
        stream = hashlib.shake_256(_mac(key, f"wide|{kind}|{attempt}|{value}")).digest(8 * len(places))
        return "".join(a[int.from_bytes(stream[8 * i : 8 * i + 8], "big") % len(a)] for i, a in enumerate(places))

    digits, lower, upper = CLASSES[:3]
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, _, top = domain.rpartition(".")
        return drawn([*([lower + digits if c.isalnum() else c for c in local]), *[lower] * extra]) + "@" + same_format(name, key, "domain") + "." + top
    if kind == "ip":
        octets = drawn([_run(chr(0), chr(255))] * 4)
        return ".".join(str(ord(c)) for c in octets)
    if kind == "card":
        inner = drawn([digits] * (len(value) - 1))
        return inner + str(luhn(inner))
    if kind == "iban":
        rest = drawn([digits if c.isdigit() else upper for c in value[4:]])
        return value[:2] + iban_check(value[:2], rest) + rest
    if kind == "phone":  # a longer number behind the country code
        cut = len(value) - 10 if len(value) > 10 else 0
        return value[:cut] + drawn([digits] * (len(value) - cut + extra))
    if kind in ("account", "ssn"):
        return drawn([digits] * len(value))
    if kind == "access_key":
        return value[:4] + drawn([upper + digits] * (len(value) - 4))
    if kind == "secret":
        return drawn([HEX if set(value) <= set(HEX) else lower + upper + digits] * (len(value) + extra))
    places = [alphabet(c) or c for c in value]
    tail = next((alphabet(c.lower() if len(c.lower()) == 1 else c) for c in reversed(value) if alphabet(c)), "") or lower
    return drawn([*places, *[tail] * extra])


#: Letters that syllables of a script are built from (first, middle), and endings by kind.
SYLLABLES = {
    "LATIN": ("bdfghklmnprstvz", "aeiou", {"given_f": ["a", "ia", "ina", "ella", "ine"], "given_m": ["o", "us", "an", "ert", "in"], "family": ["er", "en", "ov", "ard", "es"]}),
    "CYRILLIC": ("бвгдзклмнпрстх", "аеиоу", {"given_f": ["а", "ия", "ина", "ена"], "given_m": ["ан", "ор", "ий", "им"], "family": ["енко", "ук", "ич", "ян"]}),
    "GREEK": ("βγδζκλμνπρστφχ", "αειου", {"given_f": ["α", "η", "ινα"], "given_m": ["ος", "ης", "ιας"], "family": ["ου", "ακης", "ιδης"]}),
}


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def name_like(kind: str, value: str, key: bytes, attempt: int) -> str:
    """A keyed name of the gender, script, rough length and capitals of ``value``, with more syllables after every fourth attempt."""
    made = []
    for i, part in enumerate(value.split("-")):
        first, middle, endings = SYLLABLES[_script(value[0])]
        n = max(1, (len(part) - 2) // 2) + attempt // 4
        draw = iter(hashlib.shake_256(_mac(key, f"name|{kind}|{attempt}|{i}|{value}")).digest(4 * (2 * n + 2)))
        pick = lambda of: of[sum(next(draw) << 8 * j for j in range(4)) % len(of)]
        new = "".join(pick(first) + pick(middle) for _ in range(n)) + pick(first) + pick(endings[kind])
        made.append(new.upper() if part.isupper() and len(part) > 1 else new.capitalize() if part[:1].isupper() else new)
    return "-".join(made)


NAMES = ("given_f", "given_m", "family")


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of an entity: one of its format for each attempt, one of a wider format from ``WIDE`` on."""
    if kind == "initial":
        return _next_initial(key).get(value, value)
    if attempt >= WIDE:
        return wider(kind, value, key, attempt - WIDE)
    tweak = f"{kind}|{attempt}"
    if kind in NAMES and len(value) > 1 and _script(value[0]) in SYLLABLES:
        return name_like(kind, value, key, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, _, top = domain.rpartition(".")
        return same_format(local, key, f"{tweak}|{domain}") + "@" + same_format(name, key, "domain") + "." + top
    if kind == "ip":
        octets = value.split(".")
        low, size = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
        got = permuted([int(o) - low[len(o)] for o in octets], [size[len(o)] for o in octets], key, tweak)
        return ".".join(str(v + low[len(o)]) for v, o in zip(got, octets))
    if kind == "card":
        inner = value[0] + same_format(value[1:-1], key, f"{tweak}|{value[0]}")
        return inner + str(luhn(inner))
    if kind == "iban":
        rest = same_format(value[4:], key, f"{tweak}|{value[:2]}")
        return value[:2] + iban_check(value[:2], rest) + rest
    if kind == "phone":  # the digits after a country code; an area code begins as it may
        cut = len(value) - 10 if len(value) > 10 else 0
        return value[:cut] + same_format(value[cut:], key, f"{tweak}|{value[:cut]}", ["23456789" if value[cut] in "23456789" else "01", *["0123456789"] * (len(value) - cut - 1)])
    if kind == "access_key":
        return value[:4] + same_format(value[4:], key, tweak)
    if kind == "secret" and set(value) <= set(HEX):
        return same_format(value, key, tweak, [HEX] * len(value))
    return same_format(value, key, tweak)


_EMAIL = re.compile(r"@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_LOCAL = frozenset(CLASSES[0] + CLASSES[1] + CLASSES[2] + "._%+-")
_NUMBER = re.compile(r"\+?\(?\d[\d ().\-]{4,}\d")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}")
_PLUS = re.compile(r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}")
_CARD = re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?|\d{4}[ -]\d{6}[ -]\d{5}")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCESS = re.compile(r"A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"[=:]\s*[\"']?([A-Za-z0-9+/_\-]{8,})")
_SECRET = re.compile(r"(?:password|passwd|pwd|token|secret|api[_ -]?key)$", re.IGNORECASE)
_LONG_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,}(?![A-Za-z0-9])")
_WORD, _INITIAL = r"[^\W\d_]+(?:-[^\W\d_]+)?", r"[^\W\d_]\. ?"
_NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?:((?:{_INITIAL})+)({_WORD})|({_WORD})(?: ((?:{_INITIAL})*)({_WORD}))?)")
_KNOWN = {name: kind[:7] for kind, names in GIVEN.items() for name in names}
_UNTITLED = re.compile(rf"(?<!\w)({'|'.join(_KNOWN)}) ((?:{_INITIAL})*)({_WORD})(?!\w)")
_BARE = re.compile(rf"(?<!\w){_WORD}(?!\w)")
_SHORT = re.compile(rf"(?:{_INITIAL})+({_WORD})(?!\w)")


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _NUMBER.finditer(text):
        at, end = m.span()
        if at and text[at - 1].isalnum():
            while at < end and text[at].isdigit():
                at += 1
        while at < end:
            for kind, pattern in (("ip", _IP), ("card", _CARD), ("ssn", _SSN), ("phone", _PHONE), ("phone", _PLUS)):
                got = pattern.match(text, at, end)
                if got and not text[got.end() : got.end() + 1].isalnum() and not (kind == "ip" and re.match(r"\.\d", text[got.end() : got.end() + 2])):
                    digits = re.sub(r"\D", "", got[0])
                    if kind == "card":
                        kind = "card" if luhn(digits[:-1]) == int(digits[-1]) else "account"
                    yield at, got.end(), kind, got[0] if kind == "ip" else digits
                    at = got.end()
                    break
            else:  # on to the next number in the run
                at += 1
                while at < end and (text[at - 1].isdigit() or text[at] not in "+(0123456789"):
                    at += 1


def _as_name(word: str) -> str:
    """A name as its entity is known, whatever its capitals."""
    return "-".join(p[:1].upper() + p[1:].lower() for p in word.split("-"))


def _gender(title: str, given: str) -> str:
    if TITLES[title]:
        return TITLES[title]
    return _KNOWN[given][6:] if given in _KNOWN else "f" if given[-1:].lower() in "aаα" else "m"


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Names behind a title or a known given name, and all mentions of their words in the same text; an initial counts only before such a word."""
    found, own, initials = [], {}, {}

    def add(a: int, b: int, kind: str) -> None:
        # one word has one surrogate in a text
        word = _as_name(text[a:b])
        found.append((a, b, (own if b - a > 1 else initials).setdefault(word, kind), word))

    for m in _NAME.finditer(text):
        spans = []
        for i in (2, 3) if m[2] else (4, 5, 6):
            if m[i]:
                spans += [(j, j + 1) for j in range(*m.span(i)) if text[j] not in ". "] if i in (2, 5) else [m.span(i)]
        spans = list(takewhile(lambda s: text[s[0]].isupper(), spans))
        for n, (a, b) in enumerate(spans):
            given = f"given_{_gender(m[1], _as_name(text[a:b]))}"
            last = n == len(spans) - 1 and not (n == 0 and _as_name(text[a:b]) in _KNOWN)
            add(a, b, "family" if last else given if b - a > 1 else "initial")
    for m in _UNTITLED.finditer(text):
        if m[3][0].isupper():
            add(*m.span(1), _KNOWN[m[1]])
            for j in range(*m.span(2)):
                if text[j] not in ". ":
                    add(j, j + 1, "initial")
            add(*m.span(3), "family")
    for m in _BARE.finditer(text) if own else ():
        word, at = m[0], m.start()
        if len(word) == 1:
            if word in initials and (rest := _SHORT.match(text, at)) and _as_name(rest[1]) in own:
                found.append((at, at + 1, initials[word], word))
        elif word[0].isupper() and _as_name(word) in own:
            found.append((at, m.end(), own[_as_name(word)], _as_name(word)))
        else:
            for part in word.split("-"):
                if part[:1].isupper() and len(part) > 1 and _as_name(part) in own:
                    found.append((at, at + len(part), own[_as_name(part)], _as_name(part)))
                at += len(part) + 1
    return found


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) of every mention, in order, without overlaps."""
    found = []
    for m in _EMAIL.finditer(text):
        at = m.start()
        while at and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            found.append((at, m.end(), "email", text[at : m.end()].lower()))
    found += _numbers(text)
    found += [(*m.span(), "access_key", m[0]) for m in _ACCESS.finditer(text) if not (m.start() and text[m.start() - 1].isalnum())]
    for m in _ASSIGNED.finditer(text):
        at = m.start()
        while at and text[at - 1].isspace():
            at -= 1
        at -= bool(at) and text[at - 1] in "\"'"
        if _SECRET.search(text[max(0, at - 16) : at]):  # its words are shorter
            found.append((*m.span(1), "secret", m[1]))
    found += [(*m.span(), "secret", m[0]) for m in _LONG_HEX.finditer(text)]
    for m in _IBAN.finditer(text):
        bare = m[0].replace(" ", "")
        if iban_check(bare[:2], bare[4:]) == bare[2:4]:
            found.append((*m.span(), "iban", bare))
    if any(t in text for t in TITLES) or any(n in text for n in _KNOWN):
        found += _names(text)
    out, upto = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= upto:
            out.append(x)
            upto = x[1]
    return out


def laid(mention: str, kind: str, new: str) -> str:
    """A surrogate in the format of a mention."""
    if kind in ("card", "account", "phone", "ssn"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "iban":
        chars = iter(new)
        return "".join(c if c == " " else next(chars) for c in mention)
    if kind == "email":
        local = mention.rpartition("@")[0]
        if len(new) > len(mention):  # letters behind the local part
            mention = local + " " * (len(new) - len(mention)) + mention[len(local) :]
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new))
    if kind in NAMES:
        return new.upper() if len(mention) > 1 and mention.isupper() else new
    return new


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {(kind, value) for text in batch.column(0) if text.is_valid for _, _, kind, value in mentions(text.as_py())}
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["kind", "value"])


def _named(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, value, attempt = (batch.column(i).to_pylist() for i in range(3))
            new = [surrogate(*x, key, n) for *x, n in zip(kind, value, attempt)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.string())], names=["kind", "value", "attempt", "new"])

    return run


def _plain(column: str) -> F.Column:
    """A value as it is compared with those of all types."""
    return F.lower(F.col(column))


def assign(docs: DataFrame, key: bytes, text: str = "text", attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """(kind, value, attempt, new) for every distinct entity; all of ``new`` differ from each other and from every value, of whatever kind and in whatever capitals; initials differ from each other."""
    schema = "kind string, value string, attempt int, new string"
    found = save(docs.select(text).mapInArrow(_detected, "kind string, value string").distinct(), "entities")
    now = save(found.select("kind", "value", F.lit(0).alias("attempt")).mapInArrow(_named(key), schema), "surrogates")
    closed = F.col("kind") == "initial"
    taken = found.where(~closed).select(_plain("value").alias("v")).distinct()
    while True:
        real = now.where(~closed).join(taken, _plain("new") == F.col("v"), "left_semi").select("kind", "value")
        # of several entities with one surrogate, the one that had it first keeps it
        order = F.struct("attempt", "value", "kind")
        open_now = now.where(~closed).withColumn("_plain", _plain("new"))
        several = open_now.groupBy("_plain").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("keeps")).where("n > 1")
        several = open_now.join(several, "_plain").where(order != F.col("keeps")).select("kind", "value")
        again = save(real.unionByName(several).distinct(), "again")
        if not again.limit(1).count():
            break
        # a value that its permutations leave as it is has no character that could change
        tried = F.when((F.col("attempt") + 1 < attempts) & ((F.col("attempt") < 3) | (F.col("new") != F.col("value"))), F.col("attempt") + 1)
        next_try = now.join(again, ["kind", "value"], "left_semi").select("kind", "value", F.coalesce(tried, F.greatest(F.col("attempt") + 1, F.lit(WIDE))).alias("attempt"))
        now = save(now.join(again, ["kind", "value"], "left_anti").unionByName(next_try.mapInArrow(_named(key), schema)), "surrogates")
    return now


def _rewritten(key: bytes, schema: pa.Schema, text_at: int, attempts: dict[tuple[str, str], int], extra: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], str] = {}
        for batch in batches:
            texts, n, types, spans = [], [], [], []
            own = batch.column(batch.num_columns - 1).to_pylist() if extra else None
            for row, text in enumerate(batch.column(text_at).to_pylist()):
                found = mentions(text) if text else []
                mine = {(x["kind"], x["value"]): x["new"] for x in own[row] or ()} if extra else {}
                parts, at = [], 0
                for a, b, kind, value in found:
                    new = mine.get((kind, value)) or known.get((kind, value))
                    if new is None:
                        new = known[kind, value] = surrogate(kind, value, key, attempts.get((kind, value), 0))
                    parts += [text[at:a], laid(text[a:b], kind, new)]
                    at = b
                texts.append("".join([*parts, text[at:]]) if found else text)
                n.append(len(found))
                types.append(",".join(sorted({k for _, _, k, _ in found})))
                spans.append([{"start": a, "end": b, "type": k} for a, b, k, _ in found])
            if len(known) > 200_000:
                known.clear()
            made = [pa.array(x, schema.field(c).type) for c, x in zip(OUTPUT, (n, types, spans))]
            kept = [pa.array(texts, schema.field(j).type) if j == text_at else batch.column(j) for j in range(len(schema) - len(OUTPUT))]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema=schema)

    return run


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``, ``entity_types`` and ``spans`` (in characters of the input)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if not key:
        raise ValueError("a key is needed")
    ship(docs.sparkSession)
    docs = without(docs, OUTPUT)
    table = assign(docs, key, text)
    odd = table.where("attempt > 0")
    shape = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.lit(None).cast(t).alias(k) for k, t in OUTPUT.items()]).schema
    schema, at = to_arrow_schema(shape), docs.columns.index(text)
    if odd.count() <= BROADCAST_EXCEPTIONS:
        attempts = {(r.kind, r.value): r.attempt for r in odd.select("kind", "value", "attempt").collect()}
        return docs.mapInArrow(_rewritten(key, schema, at, attempts, False), shape)
    # by text: which exceptions it mentions
    by_text = docs.select(F.xxhash64(text).alias("_h"), F.col(text).alias("t")).where("t is not null").mapInArrow(_by_text, "_h long, kind string, value string").distinct()
    held = by_text.join(odd, ["kind", "value"]).groupBy("_h").agg(F.collect_list(F.struct("kind", "value", "new")).alias("_own"))
    joined = docs.withColumn("_h", F.xxhash64(text)).join(held, "_h", "left").select(*docs.columns, "_own")
    return joined.mapInArrow(_rewritten(key, schema, at, {}, True), shape)


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(h, k, v) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, v in {x[2:] for x in mentions(text)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["_h", "kind", "value"])
