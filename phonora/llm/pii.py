"""Surrogate generation: personal data replaced by keyed, type-consistent surrogates.

A keyed Feistel network puts each domain of entities (digits by digits, letters by letters of the same
script and vowel class) in a secret cyclic order, and an entity is replaced by the next one.  So a
surrogate has the format of the original, equal entities get equal surrogates in every document
(coreference), different ones different ones (no collisions), and none stands for itself.  Where the
result must satisfy a rule (check digits, address ranges), the walk goes on until it does, which keeps all
of that.  What is permuted is the normal form (digits without separators, letters without case), so
spellings of one entity get spellings of one surrogate.  First names are exchanged among names of the same
gender and script.  Names are found by titles, a list of first names, and context words.  Whoever has the
key can undo the replacement, so it is an argument without a default.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonora.llm.common import map_arrow

ROUNDS = 8
KINDS = ("email", "ip", "iban", "card", "ssn", "phone", "name")

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])", re.A)
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\w]|\.[0-9])", re.A)
_IBAN = re.compile(r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w])", re.A)
_CARD = re.compile(r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![\w-])", re.A)
_SSN = re.compile(r"(?<![\w.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A)
_PHONE = re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])|(?<![\w+])\+[0-9]{7,15}(?![\w-])|(?<![\w.+/-])0[0-9]{1,4}/[0-9]{5,9}(?![\w/-])", re.A)
#: Country calling codes of one and two digits; all others have three (fixed values).
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

#: First names that are known, by script and gender; a surrogate is another one of the same list.
NAMES = {
    ("Latin", "f"): "Anna Maria Laura Julia Sophie Emma Clara Marie Elena Lucia Sarah Alice Jane Mary Emily Ingrid Carmen Camille Claire Paula".split(),
    ("Latin", "m"): "John James Peter Paul Thomas Michael David Martin Carlos Pedro Pierre Jean Hans Karl Robert William Henri Diego Lukas Simon".split(),
    ("Cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("Cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей".split(),
    ("Greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα".split(),
    ("Greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος".split(),
}
_OF_NAME = {n: k for k, names in NAMES.items() for n in names}
_TITLES = {"m": "Mr|Herr|Monsieur|Señor|Sr|Don|Господин|Κύριος|السيد", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|Госпожа|Κυρία|السيدة", "": "Dr|Prof"}
_TITLE = rf"(?:{'|'.join(sorted('|'.join(_TITLES.values()).split('|'), key=len, reverse=True))})\.?"
_CAPITAL = r"(?:[A-ZÀ-ÖØ-ÞΑ-ΩΆΈΉΊΌΎΏА-ЯЁ][a-zß-öø-ÿα-ωά-ώа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?|[ء-ي]{2,})"
_NAME = re.compile(rf"\b(?P<title>{_TITLE} )(?P<a>{_CAPITAL})(?: (?P<b>{_CAPITAL}))?|\b(?P<first>{'|'.join(map(re.escape, _OF_NAME))})(?: (?P<last>{_CAPITAL}))?\b")
#: Words before which, or behind which, two capitalised words are a person.
_BEFORE = r"[Mm]y name is|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]e llamo|[Mm]i nombre es|Меня зовут|Με λένε|اسمي|[Nn]ame:|[Nn]om :|[Nn]ombre:|Имя:|[Aa]uthor:|[Cc]ontact:?|[Cc]ustomer:?|[Pp]atient(?:in)?:?|[Ee]mployee:?|[Ss]igned(?: by)?:?|[Dd]ear|Liebe[r]?|Ch(?:er|ère)|Estimad[oa]|[Rr]egards,|[Ss]incerely,|[Aa]ttn:?|written by|told|asked|met with"
_BEHIND = r"said|says|wrote|writes|called|told|asked|replied|sagte|schrieb|antwortete|a dit|a écrit|dijo|escribió|сказала?|написала?|είπε|έγραψε|قال"
_CONTEXT = re.compile(rf"(?<!\w)(?:{_BEFORE})\s(?P<a>{_CAPITAL}) (?P<b>{_CAPITAL})(?!\w)|(?<!\w)(?P<c>{_CAPITAL}) (?P<d>{_CAPITAL})(?= (?:{_BEHIND})(?!\w))")


def _round(key: str, tweak: str, i: int, value: int, size: int) -> int:
    data = f"{tweak}|{i}|{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key.encode()[:64], digest_size=16).digest(), "big") % size


def permute(key: str, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of 0 .. size-1: Feistel rounds on a grid, walking on while outside."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        x, y = divmod(value, b)
        for i in range(0, ROUNDS, 2):
            x = (x + _round(key, tweak, i, y, a)) % a
            y = (y + _round(key, tweak, i + 1, x, b)) % b
        value = x * b + y
        if value < size:
            return value


def unpermute(key: str, tweak: str, value: int, size: int) -> int:
    """The inverse of ``permute``."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        x, y = divmod(value, b)
        for i in range(ROUNDS - 2, -1, -2):
            y = (y - _round(key, tweak, i + 1, x, b)) % b
            x = (x - _round(key, tweak, i, y, a)) % a
        value = x * b + y
        if value < size:
            return value


def successor(key: str, tweak: str, value: int, size: int) -> int:
    """The next of 0 .. size-1 in a keyed cyclic order of all of them."""
    return unpermute(key, tweak, (permute(key, tweak, value, size) + 1) % size, size)


_ALPHABETS = ["0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщъь", "АЕИОУЫЭЮЯЁ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ", "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "áàâäéèêëíìîïóòôöúùûü", "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"]
_OF_CHAR = {c: a for a in _ALPHABETS for c in a}
_DIGITS = "0123456789"
_BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shuffled(key: str, tweak: str, text: str, fixed: int = 0, rule=None) -> str:
    """``text`` with characters exchanged inside their alphabets, the last ``fixed`` and all others kept.

    The format is part of the tweak, so texts of one format are in one cycle.  ``rule``: what the result
    must satisfy; the original must satisfy it too.
    """
    at = [i for i, c in enumerate(text) if c in _OF_CHAR and i < len(text) - fixed]
    if not at:
        return text
    alphabets = [_OF_CHAR[text[i]] for i in at]
    tweak = f"{tweak}|{''.join(a[0] if c in _OF_CHAR else c for c, a in ((c, _OF_CHAR.get(c, c)) for c in text))}"
    size = math.prod(map(len, alphabets))
    value = 0
    for i, a in zip(at, alphabets, strict=True):
        value = value * len(a) + a.index(text[i])
    while True:
        value = successor(key, tweak, value, size)
        out, rest = list(text), value
        for i, a in zip(reversed(at), reversed(alphabets), strict=True):
            rest, k = divmod(rest, len(a))
            out[i] = a[k]
        found = "".join(out)
        if rule is None or rule(found):
            return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _written(digits: str, text: str) -> str:
    """``text`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in _DIGITS else c for c in text)


def _recased(new: str, text: str) -> str:
    """``new`` with capital letters where ``text`` has them."""
    return "".join(n.upper() if c.isupper() else n for n, c in zip(new, text, strict=True))


def _card(key: str, text: str) -> str:
    digits = _only_digits(text)
    valid, first = luhn(digits), digits[0]
    return _written(first + shuffled(key, f"card{first}{valid}", digits[1:], rule=lambda x: luhn(first + x) == valid), text)


def _iban(key: str, text: str) -> str:
    body = text.replace(" ", "")
    check = lambda b: 98 - int("".join(str(_BASE36.index(c)) for c in b[4:] + b[:2] + "00")) % 97
    right = int(body[2:4]) == check(body)
    new = shuffled(key, f"iban{body[:2]}{right}", body[4:])
    new = f"{body[:2]}{check(body[:2] + '00' + new):02d}{new}" if right else body[:4] + new
    chars = iter(new)
    return "".join(c if c == " " else next(chars) for c in text)


def _ip(key: str, text: str) -> str:
    parts = [int(x) for x in text.split(".")]
    head = ".".join(map(str, parts[:1])) if parts[0] in (0, 10, 127) or parts[0] >= 224 else None
    if head:  # private, local and reserved networks stay what they are
        size, value, low = 1 << 24, (parts[1] << 16) + (parts[2] << 8) + parts[3], parts[0] << 24
    else:
        size, value, low = 1 << 32, int.from_bytes(bytes(parts), "big"), 0
    while True:
        value = successor(key, f"ip{head}", value, size)
        got = (low + value).to_bytes(4, "big")
        if head or not (got[0] in (0, 10, 127) or got[0] >= 224):
            return ".".join(map(str, got))


def _phone(key: str, text: str) -> str:
    """The country code and a leading zero stay; the other digits are one number however they are written."""
    m = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text, re.A)
    digits = _only_digits(text)
    head = len(_only_digits(m[0])) if m else 0
    if text[0] == "+" and not m:
        head = next((n for n in (1, 2) if digits[:n] in _CODES), 3)
    head += digits[head:].startswith("0")
    plain = digits[head] in "01"
    return _written(digits[:head] + shuffled(key, f"phone{plain}", digits[head:], rule=lambda x: (x[0] in "01") == plain), text)


def _email(key: str, text: str) -> str:
    local, domain = text.lower().split("@")
    labels = domain.split(".")
    keep = 2 if labels[-2] == "example" else 1
    head, tail = ".".join(labels[:-keep]), ".".join(labels[-keep:])
    moved = shuffled(key, f"email{tail}", f"{local}@{head}" if head else local)
    return _recased(f"{moved}.{tail}" if head else f"{moved}@{tail}", text)


def script(word: str) -> str:
    return unicodedata.name(word[0], "LATIN").split()[0].capitalize()


def _first(key: str, name: str) -> str:
    kind = _OF_NAME.get(name)
    if kind is None:
        return _last(key, name)
    names = sorted(NAMES[kind], key=lambda n: _round(key, f"first{n}", 0, 0, 1 << 64))
    return names[(names.index(name) + 1) % len(names)]  # one cycle: no name stands for itself


def _last(key: str, name: str) -> str:
    """A made-up name of the same script, case and pattern; endings of three letters, which may show gender, stay."""
    low = name.lower()
    if len(low) != len(name):
        return shuffled(key, "last", name)
    return _recased(shuffled(key, "last", low, fixed=3 if len(name) > 5 else 0), name)


@lru_cache(1 << 16)
def surrogate(key: str, kind: str, text: str) -> str:
    make = {"email": _email, "ip": _ip, "iban": _iban, "card": _card, "phone": _phone, "first": _first, "last": _last}
    return shuffled(key, "ssn", text) if kind == "ssn" else make[kind](key, text)


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, none overlapping; parts of a name are apart."""
    found: list[tuple[int, int, str]] = []

    def add(kind: str, pattern: re.Pattern) -> None:
        found.extend((m.start(), m.end(), kind) for m in pattern.finditer(text))

    if "@" in text:
        add("email", _EMAIL)
    if any(d in text for d in _DIGITS):
        for kind, pattern in (("ip", _IP), ("iban", _IBAN), ("card", _CARD), ("ssn", _SSN), ("phone", _PHONE)):
            add(kind, pattern)
    spans: list[tuple[int, int, str]] = []
    known: dict[str, str] = {}
    for m in _NAME.finditer(text):
        if m["title"]:
            first = m["a"] in _OF_NAME
            parts = [("a", "first" if first else "last"), ("b", "last")]
        else:
            parts = [("first", "first"), ("last", "last")]
        for group, kind in parts:
            if m[group]:
                spans.append((*m.span(group), kind))
                known[m[group]] = kind
    for m in _CONTEXT.finditer(text):
        for group, kind in (("a", "first"), ("b", "last"), ("c", "first"), ("d", "last")):
            if m[group] and m[group] not in known:
                spans.append((*m.span(group), kind))
                known[m[group]] = kind
    if known:  # later mentions of a name that was introduced
        again = re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})\b")
        spans += [(m.start(), m.end(), known[m[0]]) for m in again.finditer(text)]
    found += spans
    out: list[tuple[int, int, str]] = []
    for s in sorted(set(found), key=lambda x: (x[0], -x[1], x[2])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def replace(text: str, key: str) -> tuple[str, dict[str, int], int]:
    """The text with surrogates, entities by kind, and collisions: different originals with one surrogate."""
    spans = detect(text)
    if not spans:
        return text, {}, 0
    out, last, n, made = [], 0, {}, {}
    for s, e, kind in spans:
        new = surrogate(key, kind, text[s:e])
        made[kind, text[s:e]] = new
        out += [text[last:s], new]
        last = e
        n[kind] = n.get(kind, 0) + 1
    out.append(text[last:])
    collisions = len(made) - len({(k, v) for (k, _), v in made.items()})
    return "".join(out), n, collisions


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_entities, n_email, n_ip, n_iban, n_card, n_ssn, n_phone, n_name, n_collisions, text) per row.

    text has every entity replaced.  ``key`` is a secret of at least eight characters.  n_collisions counts
    different entities of the row that got one surrogate; it is 0 by construction.  Null and empty texts stay
    what they are and count nothing, texts of any length are read whole, an empty table gives an empty one.
    Repeated rows get equal results; only doc_id and text are read, so other columns cannot clash.
    """
    if not key or len(key) < 8:
        raise ValueError("a secret key of at least eight characters is needed")

    def one(text: str | None) -> tuple:
        new, n, bad = replace(text, key) if text else (text, {}, 0)
        n = {**n, "name": n.get("first", 0) + n.get("last", 0)}
        counts = [n.get(k, 0) for k in KINDS]
        return (sum(counts), *counts, bad, new)

    names = ["n_entities", *(f"n_{k}" for k in KINDS), "n_collisions"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*map(one, batch.column(1).to_pylist()), strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], ["doc_id", *names, "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, text string")
