"""PII surrogates: detected entities get keyed, type-consistent replacements.

An entity is a kind and a normal form: digits of a phone or card, a lower-case address, each word of a person's name. Its
surrogate is a keyed permutation of the normal form among those of the same format (a Feistel network that walks until
it lands in the format), so different entities of one format differ by construction and one entity is the same in every
document. Check digits, country codes, private address ranges and the script, gender and letter case of names stay. The
surrogate is written in the format of each mention. Digits of any script count by their values, so a number is one entity in
whatever digits it is written; its surrogate is written in the digits of the mention.

Persons are found by titles, phrases, labels, greetings, closings and given names, and by the parts of a mail address in
the text. A word of a name that was found counts wherever it stands in the document, so later bare mentions get the same
surrogate. The gender of a given name isn't part of the entity: it is what most documents tell (by its title or the list of
given names), and neutral if they disagree evenly.

Collisions: the distinct entities are gathered once. Of those that share a surrogate all but the smallest, and those whose
surrogate occurs as an entity, are drawn anew with the next tweak; each tweak gives made names a syllable more and, from the
third on, mail addresses a letter more, so that there is room for any number. The other formats have an end: an entity that
is not settled after TWEAKS tweaks, because its format is all but full, takes the value of the next such entity of its
format in a keyed order, so that surrogates still differ from each other and from what they replace; one that is the only such
entity of its format is drawn until it differs from what it replaces. What differs from what
a task draws by itself is looked up: in a broadcast if there are at most `exceptions` such entities, by a join with the
documents that hold them beyond that.

Null texts stay null and have no entities; whole texts are scanned, however long; every row gives one row, repeated rows
and null ids too; other columns are dropped and may have any names. Without the key the replacements can't be undone.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.text import trim
from loomgrid.operators.shared import cut

KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "name")
EXCEPTIONS = 100_000
TWEAKS = 8

# ---- detection

EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-]|\.\d)")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = re.compile(rf"(?<![\w.-]){OCTET}(?:\.{OCTET}){{3}}(?![\w-]|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4})(?![\w-]|\.\d)")
NUMBER, FOREIGN = re.compile(r"\d"), re.compile(r"[^\D0-9]")

#: Titles and greetings that name a person, by gender (f, m, n for neither).
TITLES = {
    "m": ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Sir", "Lord", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Lady", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "Professor", "Judge", "Captain", "Доктор"),
}
GREETINGS = {"m": ("Lieber", "Querido", "Cher", "Дорогой"), "f": ("Liebe", "Querida", "Chère", "Дорогая"), "n": ("Dear", "Hello", "Hi", "Hola", "Hallo", "Bonjour")}
#: Whom a greeting may name that is no person.
NOBODY = frozenset("All Sir Madam Customer Customers Colleague Colleagues Friend Friends Team Everyone There Reader Readers Member Members Kollegen Kunde Kunden Freunde Amigos Amigo Cliente Clientes Client Clients Ami Amis Tous World Welt Mundo Monde".split())
#: Phrases that a person's name follows.
SAYS = ("my name is", "mein Name ist", "je m'appelle", "me llamo", "mi nombre es", "mon nom est", "меня зовут")
#: Labels before a person's name, and closings of letters.
LABELS = ("Name", "Full name", "Contact", "Author", "Patient", "Attn", "Attention", "From", "Signed", "Signed by", "Written by", "Nom", "Nombre", "Autor", "Auteur", "Verfasser", "Имя")
CLOSINGS = ("Regards", "Best regards", "Kind regards", "Sincerely", "Yours sincerely", "Best wishes", "Cordialement", "Atentamente", "Saludos", "Grüße", "Viele Grüße", "Mit freundlichen Grüßen")
#: Common given names by script and gender; a caller can add more.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sarah Emma Sophie Elena Lucia Clara Martha Nina Paula Rosa Eva Irene Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Nancy Lisa Emily Carmen Isabel Ana Marta Marie Camille Chloe Claire Katharina Petra Sabine Ursula Monika".split(),
    ("latin", "m"): "John Peter Paul David Daniel Thomas Lucas Martin Carlos Juan Pierre Hans Felix Oscar Victor Simon James Robert Michael William Richard Joseph Charles Christopher Matthew Anthony Mark Steven Andrew George Kevin Brian Edward Jean Jacques Michel Luis Pedro Miguel Jorge Wolfgang Klaus Stefan".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Вера".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей Борис Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Γιάννης Κώστας Πέτρος".split(),
}
#: Syllables that names are made of: every first sign with every vowel and every closing sign of the script.
SIGNS = {"latin": ("bdfghklmnprstvwz", "aeiou", ("", "n", "r", "l", "s", "m")), "cyrillic": ("бдгклмнпрствз", "аеиоу", ("", "н", "р", "л", "с", "м")), "greek": ("βγδκλμνπρστφ", "αεοι", ("", "ν", "ρ", "λ", "σ", "μ"))}
SYLLABLES = {script: [a + b + c for a in first for b in vowels for c in last] for script, (first, vowels, last) in SIGNS.items()}
ENDINGS = {("latin", "f"): "ina", ("latin", "m"): "an", ("latin", "n"): "el", ("cyrillic", "f"): "ина", ("cyrillic", "m"): "ан", ("cyrillic", "n"): "ель", ("greek", "f"): "ίνα", ("greek", "m"): "ος", ("greek", "n"): "ι"}
SURNAME = {"latin": ("er", "ov", "in", "es", "el", "ard"), "cyrillic": ("енко", "арин", "овск", "елин"), "greek": ("ης", "άκης", "ίδης", "έλης")}

UPPER = r"[A-ZÀ-ÖØ-ÞŁŠŽА-ЯЁΑ-ΩΆΈΉΊΌΎΏ]"
WORD = rf"{UPPER}[^\W\d_]+(?:[-'’]{UPPER}[^\W\d_]+)?"
#: A name of two words; what follows it in a pattern says how often the second word comes.
FULL = rf"{WORD}(?: (?:{UPPER}\. )?{WORD})"
_either = lambda words: "|".join(sorted(words, key=len, reverse=True))
_GENDER = {t: g for told in (TITLES, GREETINGS) for g, ts in told.items() for t in ts}
TITLED = re.compile(rf"(?<!\w)({_either(t for ts in TITLES.values() for t in ts)})\.? ({FULL}{{0,2}})")
GREETED = re.compile(rf"(?<!\w)({_either(t for ts in GREETINGS.values() for t in ts)}) ({FULL}{{0,1}})(?=\s*[,!:\n])")
SAID = re.compile(rf"(?<!\w)(?i:{'|'.join(SAYS)}) ({FULL}{{0,2}})")
LABELLED = re.compile(rf"(?<!\w)(?:{_either(LABELS)}) ?: ?({FULL}{{1,2}})(?!\w)")
CLOSED = re.compile(rf"(?<!\w)(?:{_either(CLOSINGS)})[,.!]?\s+({FULL}{{1,2}})(?!\w)")
_KNOWN = {n: g for (_, g), ns in GIVEN.items() for n in ns}
PAIRED = re.compile(rf"{FULL}+(?!\w)")  # what stands before is looked at afterwards, so that the search can skip to capitals
HINT = re.compile(rf"(?:{_either([*_GENDER, *LABELS, *CLOSINGS])})[\s.,:!]")
_FOLDED_SAYS = tuple(s.casefold() for s in SAYS)
PART, ONE = re.compile(r"[^\W\d_]+"), re.compile(WORD)


def script_of(word: str) -> str:
    for c in word:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
    return "latin"


def _luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2 == 0:
            d = d * 2 - 9 * (d > 4)
        total += d
    return -total % 10


def plain_digits(text: str) -> str:
    """The text with the digits 0 to 9 for those of any script."""
    return text if text.isascii() else FOREIGN.sub(lambda m: str(unicodedata.decimal(m[0])), text)


def digit_like(like: str, digit: str) -> str:
    """A digit in the script of another one."""
    return chr(ord(like) - unicodedata.decimal(like) + int(digit))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _says(text: str) -> bool:
    """Whether a phrase of SAYS is in the text in any case, as SAID takes it (a dotless or dotted i too)."""
    low = text.casefold().replace("ı", "i").replace("i\u0307", "i")
    return any(s in low for s in _FOLDED_SAYS)


class _Person:
    """Words of the names in a document: each word's entity and what is told of its gender."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, str, str]] = []
        self.kind: dict[str, str] = {}  # a word as written and its kind; a surname once is one for bare mentions
        self.told: dict[tuple[str, str], list[str]] = {}

    def add(self, at: int, name: str, gender: str, known: Mapping[str, str], alone: str = "given") -> None:
        words = [(at + m.start(), at + m.end(), m[0]) for m in PART.finditer(name)]
        last = at + name.rfind(" ") + 1
        if gender == "n":
            gender = next((known[w] for _, _, w in words if w in known), "n")
        for s, e, w in words:
            part = alone if " " not in name else "surname" if s >= last else "given"
            if " " not in name and w in self.kind:  # a bare mention of what was found before
                part = self.kind[w].split(":")[1]
            elif " " in name and len(w) == 1:
                continue  # an initial
            kind = f"name:{part}:{script_of(w)}"
            self.spans.append((s, e, kind, w.casefold()))
            if part == "surname" or w not in self.kind:
                self.kind[w] = kind
            if part == "given":
                self.told.setdefault((kind, w.casefold()), []).append(gender)

    def gender(self, kind: str, value: str) -> str:
        if not kind.startswith("name:given"):
            return ""
        told = self.told.get((kind, value), [])
        m, f = told.count("m"), told.count("f")
        return "m" if m > f else "f" if f > m else "n"


def _persons(text: str, mails: list[str], known: Mapping[str, str]) -> _Person:
    found = _Person()
    full: list[tuple[int, str, str, str]] = []  # place, name, gender, and what it is if it is one word
    if HINT.search(text):
        full += [(m.start(2), m[2], _GENDER[m[1]], "surname") for m in TITLED.finditer(text)]
        full += [(m.start(2), m[2], _GENDER[m[1]], "given") for m in GREETED.finditer(text) if m[2].split(" ")[0] not in NOBODY]
        full += [(m.start(1), m[1], "n", "given") for pattern in (LABELLED, CLOSED) for m in pattern.finditer(text)]
    if _says(text):
        full += [(m.start(1), m[1], "n", "given") for m in SAID.finditer(text)]
    parts = {tuple(p.casefold() for p in re.split(r"[._-]+", re.sub(r"\d+", "", mail.partition("@")[0])) if len(p) > 1) for mail in mails}
    parts = {p for p in parts if len(p) == 2}
    for m in PAIRED.finditer(text):
        at, run = m.start(), m[0]
        if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            continue
        words = [(w.start(), w[0]) for w in ONE.finditer(run)]
        for (s, w), (t, v) in zip(words, words[1:], strict=False):
            if w in known or (w.casefold(), v.casefold()) in parts or (v.casefold(), w.casefold()) in parts:
                full.append((at + s, run[s : t + len(v)], "n", "given"))
                break
    taken = -1
    for at, name, gender, alone in sorted(full, key=lambda x: (" " not in x[1], x[0], -len(x[1]), x[2] == "n")):
        if " " in name and at < taken:  # told twice, as by a title and by the list
            continue
        found.add(at, name, gender, known, alone)
        taken = at + len(name) if " " in name else -1
    if found.kind:
        spelt = dict(found.kind)
        spelt |= {w.upper(): k for w, k in found.kind.items() if len(w) > 2}
        seen = {s for s, *_ in found.spans}
        for m in PART.finditer(text):  # bare mentions
            if m.start() not in seen and len(m[0]) > 1 and (kind := spelt.get(m[0])):
                found.spans.append((m.start(), m.end(), kind, m[0].casefold()))
    return found


def entities(text: str, known: Mapping[str, str] = _KNOWN) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, normal form, gender), not overlapping, by start; at one start the longer comes first. known: given
    names and their gender."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if NUMBER.search(text):
        plain = plain_digits(text)  # sign for sign as long as the text
        found += [(m.start(), m.end(), "iban", v) for m in IBAN.finditer(plain) if 15 <= len(v := m[0].replace(" ", "")) <= 34 and _mod97(v) == 1]
        found += [(m.start(), m.end(), "card", re.sub(r"\D", "", m[0])) for m in CARD.finditer(plain)]
        found += [(m.start(), m.end(), "ip", m[0]) for m in IP.finditer(plain)]
        found += [(m.start(), m.end(), "ssn", m[0].replace("-", "")) for m in SSN.finditer(plain)]
        for m in PHONE.finditer(plain):
            digits = re.sub(r"\D", "", m[0])
            if 7 <= len(digits) <= 15:
                found.append((m.start(), m.end(), "phone", ("+" if m[0][0] == "+" else "") + digits))
    persons = _persons(text, [v for _, _, k, v in found if k == "email"], known)
    found += persons.spans
    found.sort(key=lambda x: (x[0], -x[1]))
    kept, end = [], -1
    for x in found:
        if x[0] >= end:
            kept.append((*x, persons.gender(*x[2:])))
            end = x[1]
    return kept


# ---- replacement


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return 0
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for n in range(8):
            h = hashlib.blake2b(f"{n}:{half}:{tweak}:{right}".encode(), key=key, digest_size=16).digest()
            left, right = right, left ^ (int.from_bytes(h, "little") & mask)
        value = left << half | right
        if value < size:
            return value


#: Alphabets that a letter or digit is drawn from: ranges of letters of one script and case.
ALPHABETS = [(ord("0"), 10), (ord("a"), 26), (ord("A"), 26), (0xDF, 24), (0xF8, 8), (0x430, 32), (0x410, 32), (0x3B1, 17), (0x391, 17), (0x5D0, 27), (0x641, 10), (0x905, 53), (0x3041, 86), (0x30A1, 90), (0xAC00, 11_172), (0x4E00, 20_992)]


def _shuffle(text: str, key: bytes, tweak: str) -> str:
    """The text with every letter and digit drawn anew from its own alphabet; other signs stay."""
    places = []
    number, size = 0, 1
    for k, c in enumerate(text):
        for low, n in ALPHABETS:
            if low <= ord(c) < low + n:
                break
        else:
            if not c.isdecimal():
                continue
            low, n = ord(c) - unicodedata.decimal(c), 10
        places.append((k, low, n))
        number, size = number * n + ord(c) - low, size * n
    drawn = permute(number, size, key, f"{tweak}:{re.sub('[a-z]', 'a', NUMBER.sub('0', text))}")
    out = list(text)
    for k, low, n in reversed(places):
        drawn, c = divmod(drawn, n)
        out[k] = chr(low + c)
    return "".join(out)


def _private(n: int) -> str:
    a, b = n >> 24, n >> 16 & 255
    return "10" if a == 10 else "127" if a == 127 else "192.168" if (a, b) == (192, 168) else "172.16" if a == 172 and 16 <= b < 32 else "" if 0 < a < 224 else "none"


def _number(value: str, key: bytes, tweak: str, keep: int) -> str:
    return value[:keep] + _shuffle(value[keep:], key, f"{tweak}:{value[:keep]}")


@lru_cache(maxsize=200_000)
def surrogate(kind: str, value: str, key: bytes, attempt: int = 0, gender: str = "") -> str:
    """The surrogate of a normal form, as a normal form."""
    tweak = f"{kind}:{attempt}"
    if kind == "email":
        name, _, domain = value.rpartition("@")
        rest, _, top = domain.rpartition(".")
        more = _letters(max(0, attempt - 2), key, f"{tweak}:{value}")
        return more + _shuffle(f"{name}@{rest}", key, f"{tweak}:{top}") + f".{top}"
    if kind == "phone":
        keep = 0 if value[0] != "+" else 2 if value[1] in "17" else 3
        return _number(value, key, tweak, keep)
    if kind == "ssn":
        return _number(value, key, tweak, 0)
    if kind == "card":
        body, wrong = value[:-1], (int(value[-1]) - _luhn(value[:-1])) % 10
        body = _number(body, key, f"{tweak}:{wrong}", 1)
        return body + str((_luhn(body) + wrong) % 10)
    if kind == "iban":
        body = _shuffle(value[4:], key, f"{tweak}:{value[:2]}")
        return f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02d}{body}"
    if kind == "ip":
        n = 0
        for part in value.split("."):
            n = n << 8 | int(part)
        kept, m = _private(n), n
        low = {"": 32, "192.168": 16, "172.16": 16}.get(kept, 24)  # the bits that are drawn anew
        while True:
            m = n >> low << low | permute(m & ((1 << low) - 1), 1 << low, key, f"{tweak}:{n >> low}")
            if _private(m) == kept:
                return ".".join(str(m >> s & 255) for s in (24, 16, 8, 0))
    _, part, script = kind.split(":")
    draw = int.from_bytes(hashlib.blake2b(f"{tweak}:{value}".encode(), key=key, digest_size=32).digest(), "little")
    made = ""
    for _ in range((3 if len(value) > 5 else 2) + attempt):  # each further attempt has room for hundreds of times the names
        draw, k = divmod(draw, len(SYLLABLES[script]))
        made += SYLLABLES[script][k]
    tail = SURNAME[script]
    return made + (tail[draw % len(tail)] if part == "surname" else ENDINGS[script, gender or "n"])


def _letters(n: int, key: bytes, tweak: str) -> str:
    draw = int.from_bytes(hashlib.blake2b(tweak.encode(), key=key, digest_size=16).digest(), "little")
    return "".join(chr(ord("a") + draw // 26**k % 26) for k in range(n))


def format_of(kind: str, value: str) -> str:
    """Which values of a kind can stand for each other."""
    if kind == "ip":
        n = 0
        for part in value.split("."):
            n = n << 8 | int(part)
        return f"ip {_private(n)}"
    if kind == "card":
        return f"card {len(value)} {(int(value[-1]) - _luhn(value[:-1])) % 10}"
    return f"{kind} {re.sub('[A-Z]', 'A', re.sub('[0-9]', '0', value))}" if kind != "iban" else f"iban {value[:2]} {re.sub('[A-Z]', 'A', re.sub('[0-9]', '0', value[4:]))}"


def written(kind: str, mention: str, new: str) -> str:
    """A normal form in the format of a mention."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(new.lstrip("+"))
        return "".join(digit_like(c, next(digits)) if c.isdecimal() else c for c in mention)
    if kind == "ip" and not mention.isascii():
        like = next(c for c in mention if c.isdecimal())
        return "".join(digit_like(like, c) if c.isdecimal() else c for c in new)
    if kind == "iban":
        signs = iter(new)
        return "".join(c if c == " " else next(signs) for c in mention)
    if kind == "email":
        if mention.isupper():
            return new.upper()
        return "".join(n.upper() if m.isupper() else n for m, n in zip(mention, new, strict=True)) if len(mention) == len(new) else new
    if kind.startswith("name"):
        return new.upper() if len(mention) > 1 and mention.isupper() else new.capitalize() if mention[:1].isupper() else new
    return new


def _found(batches: Iterator[pa.RecordBatch], known: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
    """(doc_id, kind, value, gender), each once a document."""
    for batch in batches:
        rows = [(i, *x) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in {x[2:] for x in entities(text.as_py() or "", known)}]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 3), strict=True)], names=["doc_id", "kind", "value", "gender"])
    trim()


DRAWN = "kind string, value string, gender string, attempt int"
ENTITY = ("kind", "value", "gender", "attempt", "new")


def _drawn(batches: Iterator[pa.RecordBatch], key: bytes, make: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new = [make(k, v, key, n, g) for k, v, g, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(new, pa.string())], names=["kind", "value", "gender", "attempt", "new"])


def _other(batches: Iterator[pa.RecordBatch], key: bytes, make: Callable) -> Iterator[pa.RecordBatch]:
    """The first further draw that isn't the value itself; a `make` that knows no other value has its entities masked."""
    for batch in batches:
        new = []
        for k, v, g, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            drawn = (make(k, v, key, n + more, g) for more in range(64))
            new.append(next((d for d in drawn if d != v), hashlib.blake2b(f"{k}:{v}".encode(), key=key, digest_size=8).hexdigest()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(new, pa.string())], names=["kind", "value", "gender", "attempt", "new"])


def _formats(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    """Each entity's format and its place in a keyed order."""
    for batch in batches:
        each = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        place = [hashlib.blake2b(f"{k}:{v}".encode(), key=key, digest_size=16).digest() for k, v in each]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([format_of(k, v) for k, v in each], pa.string()), pa.array(place, pa.binary())], names=["kind", "value", "gender", "attempt", "format", "place"])


ENTITIES = "array<struct<kind:string,start:int,end:int,new_start:int,new_end:int>>"


def _rewrite(batches: Iterator[pa.RecordBatch], key: bytes, make: Callable, told, known: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
    """Columns: id, text and, where exceptions come by a join, a list of (kind, value, new)."""
    fixed = told.value if told is not None else {}
    kind_of = pa.list_(pa.struct([("kind", pa.string()), *((n, pa.int32()) for n in ("start", "end", "new_start", "new_end"))]))
    for batch in batches:
        texts, spans = [], []
        joined = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for text, own in zip(batch.column(1), joined, strict=True):
            text = text.as_py()
            mine = fixed if not own else fixed | {(x["kind"], x["value"]): x["new"] for x in own}
            out, at, size, where = [], 0, 0, []
            for s, e, kind, value, gender in entities(text or "", known):
                new = written(kind, text[s:e], mine.get((kind, value)) or make(kind, value, key, 0, gender))
                size += s - at
                out += [text[at:s], new]
                where.append({"kind": kind.split(":")[0], "start": s, "end": e, "new_start": size, "new_end": size + len(new)})
                at, size = e, size + len(new)
            texts.append(text if text is None or not where else "".join([*out, text[at:]]))
            spans.append(where)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind_of)], names=["doc_id", "text", "entities"])
    trim()


def settled(found: DataFrame, key: bytes, make: Callable = surrogate) -> DataFrame:
    """kind, value, gender, attempt, new of every distinct entity, after the collision checks. found: (kind, value, gender), a
    row for each document that tells the gender."""
    says = lambda g: F.count_if(F.col("gender") == g)
    gender = F.when(says("m") > says("f"), "m").when(says("f") > says("m"), "f").when(F.max("gender") != "", "n").otherwise("")
    now = cut(found.groupBy("kind", "value").agg(gender.alias("gender")).withColumn("attempt", F.lit(0)))
    base = F.split_part("kind", F.lit(":"), F.lit(1))  # a name's words share the kind's first part; a surrogate must be new under it
    real = now.select(base.alias("base"), F.col("value").alias("new")).distinct()
    done = None
    for _ in range(TWEAKS):
        drawn = cut(now.mapInArrow(partial(_drawn, key=key, make=make), DRAWN + ", new string").withColumn("base", base))
        taken = real if done is None else real.unionAll(done.select("base", "new"))
        free = drawn.join(taken, ["base", "new"], "left_anti")
        first = F.row_number().over(Window.partitionBy("base", "new").orderBy("value", "kind"))
        good = cut(free.withColumn("nth", first).where("nth = 1").drop("nth"))
        done = good if done is None else done.unionAll(good)
        now = cut(drawn.join(good.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt")))
        if now.isEmpty():
            return done.select(*ENTITY)
    # Their formats are all but full: each takes the value of the next of its format in a keyed order, the last that of the first.
    placed = now.mapInArrow(partial(_formats, key=key), DRAWN + ", format string, place binary")
    ring = Window.partitionBy("format").orderBy("place")
    turned = placed.withColumn("new", F.coalesce(F.lead("value").over(ring), F.first("value").over(ring)))
    lone = turned.where("new = value").select("kind", "value", "gender", "attempt").mapInArrow(partial(_other, key=key, make=make), DRAWN + ", new string")
    return done.select(*ENTITY).unionAll(turned.where("new <> value").select(*ENTITY)).unionAll(lone.select(*ENTITY))


def replace(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", exceptions: int = EXCEPTIONS, make: Callable = surrogate, given: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, text, entities): texts with surrogates, and where the entities were and are now. given: further given names and
    their gender (f, m or n)."""
    spark = docs.sparkSession
    known = _KNOWN | dict(given or {})
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = cut(rows.mapInArrow(partial(_found, known=known), "doc_id long, kind string, value string, gender string"))
    several = found.groupBy("kind", "value").agg(F.min("gender").alias("least"), F.max("gender").alias("most")).where("least <> most").select("kind", "value")
    all_of = cut(settled(found, key, make))
    # what a task can't draw from its document alone
    retried = cut(all_of.where("attempt > 0").select("kind", "value", "new").unionAll(all_of.where("attempt = 0").join(several, ["kind", "value"], "left_semi").select("kind", "value", "new")))
    n = retried.count()
    told = None
    if n > exceptions:
        mine = found.join(retried, ["kind", "value"]).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "value", "new")).alias("fixed"))
        rows = rows.join(mine, rows["doc_id"].eqNullSafe(mine["doc_id"]), "left").select(rows["doc_id"], "text", "fixed")
    elif n:
        told = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["new"] for r in retried.collect()})
    return rows.mapInArrow(partial(_rewrite, key=key, make=make, told=told, known=known), f"doc_id long, text string, entities {ENTITIES}")
